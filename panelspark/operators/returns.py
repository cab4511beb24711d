"""From bar ledgers to daily series, summaries and rankings.

Daily series are bounded by the calendar: a window per series sees one row per
date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S, stats as T
from ..session import stored
from .signal import BPS

SUMMED = ("planned_turnover", "turnover", "spread_cost", "impact_coeff", "fee_cost")
AVERAGED = ("fill_ratio", "executed_gross_exposure", "cash_buffer", "long_exposure", "short_exposure", "desired_name_count")


def slot_daily(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(slot, date): compounded return, summed turnover and costs, mean fills."""
    have = ledger.columns
    return ledger.groupBy(*by, "minute_slot", "date").agg(
        T.compound("gross_return").alias("gross_return"),
        *[F.sum(c).alias(c) for c in SUMMED if c in have],
        *[F.avg(c).alias(c) for c in AVERAGED if c in have])


def combine_slots(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Equal-capital mean over the slots of each date."""
    values = [c for c in daily.columns if c not in (*by, "minute_slot", "date")]
    return daily.groupBy(*by, "date").agg(*[F.avg(c).alias(c) for c in values])


def slot_summary(daily: DataFrame, annual_days: int = 252, by: Sequence[str] = ()) -> DataFrame:
    mean, std = F.avg("gross_return"), F.stddev_samp("gross_return")
    return daily.groupBy(*by, "minute_slot").agg(
        mean.alias("mean_daily_return"), std.alias("std_daily_return"),
        (S.ratio(mean, std) * F.sqrt(F.lit(float(annual_days)))).alias("annualized_sharpe"),
        F.count("gross_return").alias("day_count"))


def net_name(aum: float) -> str:
    return f"net_return_aum_{int(aum / 1_000_000)}m"


def net_returns(daily: DataFrame, aums: Sequence[float]) -> DataFrame:
    """One net return column per capital: impact grows with its square root."""
    return daily.withColumns({
        net_name(a): F.col("gross_return") - F.col("spread_cost") - F.col("impact_coeff") * F.sqrt(F.lit(float(a)))
        for a in aums})


def capacity(daily: DataFrame, budgets_bps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Capital at which the mean daily impact uses up each budget."""
    return daily.groupBy(*by).agg(*_capacities(F.avg("impact_coeff"), budgets_bps))


def _capacities(coeff: Column, budgets_bps: Sequence[float]) -> list[Column]:
    return [
        F.when(coeff > 0, F.pow(S.ratio(F.lit(b / BPS), coeff), F.lit(2.0))).alias(f"capacity_at_{int(b)}bps")
        for b in budgets_bps]


def equity_curve(daily: DataFrame, value: str = "gross_return", by: Sequence[str] = ()) -> DataFrame:
    """(date, wealth, drawdown); the peak starts at the first wealth value."""
    return _with_path(daily, value, by).select(*by, "date", "wealth", "drawdown")


def _with_path(daily: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    keys = [F.col(c) for c in by] or [F.lit(0)]
    path = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (daily.withColumn("wealth", F.product(1 + F.col(value)).over(path))
            .withColumn("drawdown", F.col("wealth") / F.max("wealth").over(path) - 1))


def return_summary(daily: DataFrame, value: str = "gross_return", annual_days: int = 252, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, annualised figures, t-statistic, path figures, hit rate."""
    rows = _with_path(daily.select(*by, "date", F.col(value).alias("_v")), "_v", by)
    mean, std = F.avg("_v"), F.stddev_samp("_v")
    wealth, days = F.max_by("wealth", "date"), F.count("_v")
    year = F.lit(float(annual_days))
    return rows.groupBy(*by).agg(
        mean.alias("mean_daily_return"), std.alias("std_daily_return"),
        F.when(wealth > 0, F.pow(wealth, year / days) - 1).alias("annualized_return"),
        (S.ratio(mean, std) * F.sqrt(year)).alias("annualized_sharpe"),
        T.t_stat("_v").alias("t_stat"), (wealth - 1).alias("cum_return"),
        F.min("drawdown").alias("max_drawdown"), T.positive_ratio("_v").alias("positive_day_ratio"),
        days.alias("day_count"))


def stack_series(daily: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide return columns as (series, value) rows, so one job summarises all."""
    cells = F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).alias("value")) for v in values])
    return daily.select(*by, "date", F.inline(cells))


def strategy_summary(
    daily: DataFrame, aums: Sequence[float] = (), budgets_bps: Sequence[float] = (10.0, 20.0),
    annual_days: int = 252, by: Sequence[str] = (),
) -> DataFrame:
    """Return figures of the gross and each net series, with turnover,
    execution and capacity figures alongside; one row per series.

    The daily table is a row per date and book but costs a whole backtest, so
    it is stored before it is read twice.
    """
    daily = stored(daily)
    series = ["gross_return", *[net_name(a) for a in aums]]
    stacked = stack_series(net_returns(daily, aums), series, by)
    figures = return_summary(stacked, "value", annual_days, [*by, "series"])
    have = daily.columns
    coeff = F.avg("impact_coeff")
    trading = daily.groupBy(*by).agg(
        *_capacities(coeff, budgets_bps),
        *[F.avg(c).alias(f"mean_{c}") for c in ("planned_turnover", "turnover", *AVERAGED) if c in have],
        F.percentile("turnover", F.lit(0.5)).alias("p50_turnover"),
        F.percentile("turnover", F.lit(0.95)).alias("p95_turnover"))
    if by:
        return figures.join(trading, list(by))
    return figures.withColumn("_one", F.lit(0)).join(trading.withColumn("_one", F.lit(0)), "_one").drop("_one")


def rank_variants(summary: DataFrame, net_series: str, by: str = "variant") -> DataFrame:
    """One flat row per variant, best net daily return first, then capacity."""
    gross = summary.where(F.col("series") == "gross_return").select(
        by, F.col("mean_daily_return").alias("gross_daily_return"), F.col("annualized_sharpe").alias("gross_sharpe"))
    rest = [c for c in summary.columns if c.startswith(("capacity_at_", "mean_", "p50_", "p95_")) and c != "mean_daily_return"]
    net = summary.where(F.col("series") == net_series).select(
        by, F.col("mean_daily_return").alias("net_daily_return"), F.col("annualized_sharpe").alias("net_sharpe"),
        F.col("max_drawdown").alias("net_max_drawdown"), "positive_day_ratio", *rest)
    joined = gross.join(net, by)
    caps = [F.col(c).desc() for c in rest if c.startswith("capacity_at_")]
    return joined.orderBy(F.col("net_daily_return").desc(), *caps, by)
