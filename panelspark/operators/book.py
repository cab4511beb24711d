"""Books: returns, turnover and costs of positions over time.

No book needs a loop over bars. What is held before a bar is what was executed
at the bar before, so every row yields at most two trades: its own change
against the previous bar, and, where the name is gone at the next bar, the
exit there. A lag and a lead per name find both in one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S, stats as T
from ..functions.ranks import add_group_stats, add_positions, add_value_ranks, choose_plan
from ..schema import BAR_LEDGER_COLUMNS
from ..settings import CostSettings
from .ic import CROSS_SECTION
from .positions import (
    band_state, build_position_variants, buffer_bands, cost_bands, lay_out_variants, number_bars, pair_band_state,
    side_weights,
)
from .quality import complete_cross_sections
from .signal import BPS, cost_tier


def trade_events(rows: DataFrame, unit: Sequence[str], bar: str, weight: str, carried: str, meta: Sequence[str]) -> DataFrame:
    """Trades of each bar: (unit, bar, prev, executed, held_row, meta...).

    ``weight`` is what a row executes, ``carried`` what is left of it at the
    next bar. An exit is charged with the figures of the bar it leaves. Exits
    after a book's last bar are emitted too; they have no held row there.
    """
    w = Window.partitionBy(*unit).orderBy(bar)
    linked = rows.withColumns({
        "_prev": F.when(F.lag(bar).over(w) == F.col(bar) - 1, F.lag(carried).over(w)).otherwise(F.lit(0.0)),
        "_gone": F.coalesce(F.lead(bar).over(w) != F.col(bar) + 1, F.lit(True)),
    })
    own = F.struct(F.col(bar).alias(bar), F.col("_prev").alias("prev"), F.col(weight).alias("executed"), F.lit(True).alias("held_row"))
    leave = F.struct((F.col(bar) + 1).alias(bar), F.col(carried).alias("prev"), F.lit(0.0).alias("executed"), F.lit(False).alias("held_row"))
    out = F.array_compact(F.array(own, F.when(F.col("_gone") & (F.col(carried) != 0), leave)))
    extra = [c for c in meta if c not in unit and c != bar]
    return linked.select(*unit, *extra, F.inline(out))


def _impact(eta: float, delta: Column) -> Column:
    return F.lit(eta) * F.col("sigma_intraday") * delta * F.sqrt(S.ratio(delta, F.col("adv_amount")))


def _when_held(c: Column) -> Column:
    return F.when(F.col("held_row"), c)


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def slot_book(positions: DataFrame, costs: CostSettings = CostSettings(), by: Sequence[str] = (), plan: str | None = None) -> DataFrame:
    """Bar ledger of slot books whose holdings drift with returns between bars.

    An order that cannot fill leaves the name flat. Turnover and costs are
    measured against the drifted weights of the bar before.
    """
    ret = F.coalesce(S.clean("simple_return"), F.lit(0.0))
    filled = F.col("fillable") & S.is_finite("simple_return")
    rows = positions.withColumns({"_r": ret, "_filled": filled}).withColumn(
        "_w", F.when(F.col("_filled"), F.col("target_weight")).otherwise(0.0))
    # Keyed by (date, time): the partitioning position building left behind.
    rows = add_group_stats(rows, [*by, *CROSS_SECTION], {"_gross": F.sum(F.col("_w") * F.col("_r"))}, plan)
    rows = rows.withColumn("_after", F.col("_w") * (1 + F.col("_r")) / (1 + F.col("_gross")))
    events = trade_events(
        rows, [*by, "minute_slot", "code"], "slot_bar_id", "_w", "_after",
        ["date", "time", "target_weight", "_r", "_filled", "spread_bps", "sigma_intraday", "adv_amount"])
    done, delta = F.col("executed"), F.abs(F.col("executed") - F.col("prev"))
    goal = F.when(F.col("held_row"), F.col("target_weight")).otherwise(0.0)
    ledger = events.groupBy(*by, "minute_slot", "slot_bar_id").agg(
        F.max(_when_held(F.col("date"))).alias("date"), F.max(_when_held(F.col("time"))).alias("time"),
        _total(_when_held(done * F.col("_r"))).alias("gross_return"),
        (0.5 * _total(F.abs(goal - F.col("prev")))).alias("planned_turnover"),
        (0.5 * _total(delta)).alias("turnover"),
        _total(0.5 * F.col("spread_bps") / BPS * delta).alias("spread_cost"),
        _total(F.when(delta > 0, _impact(costs.impact_eta, delta))).alias("impact_coeff"),
        F.count(_when_held(F.lit(1))).alias("planned_name_count"),
        F.count(F.when(F.col("held_row") & F.col("_filled"), 1)).alias("filled_name_count"),
        _total(F.when(done > 0, done)).alias("long_exposure"),
        _total(F.when(done < 0, -done)).alias("short_exposure"),
    ).where(F.col("planned_name_count") > 0)
    gross = F.col("long_exposure") + F.col("short_exposure")
    return ledger.withColumns({
        "fill_ratio": S.ratio("filled_name_count", "planned_name_count"),
        "executed_gross_exposure": gross, "cash_buffer": F.greatest(F.lit(0.0), 1 - gross),
    }).select(*by, *BAR_LEDGER_COLUMNS)


def slot_book_fast(positions: DataFrame, costs: CostSettings = CostSettings(), by: Sequence[str] = ()) -> DataFrame:
    """Ledger without drift: exits are charged on the last held bar."""
    w = Window.partitionBy(*by, "minute_slot", "code").orderBy("slot_bar_id")
    bar = F.col("slot_bar_id")
    rows = positions.withColumn("_w", F.when(F.col("fillable"), F.col("target_weight")).otherwise(0.0)).withColumns({
        "_prev": F.when(F.lag("slot_bar_id").over(w) == bar - 1, F.lag("_w").over(w)).otherwise(0.0),
        "_gone": F.coalesce(F.lead("slot_bar_id").over(w) > bar + 1, F.lit(True)),
    })
    weight = F.col("_w")
    delta = F.abs(weight - F.col("_prev")) + F.when(F.col("_gone"), F.abs(weight)).otherwise(0.0)
    return rows.groupBy(*by, "minute_slot", "slot_bar_id", "date", "time").agg(
        F.sum(weight * F.col("simple_return")).alias("gross_return"),
        (0.5 * F.sum(delta)).alias("turnover"),
        F.sum(0.5 * F.col("spread_bps") / BPS * delta).alias("spread_cost"),
        F.sum(_impact(costs.impact_eta, delta)).alias("impact_coeff"),
        T.share(weight != 0).alias("fill_ratio"),
        F.sum(F.when(weight > 0, weight).otherwise(0.0)).alias("long_exposure"),
        F.sum(F.when(weight < 0, -weight).otherwise(0.0)).alias("short_exposure"))


def band_book(held: DataFrame, costs: CostSettings = CostSettings(), by: Sequence[str] = ("variant",), plan: str | None = None) -> DataFrame:
    """Ledger of a two-sided band book (rows from ``pair_band_state``): weights
    per side, no drift, exits charged with the previous bar's figures."""
    rows = side_weights(held, [*by, *CROSS_SECTION], plan=plan)
    fillable = F.when(F.col("side") > 0, F.col("long_fillable")).otherwise(F.col("short_fillable"))
    rows = rows.withColumns({
        "_r": F.coalesce(S.clean("simple_return"), F.lit(0.0)),
        "_w": F.when(fillable, F.col("target_weight")).otherwise(0.0)})
    events = trade_events(
        rows, [*by, "minute_slot", "code"], "slot_bar_id", "_w", "_w",
        ["date", "time", "_r", "spread_bps", "sigma_intraday", "adv_amount"])
    done, delta = F.col("executed"), F.abs(F.col("executed") - F.col("prev"))
    ledger = events.groupBy(*by, "minute_slot", "slot_bar_id").agg(
        F.max(_when_held(F.col("date"))).alias("date"), F.max(_when_held(F.col("time"))).alias("time"),
        _total(done * F.col("_r")).alias("gross_return"), (0.5 * _total(delta)).alias("turnover"),
        _total(0.5 * F.col("spread_bps") / BPS * delta).alias("spread_cost"),
        _total(F.when(delta > 0, _impact(costs.impact_eta, delta))).alias("impact_coeff"),
        F.count(F.when(done != 0, 1)).alias("_filled"),
        _total(F.when(done > 0, done)).alias("long_exposure"),
        _total(F.when(done < 0, -done)).alias("short_exposure"),
        F.count(_when_held(F.lit(1))).alias("desired_name_count"),
    ).where(F.col("desired_name_count") > 0)
    return ledger.withColumn("fill_ratio", S.ratio("_filled", "desired_name_count")).drop("_filled")


def buffer_book(features: DataFrame, variants: Sequence[dict], price: str = "vwap", costs: CostSettings = CostSettings(), plan: str | None = None) -> DataFrame:
    """Enter on a tight band, hold on a wider one, both sides; per variant."""
    bands = buffer_bands(features, variants, price, costs, plan)
    return band_book(pair_band_state(bands, ["variant", "minute_slot", "code"], "slot_bar_id"), costs, plan=plan)


def cost_aware_book(features: DataFrame, variants: Sequence[dict], max_liq_bucket: int = 1, entry_frac: float = 0.1, hold_frac: float = 0.2, price: str = "vwap", costs: CostSettings = CostSettings(), plan: str | None = None) -> DataFrame:
    """Bands on a cost-penalised score, equal or cost-aware weights; per variant."""
    bands = cost_bands(features, variants, max_liq_bucket, entry_frac, hold_frac, price, costs, plan)
    return band_book(pair_band_state(bands, ["variant", "minute_slot", "code"], "slot_bar_id"), costs, plan=plan)


def hysteresis_book(features: DataFrame, variants: Sequence[dict], min_names: int = 1000, grid: int = 10, ret: str = "ret_vwap_exec_10", costs: CostSettings = CostSettings(), plan: str | None = None) -> DataFrame:
    """Long-only percentile hysteresis, reset each day; per variant.

    ``variants`` give open_quantile and close_quantile of the cumulative share
    of the score. Only cross-sections of at least ``min_names`` count.
    """
    rows = (features.where(F.col("prediction").isNotNull() & F.col(ret).isNotNull() & F.col("signal_amount").isNotNull()
                           & (F.col("minute_slot") % grid == 0))
            .select("date", "time", "code", "minute_slot", "prediction", F.col(ret).alias("simple_return"), "signal_amount"))
    plan = choose_plan(CROSS_SECTION, plan)
    rows = complete_cross_sections(rows, min_names, plan=plan)
    rows = add_value_ranks(rows, CROSS_SECTION, "prediction", {"cume": "signal_pct"}, plan)
    rows = add_positions(rows, CROSS_SECTION, [("signal_amount", False), "code"], tiles={"liq_bucket": 3}, plan=plan)
    rows = number_bars(rows, ["date"], "bar", ["date", "time"]).withColumn("spread_bps", cost_tier("liq_bucket", costs))
    rows = lay_out_variants(rows, variants)
    held = band_state(rows, ["variant", "date", "code"], "bar",
                      F.col("signal_pct") >= F.col("open_quantile"), F.col("signal_pct") >= F.col("close_quantile"))
    held = add_group_stats(held, ["variant", *CROSS_SECTION], {"_n": F.count(F.lit(1))}, plan)
    held = held.withColumn("_w", 1.0 / F.col("_n"))
    events = trade_events(held, ["variant", "date", "code"], "bar", "_w", "_w", ["time", "simple_return", "spread_bps"])
    done, delta = F.col("executed"), F.abs(F.col("executed") - F.col("prev"))
    active = events.groupBy("variant", "date", "bar").agg(
        _total(done * F.col("simple_return")).alias("gross_return"), (0.5 * _total(delta)).alias("turnover"),
        _total(0.5 * F.col("spread_bps") / BPS * delta).alias("spread_cost"),
        _total(F.lit(costs.fee_bps) / BPS * delta).alias("fee_cost"),
        _total(F.abs(done)).alias("gross_exposure"), F.count(_when_held(F.lit(1))).alias("active_name_count"),
        F.max(_when_held(F.col("time"))).alias("time"))
    return active.where(F.col("active_name_count") > 0).drop("bar")


def hysteresis_daily(ledger: DataFrame, by: Sequence[str] = ("variant",)) -> DataFrame:
    return ledger.groupBy(*by, "date").agg(
        T.compound("gross_return").alias("gross_return"), F.sum("turnover").alias("turnover"),
        F.sum("spread_cost").alias("spread_cost"), F.sum("fee_cost").alias("fee_cost"),
        F.avg("gross_exposure").alias("gross_exposure"), F.avg("active_name_count").alias("active_name_count"),
    ).withColumn("net_return", F.col("gross_return") - F.col("spread_cost") - F.col("fee_cost"))


def run_variants(features: DataFrame, variants: Sequence[dict], price: str = "vwap", costs: CostSettings = CostSettings(), fast: bool = True, plan: str | None = None) -> DataFrame:
    """Ledger of every trade-plan variant in one job, keyed by ``variant``."""
    positions = build_position_variants(features, variants, price, costs, plan)
    return slot_book_fast(positions, costs, ["variant"]) if fast else slot_book(positions, costs, ["variant"], plan)
