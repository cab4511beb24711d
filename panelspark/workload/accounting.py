"""Daily series, summaries, capacity and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book as B, market as M, returns as R, signal as G
from ..plans import variants as SHIPPED
from ..plans.backtest import compare_variants, trade_plan_matrix
from ..session import stored
from . import adapters as A
from .adapters import tidy
from .bookkeeping import BOOK, FAST, HYST, HYST_DAILY, hysteresis, positions
from .catalog import query
from .construction import PLAN_FIELDS, POS, VARIANTS, positions_sql, variants_sql
from .sql import CTES, oracle

SLOT_DAILY = """SELECT minute_slot, date, product(1+gross_return)-1 AS gross_return, sum(planned_turnover) AS planned_turnover, sum(turnover) AS turnover, sum(spread_cost) AS spread_cost,
 sum(impact_coeff) AS impact_coeff, avg(fill_ratio) AS fill_ratio, avg(executed_gross_exposure) AS executed_gross_exposure, avg(cash_buffer) AS cash_buffer,
 avg(long_exposure) AS long_exposure, avg(short_exposure) AS short_exposure FROM ledger GROUP BY 1, 2"""
COLS = "gross_return planned_turnover turnover spread_cost impact_coeff fill_ratio executed_gross_exposure cash_buffer long_exposure short_exposure"
COMBINED = "SELECT date, " + ", ".join(f"avg({c}) AS {c}" for c in COLS.split()) + " FROM slot_day GROUP BY date"
D = {**BOOK, "slot_day": SLOT_DAILY, "day": COMBINED}


def slot_days(spark, sf):
    return R.slot_daily(B.slot_book(positions(spark, sf)))


def days(spark, sf):
    return R.combine_slots(slot_days(spark, sf))


@query("slot_daily", oracle("SELECT * FROM slot_day", COLS, **D))
def slot_daily(spark, sf):
    return tidy(slot_days(spark, sf))


@query("combine_slots", oracle("SELECT * FROM day", COLS, **D))
def combine_slots(spark, sf):
    return tidy(days(spark, sf))


@query("slot_summary", oracle(
    """SELECT minute_slot, avg(gross_return) AS mean_daily_return, stddev_samp(gross_return) AS std_daily_return,
    avg(gross_return)/stddev_samp(gross_return)*sqrt(252) AS annualized_sharpe, count(gross_return) AS day_count FROM slot_day GROUP BY 1""",
    "mean_daily_return std_daily_return annualized_sharpe", **D))
def slot_summary(spark, sf):
    return tidy(R.slot_summary(slot_days(spark, sf)))


NET = "SELECT *, gross_return - spread_cost - impact_coeff*sqrt(10e6) AS net_return_aum_10m, gross_return - spread_cost - impact_coeff*sqrt(100e6) AS net_return_aum_100m FROM day"


@query("net_returns", oracle("SELECT * FROM net", COLS + " net_return_aum_10m net_return_aum_100m", 6, **D, net=NET))
def net_returns(spark, sf):
    return tidy(R.net_returns(days(spark, sf), [10e6, 100e6]), 6)


@query("capacity", oracle(
    "SELECT power(0.001/avg(impact_coeff), 2) AS capacity_at_10bps, power(0.002/avg(impact_coeff), 2) AS capacity_at_20bps FROM day",
    "capacity_at_10bps capacity_at_20bps", 4, **D))
def capacity(spark, sf):
    return tidy(R.capacity(days(spark, sf), [10, 20]), 4)


def summary_sql(source: str, by: str = "") -> str:
    part, lead = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}avg(v) AS mean_daily_return, stddev_samp(v) AS std_daily_return,
 CASE WHEN arg_max(wealth, date) > 0 THEN power(arg_max(wealth, date), 252.0::DOUBLE/count(v)) - 1 END AS annualized_return,
 avg(v)/stddev_samp(v)*sqrt(252) AS annualized_sharpe, avg(v)*sqrt(count(v))/stddev_samp(v) AS t_stat, arg_max(wealth, date) - 1 AS cum_return,
 min(wealth/peak - 1) AS max_drawdown, avg((v > 0)::INT) AS positive_day_ratio, count(v) AS day_count FROM
 (SELECT *, max(wealth) OVER ({part}ORDER BY date) AS peak FROM (SELECT *, product(1+v) OVER ({part}ORDER BY date) AS wealth FROM {source})) {group}"""


FIGURES = "mean_daily_return std_daily_return annualized_return annualized_sharpe t_stat cum_return max_drawdown positive_day_ratio"


@query("return_summary", oracle(summary_sql("(SELECT date, gross_return AS v FROM day)"), FIGURES, 7, **D))
def return_summary(spark, sf):
    return tidy(R.return_summary(days(spark, sf)), 7)


@query("equity_curve", oracle(
    """SELECT date, wealth, wealth/max(wealth) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT date, product(1+gross_return) OVER (ORDER BY date) AS wealth FROM day)""",
    "wealth drawdown", **D))
def equity_curve(spark, sf):
    return tidy(R.equity_curve(days(spark, sf)))


STACK = """SELECT date, unnest(['gross_return', 'net_return_aum_10m', 'net_return_aum_100m']) AS series, unnest([gross_return, net_return_aum_10m, net_return_aum_100m]) AS v FROM net"""
TRADING = """SELECT avg(planned_turnover) AS mean_planned_turnover, avg(turnover) AS mean_turnover, avg(fill_ratio) AS mean_fill_ratio, avg(executed_gross_exposure) AS mean_executed_gross_exposure,
 avg(cash_buffer) AS mean_cash_buffer, avg(long_exposure) AS mean_long_exposure, avg(short_exposure) AS mean_short_exposure, quantile_cont(turnover, 0.5) AS p50_turnover,
 quantile_cont(turnover, 0.95) AS p95_turnover, power(0.001/avg(impact_coeff), 2) AS capacity_at_10bps, power(0.002/avg(impact_coeff), 2) AS capacity_at_20bps FROM day"""
TRADING_COLS = "mean_planned_turnover mean_turnover mean_fill_ratio mean_executed_gross_exposure mean_cash_buffer mean_long_exposure mean_short_exposure p50_turnover p95_turnover capacity_at_10bps capacity_at_20bps"


@query("strategy_summary", oracle(
    "SELECT * FROM figures, trading", FIGURES + " " + TRADING_COLS, 6, {"capacity_at_10bps": 3, "capacity_at_20bps": 3}, **D, net=NET, stack=STACK, figures=summary_sql("stack", "series"), trading=TRADING))
def strategy_summary(spark, sf):
    return tidy(R.strategy_summary(days(spark, sf), [10e6, 100e6]), 6, capacity_at_10bps=3, capacity_at_20bps=3)


V = {
    **POS, "fast": FAST,
    "slot_day": """SELECT variant, minute_slot, date, product(1+gross_return)-1 AS gross_return, sum(turnover) AS turnover, sum(spread_cost) AS spread_cost, sum(impact_coeff) AS impact_coeff,
     avg(fill_ratio) AS fill_ratio, avg(long_exposure) AS long_exposure, avg(short_exposure) AS short_exposure FROM fast GROUP BY 1, 2, 3""",
    "day": "SELECT variant, date, " + ", ".join(f"avg({c}) AS {c}" for c in "gross_return turnover spread_cost impact_coeff fill_ratio long_exposure short_exposure".split()) + " FROM slot_day GROUP BY 1, 2",
    "gross": summary_sql("(SELECT variant, date, gross_return AS v FROM day)", "variant"),
    "netted": summary_sql("(SELECT variant, date, gross_return - spread_cost - impact_coeff*sqrt(10e6) AS v FROM day)", "variant"),
}


RANKED = """SELECT g.variant, g.mean_daily_return AS gross_daily_return, g.annualized_sharpe AS gross_sharpe, n.mean_daily_return AS net_daily_return, n.annualized_sharpe AS net_sharpe,
    n.max_drawdown AS net_max_drawdown, n.positive_day_ratio, t.* EXCLUDE (variant) FROM gross g JOIN netted n USING (variant) JOIN (SELECT variant, avg(turnover) AS mean_turnover,
    avg(fill_ratio) AS mean_fill_ratio, avg(long_exposure) AS mean_long_exposure, avg(short_exposure) AS mean_short_exposure, quantile_cont(turnover, 0.5) AS p50_turnover,
    quantile_cont(turnover, 0.95) AS p95_turnover, power(0.001/avg(impact_coeff), 2) AS capacity_at_10bps, power(0.002/avg(impact_coeff), 2) AS capacity_at_20bps FROM day GROUP BY 1) t USING (variant)"""
RANKED_COLS = "gross_daily_return gross_sharpe net_daily_return net_sharpe net_max_drawdown positive_day_ratio mean_turnover mean_fill_ratio mean_long_exposure mean_short_exposure p50_turnover p95_turnover capacity_at_10bps capacity_at_20bps"


@query("rank_variants", oracle(RANKED, RANKED_COLS, 6, {"capacity_at_10bps": 3, "capacity_at_20bps": 3}, **V))
def rank_variants(spark, sf):
    return tidy(compare_variants(A.feats(spark, sf), VARIANTS), 6, capacity_at_10bps=3, capacity_at_20bps=3)


# The shipped trade plans on sessions of 16 minutes: holding times and slots are a fifth.
SCALED = tuple(p | {"holding_bars": p["holding_bars"] // 5, "slot_mod_bars": p["slot_mod_bars"] // 5} for p in SHIPPED.TRADE_PLANS)


def _matrix_ctes():
    made, parts = {}, []
    for (holding, slots), group in SHIPPED.feature_groups(SCALED).items():
        feats = CTES["feats"].replace("exec_minute+4", f"exec_minute+{holding}").replace("MinuteIndex % 4", f"MinuteIndex % {slots}")
        made[f"feats_{holding}"] = feats
        made[f"eligible_{holding}"] = CTES["eligible"].replace("FROM feats", f"FROM feats_{holding}")
        made[f"variants_{holding}"] = variants_sql(SHIPPED.plan_parameters(group), PLAN_FIELDS)
        made[f"positions_{holding}"] = positions_sql().replace("FROM eligible e JOIN variants v", f"FROM eligible_{holding} e JOIN variants_{holding} v")
        parts.append(f"SELECT * FROM positions_{holding}")
    return made | {"positions": " UNION ALL ".join(parts)} | {k: v for k, v in V.items() if k not in ("variants", "positions")}


@query("trade_plan_matrix", oracle(RANKED, RANKED_COLS, 6, {"capacity_at_10bps": 3, "capacity_at_20bps": 3}, **_matrix_ctes()))
def run_trade_plan_matrix(spark, sf):
    """All shipped trade plans from four feature tables, ranked."""
    bars = stored(A.bars(spark, sf))
    st = M.active_days(A.st_periods(spark), bars.select("Date"))
    ranked = trade_plan_matrix(A.pred(spark, sf, bars), bars, A.daily(spark, sf, bars), st, SCALED, cfg=A.MARKET)
    return tidy(ranked, 6, capacity_at_10bps=3, capacity_at_20bps=3)


@query("alpha_per_turnover", oracle(
    """SELECT variant AS strategy_name, avg(gross_return) AS mean_gross_return, avg(net_return) AS mean_net_return, avg(turnover) AS mean_turnover, avg(spread_cost + fee_cost) AS mean_total_cost,
    sum(gross_return)/sum(turnover)*1e4 AS gross_bps_per_turnover, sum(net_return)/sum(turnover)*1e4 AS net_bps_per_turnover, sum(spread_cost + fee_cost)/sum(turnover)*1e4 AS cost_bps_per_turnover,
    avg((gross_return > 0)::INT) AS positive_gross_day_rate, avg((net_return > 0)::INT) AS positive_net_day_rate FROM hd GROUP BY 1""",
    "mean_gross_return mean_net_return mean_turnover mean_total_cost gross_bps_per_turnover net_bps_per_turnover cost_bps_per_turnover positive_gross_day_rate positive_net_day_rate", 6, **HYST, hd=HYST_DAILY))
def alpha_per_turnover(spark, sf):
    daily = B.hysteresis_daily(hysteresis(spark, sf)).withColumnRenamed("variant", "strategy_name")
    return tidy(G.alpha_per_turnover(daily), 6)


@query("turnover_decomposition", oracle(
    " UNION ALL ".join(f"SELECT '{c}' AS component, sum({c}) AS total, avg({c}) AS daily_mean FROM hd" for c in ("turnover", "spread_cost", "fee_cost")),
    "total daily_mean", **HYST, hd=HYST_DAILY))
def turnover_decomposition(spark, sf):
    return tidy(G.turnover_decomposition(B.hysteresis_daily(hysteresis(spark, sf))))


@query("stack_series", oracle("SELECT date, series, v AS value FROM stack", "value", 6, **D, net=NET, stack=STACK))
def stack_series(spark, sf):
    return tidy(R.stack_series(R.net_returns(days(spark, sf), [10e6, 100e6]), ["gross_return", "net_return_aum_10m", "net_return_aum_100m"]), 6)


@query("trading_by_date", oracle("SELECT date, count(*) AS bars, sum(filled_name_count)::BIGINT AS fills, sum(planned_name_count)::BIGINT AS orders FROM ledger GROUP BY date", **BOOK))
def trading_by_date(spark, sf):
    return B.slot_book(positions(spark, sf)).groupBy("date").agg(
        F.count("*").alias("bars"), F.sum("filled_name_count").alias("fills"), F.sum("planned_name_count").alias("orders"))
