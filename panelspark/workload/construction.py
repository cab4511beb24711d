"""Market state, execution features and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import market as M, positions as P, quality as Q
from ..plans.backtest import build_features
from ..schema import EXECUTION_COLUMNS, POSITIONS
from . import adapters as A
from .adapters import tidy
from .catalog import query
from .sql import oracle

KEYS = ["StockCode", "Date", "MinuteIndex"]

VARIANTS = (
    {"variant": "ls_10", "top_frac": 0.1, "long_enabled": True, "short_enabled": True, "max_liq_bucket": 3},
    {"variant": "ls_30", "top_frac": 0.3, "long_enabled": True, "short_enabled": True, "max_liq_bucket": 3},
    {"variant": "long", "top_frac": 0.2, "long_enabled": True, "short_enabled": False, "max_liq_bucket": 3},
    {"variant": "short", "top_frac": 0.2, "long_enabled": False, "short_enabled": True, "max_liq_bucket": 3},
    {"variant": "liq_1", "top_frac": 0.1, "long_enabled": True, "short_enabled": True, "max_liq_bucket": 1},
)


@query("trailing_adv", oracle("SELECT * FROM adv", "adv_amount", 6))
def trailing_adv(spark, sf):
    return tidy(M.trailing_adv(A.daily(spark, sf), 5), 6)


@query("trailing_adv_keys", oracle(
    """SELECT k.code, k.Date, (SELECT avg(a) FROM (SELECT v.daily_amount AS a FROM daily v WHERE v.code=k.code AND v.Date<k.Date
    AND v.daily_amount>0 ORDER BY v.Date DESC LIMIT 5)) AS adv_amount FROM (SELECT DISTINCT code, CAST(20000000 + date AS INT) AS Date FROM xsec) k""",
    "adv_amount", 6))
def trailing_adv_keys(spark, sf):
    """ADV at keys that are not the days of the history itself."""
    keys = A.xsec(spark, sf).select("code", S.full_date("date").alias("Date"))
    return tidy(M.trailing_adv(A.daily(spark, sf), 5, keys), 6)


FLAGS = "tradable_base, is_one_price_limit, tradable_base AND NOT is_one_price_limit AS current_tradable, is_limit_up_all_day, is_limit_down_all_day"


@query("tradable_flags", oracle(f"SELECT StockCode, Date, MinuteIndex, {FLAGS} FROM tradable"))
def tradable_flags(spark, sf):
    return A.state(spark, sf).select(
        *KEYS, "tradable_base", "is_one_price_limit", "current_tradable", "is_limit_up_all_day", "is_limit_down_all_day")


@query("market_state", oracle(
    """SELECT s.StockCode, s.Date, s.MinuteIndex, s.adv_amount, s.sigma_intraday, s.vwap, s.is_st, n.exec_minute AS next_trade_minute,
    n.px_open AS next_trade_open, n.px_vwap AS next_trade_vwap FROM state s JOIN next_trade n ON n.code=s.StockCode AND n.date=s.date_short AND n.schedule_minute=s.MinuteIndex""",
    "adv_amount sigma_intraday vwap next_trade_open next_trade_vwap", 6))
def market_state(spark, sf):
    return tidy(A.state(spark, sf).select(
        *KEYS, "adv_amount", "sigma_intraday", "vwap", "is_st", "next_trade_minute", "next_trade_open", "next_trade_vwap"), 6)


@query("next_trade_lookup", oracle(
    """SELECT s.StockCode AS code, s.date_short AS date, s.MinuteIndex AS base_minute, e.exec_minute AS entry_exec_minute, x.exec_minute AS exit_exec_minute,
    x.px_vwap AS exit_vwap FROM state s LEFT JOIN next_trade e ON e.code=s.StockCode AND e.date=s.date_short AND e.schedule_minute=s.MinuteIndex+2
    LEFT JOIN next_trade x ON x.code=s.StockCode AND x.date=s.date_short AND x.schedule_minute=e.exec_minute+3""", "exit_vwap", 6))
def next_trade_lookup(spark, sf):
    state = A.state(spark, sf)
    lookup = M.next_trade_table(state)
    rows = M.universe(state).select("code", "date", "base_minute").withColumn("entry_schedule_minute", F.col("base_minute") + 2)
    rows = M.next_trade_lookup(rows, lookup, "entry").withColumn("exit_schedule_minute", F.col("entry_exec_minute") + 3)
    rows = M.next_trade_lookup(rows.drop("entry_open", "entry_vwap"), lookup, "exit")
    return tidy(rows.select("code", "date", "base_minute", "entry_exec_minute", "exit_exec_minute", "exit_vwap"), 6)


@query("execution_features", oracle(
    f"SELECT {', '.join(EXECUTION_COLUMNS)} FROM feats",
    "prediction signal_open signal_close signal_vol signal_amount adv_amount sigma_intraday up_limit down_limit entry_open entry_vwap exit_open exit_vwap ret_open_exec_10 ret_vwap_exec_10", 6))
def execution_features(spark, sf):
    return tidy(A.feats(spark, sf), 6)


@query("allowed_times", oracle(
    """SELECT date_short AS date, count(*) AS row_count FROM state WHERE date_short IN (SELECT date FROM pred WHERE prediction >= 0.48)
    AND 93000 + 100*MinuteIndex IN (SELECT time FROM pred WHERE prediction >= 0.48) GROUP BY 1"""))
def allowed_times(spark, sf):
    scores = A.pred(spark, sf).where("prediction >= 0.48")
    return M.allowed_times(M.universe(A.state(spark, sf)), scores).groupBy("date").agg(F.count("*").alias("row_count"))


@query("signal_left_join", oracle(
    """SELECT s.date_short AS date, count(*) AS row_count, count(p.code) AS prediction_rows FROM state s LEFT JOIN
    (SELECT * FROM pred WHERE prediction > 0) p ON p.date=s.date_short AND p.code=s.StockCode AND p.time=93000+100*s.MinuteIndex GROUP BY 1"""))
def signal_left_join(spark, sf):
    rows = M.signal_left_join(M.universe(A.state(spark, sf)), A.pred(spark, sf).where("prediction > 0"))
    return rows.groupBy("date").agg(F.count("*").alias("row_count"), F.count(F.when(F.col("prediction_available"), 1)).alias("prediction_rows"))


@query("feature_audit", oracle(
    """SELECT date, count(*) AS raw_universe_rows, count(*) FILTER (prediction_available) AS prediction_rows, count(*) FILTER (current_tradable) AS current_tradable_rows,
    count(*) FILTER (fillable_open) AS fillable_open_rows, count(*) FILTER (fillable_vwap) AS fillable_vwap_rows, avg(prediction_available::INT) AS coverage_ratio
    FROM feats GROUP BY date""", "coverage_ratio"))
def feature_audit(spark, sf):
    return tidy(Q.feature_audit(A.feats(spark, sf)))


COVERAGE = {
    "not_fillable_vwap": "NOT fillable_vwap", "not_fillable_open": "NOT fillable_open",
    "limit_up_all_day": "is_limit_up_all_day", "limit_down_all_day": "is_limit_down_all_day",
    "limit_at_entry": "entry_vwap_is_up_limit OR entry_vwap_is_down_limit", "limit_at_exit": "exit_vwap_is_up_limit OR exit_vwap_is_down_limit",
}


@query("label_coverage", oracle(
    " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) FILTER ({c}) AS row_count, avg(({c})::INT) AS row_ratio FROM feats" for n, c in COVERAGE.items()),
    "row_ratio"))
def label_coverage(spark, sf):
    return tidy(Q.label_coverage(A.feats(spark, sf)))


@query("eligible_signals", oracle("SELECT date, time, code, CAST(liq_bucket AS INT) AS liq_bucket FROM eligible"))
def eligible_signals(spark, sf):
    return P.liquidity_tercile(P.eligible_signals(A.feats(spark, sf))).select("date", "time", "code", "liq_bucket")


def _fill(side: str, price: str = "vwap") -> str:
    entry, leave = ("down", "up") if side == "short" else ("up", "down")
    return (f"fillable_{price} AND NOT is_limit_up_all_day AND NOT is_limit_down_all_day AND NOT entry_{price}_is_{entry}_limit "
            f"AND NOT exit_{price}_is_{leave}_limit")


@query("directional_fillable", oracle(
    f"SELECT date, count(*) FILTER ({_fill('long')}) AS long_rows, count(*) FILTER ({_fill('short')}) AS short_rows FROM feats GROUP BY date"))
def directional_fillable(spark, sf):
    return A.feats(spark, sf).groupBy("date").agg(
        F.count(F.when(P.directional_fillable(P.LONG, "vwap"), 1)).alias("long_rows"),
        F.count(F.when(P.directional_fillable(P.SHORT, "vwap"), 1)).alias("short_rows"))


def variants_sql(variants, fields) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::DECIMAL(9,8)" if isinstance(v, float) else str(v)

    rows = ", ".join("(" + ", ".join(lit(v[f]) for f in fields) + ")" for v in variants)
    return f"SELECT * FROM (VALUES {rows}) t({', '.join(fields)})"


def positions_sql(price: str = "vwap") -> str:
    return f"""SELECT variant, date, time, minute_slot, CAST(dense_rank() OVER (PARTITION BY variant, minute_slot ORDER BY date, time) AS INT) AS slot_bar_id,
 code, prediction, prediction_available, current_tradable, ret_{price}_exec_10 AS simple_return, sigma_intraday, adv_amount,
 CASE WHEN rk <= kc THEN {_fill('short', price)} ELSE {_fill('long', price)} END AS fillable,
 CASE liq_bucket WHEN 1 THEN 5.0 WHEN 2 THEN 10.0 ELSE 20.0 END::DOUBLE AS spread_bps,
 CAST(CASE WHEN short_enabled AND rk <= kc THEN -1 ELSE 1 END AS INT) AS side,
 CASE WHEN short_enabled AND rk <= kc THEN -(CASE WHEN long_enabled THEN 0.5 ELSE 1.0 END)::DOUBLE/kc ELSE (CASE WHEN short_enabled THEN 0.5 ELSE 1.0 END)::DOUBLE/kc END AS target_weight
 FROM (SELECT *, CAST(ceil(top_frac*nn) AS BIGINT) AS kc FROM (SELECT e.*, v.*, row_number() OVER (PARTITION BY variant, date, time ORDER BY prediction, code) AS rk,
  count(*) OVER (PARTITION BY variant, date, time) AS nn FROM eligible e JOIN variants v ON e.liq_bucket <= v.max_liq_bucket))
 WHERE (short_enabled AND rk <= kc) OR (long_enabled AND rk > nn - kc)"""


PLAN_FIELDS = ("variant", "top_frac", "long_enabled", "short_enabled", "max_liq_bucket")
POSITION_COLS = "prediction simple_return sigma_intraday adv_amount spread_bps target_weight"
POS = {"variants": variants_sql(VARIANTS, PLAN_FIELDS), "positions": positions_sql()}
ONE = {"variants": variants_sql(VARIANTS[1:2], PLAN_FIELDS), "positions": positions_sql()}


@query("build_positions", oracle("SELECT * EXCLUDE (variant) FROM positions", POSITION_COLS, 6, **ONE))
def build_positions(spark, sf):
    return tidy(P.build_positions(A.feats(spark, sf), top_frac=0.3), 6)


@query("build_positions_open", oracle(
    "SELECT * EXCLUDE (variant) FROM positions", POSITION_COLS, 6, variants=variants_sql(VARIANTS[2:3], PLAN_FIELDS), positions=positions_sql("open")))
def build_positions_open(spark, sf):
    return tidy(P.build_positions(A.feats(spark, sf), top_frac=0.2, short_enabled=False, price="open"), 6)


@query("build_position_variants", oracle("SELECT * FROM positions", POSITION_COLS, 6, **POS))
def build_position_variants(spark, sf):
    return tidy(P.build_position_variants(A.feats(spark, sf), VARIANTS), 6)


@query("build_positions_ranged", oracle("SELECT * EXCLUDE (variant) FROM positions", POSITION_COLS, 6, **ONE))
def build_positions_ranged(spark, sf):
    """The same positions by range-partitioned ranks, as used for very large cross-sections."""
    return tidy(P.build_positions(A.feats(spark, sf), top_frac=0.3, plan="ranged"), 6)


@query("build_features", oracle(
    """SELECT date, count(*) AS row_count, avg(adv_amount) AS mean_adv, count(*) FILTER (fillable_vwap) AS fillable_rows FROM feats GROUP BY 1""", "mean_adv", 4))
def build_features_from_scores(spark, sf):
    """ADV history limited to the dates that have scores."""
    scores = A.pred(spark, sf)
    st = M.active_days(A.st_periods(spark), A.calendar(spark, sf))
    feats = build_features(scores, A.bars(spark, sf), A.daily(spark, sf), st, A.MARKET)
    return tidy(feats.groupBy("date").agg(
        F.count("*").alias("row_count"), F.avg("adv_amount").alias("mean_adv"), F.count(F.when(F.col("fillable_vwap"), 1)).alias("fillable_rows")), 4)


assert [f.name for f in POSITIONS.fields][:5] == ["date", "time", "minute_slot", "slot_bar_id", "code"]
