"""Books: bands, ledgers and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book as B, positions as P
from ..plans import variants as SHIPPED
from . import adapters as A
from .adapters import tidy
from .catalog import query
from .construction import ONE, POS, VARIANTS, _fill, variants_sql
from .sql import oracle

# --- slot books ----------------------------------------------------------------------

# One row per (book, bar, code) of the bar itself and of the holdings it inherits.
TRADES = """SELECT coalesce(c.variant, p.variant) AS variant, coalesce(c.minute_slot, p.minute_slot) AS minute_slot, coalesce(c.slot_bar_id, p.slot_bar_id) AS slot_bar_id,
 c.date, c.time, c.code IS NOT NULL AS cur, coalesce(c.w, 0) AS w, coalesce(c.target_weight, 0) AS goal, coalesce(p.after, 0) AS prev, coalesce(c.r, 0) AS r,
 coalesce(c.ok, false) AS ok, coalesce(c.spread_bps, p.spread_bps) AS spread_bps, coalesce(c.sigma_intraday, p.sigma_intraday) AS sg, coalesce(c.adv_amount, p.adv_amount) AS adv
 FROM held c FULL OUTER JOIN (SELECT * REPLACE (slot_bar_id + 1 AS slot_bar_id) FROM held WHERE w <> 0) p
 ON c.variant=p.variant AND c.minute_slot=p.minute_slot AND c.slot_bar_id=p.slot_bar_id AND c.code=p.code"""
DRIFT_HELD = """SELECT *, w*(1+r)/(1 + sum(w*r) OVER (PARTITION BY variant, minute_slot, slot_bar_id)) AS after FROM
 (SELECT *, CASE WHEN fillable AND simple_return IS NOT NULL THEN target_weight ELSE 0 END AS w, coalesce(simple_return, 0) AS r,
 fillable AND simple_return IS NOT NULL AS ok FROM positions)"""
LEDGER = """SELECT *, filled_name_count/planned_name_count AS fill_ratio, long_exposure + short_exposure AS executed_gross_exposure,
 greatest(0, 1 - long_exposure - short_exposure) AS cash_buffer FROM (SELECT variant, minute_slot, slot_bar_id, max(date) AS date, max(time) AS time,
 sum(w*r) AS gross_return, 0.5*sum(abs(goal-prev)) AS planned_turnover, 0.5*sum(abs(w-prev)) AS turnover, sum(0.5*spread_bps/10000*abs(w-prev)) AS spread_cost,
 sum(CASE WHEN w <> prev THEN 0.5*sg*abs(w-prev)*sqrt(abs(w-prev)/adv) ELSE 0 END) AS impact_coeff, count(*) FILTER (cur) AS planned_name_count,
 count(*) FILTER (cur AND ok) AS filled_name_count, coalesce(sum(w) FILTER (w > 0), 0) AS long_exposure, coalesce(sum(-w) FILTER (w < 0), 0) AS short_exposure
 FROM moves GROUP BY 1, 2, 3) WHERE planned_name_count > 0"""
LEDGER_COLS = "gross_return planned_turnover turnover spread_cost impact_coeff fill_ratio long_exposure short_exposure executed_gross_exposure cash_buffer"
BOOK = {**ONE, "held": DRIFT_HELD, "moves": TRADES, "ledger": LEDGER}
BOOKS = {**POS, "held": DRIFT_HELD, "moves": TRADES, "ledger": LEDGER}


def positions(spark, sf):
    return P.build_positions(A.feats(spark, sf), top_frac=0.3)


@query("slot_book", oracle("SELECT * EXCLUDE (variant) FROM ledger", LEDGER_COLS, **BOOK))
def slot_book(spark, sf):
    return tidy(B.slot_book(positions(spark, sf)))


@query("run_variants_drift", oracle("SELECT * FROM ledger", LEDGER_COLS, **BOOKS))
def run_variants_drift(spark, sf):
    return tidy(B.run_variants(A.feats(spark, sf), VARIANTS, fast=False))


FAST = """SELECT variant, minute_slot, slot_bar_id, date, time, sum(w*simple_return) AS gross_return, 0.5*sum(d) AS turnover, sum(0.5*spread_bps/10000*d) AS spread_cost,
 sum(0.5*sigma_intraday*d*sqrt(d/adv_amount)) AS impact_coeff, avg((w <> 0)::INT) AS fill_ratio, sum(CASE WHEN w > 0 THEN w ELSE 0 END) AS long_exposure,
 sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS short_exposure FROM (SELECT *, abs(w - CASE WHEN pb = slot_bar_id - 1 THEN pw ELSE 0 END)
 + CASE WHEN nb IS NULL OR nb > slot_bar_id + 1 THEN abs(w) ELSE 0 END AS d FROM (SELECT *, lag(w) OVER o AS pw, lag(slot_bar_id) OVER o AS pb, lead(slot_bar_id) OVER o AS nb FROM
 (SELECT *, CASE WHEN fillable THEN target_weight ELSE 0 END AS w FROM positions) WINDOW o AS (PARTITION BY variant, minute_slot, code ORDER BY slot_bar_id)))
 GROUP BY 1, 2, 3, 4, 5"""
FAST_COLS = "gross_return turnover spread_cost impact_coeff fill_ratio long_exposure short_exposure"


@query("slot_book_fast", oracle("SELECT * EXCLUDE (variant) FROM fast", FAST_COLS, **ONE, fast=FAST))
def slot_book_fast(spark, sf):
    return tidy(B.slot_book_fast(positions(spark, sf)))


@query("run_variants", oracle("SELECT * FROM fast", FAST_COLS, **POS, fast=FAST))
def run_variants(spark, sf):
    return tidy(B.run_variants(A.feats(spark, sf), VARIANTS))


# --- bands ---------------------------------------------------------------------------

BUFFERS = (
    {"variant": "wide", "entry_frac": 0.1, "hold_frac": 0.3, "max_liq_bucket": 3},
    {"variant": "liquid", "entry_frac": 0.2, "hold_frac": 0.4, "max_liq_bucket": 2},
    {"variant": "overlap", "entry_frac": 0.2, "hold_frac": 0.7, "max_liq_bucket": 3},
)
NUMBERED = "SELECT *, CAST(dense_rank() OVER (PARTITION BY minute_slot ORDER BY date, time) AS INT) AS slot_bar_id FROM eligible"
BUFFER_BANDS = f"""SELECT variant, date, time, code, minute_slot, slot_bar_id, prediction, ret_vwap_exec_10 AS simple_return, sigma_intraday, adv_amount,
 CASE liq_bucket WHEN 1 THEN 5.0 WHEN 2 THEN 10.0 ELSE 20.0 END::DOUBLE AS spread_bps, {_fill('long')} AS long_fillable, {_fill('short')} AS short_fillable,
 rk > nn - ec AS long_entry, rk > nn - hc AS long_hold, rk <= ec AS short_entry, rk <= hc AS short_hold FROM
 (SELECT *, CAST(ceil(entry_frac*nn) AS BIGINT) AS ec, CAST(ceil(hold_frac*nn) AS BIGINT) AS hc FROM (SELECT e.*, v.*,
  row_number() OVER (PARTITION BY variant, date, time ORDER BY prediction, code) AS rk, count(*) OVER (PARTITION BY variant, date, time) AS nn
  FROM numbered e JOIN variants v ON e.liq_bucket <= v.max_liq_bucket)) WHERE rk > nn - hc OR rk <= hc"""
BAND_COLS = "prediction simple_return sigma_intraday adv_amount spread_bps"
BUF = {"numbered": NUMBERED, "variants": variants_sql(BUFFERS, ("variant", "entry_frac", "hold_frac", "max_liq_bucket")), "bands": BUFFER_BANDS}

# The state machine itself, one bar after the other.
SIDES = """SELECT variant, minute_slot, code, slot_bar_id, CASE WHEN long_entry THEN 1 WHEN short_entry THEN -1 ELSE 0 END AS side FROM bands b
 WHERE NOT EXISTS (SELECT 1 FROM bands p WHERE p.variant=b.variant AND p.minute_slot=b.minute_slot AND p.code=b.code AND p.slot_bar_id=b.slot_bar_id-1)
 UNION ALL SELECT b.variant, b.minute_slot, b.code, b.slot_bar_id, CASE WHEN s.side=1 AND long_hold THEN 1 WHEN s.side=-1 AND short_hold THEN -1
 WHEN long_entry THEN 1 WHEN short_entry THEN -1 ELSE 0 END FROM sides s JOIN bands b ON b.variant=s.variant AND b.minute_slot=s.minute_slot AND b.code=s.code AND b.slot_bar_id=s.slot_bar_id+1"""
CHOSEN = "SELECT b.*, CAST(s.side AS INT) AS side FROM bands b JOIN sides s USING (variant, minute_slot, code, slot_bar_id) WHERE s.side <> 0"


@query("buffer_bands", oracle("SELECT * FROM bands", BAND_COLS, 6, **BUF))
def buffer_bands(spark, sf):
    return tidy(P.buffer_bands(A.feats(spark, sf), BUFFERS), 6)


@query("pair_band_state", oracle("SELECT variant, minute_slot, code, slot_bar_id, side FROM chosen", **BUF, sides=SIDES, chosen=CHOSEN))
def pair_band_state(spark, sf):
    bands = P.buffer_bands(A.feats(spark, sf), BUFFERS)
    held = P.pair_band_state(bands, ["variant", "minute_slot", "code"], "slot_bar_id")
    return held.select("variant", "minute_slot", "code", "slot_bar_id", "side")


BAND_HELD = """SELECT *, w AS after, true AS ok, target_weight AS goal FROM (SELECT *, CASE WHEN CASE WHEN side > 0 THEN long_fillable ELSE short_fillable END THEN target_weight ELSE 0 END AS w,
 coalesce(simple_return, 0) AS r FROM (SELECT *, side*0.5*score/sum(score) OVER (PARTITION BY variant, minute_slot, slot_bar_id, side) AS target_weight FROM scored))"""
BAND_LEDGER = """SELECT variant, minute_slot, slot_bar_id, max(date) AS date, max(time) AS time, sum(w*r) AS gross_return, 0.5*sum(abs(w-prev)) AS turnover,
 sum(0.5*spread_bps/10000*abs(w-prev)) AS spread_cost, sum(CASE WHEN w <> prev THEN 0.5*sg*abs(w-prev)*sqrt(abs(w-prev)/adv) ELSE 0 END) AS impact_coeff,
 coalesce(sum(w) FILTER (w > 0), 0) AS long_exposure, coalesce(sum(-w) FILTER (w < 0), 0) AS short_exposure, count(*) FILTER (cur) AS desired_name_count,
 count(*) FILTER (w <> 0)/count(*) FILTER (cur) AS fill_ratio FROM moves GROUP BY 1, 2, 3 HAVING count(*) FILTER (cur) > 0"""
BAND_LEDGER_COLS = "gross_return turnover spread_cost impact_coeff long_exposure short_exposure fill_ratio"
BUFFER_BOOK = {**BUF, "sides": SIDES, "chosen": CHOSEN, "scored": "SELECT *, 1.0::DOUBLE AS score FROM chosen", "held": BAND_HELD, "moves": TRADES, "band_ledger": BAND_LEDGER}


@query("buffer_book", oracle("SELECT * FROM band_ledger", BAND_LEDGER_COLS, **BUFFER_BOOK))
def buffer_book(spark, sf):
    return tidy(B.buffer_book(A.feats(spark, sf), BUFFERS))


COSTS = (
    {"variant": "equal", "sizing_method": "equal", "entry_cost_penalty": 0.0},
    {"variant": "sized", "sizing_method": "cost_aware", "entry_cost_penalty": 0.0},
    {"variant": "small", "sizing_method": "cost_aware", "entry_cost_penalty": 0.05},
    {"variant": "large", "sizing_method": "cost_aware", "entry_cost_penalty": 0.8},
)
COST_BANDS = f"""SELECT variant, sizing_method, date, time, code, minute_slot, slot_bar_id, prediction, ret_vwap_exec_10 AS simple_return, sigma_intraday, adv_amount,
 5.0::DOUBLE AS spread_bps, {_fill('long')} AS long_fillable, {_fill('short')} AS short_fillable, rl <= ec AS long_entry, rl <= hc AS long_hold, rs <= ec AS short_entry, rs <= hc AS short_hold
 FROM (SELECT *, CAST(ceil(0.2*nn) AS BIGINT) AS ec, CAST(ceil(0.4*nn) AS BIGINT) AS hc, row_number() OVER (PARTITION BY variant, date, time ORDER BY prediction - pen*cp DESC, code) AS rl,
  row_number() OVER (PARTITION BY variant, date, time ORDER BY prediction + pen*cp, code) AS rs FROM
  (SELECT e.*, v.*, entry_cost_penalty::DOUBLE AS pen FROM costed e, variants v)) WHERE rl <= hc OR rs <= hc"""
COSTED = """SELECT *, percent_rank() OVER (PARTITION BY date, time ORDER BY sigma_intraday/sqrt(adv_amount)) AS cp, count(*) OVER (PARTITION BY date, time) AS nn FROM
 (SELECT *, CAST(dense_rank() OVER (PARTITION BY minute_slot ORDER BY date, time) AS INT) AS slot_bar_id,
 ntile(3) OVER (PARTITION BY date, time ORDER BY signal_amount DESC, code) AS lb FROM eligible WHERE sigma_intraday > 0) WHERE lb <= 2"""
COST = {"costed": COSTED, "variants": variants_sql(COSTS, ("variant", "sizing_method", "entry_cost_penalty")), "bands": COST_BANDS, "sides": SIDES, "chosen": CHOSEN,
        "scored": "SELECT *, CASE WHEN sizing_method = 'equal' THEN 1.0 ELSE sqrt(adv_amount)/sigma_intraday END AS score FROM chosen",
        "held": BAND_HELD, "moves": TRADES, "band_ledger": BAND_LEDGER}


@query("cost_bands", oracle("SELECT * FROM bands", BAND_COLS, 6, **{k: COST[k] for k in ("costed", "variants", "bands")}))
def cost_bands(spark, sf):
    return tidy(P.cost_bands(A.feats(spark, sf), COSTS, max_liq_bucket=2, entry_frac=0.2, hold_frac=0.4), 6)


@query("cost_aware_book", oracle("SELECT * FROM band_ledger", BAND_LEDGER_COLS, 7, **COST))
def cost_aware_book(spark, sf):
    return tidy(B.cost_aware_book(A.feats(spark, sf), COSTS, max_liq_bucket=2, entry_frac=0.2, hold_frac=0.4), 7)


# --- hysteresis ------------------------------------------------------------------------

QUANTILES = ({"variant": "q90_q70", "open_quantile": 0.9, "close_quantile": 0.7}, {"variant": "q80_q50", "open_quantile": 0.8, "close_quantile": 0.5})
HYST = {
    "variants": variants_sql(QUANTILES, ("variant", "open_quantile", "close_quantile")),
    "ranked_rows": """SELECT *, cume_dist() OVER (PARTITION BY date, time ORDER BY prediction) AS pct, ntile(3) OVER (PARTITION BY date, time ORDER BY signal_amount DESC, code) AS lb,
     dense_rank() OVER (PARTITION BY date ORDER BY time) AS bar FROM (SELECT *, count(*) OVER (PARTITION BY date, time) AS names FROM feats
     WHERE prediction IS NOT NULL AND ret_vwap_exec_10 IS NOT NULL AND signal_amount IS NOT NULL AND minute_slot % 2 = 0) WHERE names >= 5""",
    "inband": """SELECT r.*, v.variant, pct >= open_quantile::DOUBLE AS opens FROM ranked_rows r JOIN variants v ON pct >= close_quantile::DOUBLE""",
    "hyst_state": """SELECT variant, date, code, bar, opens AS active FROM inband b WHERE NOT EXISTS (SELECT 1 FROM inband p WHERE p.variant=b.variant AND p.date=b.date AND p.code=b.code AND p.bar=b.bar-1)
     UNION ALL SELECT b.variant, b.date, b.code, b.bar, s.active OR b.opens FROM hyst_state s JOIN inband b ON b.variant=s.variant AND b.date=s.date AND b.code=s.code AND b.bar=s.bar+1""",
    "longs": """SELECT b.*, 1.0::DOUBLE/count(*) OVER (PARTITION BY b.variant, b.date, b.bar) AS w, CASE lb WHEN 1 THEN 5.0 WHEN 2 THEN 10.0 ELSE 20.0 END::DOUBLE AS spread FROM inband b
     JOIN hyst_state s USING (variant, date, code, bar) WHERE s.active""",
    "hyst": """SELECT variant, date, max(time) AS time, sum(w*r) AS gross_return, 0.5*sum(abs(w-prev)) AS turnover, sum(0.5*spread/10000*abs(w-prev)) AS spread_cost,
     sum(abs(w-prev))/10000 AS fee_cost, sum(w) AS gross_exposure, count(time) AS active_name_count FROM (
     SELECT coalesce(c.variant, p.variant) AS variant, coalesce(c.date, p.date) AS date, coalesce(c.bar, p.bar) AS bar, c.time, coalesce(c.w, 0) AS w, coalesce(p.w, 0) AS prev,
     coalesce(c.ret_vwap_exec_10, 0) AS r, coalesce(c.spread, p.spread) AS spread FROM longs c FULL OUTER JOIN (SELECT * REPLACE (bar+1 AS bar) FROM longs) p
     ON c.variant=p.variant AND c.date=p.date AND c.code=p.code AND c.bar=p.bar) GROUP BY variant, date, bar HAVING count(time) > 0""",
}


def hysteresis(spark, sf):
    return B.hysteresis_book(A.feats(spark, sf), QUANTILES, A.MIN_NAMES, A.GRID)


@query("hysteresis_book", oracle("SELECT * FROM hyst", "gross_return turnover spread_cost fee_cost gross_exposure", **HYST))
def hysteresis_book(spark, sf):
    return tidy(hysteresis(spark, sf))


HYST_DAILY = """SELECT *, gross_return - spread_cost - fee_cost AS net_return FROM (SELECT variant, date, product(1+gross_return)-1 AS gross_return, sum(turnover) AS turnover,
 sum(spread_cost) AS spread_cost, sum(fee_cost) AS fee_cost, avg(gross_exposure) AS gross_exposure, avg(active_name_count) AS active_name_count FROM hyst GROUP BY 1, 2)"""


@query("hysteresis_daily", oracle("SELECT * FROM hd", "gross_return turnover spread_cost fee_cost gross_exposure active_name_count net_return", **HYST, hd=HYST_DAILY))
def hysteresis_daily(spark, sf):
    return tidy(B.hysteresis_daily(hysteresis(spark, sf)))


# --- the shipped matrices ---------------------------------------------------------------

SHIPPED_COSTED = COSTED.replace("WHERE lb <= 2", "WHERE lb <= 1")
SHIPPED_BANDS = COST_BANDS.replace("ceil(0.2*nn)", "ceil(0.1*nn)").replace("ceil(0.4*nn)", "ceil(0.2*nn)")
SHIPPED_COST = COST | {
    "costed": SHIPPED_COSTED, "bands": SHIPPED_BANDS,
    "variants": variants_sql(SHIPPED.COST_AWARE, ("variant", "sizing_method", "entry_cost_penalty"))}


@query("cost_aware_matrix", oracle("SELECT * FROM band_ledger", BAND_LEDGER_COLS, 7, **SHIPPED_COST))
def cost_aware_matrix(spark, sf):
    return tidy(B.cost_aware_book(A.feats(spark, sf), SHIPPED.COST_AWARE), 7)


SHIPPED_BUFFER = BUFFER_BOOK | {
    "variants": variants_sql(SHIPPED.BUFFERS, ("variant", "entry_frac", "hold_frac", "max_liq_bucket"))}


@query("buffer_matrix", oracle("SELECT * FROM band_ledger", BAND_LEDGER_COLS, **SHIPPED_BUFFER))
def buffer_matrix(spark, sf):
    return tidy(B.buffer_book(A.feats(spark, sf), SHIPPED.BUFFERS))


SHIPPED_HYST = HYST | {"variants": variants_sql(SHIPPED.HYSTERESIS, ("variant", "open_quantile", "close_quantile"))}


@query("hysteresis_matrix", oracle("SELECT * FROM hyst", "gross_return turnover spread_cost fee_cost gross_exposure", **SHIPPED_HYST))
def hysteresis_matrix(spark, sf):
    return tidy(B.hysteresis_book(A.feats(spark, sf), SHIPPED.HYSTERESIS, A.MIN_NAMES, A.GRID))


BAND = {
    "scores": "SELECT *, prediction FROM pred",
    "hold_rows": "SELECT date, code, CAST((time - 93000)//100 AS INT) AS bar, prediction >= 0.2 AS enter FROM pred WHERE prediction >= -0.2",
    "band": """SELECT date, code, bar, enter AS active FROM hold_rows b WHERE NOT EXISTS (SELECT 1 FROM hold_rows p WHERE p.date=b.date AND p.code=b.code AND p.bar=b.bar-1)
     UNION ALL SELECT b.date, b.code, b.bar, s.active OR b.enter FROM band s JOIN hold_rows b ON b.date=s.date AND b.code=s.code AND b.bar=s.bar+1""",
}


@query("band_state", oracle("SELECT date, code, bar FROM band WHERE active", **BAND))
def band_state(spark, sf):
    rows = A.pred(spark, sf).withColumn("bar", F.floor((F.col("time") - 93000) / 100).cast("int"))
    return P.band_state(rows, ["date", "code"], "bar", F.col("prediction") >= 0.2, F.col("prediction") >= -0.2).select("date", "code", "bar")


# --- one-step rebalance -------------------------------------------------------------------

WEIGHTS = "SELECT date, time, code, prediction/sum(abs(prediction)) OVER (PARTITION BY date, time) AS weight FROM pred WHERE {w}"
STEP = {
    "pw": WEIGHTS.format(w="prediction > -0.2"), "tw": WEIGHTS.format(w="prediction < 0.3"),
    "gated": """SELECT *, CASE WHEN hasp AND hast AND abs(t-p) < 0.0113 THEN p ELSE t END AS goal FROM (SELECT coalesce(a.date, b.date) AS date, coalesce(a.time, b.time) AS time,
     coalesce(a.code, b.code) AS code, coalesce(a.weight, 0) AS p, coalesce(b.weight, 0) AS t, a.weight IS NOT NULL AS hasp, b.weight IS NOT NULL AS hast
     FROM pw a FULL OUTER JOIN tw b ON a.date=b.date AND a.time=b.time AND a.code=b.code)""",
}


@query("rebalance_step", oracle(
    """SELECT date, time, code, p AS prev_weight, CASE WHEN planned_turnover > 0.25 THEN p + 0.25/planned_turnover*(goal-p) ELSE goal END AS weight, planned_turnover
    FROM (SELECT *, 0.5*sum(abs(goal-p)) OVER (PARTITION BY date, time) AS planned_turnover FROM gated)""", "prev_weight weight planned_turnover", **STEP))
def rebalance_step(spark, sf):
    from ..functions.ranks import add_group_stats

    def weights(cond):
        rows = add_group_stats(A.pred(spark, sf).where(cond), ["date", "time"], {"_s": F.sum(F.abs("prediction"))})
        return rows.select("date", "time", "code", F.try_divide(F.col("prediction"), F.col("_s")).alias("weight"))

    return tidy(P.rebalance_step(weights("prediction > -0.2"), weights("prediction < 0.3"), ["date", "time"], 0.0113, 0.25))
