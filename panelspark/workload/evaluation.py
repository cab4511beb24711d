"""Information-coefficient operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ic as I, features as P
from ..registry import default_registry
from ..session import stored
from . import adapters as A
from .adapters import tidy
from .catalog import query
from .sql import oracle


def _fin(e: str) -> str:
    return f"CASE WHEN abs({e}) < 1e-12 THEN 0.0 WHEN isfinite({e}) THEN {e} END"


def ranked(source: str, keys: str, x: str = "prediction", y: str = "target") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    comma = f"{keys}, " if keys else ""
    return (f"SELECT *, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {comma}{x}) - 1)/2.0 AS rx, "
            f"rank() OVER ({part} ORDER BY {y}) + (count(*) OVER (PARTITION BY {comma}{y}) - 1)/2.0 AS ry FROM {source}")


IC = f"{_fin('corr(prediction, target)')} AS ic, {_fin('corr(rx, ry)')} AS rank_ic, count(*) AS count"
STAMPS = f"SELECT date, time, {IC} FROM r GROUP BY date, time"
X = {"r": ranked("xsec", "date, time"), "stamps": STAMPS}
L = {"r": ranked("labeled", "date, time"), "stamps": STAMPS}
SUMMARY = """count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, avg({c})*sqrt(count({c}))/stddev_samp({c}) AS t_stat,
 avg(({c}>0)::INT) AS positive_ratio, avg({c})/stddev_samp({c}) AS icir"""
SUM_COLS = "mean std t_stat positive_ratio icir"


@query("ic_by_timestamp", oracle("SELECT * FROM stamps", "ic rank_ic", **X))
def ic_by_timestamp(spark, sf):
    return tidy(I.ic_by_timestamp(A.xsec(spark, sf)))


@query("ic_by_timestamp_ranged", oracle("SELECT * FROM stamps", "ic rank_ic", **X))
def ic_by_timestamp_ranged(spark, sf):
    return tidy(I.ic_by_timestamp(A.xsec(spark, sf), plan="ranged"))


@query("ic_summary", oracle(f"SELECT {SUMMARY.format(c='ic')} FROM stamps", SUM_COLS, **X))
def ic_summary(spark, sf):
    return tidy(I.ic_summary(I.ic_by_timestamp(A.xsec(spark, sf))))


@query("rank_ic_summary", oracle(f"SELECT {SUMMARY.format(c='rank_ic')} FROM stamps", SUM_COLS, **L))
def rank_ic_summary(spark, sf):
    return tidy(I.ic_summary(I.ic_by_timestamp(A.labeled(spark, sf)), "rank_ic"))


@query("pooled_ic", oracle(f"SELECT {IC} FROM r", "ic rank_ic", r=ranked("xsec", "")))
def pooled_ic(spark, sf):
    return tidy(I.pooled_ic(A.xsec(spark, sf)))


DAYS = "SELECT date, avg(ic) AS ic, avg(rank_ic) AS rank_ic, count(ic) AS timestamps FROM stamps GROUP BY date"


@query("daily_ic", oracle("SELECT * FROM days", "ic rank_ic", **L, days=DAYS))
def daily_ic(spark, sf):
    return tidy(I.daily_ic(I.ic_by_timestamp(A.labeled(spark, sf))))


BLOCKS = """SELECT CAST((k-1)//5 AS INT) AS block, min(date) AS start_date, max(date) AS end_date, count(*) AS day_count, avg(ic) AS mean,
 stddev_samp(ic) AS std, avg(ic)/stddev_samp(ic) AS icir FROM (SELECT *, row_number() OVER (ORDER BY date) AS k FROM days WHERE ic IS NOT NULL) GROUP BY 1"""


@query("icir_windows", oracle("SELECT * FROM blocks", "mean std icir", **L, days=DAYS, blocks=BLOCKS))
def icir_windows(spark, sf):
    return tidy(I.icir_windows(I.daily_ic(I.ic_by_timestamp(A.labeled(spark, sf))), days=A.ICIR_DAYS))


@query("icir_mean", oracle("SELECT avg(icir) AS mean_icir, count(icir) AS windows FROM blocks", "mean_icir", **L, days=DAYS, blocks=BLOCKS))
def icir_mean(spark, sf):
    return tidy(I.icir_mean(I.icir_windows(I.daily_ic(I.ic_by_timestamp(A.labeled(spark, sf))), days=A.ICIR_DAYS)))


@query("annual_ic", oracle(f"SELECT CAST(2000 + date//10000 AS INT) AS year, {IC} FROM r GROUP BY 1", "ic rank_ic", r=ranked("xsec", "date//10000")))
def annual_ic(spark, sf):
    return tidy(I.annual_ic(A.xsec(spark, sf)))


INTRADAY = """SELECT time, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS std_rank_ic, count(ic) AS count
 FROM stamps {w} GROUP BY time"""


@query("intraday_ic", oracle(INTRADAY.format(w=""), "mean_ic std_ic mean_rank_ic std_rank_ic", **L))
def intraday_ic(spark, sf):
    return tidy(I.intraday_ic(I.ic_by_timestamp(A.labeled(spark, sf))))


@query("intraday_ic_compare", oracle(
    """SELECT a.time, a.mean_ic AS train_mean_ic, a.std_ic AS train_std_ic, a.count AS train_count, b.mean_ic AS test_mean_ic, b.std_ic AS test_std_ic,
    b.count AS test_count FROM a JOIN b USING (time)""", "train_mean_ic train_std_ic test_mean_ic test_std_ic", **L,
    a=INTRADAY.format(w="WHERE date <= 190101"), b=INTRADAY.format(w="WHERE date > 190101")))
def intraday_ic_compare(spark, sf):
    stamps = I.ic_by_timestamp(A.labeled(spark, sf))
    return tidy(I.intraday_ic_compare(stamps.where("date <= 190101"), stamps.where("date > 190101")))


REGIME = """SELECT CAST(Date % 1000000 AS INT) AS date, prior_amount, CAST(CASE WHEN prior_amount <= (SELECT quantile_cont(prior_amount, 1/3::DOUBLE) FROM prior) THEN 0
 WHEN prior_amount <= (SELECT quantile_cont(prior_amount, 2/3::DOUBLE) FROM prior) THEN 1 ELSE 2 END AS INT) AS regime FROM prior"""
PRIOR = """SELECT * FROM (SELECT Date, CASE WHEN count(*) OVER w = 5 THEN sum(a) OVER w END AS prior_amount FROM (SELECT Date, sum(Amount) AS a FROM bars GROUP BY Date)
 WINDOW w AS (ORDER BY Date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE prior_amount IS NOT NULL"""


@query("liquidity_regime", oracle("SELECT * FROM regime", "prior_amount", 4, prior=PRIOR, regime=REGIME))
def liquidity_regime(spark, sf):
    return tidy(I.liquidity_regime(A.bars(spark, sf)), 4)


VOL = """SELECT StockCode, Date, MinuteIndex, Close, Amount, CASE WHEN count(*) OVER (s ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) >= 3
 AND count(r1) OVER (s ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) >= 2 THEN stddev_pop(r1) OVER (s ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) END AS v
 FROM steps WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)"""
TAGGED = """SELECT l.*, Close AS price_label, Amount AS liquidity_label, v AS volatility_label FROM labeled l LEFT JOIN vol b
 ON b.StockCode=l.code AND CAST(b.Date % 1000000 AS INT)=l.date AND l.time=93000+100*b.MinuteIndex"""
G = {"vol": VOL, "tagged": TAGGED}


@query("attach_group_labels", oracle("SELECT * FROM tagged", "prediction target price_label liquidity_label volatility_label", 6, **G))
def attach_group_labels(spark, sf):
    return tidy(I.attach_group_labels(A.labeled(spark, sf), A.bars(spark, sf), 4), 6)


GROUPED = f"""SELECT grp AS "group", {IC} FROM r GROUP BY grp"""
MEMBERS = """SELECT prediction, target, grp FROM (SELECT t.*, g.regime, cume_dist() OVER (PARTITION BY t.date, time ORDER BY prediction) AS c1,
 CASE WHEN liquidity_label IS NOT NULL THEN cume_dist() OVER (PARTITION BY t.date, time, liquidity_label IS NULL ORDER BY liquidity_label) END AS c2,
 CASE WHEN volatility_label IS NOT NULL THEN cume_dist() OVER (PARTITION BY t.date, time, volatility_label IS NULL ORDER BY volatility_label) END AS c3
 FROM tagged t LEFT JOIN regime g ON g.date = t.date),
 LATERAL (SELECT unnest([CASE WHEN c1 <= 0.9 THEN 'prediction_low_p90' ELSE 'prediction_high_p10' END,
 CASE WHEN c2 <= 0.5 THEN 'liquidity_low' WHEN c2 > 0.5 THEN 'liquidity_high' END,
 CASE WHEN c3 <= 0.5 THEN 'volatility_low' WHEN c3 > 0.5 THEN 'volatility_high' END,
 CASE regime WHEN 0 THEN 'regime_low' WHEN 1 THEN 'regime_mid' WHEN 2 THEN 'regime_high' END]) AS grp) WHERE grp IS NOT NULL"""


def _grouped(spark, sf, plan):
    bars = stored(A.bars(spark, sf))
    rows = I.attach_group_labels(A.labeled(spark, sf, bars), bars, 4)
    return tidy(I.grouped_ic(rows, I.liquidity_regime(bars), plan))


@query("grouped_ic", oracle(GROUPED, "ic rank_ic", **G, prior=PRIOR, regime=REGIME, members=MEMBERS, r=ranked("members", "grp")))
def grouped_ic(spark, sf):
    return _grouped(spark, sf, None)


@query("grouped_ic_ranged", oracle(GROUPED, "ic rank_ic", **G, prior=PRIOR, regime=REGIME, members=MEMBERS, r=ranked("members", "grp")))
def grouped_ic_ranged(spark, sf):
    return _grouped(spark, sf, "ranged")


def _roll(source_keys: str, order: str) -> dict[str, str]:
    part = f"PARTITION BY {source_keys}" if source_keys else ""
    by = f"({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)"
    return {
        "r": ranked("xsec", source_keys),
        "rolled": f"""SELECT *, row_number() OVER ({part} ORDER BY {order}) AS k, count(*) OVER ({part}) AS n,
        {_fin(f'corr(prediction, target) OVER {by}')} AS ic, {_fin(f'corr(rx, ry) OVER {by}')} AS ric,
        last_value(amount) OVER {by} AS label_right, nth_value(amount, 5) OVER {by} AS label_center FROM r""",
        "windows": """SELECT *, k - 1 AS st, (k - 1 + 4.0)/n AS center FROM rolled WHERE (k - 1) % 2 = 0 AND k - 1 + 8 <= n""",
    }


CURVE = """SELECT CAST(round_even(center*1000, 0) AS INT) AS rank_bin, avg(center) AS group_center_rank, avg(ic) AS mean_ic,
 CASE WHEN count(ic) > 1 THEN stddev_pop(ic) END AS std_ic, avg(ric) AS mean_rank_ic, CASE WHEN count(ric) > 1 THEN stddev_pop(ric) END AS std_rank_ic,
 count(*) AS count FROM windows GROUP BY 1"""
CURVE_COLS = "group_center_rank mean_ic std_ic mean_rank_ic std_rank_ic"


@query("rolling_group_ic", oracle(CURVE, CURVE_COLS, 6, **_roll("date", "amount, code")))
def rolling_group_ic(spark, sf):
    return tidy(I.rolling_group_ic(A.xsec(spark, sf), "amount", A.ROLL_WINDOW, A.ROLL_STEP), 6)


@query("rolling_group_ic_ranged", oracle(CURVE, CURVE_COLS, 6, **_roll("date", "amount, code")))
def rolling_group_ic_ranged(spark, sf):
    return tidy(I.rolling_group_ic(A.xsec(spark, sf), "amount", A.ROLL_WINDOW, A.ROLL_STEP, plan="ranged"), 6)


@query("rolling_group_ic_rows", oracle(
    """SELECT st AS window_start, st + 7 AS window_end, center AS group_center_rank, amount AS label_left, label_center, label_right,
    ic AS mean_ic, ric AS mean_rank_ic, CAST(8 AS BIGINT) AS count FROM windows""",
    "group_center_rank label_left label_center label_right mean_ic mean_rank_ic", 5, **_roll("", "amount, date, code")))
def rolling_group_ic_rows(spark, sf):
    return tidy(I.rolling_group_ic_rows(A.xsec(spark, sf), "amount", A.ROLL_WINDOW, A.ROLL_STEP), 5)


@query("rolling_group_ic_any_step", oracle(
    """SELECT k - 1 AS window_start, k + 6 AS window_end, (k - 1 + 4.0)/n AS group_center_rank, amount AS label_left, label_center, label_right,
    ic AS mean_ic, ric AS mean_rank_ic, CAST(8 AS BIGINT) AS count FROM rolled WHERE (k - 1) % 3 = 0 AND k - 1 + 8 <= n""",
    "group_center_rank label_left label_center label_right mean_ic mean_rank_ic", 5, **_roll("", "amount, date, code")))
def rolling_group_ic_any_step(spark, sf):
    """A step that has no divisor in common with the window."""
    return tidy(I.rolling_group_ic_rows(A.xsec(spark, sf), "amount", A.ROLL_WINDOW, 3), 5)


@query("curve_summary", oracle(
    """SELECT min(x) AS center_rank_min, max(x) AS center_rank_max, CAST(sum(count) AS BIGINT) AS count_sum, max(y) AS max_value, min(y) AS min_value,
    arg_max(x, y) AS max_rank, arg_min(x, y) AS min_rank, min(x) FILTER ((p <= 0 AND y > 0) OR (p >= 0 AND y < 0)) AS first_sign_flip
    FROM (SELECT group_center_rank AS x, mean_ic AS y, count, lag(mean_ic) OVER (ORDER BY group_center_rank) AS p FROM curve)""",
    "center_rank_min center_rank_max max_value min_value max_rank min_rank first_sign_flip", 6, **_roll("date", "amount, code"), curve=CURVE))
def curve_summary(spark, sf):
    return tidy(I.curve_summary(I.rolling_group_ic(A.xsec(spark, sf), "amount", A.ROLL_WINDOW, A.ROLL_STEP)), 6)


PAIRS = """SELECT a.date, p.time AS prev_time, a.time, a.code, p.prediction AS x, a.prediction AS y FROM t a JOIN t p ON p.date=a.date AND p.code=a.code AND p.k=a.k-1"""
TURN = {
    "t": "SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY time) AS k FROM pred",
    "pairs": PAIRS, "r": ranked("pairs", "date, time", "x", "y"),
    "turnover": f"""SELECT *, 1 - rank_corr AS rank_turnover FROM (SELECT date, prev_time, time, {_fin('corr(rx, ry)')} AS rank_corr, count(*) AS count
    FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2)""",
}
BY_TIME = """SELECT time, avg(rank_corr) AS mean_rank_corr, avg(rank_turnover) AS mean_rank_turnover, stddev_samp(rank_turnover) AS std_rank_turnover,
 count(rank_turnover) AS count FROM turnover GROUP BY time"""


@query("rank_turnover", oracle("SELECT * FROM turnover", "rank_corr rank_turnover", **TURN))
def rank_turnover(spark, sf):
    return tidy(I.rank_turnover(A.pred(spark, sf)))


@query("turnover_by_time", oracle(BY_TIME, "mean_rank_corr mean_rank_turnover std_rank_turnover", **TURN))
def turnover_by_time(spark, sf):
    return tidy(I.turnover_by_time(I.rank_turnover(A.pred(spark, sf))))


@query("turnover_summary", oracle(
    """SELECT count(*) AS row_count, avg(rank_corr) AS mean_rank_corr, avg(rank_turnover) AS mean_rank_turnover,
    avg(CASE WHEN rank_corr > 0 THEN 1.0 ELSE 0.0 END) AS positive_rank_corr_ratio,
    (SELECT arg_min(time, mean_rank_turnover) FROM b) AS lowest_turnover_time, (SELECT min(mean_rank_turnover) FROM b) AS lowest_turnover_value,
    (SELECT arg_max(time, mean_rank_turnover) FROM b) AS highest_turnover_time, (SELECT max(mean_rank_turnover) FROM b) AS highest_turnover_value FROM turnover""",
    "mean_rank_corr mean_rank_turnover positive_rank_corr_ratio lowest_turnover_value highest_turnover_value", **TURN, b=BY_TIME))
def turnover_summary(spark, sf):
    return tidy(I.turnover_summary(I.rank_turnover(A.pred(spark, sf))))


RES = "SELECT *, target - prediction AS e FROM xsec"
RZ = "SELECT *, (e - avg(e) OVER ())/stddev_pop(e) OVER () AS z FROM res"


@query("residual_diagnostics", oracle(
    """SELECT count(*) AS count, avg(e) AS mean, stddev_pop(e) AS std, avg(power(z, 3)) AS skew, avg(power(z, 4)) - 3 AS kurtosis, avg(abs(e)) AS mae,
    sqrt(avg(e*e)) AS rmse, corr(prediction, e) AS corr_prediction_residual FROM rz""",
    "mean std skew kurtosis mae rmse corr_prediction_residual", res=RES, rz=RZ))
def residual_diagnostics(spark, sf):
    return tidy(I.residual_diagnostics(A.xsec(spark, sf)))


@query("residual_diagnostics_sample", oracle(
    """SELECT count(*) AS count, avg(e) AS mean, stddev_samp(e) AS std, avg(power(z, 3))*sqrt(count(*)*(count(*)-1.0::DOUBLE))/(count(*)-2) AS skew,
    (count(*)-1.0::DOUBLE)*((count(*)+1)*(avg(power(z, 4))-3)+6)/((count(*)-2.0::DOUBLE)*(count(*)-3)) AS kurtosis, avg(abs(e)) AS mae,
    sqrt(avg(e*e)) AS rmse, corr(prediction, e) AS corr_prediction_residual FROM rz""",
    "mean std skew kurtosis mae rmse corr_prediction_residual", res=RES, rz=RZ))
def residual_diagnostics_sample(spark, sf):
    return tidy(I.residual_diagnostics(A.xsec(spark, sf), sample=True))


@query("decile_curve", oracle(
    """SELECT CAST(k AS INT) AS decile, avg(target) AS mean_target, avg(CASE WHEN target > 0 THEN 1.0 WHEN target IS NOT NULL THEN 0.0 END) AS win_rate, count(target) AS count
    FROM range(0, 10) d(k) LEFT JOIN (SELECT target, least(floor((rank() OVER (PARTITION BY date ORDER BY prediction) + (count(*) OVER (PARTITION BY date, prediction)-1)/2.0)
    / count(*) OVER (PARTITION BY date) * 10), 9) AS dec FROM xsec) ON dec = k GROUP BY 1""", "mean_target win_rate"))
def decile_curve(spark, sf):
    return tidy(I.decile_curve(A.xsec(spark, sf)))


SPECS = {"ret_1m": {"ret_1m": 1.0}, "ret_3m": {"ret_3m": 1.0}, "ret_combo": {"ret_1m": 1.0, "ret_2m": 0.5, "ret_3m": 0.25}}
BASE = {
    "rows_in": """SELECT t.Date AS date, t.MinuteIndex AS time, label_ret AS y, s.baseline, c.scope,
    CASE s.baseline WHEN 'ret_1m' THEN ret_1m WHEN 'ret_3m' THEN ret_3m ELSE ret_1m + 0.5*ret_2m + 0.25*ret_3m END AS x
    FROM training t, (VALUES ('ret_1m'), ('ret_3m'), ('ret_combo')) s(baseline), (VALUES ('all'), ('late')) c(scope) WHERE c.scope = 'all' OR MinuteIndex >= 6""",
    "st": f"SELECT scope, baseline, date, time, {_fin('corr(x, y)')} AS ic FROM rows_in GROUP BY 1, 2, 3, 4",
    "dd": "SELECT scope, baseline, date, CASE WHEN abs(avg(ic)) < 1e-12 THEN 0.0 ELSE avg(ic) END AS ic FROM st GROUP BY 1, 2, 3 HAVING avg(ic) IS NOT NULL",
}


@query("baseline_ic", oracle(
    """SELECT * FROM (SELECT scope, baseline, count(*) AS rows, corr(x, y) AS pooled_ic FROM rows_in GROUP BY 1, 2) JOIN
    (SELECT scope, baseline, avg(ic) AS daily_ic_mean, stddev_pop(ic) AS daily_ic_std, count(ic) AS daily_count, avg((ic > 0)::INT) AS daily_positive_ratio FROM dd GROUP BY 1, 2) USING (scope, baseline)""",
    "pooled_ic daily_ic_mean daily_ic_std daily_positive_ratio", **BASE))
def baseline_ic(spark, sf):
    rows = P.with_short_keys(P.training_table(A.bars(spark, sf), A.FEATURES))
    return tidy(I.baseline_ic(rows, SPECS, {"all": F.lit(True), "late": F.col("MinuteIndex") >= 6}))


SOURCED = {
    "runs_in": """SELECT *, count(*) OVER (PARTITION BY StockCode, Date, island ORDER BY MinuteIndex) AS run FROM (
    SELECT *, MinuteIndex - row_number() OVER (PARTITION BY StockCode, Date ORDER BY MinuteIndex) AS island FROM training)""",
    "rows_in": BASE["rows_in"].replace("SELECT t.Date", "SELECT CASE WHEN StockCode % 2 = 0 THEN 'even' ELSE 'odd' END AS source, t.Date").replace(
        "FROM training t", "FROM runs_in t").replace("('late')", "('endpoints')").replace("MinuteIndex >= 6", "run >= 3"),
    "st": BASE["st"].replace("SELECT scope", "SELECT source, scope").replace("1, 2, 3, 4", "1, 2, 3, 4, 5"),
    "dd": BASE["dd"].replace("SELECT scope", "SELECT source, scope").replace("1, 2, 3", "1, 2, 3, 4"),
}


@query("baseline_ic_sources", oracle(
    """SELECT * FROM (SELECT source, scope, baseline, count(*) AS rows, corr(x, y) AS pooled_ic FROM rows_in GROUP BY 1, 2, 3) LEFT JOIN
    (SELECT source, scope, baseline, avg(ic) AS daily_ic_mean, stddev_pop(ic) AS daily_ic_std, count(ic) AS daily_count, avg((ic > 0)::INT) AS daily_positive_ratio
    FROM dd GROUP BY 1, 2, 3) USING (source, scope, baseline)""",
    "pooled_ic daily_ic_mean daily_ic_std daily_positive_ratio", **SOURCED))
def baseline_ic_sources(spark, sf):
    """Baselines of two sources, over all rows and over the ends of sequences of three minutes."""
    rows = P.contiguous_runs(P.training_table(A.bars(spark, sf), A.FEATURES))
    rows = P.with_short_keys(rows).withColumn("source", F.when(F.col("code") % 2 == 0, "even").otherwise("odd"))
    return tidy(I.baseline_ic(rows, SPECS, {"all": F.lit(True), "endpoints": F.col("run_len") >= 3}, source="source"))


@query("topk_return", oracle(
    f"""SELECT date, ic, rank_ic, count, topk_return FROM (SELECT date, {IC} FROM r GROUP BY date) JOIN (SELECT date, avg(target) AS topk_return FROM
    (SELECT *, row_number() OVER (PARTITION BY date ORDER BY prediction DESC, time, code) AS k FROM xsec) WHERE k <= 5 GROUP BY date) USING (date)""",
    "ic rank_ic topk_return", r=ranked("xsec", "date")))
def topk_return(spark, sf):
    return tidy(I.topk_return(A.xsec(spark, sf), 5))


@query("metric_registry", oracle(
    """SELECT 'val/' || m AS metric, v AS value FROM (SELECT unnest(['quality/global_ic', 'quality/rank_ic', 'objective/mse', 'dist/mean/pred', 'dist/mean/target',
    'dist/std/pred', 'dist/std/target', 'dist/abs_mean/pred', 'dist/abs_mean/target', 'dist/pred_std_over_target_std']) AS m,
    unnest([corr(prediction, target), corr(rx, ry), avg(power(prediction-target, 2)), avg(prediction), avg(target), stddev_pop(prediction), stddev_pop(target),
    avg(abs(prediction)), avg(abs(target)), stddev_pop(prediction)/stddev_pop(target)]) AS v FROM r)""", "value", r=ranked("xsec", "")))
def metric_registry(spark, sf):
    return tidy(default_registry().evaluate(A.xsec(spark, sf), "val"))


@query("metric_histograms", oracle(
    """SELECT 'val/dist/' || field AS metric, CAST(least(greatest(floor((v+0.5)/0.0125)+1, 1), 80) AS INT) AS bin, count(*) AS count FROM
    (SELECT unnest(['prediction', 'target']) AS field, unnest([prediction, target]) AS v FROM xsec) GROUP BY 1, 2"""))
def metric_histograms(spark, sf):
    return default_registry().histograms(A.xsec(spark, sf), "val", -0.5, 0.5, 80)
