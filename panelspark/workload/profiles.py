"""Signal profiles and benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import column_quantiles
from ..operators import ic as I, signal as G
from ..session import stored
from . import adapters as A
from .adapters import tidy
from .catalog import query
from .evaluation import CURVE, _fin, _roll, ranked
from .sql import oracle

BUCKETED = "SELECT *, CAST(ntile(10) OVER (PARTITION BY date, time ORDER BY prediction, code) AS INT) AS signal_bucket FROM xsec"
BUCKET_DAILY = """SELECT date, signal_bucket, count(*) AS row_count, avg(prediction) AS mean_prediction, avg(target)*1e4 AS mean_return_bps,
 avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM bucketed GROUP BY 1, 2"""
BUCKETS = """SELECT signal_bucket, avg(row_count) AS row_count, avg(mean_prediction) AS mean_prediction, avg(mean_return_bps) AS mean_return_bps,
 avg(mean_return_bps)*sqrt(count(*))/stddev_samp(mean_return_bps) AS t_stat, avg(hit_rate) AS hit_rate FROM bucket_daily GROUP BY 1"""
B = {"bucketed": BUCKETED, "bucket_daily": BUCKET_DAILY, "buckets": BUCKETS}


@query("signal_bucket_daily", oracle("SELECT * FROM bucket_daily", "mean_prediction mean_return_bps hit_rate", 6, **B))
def signal_bucket_daily(spark, sf):
    return tidy(G.signal_bucket_daily(A.xsec(spark, sf)), 6)


@query("signal_buckets", oracle("SELECT * FROM buckets", "row_count mean_prediction mean_return_bps t_stat hit_rate", 6, **B))
def signal_buckets(spark, sf):
    return tidy(G.signal_buckets(A.xsec(spark, sf)), 6)


SIGNAL = """SELECT *, CAST(ntile(10) OVER (PARTITION BY date, time ORDER BY prediction, code) AS INT) AS signal_decile,
 CAST(ntile(3) OVER (PARTITION BY date, time ORDER BY signal_amount DESC, code) AS INT) AS liq_bucket FROM
 (SELECT date, time, minute_slot, code, prediction, ret_vwap_exec_10 AS simple_return, signal_amount, count(*) OVER (PARTITION BY date, time) AS names
  FROM feats WHERE prediction IS NOT NULL AND ret_vwap_exec_10 IS NOT NULL AND signal_amount IS NOT NULL AND minute_slot % 2 = 0) WHERE names >= 5"""
SPREAD = "CASE liq_bucket WHEN 1 THEN 5.0 WHEN 2 THEN 10.0 ELSE 20.0 END"
S = {"signal": f"SELECT *, {SPREAD} AS spread_bps FROM ({SIGNAL})"}


def _base(spark, sf):
    return G.signal_base(A.feats(spark, sf), A.MIN_NAMES, A.GRID)


@query("signal_base", oracle("SELECT * EXCLUDE (names) FROM signal", "prediction simple_return signal_amount spread_bps", **S))
def signal_base(spark, sf):
    return tidy(_base(spark, sf))


DECILE_DAILY = """SELECT date, signal_decile, count(*) AS row_count, avg(prediction) AS mean_prediction, avg(simple_return) AS mean_return,
 avg(spread_bps) AS mean_spread_bps FROM signal GROUP BY 1, 2"""
D = {**S, "decile_daily": DECILE_DAILY}


@query("decile_daily", oracle("SELECT * FROM decile_daily", "mean_prediction mean_return mean_spread_bps", **D))
def decile_daily(spark, sf):
    return tidy(G.decile_daily(_base(spark, sf)))


@query("decile_summary", oracle(
    """SELECT signal_decile, avg(mean_return) AS mean_daily_return, stddev_samp(mean_return) AS std_daily_return, avg((mean_return > 0)::INT) AS hit_rate,
    avg(mean_prediction) AS mean_prediction, avg(mean_spread_bps) AS mean_spread_bps, avg(row_count) AS mean_row_count, avg(mean_return)*1e4 AS daily_return_bps,
    avg(mean_return)/stddev_samp(mean_return)*sqrt((SELECT count(DISTINCT date) FROM decile_daily)) AS t_stat FROM decile_daily GROUP BY 1""",
    "mean_daily_return std_daily_return hit_rate mean_prediction mean_spread_bps mean_row_count daily_return_bps t_stat", 6, **D))
def decile_summary(spark, sf):
    return tidy(G.decile_summary(G.decile_daily(_base(spark, sf))), 6)


PIVOT = ", ".join(f"max(mean_return) FILTER (signal_decile = {k}) AS d{k}" for k in range(1, 11))


@query("decile_pivot", oracle(f"SELECT date, {PIVOT} FROM decile_daily GROUP BY date", " ".join(f"d{k}" for k in range(1, 11)), **D))
def decile_pivot(spark, sf):
    return tidy(G.decile_pivot(G.decile_daily(_base(spark, sf))))


MONO = {
    **B, "bd": "SELECT date, signal_bucket AS b, mean_return_bps/1e4 AS v FROM bucket_daily",
    "br": ranked("bd", "date", "b", "v"),
    "mono": f"""SELECT *, product(1 + top_minus_bottom) OVER (ORDER BY date) - 1 AS cum_top_minus_bottom FROM (
    SELECT date, max(v) FILTER (b = 10) AS top_decile_return, max(v) FILTER (b = 1) AS bottom_decile_return,
    max(v) FILTER (b = 10) - max(v) FILTER (b = 1) AS top_minus_bottom, {_fin('corr(rx, ry)')} AS spearman_decile_return
    FROM br GROUP BY date)""",
}
MONO_COLS = "top_decile_return bottom_decile_return top_minus_bottom spearman_decile_return cum_top_minus_bottom"


def _mono(spark, sf):
    daily = G.signal_bucket_daily(A.xsec(spark, sf)).withColumn("ret", F.col("mean_return_bps") / 1e4)
    return G.monotonicity(daily, "signal_bucket", "ret")


@query("monotonicity", oracle("SELECT * FROM mono", MONO_COLS, 6, **MONO))
def monotonicity(spark, sf):
    return tidy(_mono(spark, sf), 6)


@query("monotonicity_summary", oracle(
    """SELECT count(*) AS day_count, avg(top_minus_bottom) AS mean_top_minus_bottom, avg((top_minus_bottom > 0)::INT) AS positive_spread_ratio,
    avg(spearman_decile_return) AS mean_spearman, avg((spearman_decile_return > 0)::INT) AS positive_spearman_ratio FROM mono""",
    "mean_top_minus_bottom positive_spread_ratio mean_spearman positive_spearman_ratio", **MONO))
def monotonicity_summary(spark, sf):
    return tidy(G.monotonicity_summary(_mono(spark, sf)))


LIQUIDITY = """SELECT liq_bucket, signal_decile, count(*) AS row_count, avg(simple_return) AS mean_return, avg(spread_bps) AS mean_spread_bps,
 avg(simple_return - 0.5*spread_bps/10000.0 - 1.0/10000.0) AS mean_entry_net_proxy, avg(simple_return)*1e4 AS gross_return_bps,
 avg(simple_return - 0.5*spread_bps/10000.0 - 1.0/10000.0)*1e4 AS entry_net_proxy_bps FROM signal GROUP BY 1, 2"""


@query("liquidity_by_signal", oracle(LIQUIDITY, "mean_return mean_spread_bps mean_entry_net_proxy gross_return_bps entry_net_proxy_bps", 6, **S))
def liquidity_by_signal(spark, sf):
    return tidy(G.liquidity_by_signal(_base(spark, sf)), 6)


TIMES = "SELECT time, count(*) AS row_count, avg(target)*1e4 AS mean_return_bps, count(DISTINCT code) AS code_count FROM labeled GROUP BY time"


@query("time_bucket_metrics", oracle(TIMES, "mean_return_bps", 6))
def time_bucket_metrics(spark, sf):
    return tidy(G.time_bucket_metrics(A.labeled(spark, sf)), 6)


BEST = """SELECT arg_max(time, mean_return_bps) AS best_time, max(mean_return_bps) AS best_value, arg_min(time, mean_return_bps) AS worst_time,
 min(mean_return_bps) AS worst_value FROM times"""


@query("best_worst_time", oracle(BEST, "best_value worst_value", 6, times=TIMES))
def best_worst_time(spark, sf):
    return tidy(G.best_worst_time(G.time_bucket_metrics(A.labeled(spark, sf))), 6)


EXTREME = """SELECT extreme_type, count(*) AS row_count, avg((signal_bucket = 10)::INT) AS top_decile_share, avg((signal_bucket = 1)::INT) AS bottom_decile_share,
 avg(target)*1e4 AS mean_return_bps, count(*)/(SELECT count(*) FROM bucketed) AS row_ratio FROM (
 SELECT 'extreme_positive_target' AS extreme_type, * FROM bucketed WHERE target >= (SELECT quantile_cont(target, 0.995) FROM bucketed) UNION ALL
 SELECT 'extreme_negative_target', * FROM bucketed WHERE target <= (SELECT quantile_cont(target, 0.005) FROM bucketed)) GROUP BY 1"""


@query("extreme_target_profile", oracle(EXTREME, "top_decile_share bottom_decile_share mean_return_bps row_ratio", 6, **B))
def extreme_target_profile(spark, sf):
    return tidy(G.extreme_target_profile(A.xsec(spark, sf)), 6)


SCALE = ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, avg(abs({c})) AS {c}_abs_mean, quantile_cont({c}, 0.01) AS {c}_p01, quantile_cont({c}, 0.5) AS {c}_p50, quantile_cont({c}, 0.99) AS {c}_p99"
    for c in ("prediction", "target"))
SCALE_COLS = " ".join(f"{c}_{s}" for c in ("prediction", "target") for s in ("mean", "std", "abs_mean", "p01", "p50", "p99"))


@query("prediction_scale", oracle(f"SELECT {SCALE}, stddev_samp(prediction)/stddev_samp(target) AS std_ratio FROM xsec", SCALE_COLS + " std_ratio"))
def prediction_scale(spark, sf):
    return tidy(G.prediction_scale(A.xsec(spark, sf)))


@query("mse_by_model", oracle(
    """SELECT model, avg(power(m*prediction - target, 2)) AS mse, count(*) AS count, rank() OVER (ORDER BY avg(power(m*prediction - target, 2))) AS metric_rank,
    CASE WHEN rank() OVER (ORDER BY avg(power(m*prediction - target, 2))) = 1 THEN 'promote' ELSE 'reject' END AS decision
    FROM xsec, (VALUES ('m0', 0.0::DOUBLE), ('m1', 1.0::DOUBLE), ('m2', 0.5::DOUBLE)) t(model, m) GROUP BY model""", "mse"))
def mse_by_model(spark, sf):
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m).alias("m")) for n, m in (("m0", 0.0), ("m1", 1.0), ("m2", 0.5))])
    rows = A.xsec(spark, sf).select("prediction", "target", F.inline(models)).withColumn("prediction", F.col("m") * F.col("prediction"))
    return tidy(G.best_candidate(G.mse(rows, ["model"])))


@query("bootstrap_ci", oracle(
    """SELECT avg(value) AS mean, stddev_samp(value) AS std, count(*) AS sample_count, any_value(i.ci_025) AS ci_025, any_value(i.ci_500) AS ci_500,
    any_value(i.ci_975) AS ci_975, any_value(i.bootstrap_samples) AS bootstrap_samples FROM series, (
    SELECT quantile_cont(m, 0.025) AS ci_025, quantile_cont(m, 0.5) AS ci_500, quantile_cont(m, 0.975) AS ci_975, count(*) AS bootstrap_samples FROM (
    SELECT b, avg(s.value) AS m FROM (SELECT b, CAST('0x'||substr(md5('7|'||b||'|'||k), 1, 15) AS BIGINT) % n + 1 AS pick FROM series, range(500) t(b)) d
    JOIN series s ON s.k = d.pick GROUP BY b)) i""", "mean std ci_025 ci_500 ci_975",
    series="""SELECT *, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT date, avg(target) AS value FROM xsec GROUP BY date)"""))
def bootstrap_ci(spark, sf):
    daily = A.xsec(spark, sf).groupBy("date").agg(F.avg("target").alias("value"))
    return tidy(G.bootstrap_ci(daily, "value", samples=500))


MONTHLY = "SELECT CAST(date//100 AS INT) AS month, avg(top_minus_bottom)*1e4 AS mean_bps, avg((top_minus_bottom > 0)::INT) AS positive_ratio, count(top_minus_bottom) AS day_count FROM mono GROUP BY 1"


@query("monthly_stability", oracle(MONTHLY, "mean_bps positive_ratio", 6, **MONO))
def monthly_stability(spark, sf):
    return tidy(G.monthly_stability(_mono(spark, sf)), 6)


@query("join_monthly", oracle(
    f"""SELECT month, a.mean_bps, a.positive_ratio, a.day_count, b.trades FROM ({MONTHLY}) a FULL OUTER JOIN
    (SELECT CAST(date//100 AS INT) AS month, count(*) AS trades FROM xsec WHERE amount > 50000 GROUP BY 1) b USING (month)""",
    "mean_bps positive_ratio", 6, **MONO))
def join_monthly(spark, sf):
    traded = A.xsec(spark, sf).where("amount > 50000").groupBy(F.floor(F.col("date") / 100).cast("int").alias("month")).agg(F.count("*").alias("trades"))
    return tidy(G.join_monthly(G.monthly_stability(_mono(spark, sf)), traded), 6)


@query("regime_stability", oracle(
    """SELECT CASE WHEN a <= (SELECT quantile_cont(abs(top_minus_bottom), 1/3::DOUBLE) FROM mono) THEN 'low_abs_gross'
    WHEN a <= (SELECT quantile_cont(abs(top_minus_bottom), 2/3::DOUBLE) FROM mono) THEN 'mid_abs_gross' ELSE 'high_abs_gross' END AS regime,
    count(*) AS day_count, avg(top_minus_bottom)*1e4 AS mean_bps FROM (SELECT *, abs(top_minus_bottom) AS a FROM mono) GROUP BY 1""", "mean_bps", 6, **MONO))
def regime_stability(spark, sf):
    return tidy(G.regime_stability(_mono(spark, sf)), 6)


CUTS = ", ".join(f"quantile_cont(group_center_rank, {k}/5::DOUBLE) AS q{k}" for k in range(1, 5))


@query("curve_stability", oracle(
    f"""SELECT CAST(CASE WHEN group_center_rank <= q1 THEN 1 WHEN group_center_rank <= q2 THEN 2 WHEN group_center_rank <= q3 THEN 3 WHEN group_center_rank <= q4 THEN 4 ELSE 5 END AS INT) AS bucket,
    CAST(sum(count) AS BIGINT) AS row_count, avg(mean_ic) AS mean_ic, avg(mean_rank_ic) AS mean_rank_ic, min(group_center_rank) AS center_rank_min,
    max(group_center_rank) AS center_rank_max FROM curve, (SELECT {CUTS} FROM curve) GROUP BY 1""",
    "mean_ic mean_rank_ic center_rank_min center_rank_max", 6, **_roll("date", "amount, code"), curve=CURVE))
def curve_stability(spark, sf):
    curve = I.rolling_group_ic(A.xsec(spark, sf), "amount", A.ROLL_WINDOW, A.ROLL_STEP)
    return tidy(G.curve_stability(curve), 6)


@query("signal_proxy_strategy", oracle(
    """SELECT 'top_minus_bottom' AS strategy_name, g AS gross_daily_return_bps, g AS net_daily_return_bps, 1.0 AS daily_turnover, g AS gross_bps_per_turnover,
    g AS net_bps_per_turnover, a AS active_names FROM (SELECT max(mean_return_bps) FILTER (signal_bucket = 10) - max(mean_return_bps) FILTER (signal_bucket = 1) AS g,
    max(row_count) FILTER (signal_bucket = 10) AS a FROM buckets)""",
    "gross_daily_return_bps net_daily_return_bps daily_turnover gross_bps_per_turnover net_bps_per_turnover active_names", 6, **B))
def signal_proxy_strategy(spark, sf):
    return tidy(G.signal_proxy_strategy(G.signal_buckets(A.xsec(spark, sf))), 6)


@query("headline_summary", oracle(
    """SELECT t AS top_decile_return_bps, b AS bottom_decile_return_bps, u AS universe_return_bps, t - b AS top_minus_bottom_bps, u - b AS short_avoidance_bps,
    (SELECT max(entry_net_proxy_bps) FROM liq WHERE liq_bucket = 1 AND signal_decile = 10) AS high_liq_top_net_bps, best.* FROM
    (SELECT max(mean_return_bps) FILTER (signal_bucket = 10) AS t, max(mean_return_bps) FILTER (signal_bucket = 1) AS b, avg(mean_return_bps) AS u FROM buckets), best""",
    "top_decile_return_bps bottom_decile_return_bps universe_return_bps top_minus_bottom_bps short_avoidance_bps high_liq_top_net_bps best_value worst_value", 6,
    **B, **S, liq=LIQUIDITY, times=TIMES, best=BEST))
def headline_summary(spark, sf):
    return tidy(G.headline_summary(
        G.signal_buckets(A.xsec(spark, sf)), G.liquidity_by_signal(_base(spark, sf)), G.time_bucket_metrics(A.labeled(spark, sf))), 6)


SIDE = "SELECT unnest(['mean', 'std', 'p50']) AS metric, unnest([avg({c}), stddev_samp({c}), quantile_cont({c}, 0.5)]) AS value FROM xsec"


@query("compare_to_parent", oracle(
    """SELECT metric, a.value AS baseline, b.value AS experiment, b.value - a.value AS absolute_change, (b.value - a.value)/abs(nullif(a.value, 0)) AS relative_change
    FROM a FULL OUTER JOIN b USING (metric)""", "baseline experiment absolute_change relative_change", 7,
    a=SIDE.format(c="prediction"), b=SIDE.format(c="target")))
def compare_to_parent(spark, sf):
    rows = stored(A.xsec(spark, sf).select("prediction", "target"))
    middle = column_quantiles(rows, {c: {c: 0.5} for c in rows.columns}, store=False)

    def side(c):
        row = rows.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).withColumn("p50", middle.select(c).scalar())
        return G.to_metrics(row)

    return tidy(G.compare_to_parent(side("prediction"), side("target")), 7)
