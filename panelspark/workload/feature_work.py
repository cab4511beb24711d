"""Features, labels, datasets and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.ranks import add_positions, add_value_ranks
from ..functions.tables import register_session_function, register_session_metrics
from ..operators import datasets as D, features as P, ic as I, partials, quality as Q, windows as window_tables
from ..plans.dataset import split_training_rows
from ..session import scratch, stored
from ..sources import writers as W
from . import adapters as A
from .adapters import tidy
from .catalog import query
from .sql import oracle

KEYS = ["StockCode", "Date", "MinuteIndex"]
COLS = A.FEATURES.feature_names
FLOATS = " ".join(COLS)
ALL = ", ".join(COLS)


# --- the flagship ------------------------------------------------------------------

@query("daily_ic_momentum", oracle(
    """SELECT date, avg(ic) AS ic, avg(rank_ic) AS rank_ic, count(ic) AS timestamps FROM (
      SELECT date, time, CASE WHEN isfinite(corr(x, y)) THEN corr(x, y) END AS ic,
      CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END AS rank_ic FROM (
        SELECT *, rank() OVER (PARTITION BY date, time ORDER BY x) + (count(*) OVER (PARTITION BY date, time, x) - 1)/2.0 AS rx,
        rank() OVER (PARTITION BY date, time ORDER BY y) + (count(*) OVER (PARTITION BY date, time, y) - 1)/2.0 AS ry FROM
        (SELECT CAST(Date % 1000000 AS INT) AS date, MinuteIndex AS time, r1 AS x, label_ret AS y FROM steps JOIN labels USING (StockCode, Date, MinuteIndex)
         WHERE r1 IS NOT NULL AND label_ret IS NOT NULL))
      GROUP BY date, time) GROUP BY date""", "ic rank_ic"))
def daily_ic_momentum(spark, sf):
    """Bars -> one-minute return -> forward label -> rank IC per timestamp -> per day."""
    bars = P.forward_label(A.bars(spark, sf), A.FEATURES.horizon, A.FEATURES.entry_lag)
    scored = P.with_short_keys(bars.withColumn("ret_1m", P.row_change("log_close", 1)))
    rows = scored.select("date", "time", "code", P.linear_score({"ret_1m": 1.0}).alias("prediction"), F.col("label_ret").alias("target"))
    return tidy(I.daily_ic(I.ic_by_timestamp(rows)))


# --- features and labels ---------------------------------------------------------------

@query("bar_features", oracle(f"SELECT StockCode, Date, MinuteIndex, {ALL} FROM feature_rows", FLOATS))
def bar_features(spark, sf):
    return tidy(P.bar_features(A.bars(spark, sf), A.FEATURES).select(*KEYS, *COLS))


@query("bucketed_bars", oracle(f"SELECT StockCode, Date, MinuteIndex, {ALL} FROM feature_rows", FLOATS))
def bucketed_bars(spark, sf):
    """The same features, from bars stored in buckets of their sessions: nothing is exchanged after the write."""
    path = scratch(spark)
    bars = W.write_bucketed_bars(A.bars(spark, sf), path.rsplit("/", 1)[1].replace("-", "_"), path, buckets=16)
    return tidy(P.bar_features(bars, A.FEATURES).select(*KEYS, *COLS))


@query("forward_label", oracle("SELECT StockCode, Date, MinuteIndex, label_ret FROM labels", "label_ret"))
def forward_label(spark, sf):
    return tidy(P.forward_label(A.bars(spark, sf), 4, 1).select(*KEYS, "label_ret"))


@query("training_table", oracle(f"SELECT StockCode, Date, MinuteIndex, {ALL}, label_ret FROM training", FLOATS + " label_ret"))
def training_table(spark, sf):
    return tidy(P.training_table(A.bars(spark, sf), A.FEATURES))


@query("inference_table", oracle(
    f"""SELECT StockCode, Date, MinuteIndex, {ALL}, CAST(NULL AS DOUBLE) AS target FROM feature_rows
    WHERE ret_3m IS NOT NULL AND vol_3m IS NOT NULL""", FLOATS))
def inference_table(spark, sf):
    return tidy(P.inference_table(A.bars(spark, sf), A.FEATURES))


def _horner(x: str, coefficients) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out})*({x}) + {c!r}::DOUBLE"
    return out


def _normal_sql(p: str) -> str:
    central = f"(({p})-0.5)*({_horner(f'0.180625-(({p})-0.5)*(({p})-0.5)', S._CENTRAL[0])})/({_horner(f'0.180625-(({p})-0.5)*(({p})-0.5)', S._CENTRAL[1])})"
    t = f"(sqrt(-ln(least({p}, 1.0-({p})))) - 1.6)"
    tail = f"(CASE WHEN ({p})<0.5 THEN -1.0 ELSE 1.0 END)*({_horner(t, S._MIDDLE[0])})/({_horner(t, S._MIDDLE[1])})"
    return f"CASE WHEN abs(({p})-0.5) <= 0.425 THEN {central} ELSE {tail} END"


@query("cross_section_gaussianize", oracle(
    f"""SELECT StockCode, Date, MinuteIndex, {_normal_sql('p1')} AS log_vol_cs, {_normal_sql('p2')} AS hl_cs FROM (
    SELECT StockCode, Date, MinuteIndex,
      least(greatest((rank() OVER (PARTITION BY Date, MinuteIndex ORDER BY log_vol) + (count(*) OVER (PARTITION BY Date, MinuteIndex, log_vol)-1)/2.0)/count(*) OVER (PARTITION BY Date, MinuteIndex), 0.001), 0.999)::DOUBLE AS p1,
      least(greatest((rank() OVER (PARTITION BY Date, MinuteIndex ORDER BY hl) + (count(*) OVER (PARTITION BY Date, MinuteIndex, hl)-1)/2.0)/count(*) OVER (PARTITION BY Date, MinuteIndex), 0.001), 0.999)::DOUBLE AS p2
    FROM feature_rows)""", "log_vol_cs hl_cs"))
def cross_section_gaussianize(spark, sf):
    rows = P.bar_features(A.bars(spark, sf), A.FEATURES)
    return tidy(P.cross_section_gaussianize(rows, ["log_vol", "hl"]).select(*KEYS, "log_vol_cs", "hl_cs"))


@query("inverse_normal", oracle(
    f"""SELECT date, code, p, {_normal_sql('q')} AS z FROM (SELECT *, least(greatest(p, 0.001), 0.999)::DOUBLE AS q FROM (SELECT date, code,
    (rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1)/2.0)/count(*) OVER (PARTITION BY date) AS p FROM xsec))""", "p z"))
def inverse_normal(spark, sf):
    rows = add_value_ranks(A.xsec(spark, sf).select("date", "code", "target"), ["date"], "target", {"pct": "p"})
    return tidy(rows.select("date", "code", "p", S.inverse_normal(S.clip("p", 1e-3, 1 - 1e-3)).alias("z")))


ZFIT = " UNION ALL ".join(
    f"SELECT '{c}' AS field, " + ("0.0::DOUBLE * count(*) AS mean, 1.0::DOUBLE + 0.0::DOUBLE * count(*) AS std" if c == "minute_norm" else f"avg({c}) AS mean, stddev_pop({c}) AS std") + " FROM training"
    for c in [*COLS, "label_ret"])


@query("fit_zscore", oracle(ZFIT, "mean std"))
def fit_zscore(spark, sf):
    return tidy(P.zscore_table(P.training_table(A.bars(spark, sf), A.FEATURES), [*COLS, "label_ret"], exclude=["minute_norm"]))


@query("apply_zscore", oracle(
    """SELECT StockCode, Date, MinuteIndex, (log_vol - (SELECT avg(log_vol) FROM training))/(SELECT stddev_pop(log_vol) FROM training) AS log_vol,
    (label_ret - (SELECT avg(label_ret) FROM training))/(SELECT stddev_pop(label_ret) FROM training) AS label_ret FROM training""", "log_vol label_ret", 7))
def apply_zscore(spark, sf):
    rows = P.training_table(A.bars(spark, sf), A.FEATURES)
    params = P.fit_zscore(rows, ["log_vol", "label_ret"])
    return tidy(P.apply_zscore(rows, params).select(*KEYS, "log_vol", "label_ret"), 7)


@query("invert_zscore", oracle("SELECT StockCode, Date, MinuteIndex, label_ret FROM training", "label_ret"))
def invert_zscore(spark, sf):
    rows = P.training_table(A.bars(spark, sf), A.FEATURES)
    params = P.fit_zscore(rows, ["label_ret"])
    return tidy(P.invert_zscore(P.apply_zscore(rows, params), params).select(*KEYS, "label_ret"))


@query("linear_score", oracle(
    "SELECT StockCode, Date, MinuteIndex, ret_1m + 0.5*ret_2m + 0.25*ret_3m AS score FROM training", "score"))
def linear_score(spark, sf):
    rows = P.training_table(A.bars(spark, sf), A.FEATURES)
    return tidy(rows.select(*KEYS, P.linear_score({"ret_1m": 1.0, "ret_2m": 0.5, "ret_3m": 0.25}).alias("score")))


@query("lagged_returns", oracle(
    """SELECT b.StockCode, b.Date, b.MinuteIndex, b.r1 AS ret_1m_current, b.p1 AS ret_1m_previous, b.r2 AS ret_2m_current, b.p2 AS ret_2m_previous,
    ln(f.Close)-ln(b.Close) AS target_A, ln(f.Close)-ln(e.Close) AS target_B, ln(f.Close)-ln(b.Close) AS target_C
    FROM (SELECT *, lag(ln(Close)) OVER s - lag(ln(Close), 2) OVER s AS p1, lag(ln(Close)) OVER s - lag(ln(Close), 3) OVER s AS p2 FROM steps
      WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)) b
    LEFT JOIN bars e ON e.StockCode=b.StockCode AND e.Date=b.Date AND e.MinuteIndex=b.MinuteIndex+1
    LEFT JOIN bars f ON f.StockCode=b.StockCode AND f.Date=b.Date AND f.MinuteIndex=b.MinuteIndex+4""",
    "ret_1m_current ret_1m_previous ret_2m_current ret_2m_previous target_A target_B target_C"))
def lagged_returns(spark, sf):
    return tidy(P.lagged_returns(A.bars(spark, sf), [1, 2], 4).select(
        *KEYS, "ret_1m_current", "ret_1m_previous", "ret_2m_current", "ret_2m_previous", "target_A", "target_B", "target_C"))


@query("drop_zero_indicators", oracle(
    f"SELECT StockCode, Date, MinuteIndex, {', '.join(c for c in COLS if 'is_zero' not in c)} FROM feature_rows",
    " ".join(c for c in COLS if "is_zero" not in c)))
def drop_zero_indicators(spark, sf):
    return tidy(P.bar_features(A.bars(spark, sf), A.FEATURES).select(*KEYS, *P.drop_zero_indicators(COLS)))


STATES = """SELECT field, value, Date FROM (SELECT Date, unnest(['Close', 'Vol', 'ret']) AS field, unnest([Close, Vol, Close/Open - 1]) AS value FROM bars)
 WHERE isfinite(value)"""


@query("stored_moments", oracle(
    """SELECT field, count(*) AS count, any_value(m) AS mean, sqrt(avg(power(value - m, 2))) AS std,
    avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 1.5) AS skew, avg(power(value - m, 4)) / power(avg(power(value - m, 2)), 2) - 3 AS kurtosis,
    min(value) AS least, max(value) AS greatest FROM (SELECT *, avg(value) OVER (PARTITION BY field) AS m FROM states) GROUP BY field""",
    "mean std skew kurtosis least greatest", 6, states=STATES))
def stored_moments(spark, sf):
    """States of all days but the last, a wrong version of one of them replaced, the last day added: as if computed at once."""
    return tidy(partials.moments(_states(spark, sf)), 6)


@query("stored_histogram", oracle(
    """SELECT field, CAST(least(greatest(floor((value + 5) / 0.125) + 1, 1), 80) AS INT) AS bin, count(*) AS count FROM states GROUP BY 1, 2""", states=STATES))
def stored_histogram(spark, sf):
    return partials.histogram(_states(spark, sf))


def _states(spark, sf):
    bars = stored(A.bars(spark, sf).withColumn("ret", F.col("Close") / F.col("Open") - 1))
    ends = bars.agg(F.min("Date").alias("a"), F.max("Date").alias("b")).first()
    fields, path = ["Close", "Vol", "ret"], f"{scratch(spark)}/states"
    wrong = bars.withColumn("Close", F.when(F.col("Date") == ends["a"], F.lit(0.0)).otherwise(F.col("Close")))
    partials.update_states(partials.day_states(wrong.where(F.col("Date") < ends["b"]), fields), path)
    return partials.update_states(partials.day_states(bars.where(F.col("Date").isin(ends["a"], ends["b"])), fields), path)


# --- sequences ---------------------------------------------------------------------------

RUNS = """SELECT *, CAST(row_number() OVER (PARTITION BY StockCode, Date, g ORDER BY MinuteIndex) AS INT) AS run_len FROM
 (SELECT *, MinuteIndex - row_number() OVER (PARTITION BY StockCode, Date ORDER BY MinuteIndex) AS g FROM bars)"""


@query("valid_windows", oracle("SELECT StockCode, Date, MinuteIndex, run_len FROM runs WHERE run_len >= 3", runs=RUNS))
def valid_windows(spark, sf):
    return P.valid_windows(A.bars(spark, sf), 3).select(*KEYS, "run_len")


@query("sequence_windows", oracle(
    """SELECT StockCode, Date, MinuteIndex, CAST(3 AS INT) AS length, c0 + c1 + c2 AS close_sum, c2 AS first_close FROM
    (SELECT *, CAST(CAST(Close AS FLOAT) AS DOUBLE) AS c0, lag(CAST(CAST(Close AS FLOAT) AS DOUBLE)) OVER s AS c1,
     lag(CAST(CAST(Close AS FLOAT) AS DOUBLE), 2) OVER s AS c2 FROM runs
     WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)) WHERE run_len >= 3""", "close_sum first_close", 4, runs=RUNS))
def sequence_windows(spark, sf):
    rows = P.sequence_windows(A.bars(spark, sf), ["Close", "Vol"], 3)
    total = F.aggregate("window", F.lit(0.0), lambda acc, step: acc + step[0].cast("double"))
    return tidy(rows.select(*KEYS, F.size("window").alias("length"), total.alias("close_sum"), F.col("window")[0][0].cast("double").alias("first_close")), 4)


@query("batch_score", oracle("SELECT Date, MinuteIndex, StockCode, (2.0*ret_1m - ret_2m)*0.5 + 0.1 AS prediction FROM training", "prediction"))
def batch_score(spark, sf):
    rows = P.training_table(A.bars(spark, sf), A.FEATURES)
    return tidy(D.batch_score(rows, lambda b: 2.0 * b["ret_1m"] - b["ret_2m"], ["Date", "MinuteIndex", "StockCode"], label_scale=(0.1, 0.5)))


@query("batch_score_windows", oracle(
    """SELECT Date, MinuteIndex, StockCode, ((c0 + c1 + c2) / 3 - v1) * 0.5 + 0.1 AS prediction FROM
    (SELECT *, CAST(CAST(Close AS FLOAT) AS DOUBLE) AS c0, lag(CAST(CAST(Close AS FLOAT) AS DOUBLE)) OVER s AS c1,
     lag(CAST(CAST(Close AS FLOAT) AS DOUBLE), 2) OVER s AS c2, lag(CAST(CAST(Vol AS FLOAT) AS DOUBLE)) OVER s AS v1 FROM runs
     WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)) WHERE run_len >= 3""", "prediction", 4, runs=RUNS))
def batch_score_windows(spark, sf):
    """A model of windows of three minutes and two columns, over blocks with their lead-in rows."""
    score = lambda w: w[:, :, 0].astype("float64").mean(axis=1) - w[:, 1, 1]
    return tidy(D.batch_score(A.bars(spark, sf), score, ["Date", "MinuteIndex", "StockCode"], (0.1, 0.5), ["Close", "Vol"], 3), 4)


@query("session_metrics_sql", oracle(
    """SELECT StockCode, Date, max(CAST(climb AS DOUBLE)) AS longest_rise, min(fall) AS worst_fall FROM
    (SELECT *, sum(CAST(up AS INT)) OVER (PARTITION BY StockCode, Date, run ORDER BY MinuteIndex) AS climb FROM
    (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER s AS run FROM
    (SELECT *, coalesce(Close > lag(Close) OVER s, false) AS up, Close / max(Close) OVER s - 1 AS fall FROM bars
    WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex))
    WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)))
    GROUP BY StockCode, Date""", "worst_fall"))
def session_metrics_sql(spark, sf):
    """Metrics in Python that follow the order of a session, called from SQL."""
    def longest_rise(session):
        best = run = 0
        for a, b in zip(session["Close"], session["Close"][1:]):
            run = run + 1 if b > a else 0
            best = max(best, run)
        return float(best)

    def worst_fall(session):
        top, worst = 0.0, 0.0
        for x in session["Close"]:
            top = max(top, x)
            worst = min(worst, x / top - 1)
        return worst

    register_session_metrics(spark, "panel_shape", {"longest_rise": longest_rise, "worst_fall": worst_fall}, ["Close"])
    return tidy(spark.sql("SELECT * FROM panel_shape(TABLE({bars}))", bars=A.bars(spark, sf)))


@query("session_model_sql", oracle(
    """SELECT StockCode, Date, MinuteIndex, Close / (sum(Amount) OVER s / sum(Vol) OVER s) - 1 AS gap FROM bars
    WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)""", "gap"))
def session_model_sql(spark, sf):
    """A model of whole sessions called from SQL: the close against the session's average price so far."""
    def gap(session):
        import numpy as np

        close, vol, amount = (np.array(session[c], float) for c in ("Close", "Vol", "Amount"))
        return {"gap": close / (np.cumsum(amount) / np.cumsum(vol)) - 1}

    register_session_function(spark, "panel_gap", gap, ["Close", "Vol", "Amount"], {"gap": "double"})
    return tidy(spark.sql("SELECT * FROM panel_gap(TABLE({bars}))", bars=A.bars(spark, sf)))


@query("window_blocks", oracle(
    """SELECT StockCode, Date, CAST(count(*) AS BIGINT) AS windows, CAST(sum(run_len + 0) AS BIGINT) AS places FROM runs WHERE run_len >= 3 GROUP BY ALL""",
    runs=RUNS))
def window_blocks(spark, sf):
    """Blocks of at most four windows of three minutes, written and read back: their windows by session."""
    bars = P.contiguous_runs(A.bars(spark, sf)).withColumnRenamed("run_len", "place").drop("run_id")
    blocks = stored(window_tables.window_blocks(bars, ["Close", "Vol"], 3, ["StockCode", "Date", "place"], block=4))
    whole = blocks.where(F.size("steps") == 2 * (F.size("ends") + 2))
    return whole.select(F.explode("ends").alias("e")).groupBy("e.StockCode", "e.Date").agg(
        F.count("*").alias("windows"), F.sum("e.place").alias("places"))


# --- splits --------------------------------------------------------------------------------

DATES = "SELECT Date AS date, row_number() OVER (ORDER BY Date) - 1 AS i, count(*) OVER () AS n FROM calendar"


def _dates(spark, sf):
    return A.calendar(spark, sf).withColumnRenamed("Date", "date")


@query("split_by_counts", oracle(
    "SELECT date, CASE WHEN i < 50 THEN 'train' WHEN i < 60 THEN 'val' ELSE 'test' END AS split FROM days WHERE i < 75", days=DATES))
def split_by_counts(spark, sf):
    return D.split_by_counts(_dates(spark, sf), 50, 10, 15)


@query("split_by_ranges", oracle(
    "SELECT Date AS date, CASE WHEN Date <= 20190101 THEN 'train' WHEN Date <= 20200101 THEN 'val' ELSE 'test' END AS split FROM calendar"))
def split_by_ranges(spark, sf):
    return D.split_by_ranges(_dates(spark, sf), 20190101, 20200101)


@query("split_tail_holdout", oracle(
    "SELECT date, CASE WHEN n-1-i < 12 THEN 'test' WHEN n-1-i < 18 THEN 'val' ELSE 'train' END AS split FROM days", days=DATES))
def split_tail_holdout(spark, sf):
    return D.split_tail_holdout(_dates(spark, sf), 6, 12)


@query("rolling_folds", oracle(
    """SELECT CAST(f AS INT) AS fold, date, CASE WHEN i - f*10 < 24 THEN 'train' WHEN i - f*10 < 30 THEN 'val' ELSE 'test' END AS split
    FROM days, range(0, 100) r(f) WHERE f*10 + 36 <= n AND i >= f*10 AND i < f*10 + 36""", days=DATES))
def rolling_folds(spark, sf):
    return D.rolling_folds(_dates(spark, sf), 24, 6, 6, 10)


@query("split_training_rows", oracle(
    """SELECT CASE WHEN t.Date <= 20190101 THEN 'train' WHEN t.Date <= 20200101 THEN 'val' ELSE 'test' END AS split,
    count(*) AS row_count, avg(label_ret) AS mean_label FROM training t GROUP BY 1""", "mean_label"))
def training_rows_by_split(spark, sf):
    splits = D.split_by_ranges(_dates(spark, sf), 20190101, 20200101, check=False)
    return tidy(split_training_rows(A.bars(spark, sf), splits, A.FEATURES).groupBy("split").agg(
        F.count("*").alias("row_count"), F.avg("label_ret").alias("mean_label")))


COMPLETE = """SELECT Date, StockCode, row_number() OVER (ORDER BY Date, StockCode) - 1 AS run FROM
 (SELECT Date, StockCode FROM bars GROUP BY 1, 2 HAVING count(*) = 7)"""


@query("code_day_runs", oracle(
    """SELECT CASE WHEN run < 20 THEN 'train' WHEN run < 25 THEN 'val' ELSE 'test' END AS split, CAST(run AS INT) AS run,
    count(*) AS row_count, sum(Vol) AS volume FROM bars JOIN complete USING (Date, StockCode) WHERE run < 40 GROUP BY 1, 2""",
    "volume", complete=COMPLETE))
def code_day_runs(spark, sf):
    bars = A.bars(spark, sf)
    rows = D.take_runs(bars, D.code_day_runs(bars, 7, 40), 20, 5)
    return tidy(rows.groupBy("split", "run").agg(F.count("*").alias("row_count"), F.sum("Vol").alias("volume")))


@query("shift_labels_one_run", oracle(
    """SELECT a.StockCode, a.Date, a.MinuteIndex, b.Close AS given FROM numbered a LEFT JOIN numbered b
    ON b.run % b.runs + 1 = a.run AND b.pos = a.pos""", "given",
    numbered="""SELECT *, dense_rank() OVER (ORDER BY Date, StockCode) AS run, row_number() OVER (PARTITION BY Date, StockCode ORDER BY MinuteIndex) AS pos,
    (SELECT count(*) FROM (SELECT DISTINCT Date, StockCode FROM bars)) AS runs FROM bars"""))
def shift_labels_one_run(spark, sf):
    rows = D.shift_labels_one_run(A.bars(spark, sf).select(*KEYS, F.col("Close").alias("given")), "given")
    return tidy(rows.select(*KEYS, "given"))


@query("shuffle_labels", oracle(
    """SELECT a.date, a.code, b.target FROM (SELECT date, code, row_number() OVER (ORDER BY date, code) AS k FROM xsec) a
    JOIN (SELECT target, row_number() OVER (ORDER BY md5('7|'||date||'|'||code), date, code) AS k FROM xsec) b USING (k)""", "target"))
def shuffle_labels(spark, sf):
    return tidy(D.shuffle_labels(A.xsec(spark, sf).select("date", "code", "target"), "target", ["date", "code"], 7))


# --- quality -------------------------------------------------------------------------------

def _stats_sql(c: str) -> str:
    fin = f"CASE WHEN isfinite({c}) THEN {c} END"
    return f"""SELECT '{c}' AS field, count(*) AS total_count, count({fin}) AS finite_count, count(*) FILTER ({c} IS NULL OR isnan({c})) AS nan_count,
    count(*) FILTER ({c} = 'infinity'::DOUBLE) AS posinf_count, count(*) FILTER ({c} = '-infinity'::DOUBLE) AS neginf_count,
    avg({fin}) AS mean, stddev_pop({fin}) AS std,
    avg(power(({fin} - (SELECT avg({fin}) FROM dirty))/(SELECT stddev_pop({fin}) FROM dirty), 3)) AS skew,
    avg(power(({fin} - (SELECT avg({fin}) FROM dirty))/(SELECT stddev_pop({fin}) FROM dirty), 4)) - 3 AS kurtosis,
    min({fin}) AS min_finite, max({fin}) AS max_finite,
    count(*) FILTER ({c} IS NULL OR isnan({c}))/count(*) AS nan_ratio, 1 - count({fin})/count(*) AS invalid_ratio FROM dirty"""


@query("invalid_value_stats", oracle(
    " UNION ALL ".join(_stats_sql(c) for c in ("Close", "Vol")),
    "mean std skew kurtosis min_finite max_finite nan_ratio invalid_ratio", 6))
def invalid_value_stats(spark, sf):
    return tidy(Q.invalid_value_stats(A.dirty_bars(spark, sf), ["Close", "Vol"]), 6)


MOMENTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count({c}) AS count, avg({c}) AS mean, stddev_pop({c}) AS std,
    avg(power(({c}-(SELECT avg({c}) FROM training))/(SELECT stddev_pop({c}) FROM training), 3)) AS skew,
    avg(power(({c}-(SELECT avg({c}) FROM training))/(SELECT stddev_pop({c}) FROM training), 4))-3 AS kurtosis FROM training"""
    for c in ("ret_1m", "hl", "log_vol"))


@query("feature_moments", oracle(MOMENTS, "mean std skew kurtosis", 6))
def feature_moments(spark, sf):
    return tidy(Q.feature_moments(P.training_table(A.bars(spark, sf), A.FEATURES), ["ret_1m", "hl", "log_vol"]), 6)


@query("feature_shift", oracle(
    "SELECT max(abs(mean)) AS max_abs_mean, max(abs(std-1)) AS max_std_shift, max(abs(skew)) AS max_abs_skew, max(kurtosis) AS max_kurtosis FROM m",
    "max_abs_mean max_std_shift max_abs_skew max_kurtosis", 6, m=MOMENTS))
def feature_shift(spark, sf):
    return tidy(Q.feature_shift(Q.feature_moments(P.training_table(A.bars(spark, sf), A.FEATURES), ["ret_1m", "hl", "log_vol"])), 6)


@query("feature_histogram", oracle(
    """SELECT field, CAST(least(greatest(floor((v+5.0)/0.125)+1, 1), 80) AS INT) AS bin, count(*) AS count FROM
    (SELECT unnest(['ret_1m', 'log_vol', 'oc']) AS field, unnest([ret_1m, log_vol, oc]) AS v FROM training) GROUP BY 1, 2"""))
def feature_histogram(spark, sf):
    return Q.fixed_histogram(P.training_table(A.bars(spark, sf), A.FEATURES), ["ret_1m", "log_vol", "oc"])


@query("label_audit", oracle(
    """SELECT Date, count(*) AS row_count, count(*) FILTER (bad) AS invalid_rows, count(*) FILTER (nf AND NOT raw) AS raw_absent_rows,
    count(*) FILTER (nf AND raw) AS filtered_rows, count(*) FILTER (ne) AS missing_entry_rows, count(*) FILTER (bad AND NOT nf AND NOT ne) AS other_rows,
    avg(bad::INT) AS invalid_ratio, avg((nf AND NOT raw)::INT) AS raw_absent_ratio, avg((nf AND raw)::INT) AS filtered_ratio,
    avg(ne::INT) AS missing_entry_ratio, avg((bad AND NOT nf AND NOT ne)::INT) AS other_ratio FROM (
      SELECT b.Date, f.Close IS NULL AS nf, e.Close IS NULL AS ne, f.Close IS NULL OR e.Close IS NULL AS bad,
      EXISTS (SELECT 1 FROM dirty d WHERE d.StockCode=b.StockCode AND d.Date=b.Date AND d.MinuteIndex=b.MinuteIndex+4) AS raw
      FROM good b LEFT JOIN good e ON e.StockCode=b.StockCode AND e.Date=b.Date AND e.MinuteIndex=b.MinuteIndex+1
      LEFT JOIN good f ON f.StockCode=b.StockCode AND f.Date=b.Date AND f.MinuteIndex=b.MinuteIndex+4 WHERE b.MinuteIndex <= 11)
    GROUP BY Date""", "invalid_ratio raw_absent_ratio filtered_ratio missing_entry_ratio other_ratio",
    good="SELECT * FROM dirty WHERE isfinite(Close) AND Close > 0"))
def label_audit(spark, sf):
    return tidy(Q.label_audit(A.dirty_bars(spark, sf), A.FEATURES))


@query("kept_by_minute", oracle(
    "SELECT CAST(m AS INT) AS MinuteIndex, (SELECT count(*) FROM training WHERE MinuteIndex = m) AS kept_rows FROM range(0, 12) t(m)"))
def kept_by_minute(spark, sf):
    return Q.kept_by_minute(P.training_table(A.bars(spark, sf), A.FEATURES), 4, A.LAST)


@query("drop_by_code", oracle(
    """SELECT StockCode, count(*) AS days, CAST(sum(k) AS BIGINT) AS kept_minutes, CAST(count(*)*10 - sum(k) AS BIGINT) AS missing_minutes,
    (count(*)*10 - sum(k))/(count(*)*10.0) AS drop_ratio FROM (SELECT StockCode, Date, count(DISTINCT MinuteIndex) AS k FROM training GROUP BY 1, 2) GROUP BY StockCode""",
    "drop_ratio"))
def drop_by_code(spark, sf):
    return tidy(Q.drop_by_code(P.training_table(A.bars(spark, sf), A.FEATURES), A.FEATURES))


@query("audit_rates", oracle(
    """SELECT s.Date, s.split, (SELECT count(*) FROM bars b WHERE b.Date=s.Date) AS raw_rows, (SELECT count(*) FROM training t WHERE t.Date=s.Date) AS kept_rows,
    CAST(coalesce((SELECT sum(k) FROM (SELECT least(count(*), 2) AS k FROM training t WHERE t.Date=s.Date GROUP BY MinuteIndex)), 0) AS BIGINT) AS sampled_rows,
    (SELECT count(*) FROM training t WHERE t.Date=s.Date)/nullif((SELECT count(*) FROM bars b WHERE b.Date=s.Date), 0) AS kept_rate,
    (SELECT sum(k) FROM (SELECT least(count(*), 2) AS k FROM training t WHERE t.Date=s.Date GROUP BY MinuteIndex))/nullif((SELECT count(*) FROM training t WHERE t.Date=s.Date), 0) AS sampled_rate
    FROM (SELECT Date, CASE WHEN Date <= 20190101 THEN 'train' WHEN Date <= 20200101 THEN 'val' ELSE 'test' END AS split FROM calendar) s""",
    "kept_rate sampled_rate"))
def audit_rates(spark, sf):
    bars = A.bars(spark, sf)
    kept = P.training_table(bars, A.FEATURES)
    sampled = D.sample_per_group(kept, ["Date", "MinuteIndex"], 2, 5, ["StockCode"])
    splits = D.split_by_ranges(_dates(spark, sf), 20190101, 20200101, check=False)
    return tidy(Q.audit_rates(bars, kept, sampled, splits))


VALIDATION = """SELECT CAST(coalesce(sum(l), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(r), 0) AS BIGINT) AS right_rows, count(l) AS left_keys, count(r) AS right_keys,
 count(*) FILTER (l > 1) AS left_duplicate_keys, count(*) FILTER (r > 1) AS right_duplicate_keys, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS joined_keys,
 count(*) FILTER (r IS NULL) AS left_unmatched, count(*) FILTER (l IS NULL) AS right_unmatched, CAST(0 AS BIGINT) AS null_horizon_rows"""


@query("join_validation", oracle(
    f"""SELECT *, 'left_unmatched' AS failures, 'failed' AS status FROM ({VALIDATION}, CAST(min(date) AS BIGINT) AS min_date, CAST(max(date) AS BIGINT) AS max_date,
    CAST(min(time) AS BIGINT) AS min_time, CAST(max(time) AS BIGINT) AS max_time
    FROM (SELECT date, time, code, count(*) AS l FROM pred GROUP BY 1, 2, 3) a FULL OUTER JOIN
    (SELECT date, time, code, count(*) AS r FROM labeled GROUP BY 1, 2, 3) b USING (date, time, code))"""))
def join_validation(spark, sf):
    return Q.join_validation(A.pred(spark, sf), A.labeled(spark, sf), ["date", "time", "code"])


@query("join_validation_duplicates", oracle(
    f"""SELECT *, 'left_duplicates,left_unmatched' AS failures, 'failed' AS status FROM ({VALIDATION}
    FROM (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS l FROM lineitem GROUP BY 1, 2) a FULL OUTER JOIN
    (SELECT o_orderkey AS k, 1 AS n, count(*) AS r FROM orders GROUP BY 1, 2) b USING (k, n))"""))
def join_validation_duplicates(spark, sf):
    left = A.lineitem(spark, sf).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    right = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("n"))
    return Q.join_validation(left, right, ["k", "n"])


@query("compare_sources", oracle(
    """SELECT count(*) AS matched_rows, max(abs(a.label_ret-b.target_A)) AS max_abs_diff, avg(abs(a.label_ret-b.target_A)) AS mean_abs_diff,
    corr(a.label_ret, b.target_A) AS correlation FROM training a JOIN
    (SELECT b.StockCode, b.Date, b.MinuteIndex, ln(f.Close)-ln(b.Close) AS target_A FROM bars b JOIN bars f ON f.StockCode=b.StockCode AND f.Date=b.Date AND f.MinuteIndex=b.MinuteIndex+4) b
    USING (StockCode, Date, MinuteIndex)""", "max_abs_diff mean_abs_diff correlation"))
def compare_sources(spark, sf):
    bars = A.bars(spark, sf)
    raw = P.lagged_returns(bars, [1], 4).where(F.col("target_A").isNotNull()).select(*KEYS, F.col("target_A").alias("label_ret"))
    return tidy(Q.compare_sources(P.training_table(bars, A.FEATURES), raw, KEYS, "label_ret"))


@query("numbered_runs_ranged", oracle(
    "SELECT Date, StockCode, row_number() OVER (ORDER BY Date, StockCode) AS run FROM (SELECT DISTINCT Date, StockCode FROM bars)"))
def numbered_runs_ranged(spark, sf):
    return add_positions(A.bars(spark, sf).select("Date", "StockCode").distinct(), [], ["Date", "StockCode"], rn="run")
