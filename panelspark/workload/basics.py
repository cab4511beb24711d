"""Sources, filters, joins, aggregates, windows, scalars and sampling."""

from __future__ import annotations

from pyspark.sql import Window, functions as F
from pyspark.sql.types import StructType

from ..functions import scalar as S, stats as T
from ..functions.ranks import add_group_stats, add_positions, add_value_ranks, group_quantiles
from ..operators import datasets as D, features as P, market as M, quality as Q, signal as G
from ..schema import ContractError, DAILY, NAME_HISTORY, duplicate_keys, unique_rows
from ..sources import readers as R, writers as W
from ..sources.feather import decode_feather, store_days
from ..sources.feather_source import FeatherSource, write_feather
from ..session import scratch
from . import adapters as A
from .adapters import tidy
from .catalog import query
from .sql import oracle

PX = "Open Close High Low Vol Amount"


# --- sources -------------------------------------------------------------------

@query("bars", oracle("SELECT * FROM bars", PX))
def bars(spark, sf):
    return tidy(A.bars(spark, sf))


@query("read_bars", oracle("SELECT Date, MinuteIndex, Close FROM bars WHERE Date BETWEEN 20160101 AND 20181231", "Close"))
def read_bars(spark, sf):
    path = f"{scratch(spark)}/bars"
    rows = A.bars(spark, sf).withColumn("DateTime", F.to_timestamp_ntz(F.col("Date").cast("string"), F.lit("yyyyMMdd")))
    W.write_bars(rows, path)
    return tidy(R.read_bars(spark, path, 20160101, 20181231, ["Date", "MinuteIndex", "Close"]))


@query("list_trade_dates", oracle("SELECT DISTINCT Date AS date FROM trades WHERE Date >= 20160101 AND Date <= 20191231"))
def list_trade_dates(spark, sf):
    return R.list_trade_dates(A.calendar(spark, sf), 20160101, 20191231)


def _symbol_file(spark, sf):
    """The symbol list as a CSV file, as it arrives."""
    symbol = F.when(F.col("p_partkey") % 13 != 0, F.col("p_partkey").cast("string"))
    path = f"{scratch(spark)}/symbols"
    A.table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ts_code"), symbol.alias("symbol"),
    ).write.option("header", True).csv(path)
    return path


SYMBOLS = "SELECT DISTINCT 'P'||p_partkey AS ts_code, CAST(p_partkey AS INT) AS code FROM part WHERE p_partkey % 13 <> 0"


@query("read_symbols", oracle(SYMBOLS))
def read_symbols(spark, sf):
    return R.read_symbols(spark, _symbol_file(spark, sf))


@query("read_st_periods", oracle(
    """SELECT DISTINCT s.code, CAST(20150101 + p_size AS INT) AS start_date,
    CAST(CASE WHEN p_size % 5 = 0 THEN 99991231 ELSE 20160101 + p_size END AS INT) AS end_date
    FROM part JOIN symbols s ON s.ts_code = 'P'||p_partkey WHERE contains(p_type, 'ST')""", symbols=SYMBOLS))
def read_st_periods(spark, sf):
    path = f"{scratch(spark)}/names"
    made = {
        "ts_code": F.concat(F.lit("P"), F.col("p_partkey").cast("string")), "name": F.col("p_type"),
        "start_date": (F.col("p_size") + 20150101).cast("int"),
        "end_date": F.when(F.col("p_size") % 5 != 0, F.col("p_size") + 20160101).cast("int")}
    A.table(spark, sf, "part").select(*[
        made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NAME_HISTORY.fields
    ]).write.option("header", True).csv(path)
    return R.read_st_periods(spark, path, R.read_symbols(spark, _symbol_file(spark, sf)))


@query("read_daily", oracle(
    "SELECT s.code, d.Date, d.up_limit, d.down_limit, d.daily_amount FROM daily d JOIN symbols s ON s.code = d.code",
    "up_limit down_limit daily_amount", special={"daily_amount": 4}, symbols=SYMBOLS))
def read_daily(spark, sf):
    path = f"{scratch(spark)}/daily"
    made = {"ts_code": F.concat(F.lit("P"), F.col("code").cast("string")), "amount": F.col("daily_amount")}
    rows = A.daily(spark, sf)
    rows.select(F.col("Date").alias(R.DATE_COLUMN), *[
        (made[f.name] if f.name in made else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in DAILY.fields]).write.partitionBy(R.DATE_COLUMN).parquet(path)
    return tidy(R.read_daily(spark, path, R.read_symbols(spark, _symbol_file(spark, sf))), daily_amount=4)


@query("ingest_feather", oracle("SELECT Date, count(*) AS row_count, sum(Close) AS total FROM bars GROUP BY Date", "total", 5))
def ingest_feather(spark, sf):
    """Bars encoded as one Arrow file a day, decoded again and stored by date."""
    def one_file(day):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, day.schema) as writer:
            writer.write_table(day)
        return pa.table({"content": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    rows = A.bars(spark, sf)
    files = rows.groupBy("Date").applyInArrow(one_file, "content binary")
    wanted = StructType([rows.schema[c] for c in ("StockCode", "Date", "Close")])
    days = store_days(decode_feather(files, wanted), f"{scratch(spark)}/days")
    return tidy(days.groupBy("Date").agg(F.count("*").alias("row_count"), F.sum("Close").alias("total")), 5)


@query("feather_source", oracle("SELECT Date, count(*) AS row_count, sum(Close) AS total FROM bars GROUP BY Date", "total", 5))
def feather_source(spark, sf):
    """Bars written as Feather files by the tasks and read again as a data source, three columns of them."""
    path = f"{scratch(spark)}/feather"
    rows = A.bars(spark, sf)
    write_feather(rows, path).agg(F.sum("rows")).collect()
    spark.dataSource.register(FeatherSource)
    wanted = StructType([rows.schema[c] for c in ("StockCode", "Date", "Close")])
    back = spark.read.format("panel_feather").schema(wanted).option("batches", 1).load(path)
    return tidy(back.groupBy("Date").agg(F.count("*").alias("row_count"), F.sum("Close").alias("total")), 5)


@query("read_predictions", oracle(
    "SELECT date, count(*) AS row_count, avg(prediction) AS mean_prediction FROM pred GROUP BY date", "mean_prediction"))
def read_predictions(spark, sf):
    path = f"{scratch(spark)}/pred"
    rows = A.pred(spark, sf).select("prediction", "code", "date", "time")
    W.write_inference(rows, path)
    back = R.read_inference(spark, [f"{path}/*.parquet"])
    return tidy(back.groupBy("date").agg(F.count("*").alias("row_count"), F.avg("prediction").alias("mean_prediction")))


@query("write_predictions", oracle(
    """SELECT count(*) AS row_count, min(date) AS date_min, max(date) AS date_max,
    count(*) AS stored_rows FROM pred"""))
def write_predictions(spark, sf):
    path = f"{scratch(spark)}/pred"
    info = W.write_predictions(A.pred(spark, sf), path, rows_per_file=10_000)
    stored = spark.read.parquet(*[f"{path}/{name}" for name in info["chunk_files"]])
    return stored.agg(F.count("*").alias("stored_rows")).select(
        F.lit(info["row_count"]).cast("bigint").alias("row_count"), F.lit(info["date_min"]).alias("date_min"),
        F.lit(info["date_max"]).alias("date_max"), "stored_rows")


@query("read_manifest", oracle(
    "SELECT time, count(*) AS row_count, sum(prediction) AS total FROM pred GROUP BY time", "total", 6))
def read_manifest(spark, sf):
    """The manifest's files count; a stray file beside them does not."""
    path = f"{scratch(spark)}/pred"
    rows = A.pred(spark, sf)
    W.write_predictions(rows, path)
    rows.write.mode("append").parquet(path)
    listed = R.read_manifest(spark, f"{path}/manifest.yaml", ["time", "prediction"], rows.schema)
    return tidy(listed.groupBy("time").agg(F.count("*").alias("row_count"), F.sum("prediction").alias("total")), 6)


@query("write_features", oracle("SELECT date, count(*) AS row_count, sum(signal_amount) AS total FROM feats GROUP BY date", "total", 4))
def write_features(spark, sf):
    path = f"{scratch(spark)}/features"
    W.write_features(A.feats(spark, sf), path)
    return tidy(spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("row_count"), F.sum("signal_amount").alias("total")), 4)


@query("export_table", oracle("SELECT code, count(*) AS row_count, sum(prediction) AS total FROM xsec GROUP BY code", "total", 6))
def export_table(spark, sf):
    path = f"{scratch(spark)}/xsec.csv"
    rows = A.xsec(spark, sf).select("date", "code", "prediction")
    W.export_table(rows, path)
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return tidy(back.groupBy("code").agg(F.count("*").alias("row_count"), F.sum("prediction").alias("total")), 6)


@query("read_eval_shards", oracle("SELECT time, count(*) AS row_count FROM pred GROUP BY time"))
def read_eval_shards(spark, sf):
    base = scratch(spark)
    rows = A.pred(spark, sf)
    for side, cond in (("rank0", "prediction < 0"), ("rank1", "prediction >= 0")):
        rows.where(cond).write.parquet(f"{base}/{side}")
    return R.read_eval_shards(spark, [f"{base}/rank0", f"{base}/rank1"], ["time", "prediction"]).groupBy("time").agg(F.count("*").alias("row_count"))


@query("write_metrics", oracle(
    """SELECT 'val/' || m AS metric, v AS value FROM (SELECT unnest(['objective/mse', 'quality/global_ic']) AS m,
    unnest([avg(power(prediction-target, 2)), corr(prediction, target)]) AS v FROM xsec)""", "value"))
def write_metrics(spark, sf):
    from ..registry import default_registry

    path = f"{scratch(spark)}/metrics"
    W.write_metrics(default_registry().evaluate(A.xsec(spark, sf), "val", ["quality/global_ic", "objective/mse"]), path)
    return tidy(spark.read.schema("metric string, value double").json(path))


@query("reuse_or_build", oracle("SELECT Date, count(*) AS row_count FROM bars GROUP BY Date"))
def reuse_or_build(spark, sf):
    path = f"{scratch(spark)}/bars"
    build = lambda: A.bars(spark, sf)
    W.reuse_or_build(spark, path, {"table": "bars", "version": 1}, build)
    try:
        W.reuse_or_build(spark, path, {"table": "bars", "version": 2}, build)
    except ContractError:
        pass
    else:
        raise AssertionError("a table was reused under another contract")
    again = W.reuse_or_build(spark, path, {"version": 1, "table": "bars"}, lambda: 1 / 0)
    return again.groupBy("Date").agg(F.count("*").alias("row_count"))


@query("read_split", oracle(
    "SELECT count(*) AS row_count, min(Date) AS first_date, max(Date) AS last_date FROM bars WHERE Date BETWEEN 20190102 AND 20200101"))
def read_split(spark, sf):
    path = f"{scratch(spark)}/split"
    W.write_split_table(D.attach_split(A.bars(spark, sf), D.split_by_ranges(
        A.calendar(spark, sf).withColumnRenamed("Date", "date"), 20190101, 20200101)), path)
    return R.read_split(spark, path, "val").agg(
        F.count("*").alias("row_count"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


@query("number_rows", oracle(
    "SELECT date, code, row_number() OVER (ORDER BY date, code) - 1 AS row_id FROM xsec"))
def number_rows(spark, sf):
    return R.number_rows(A.xsec(spark, sf).select("date", "code"), ["date", "code"])


# --- filters -------------------------------------------------------------------

VALID = "isfinite(Close) AND Close > 0"


@query("valid_bars", oracle(f"SELECT StockCode, Date, MinuteIndex, Close FROM dirty WHERE {VALID}", "Close"))
def valid_bars(spark, sf):
    return tidy(P.valid_bars(A.dirty_bars(spark, sf)).select("StockCode", "Date", "MinuteIndex", "Close"))


@query("keep_finite", oracle("SELECT StockCode, Date, MinuteIndex, Close FROM dirty WHERE isfinite(Close)", "Close"))
def keep_finite(spark, sf):
    return tidy(P.keep_finite(A.dirty_bars(spark, sf), ["Close", "Vol"]).select("StockCode", "Date", "MinuteIndex", "Close"))


@query("finite_pairs", oracle("SELECT Date, count(*) AS row_count FROM dirty WHERE isfinite(Close) AND isfinite(Open) GROUP BY Date"))
def finite_pairs(spark, sf):
    return P.finite_pairs(A.dirty_bars(spark, sf), "Close", "Open").groupBy("Date").agg(F.count("*").alias("row_count"))


@query("drop_horizon_tail", oracle("SELECT MinuteIndex, count(*) AS row_count FROM bars WHERE MinuteIndex <= 11 GROUP BY 1"))
def drop_horizon_tail(spark, sf):
    return P.drop_horizon_tail(A.bars(spark, sf), 4, A.LAST).groupBy("MinuteIndex").agg(F.count("*").alias("row_count"))


@query("universe_first_n", oracle(
    """SELECT Date, count(*) AS row_count, max(StockCode) AS last_code FROM
    (SELECT *, dense_rank() OVER (PARTITION BY Date ORDER BY StockCode) AS k FROM bars) WHERE k <= 5 GROUP BY Date"""))
def universe_first_n(spark, sf):
    return D.universe_first_n(A.bars(spark, sf), 5).groupBy("Date").agg(
        F.count("*").alias("row_count"), F.max("StockCode").alias("last_code"))


@query("grid_times", oracle("SELECT MinuteIndex % 4 AS minute_slot, count(*) AS row_count FROM bars WHERE (MinuteIndex % 4) % 2 = 0 GROUP BY 1"))
def grid_times(spark, sf):
    return (A.bars(spark, sf).withColumn("minute_slot", S.minute_slot("MinuteIndex", 4)).where(F.col("minute_slot") % 2 == 0)
            .groupBy("minute_slot").agg(F.count("*").alias("row_count")))


# --- joins ---------------------------------------------------------------------

@query("forward_value", oracle(
    """SELECT b.StockCode, b.Date, b.MinuteIndex, f.Close AS close_fwd FROM bars b LEFT JOIN bars f
    ON f.StockCode=b.StockCode AND f.Date=b.Date AND f.MinuteIndex=b.MinuteIndex+4""", "close_fwd"))
def forward_value(spark, sf):
    return tidy(P.forward_value(A.bars(spark, sf), "Close", 4, "close_fwd").select("StockCode", "Date", "MinuteIndex", "close_fwd"))


@query("attach_daily", oracle(
    """SELECT b.StockCode, b.Date, b.MinuteIndex, d.up_limit, d.down_limit FROM bars b LEFT JOIN daily d
    ON d.code=b.StockCode AND d.Date=b.Date AND d.daily_amount > 0""", "up_limit down_limit"))
def attach_daily(spark, sf):
    side = A.daily(spark, sf).where("daily_amount > 0").select("code", "Date", "up_limit", "down_limit")
    return tidy(M.attach_daily(A.bars(spark, sf), side).select("StockCode", "Date", "MinuteIndex", "up_limit", "down_limit"))


@query("active_intervals", oracle(
    "SELECT DISTINCT p.code, c.Date FROM calendar c JOIN periods p ON c.Date BETWEEN p.start_date AND p.end_date"))
def active_intervals(spark, sf):
    return M.active_days(A.st_periods(spark), A.calendar(spark, sf))


@query("join_predictions_labels", oracle(
    "SELECT date, time, count(*) AS row_count, sum(prediction*target) AS cross_sum FROM labeled GROUP BY 1, 2", "cross_sum", 6))
def join_predictions_labels(spark, sf):
    labels = P.with_short_keys(P.forward_label(A.bars(spark, sf), 4, 1)).where(F.col("label_ret").isNotNull())
    joined = A.pred(spark, sf).join(labels.select("date", "time", "code", "label_ret"), ["date", "time", "code"])
    return tidy(joined.groupBy("date", "time").agg(
        F.count("*").alias("row_count"), F.sum(F.col("prediction") * F.col("label_ret")).alias("cross_sum")), 6)


@query("complete_timestamps", oracle(
    "SELECT date, count(*) AS row_count FROM xsec GROUP BY date HAVING count(*) >= 20"))
def complete_timestamps(spark, sf):
    return Q.complete_cross_sections(A.xsec(spark, sf), 20).groupBy("date").agg(F.count("*").alias("row_count"))


@query("unmatched_keys", oracle(
    """SELECT date, time, code, 'left' AS side FROM pred p WHERE NOT EXISTS (SELECT 1 FROM labeled l WHERE l.date=p.date AND l.time=p.time AND l.code=p.code)"""))
def unmatched_keys(spark, sf):
    return Q.unmatched(A.pred(spark, sf), A.labeled(spark, sf), ["date", "time", "code"])


# --- aggregates ------------------------------------------------------------------

@query("group_aggregates", oracle(
    """SELECT Date, count(*) AS row_count, count(DISTINCT StockCode) AS codes, sum(Vol) AS volume, avg(Close) AS mean_close,
    min(Low) AS low, max(High) AS high FROM bars GROUP BY Date""", "volume mean_close low high", 6))
def group_aggregates(spark, sf):
    return tidy(A.bars(spark, sf).groupBy("Date").agg(
        F.count("*").alias("row_count"), F.count_distinct("StockCode").alias("codes"), F.sum("Vol").alias("volume"),
        F.avg("Close").alias("mean_close"), F.min("Low").alias("low"), F.max("High").alias("high")), 6)


@query("pearson", oracle(
    "SELECT date, CASE WHEN isfinite(corr(prediction, target)) THEN corr(prediction, target) END AS ic FROM xsec GROUP BY date", "ic"))
def pearson(spark, sf):
    return tidy(A.xsec(spark, sf).groupBy("date").agg(T.pearson("prediction", "target").alias("ic")))


@query("running_moments", oracle(
    """SELECT code, count(target) AS count, avg(target) AS mean, stddev_samp(target) AS std,
    avg(target)*sqrt(count(target))/stddev_samp(target) AS t_stat, avg((target>0)::INT) AS positive_ratio,
    avg(target)/stddev_samp(target) AS icir FROM xsec GROUP BY code""", "mean std t_stat positive_ratio icir"))
def running_moments(spark, sf):
    return tidy(A.xsec(spark, sf).groupBy("code").agg(*T.series_summary("target")))


MOMENT_SQL = """SELECT code, count(amount) AS n, avg(amount) AS m, stddev_pop(amount) AS s,
 avg(power(z, 3)) AS g1, avg(power(z, 4)) - 3 AS g2 FROM
 (SELECT code, amount, (amount - avg(amount) OVER (PARTITION BY code)) / nullif(stddev_pop(amount) OVER (PARTITION BY code), 0) AS z FROM xsec)
 GROUP BY code"""


@query("pooled_moments", oracle(
    "SELECT code, n AS count, m AS mean, s AS std, g1 AS skew, g2 AS kurtosis FROM mom", "mean std skew kurtosis", 6,
    {"mean": 3, "std": 3}, mom=MOMENT_SQL))
def pooled_moments(spark, sf):
    return tidy(A.xsec(spark, sf).groupBy("code").agg(
        F.count("amount").alias("count"), F.avg("amount").alias("mean"), F.stddev_pop("amount").alias("std"),
        T.skew("amount").alias("skew"), T.excess_kurtosis("amount").alias("kurtosis")), 6, mean=3, std=3)


@query("sample_skew_kurt", oracle(
    """SELECT code, CASE WHEN n > 2 THEN g1*sqrt(n*(n-1.0::DOUBLE))/(n-2) END AS skew,
    CASE WHEN n > 3 THEN (n-1.0::DOUBLE)*((n+1)*g2+6)/((n-2.0::DOUBLE)*(n-3)) END AS kurtosis FROM mom""", "skew kurtosis", 6, mom=MOMENT_SQL))
def sample_skew_kurt(spark, sf):
    return tidy(A.xsec(spark, sf).groupBy("code").agg(
        T.skew("amount", bias=False).alias("skew"), T.excess_kurtosis("amount", bias=False).alias("kurtosis")), 6)


@query("fixed_histogram", oracle(
    """SELECT field, CAST(least(greatest(floor((v+5.0)/0.125)+1, 1), 80) AS INT) AS bin, count(*) AS count FROM
    (SELECT unnest(['prediction', 'target']) AS field, unnest([prediction*20, target*100]) AS v FROM xsec) GROUP BY 1, 2"""))
def fixed_histogram(spark, sf):
    rows = A.xsec(spark, sf).select((F.col("prediction") * 20).alias("prediction"), (F.col("target") * 100).alias("target"))
    return Q.fixed_histogram(rows, ["prediction", "target"])


@query("exact_quantiles", oracle(
    """SELECT code, quantile_cont(amount, 0.01) AS p01, quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.95) AS p95
    FROM xsec GROUP BY code""", "p01 p50 p95", 4))
def exact_quantiles(spark, sf):
    return tidy(group_quantiles(A.xsec(spark, sf), ["code"], "amount", {"p01": 0.01, "p50": 0.5, "p95": 0.95}), 4)


@query("pooled_quantiles", oracle(
    "SELECT quantile_cont(amount, 0.01) AS p01, quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.99) AS p99 FROM xsec", "p01 p50 p99", 4))
def pooled_quantiles(spark, sf):
    return tidy(group_quantiles(A.xsec(spark, sf), [], "amount", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, plan="ranged"), 4)


@query("compound_return", oracle("SELECT code, product(1+target)-1 AS total FROM xsec GROUP BY code", "total"))
def compound_return(spark, sf):
    return tidy(A.xsec(spark, sf).groupBy("code").agg(T.compound("target").alias("total")))


@query("conditional_share", oracle(
    "SELECT date, avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM xsec GROUP BY date", "hit_rate"))
def conditional_share(spark, sf):
    return tidy(A.xsec(spark, sf).groupBy("date").agg(T.share(F.col("target") > 0).alias("hit_rate")))


@query("all_in_group", oracle(
    "SELECT StockCode, Date, bool_and(High = Low) AS flat FROM bars GROUP BY 1, 2"))
def all_in_group(spark, sf):
    return A.bars(spark, sf).groupBy("StockCode", "Date").agg(F.bool_and(F.col("High") == F.col("Low")).alias("flat"))


@query("extreme_row_pick", oracle(
    "SELECT date, arg_max(code, row(target, -code)) AS best_code, arg_min(code, row(target, code)) AS worst_code FROM xsec GROUP BY date"))
def extreme_row_pick(spark, sf):
    return A.xsec(spark, sf).groupBy("date").agg(
        F.max_by("code", F.struct("target", -F.col("code"))).alias("best_code"),
        F.min_by("code", F.struct("target", "code")).alias("worst_code"))


@query("having_count", oracle("SELECT date, count(*) AS row_count FROM xsec GROUP BY date HAVING count(*) >= 25"))
def having_count(spark, sf):
    return A.xsec(spark, sf).groupBy("date").agg(F.count("*").alias("row_count")).where(F.col("row_count") >= 25)


# --- windows ---------------------------------------------------------------------

@query("cross_section_ranks", oracle(
    """SELECT date, code, rank() OVER o AS rank, rank() OVER o + (count(*) OVER (PARTITION BY date, prediction) - 1)/2.0 AS avg_rank,
    (rank() OVER o + (count(*) OVER (PARTITION BY date, prediction) - 1)/2.0)/count(*) OVER (PARTITION BY date) AS rank_pct,
    cume_dist() OVER o AS cume, percent_rank() OVER o AS percent, count(*) OVER (PARTITION BY date) AS names
    FROM xsec WINDOW o AS (PARTITION BY date ORDER BY prediction)""", "avg_rank rank_pct cume percent"))
def cross_section_ranks(spark, sf):
    names = {"rank": "rank", "avg": "avg_rank", "pct": "rank_pct", "cume": "cume", "percent": "percent", "n": "names"}
    return tidy(add_value_ranks(A.xsec(spark, sf).select("date", "code", "prediction"), ["date"], "prediction", names).drop("prediction"))


@query("cross_section_ranks_ranged", oracle(
    """SELECT date, code, rank() OVER o AS rank, rank() OVER o + (count(*) OVER (PARTITION BY date, prediction) - 1)/2.0 AS avg_rank,
    cume_dist() OVER o AS cume, percent_rank() OVER o AS percent
    FROM xsec WINDOW o AS (PARTITION BY date ORDER BY prediction)""", "avg_rank cume percent"))
def cross_section_ranks_ranged(spark, sf):
    names = {"rank": "rank", "avg": "avg_rank", "cume": "cume", "percent": "percent"}
    rows = A.xsec(spark, sf).select("date", "code", "prediction")
    return tidy(add_value_ranks(rows, ["date"], "prediction", names, plan="ranged").drop("prediction"))


@query("global_avg_rank", oracle(
    """SELECT date, code, rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1)/2.0 AS avg_rank FROM xsec""", "avg_rank"))
def global_avg_rank(spark, sf):
    return tidy(add_value_ranks(A.xsec(spark, sf).select("date", "code", "prediction"), [], "prediction", {"avg": "avg_rank"}).drop("prediction"))


TILES = """SELECT date, code, row_number() OVER o AS rn, count(*) OVER (PARTITION BY date) AS n, CAST(ntile(3) OVER o AS INT) AS tercile,
 CAST(ntile(10) OVER o AS INT) AS decile FROM xsec WINDOW o AS (PARTITION BY date ORDER BY amount DESC, code)"""


def _tiles(spark, sf, plan):
    rows = A.xsec(spark, sf).select("date", "code", "amount")
    out = add_positions(rows, ["date"], [("amount", False), "code"], "rn", "n", {"tercile": 3, "decile": 10}, plan)
    return out.select("date", "code", "rn", "n", "tercile", "decile")


@query("positions_and_tiles", oracle(TILES))
def positions_and_tiles(spark, sf):
    return _tiles(spark, sf, None)


@query("positions_and_tiles_ranged", oracle(TILES))
def positions_and_tiles_ranged(spark, sf):
    return _tiles(spark, sf, "ranged")


@query("group_stats", oracle(
    "SELECT date, code, amount / sum(amount) OVER (PARTITION BY date) AS weight FROM xsec", "weight"))
def group_stats(spark, sf):
    rows = add_group_stats(A.xsec(spark, sf).select("date", "code", "amount"), ["date"], {"total": F.sum("amount")})
    return tidy(rows.select("date", "code", (F.col("amount") / F.col("total")).alias("weight")))


@query("row_lags", oracle(
    """SELECT StockCode, Date, MinuteIndex, Close - lag(Close) OVER s AS d1, Close - lag(Close, 2) OVER s AS d2 FROM bars
    WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)""", "d1 d2"))
def row_lags(spark, sf):
    return tidy(A.bars(spark, sf).select("StockCode", "Date", "MinuteIndex", P.row_change("Close", 1).alias("d1"), P.row_change("Close", 2).alias("d2")))


@query("rolling_frames", oracle(
    """SELECT StockCode, Date, MinuteIndex, CASE WHEN count(*) OVER a >= 2 THEN stddev_pop(Close) OVER a END AS std_pop,
    CASE WHEN count(*) OVER b >= 3 THEN stddev_samp(Close) OVER b END AS std_samp, avg(Close) OVER a AS mean FROM bars WINDOW
    a AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", "std_pop std_samp mean", 6))
def rolling_frames(spark, sf):
    return tidy(A.bars(spark, sf).select(
        "StockCode", "Date", "MinuteIndex", P.rolling_std("Close", 4, 2, 0).alias("std_pop"),
        P.rolling_std("Close", 5, 3, 1).alias("std_samp"), P.rolling_mean("Close", 4).alias("mean")), 6)


@query("forward_vol", oracle(
    """SELECT StockCode, Date, MinuteIndex, CASE WHEN count(*) OVER (s ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) >= 3
    AND count(r1) OVER (s ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) >= 2
    THEN stddev_pop(r1) OVER (s ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) END AS volatility_label FROM steps
    WINDOW s AS (PARTITION BY StockCode, Date ORDER BY MinuteIndex)""", "volatility_label"))
def forward_vol(spark, sf):
    return tidy(P.forward_vol(A.bars(spark, sf), 4).select("StockCode", "Date", "MinuteIndex", "volatility_label"))


@query("next_valid", oracle(
    """SELECT StockCode, Date, MinuteIndex, (SELECT arg_min(x.Close, x.MinuteIndex) FROM bars x WHERE x.StockCode=b.StockCode
    AND x.Date=b.Date AND x.MinuteIndex>=b.MinuteIndex AND x.Vol > 20) AS next_close FROM bars b""", "next_close"))
def next_valid(spark, sf):
    rows = A.bars(spark, sf)
    value = P.next_valid(F.when(F.col("Vol") > 20, F.col("Close")))
    return tidy(rows.select("StockCode", "Date", "MinuteIndex", value.alias("next_close")))


@query("contiguous_runs", oracle(
    """SELECT StockCode, Date, MinuteIndex, min(MinuteIndex) OVER (PARTITION BY StockCode, Date, g) AS run_id,
    CAST(row_number() OVER (PARTITION BY StockCode, Date, g ORDER BY MinuteIndex) AS INT) AS run_len FROM
    (SELECT *, MinuteIndex - row_number() OVER (PARTITION BY StockCode, Date ORDER BY MinuteIndex) AS g FROM bars)"""))
def contiguous_runs(spark, sf):
    return P.contiguous_runs(A.bars(spark, sf)).select("StockCode", "Date", "MinuteIndex", "run_id", "run_len")


@query("position_in_session", oracle(
    "SELECT StockCode, Date, MinuteIndex, CAST(row_number() OVER (PARTITION BY StockCode, Date ORDER BY MinuteIndex) - 1 AS INT) AS position FROM bars"))
def position_in_session(spark, sf):
    return P.position_in_session(A.bars(spark, sf)).select("StockCode", "Date", "MinuteIndex", "position")


@query("latest_per_step", oracle(
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k = 1""", "value"))
def latest_per_step(spark, sf):
    return tidy(R.latest_per_step(A.table(spark, sf, "events"), ["user_id"], "ts").select("user_id", "event_id", "value"))


@query("smoothed_log", oracle(
    """SELECT tag, step, CASE WHEN count(*) OVER w = 20 THEN avg(value) OVER w END AS smooth FROM logs
    WINDOW w AS (PARTITION BY tag ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "smooth",
    logs="SELECT event_type AS tag, event_id AS step, value FROM events"))
def smoothed_log(spark, sf):
    logs = A.table(spark, sf, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return tidy(G.smoothed_log(logs, 20).select("tag", "step", "smooth"))


@query("step_summary", oracle(
    """SELECT tag, max(step) AS last_step, max_by(value, step) AS last_value, avg(value) FILTER (k <= 100) AS tail_mean,
    stddev_pop(value) FILTER (k <= 100) AS tail_std, min(value) AS min_value, max(value) AS max_value FROM
    (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY step DESC) AS k FROM logs) GROUP BY tag""",
    "last_value tail_mean tail_std min_value max_value",
    logs="SELECT event_type AS tag, event_id AS step, value FROM events"))
def step_summary(spark, sf):
    logs = A.table(spark, sf, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return tidy(G.step_summary(logs))


# --- scalars -----------------------------------------------------------------------

@query("scalar_transforms", oracle(
    """SELECT StockCode, Date, MinuteIndex, sign(c)*ln(1+abs(c)) AS slog, tanh(c/3.0) AS squashed, least(greatest(c, -5.0), 5.0) AS clipped,
    CAST((Vol = 10)::INT AS DOUBLE) AS is_ten, (Close-110.0)/4.0 AS z, Amount/Vol AS vwap
    FROM (SELECT *, Close - 110.0 AS c FROM bars)""", "slog squashed clipped is_ten z vwap"))
def scalar_transforms(spark, sf):
    c = F.col("Close") - 110.0
    return tidy(A.bars(spark, sf).select(
        "StockCode", "Date", "MinuteIndex", S.signed_log1p(c).alias("slog"), S.squash(c, 3.0).alias("squashed"),
        S.clip(c, -5.0, 5.0).alias("clipped"), S.is_zero(F.col("Vol") - 10).alias("is_ten"),
        S.zscore("Close", 110.0, 4.0).alias("z"), S.vwap().alias("vwap")))


@query("calendar_fields", oracle(
    """SELECT DISTINCT CAST(year(ts)%100*10000+month(ts)*100+day(ts) AS INT) AS date, CAST(hour(ts)*10000+minute(ts)*100+second(ts) AS INT) AS time,
    CAST(year(ts)*10000+month(ts)*100+day(ts) AS INT) AS full_date, CAST(year(ts) AS INT) AS year,
    CAST(year(ts)%100*100+month(ts) AS INT) AS month, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS stamp,
    CAST(CASE WHEN m BETWEEN 570 AND 689 THEN m-570 WHEN m BETWEEN 780 AND 899 THEN m-660 END AS INT) AS session_minute
    FROM (SELECT ts, hour(ts)*60+minute(ts) AS m FROM events)"""))
def calendar_fields(spark, sf):
    rows = A.table(spark, sf, "events").select(S.date_int("ts").alias("date"), S.time_int("ts").alias("time")).distinct()
    return rows.select(
        "date", "time", S.full_date("date").alias("full_date"), S.year_of("date").alias("year"), S.month_of("date").alias("month"),
        F.date_format(S.timestamp_key("date", "time", False), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        S.session_minute("time").alias("session_minute"))


# --- sampling and order ------------------------------------------------------------

@query("top_by", oracle("SELECT * FROM (SELECT code, sum(amount) AS total FROM xsec GROUP BY code) ORDER BY total DESC, code LIMIT 8", "total", 2))
def top_by(spark, sf):
    return tidy(D.top_by(A.xsec(spark, sf).groupBy("code").agg(F.sum("amount").alias("total")), "total", 8, ["code"]), 2)


@query("sample_per_group", oracle(
    """SELECT StockCode, Date, MinuteIndex FROM (SELECT *, row_number() OVER (PARTITION BY Date, MinuteIndex ORDER BY
    md5('11|'||StockCode||'|'||Date||'|'||MinuteIndex), StockCode) AS k FROM bars) WHERE k <= 3"""))
def sample_per_group(spark, sf):
    rows = D.sample_per_group(A.bars(spark, sf), ["Date", "MinuteIndex"], 3, 11, ["StockCode", "Date", "MinuteIndex"])
    return rows.select("StockCode", "Date", "MinuteIndex")


@query("bounded_sample", oracle(
    "SELECT date, code, prediction FROM xsec ORDER BY md5('3|'||date||'|'||code), date, code LIMIT 500", "prediction"))
def bounded_sample(spark, sf):
    return tidy(D.bounded_sample(A.xsec(spark, sf).select("date", "code", "prediction"), 500, 3, ["date", "code"]))


@query("evenly_spaced", oracle(
    """SELECT date, code FROM (SELECT date, code, row_number() OVER (ORDER BY date, code) AS k, count(*) OVER () AS n FROM xsec)
    WHERE (k-1) % greatest(n // 300, 1) = 0"""))
def evenly_spaced(spark, sf):
    return D.evenly_spaced(A.xsec(spark, sf).select("date", "code"), ["date", "code"], 300)


@query("epoch_shuffle", oracle(
    """SELECT date, code, epoch_key, CAST(CAST('0x'||substr(epoch_key, 1, 8) AS BIGINT) % 4 AS INT) AS shard
    FROM (SELECT date, code, md5('5-2|'||date||'|'||code) AS epoch_key FROM xsec)"""))
def epoch_shuffle(spark, sf):
    return D.epoch_shuffle(A.xsec(spark, sf).select("date", "code"), ["date", "code"], seed=5, epoch=2, world=4)


@query("metric_rank", oracle(
    "SELECT CAST(code AS INT) AS code, avg(power(prediction-target, 2)) AS mse, rank() OVER (ORDER BY avg(power(prediction-target, 2))) AS metric_rank, CASE WHEN rank() OVER (ORDER BY avg(power(prediction-target, 2))) = 1 THEN 'promote' ELSE 'reject' END AS decision, count(*) AS count FROM xsec GROUP BY code", "mse"))
def metric_rank(spark, sf):
    return tidy(G.best_candidate(G.mse(A.xsec(spark, sf), ["code"])))


@query("duplicate_keys", oracle(
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"))
def find_duplicates(spark, sf):
    return duplicate_keys(A.lineitem(spark, sf), ["l_orderkey", "l_linenumber"])


@query("unique_rows", oracle(
    "SELECT l_orderkey, l_linenumber, l.l_suppkey, s.s_nationkey FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey"))
def many_to_one_join(spark, sf):
    """Line items with their supplier, the lookup side guarded against repeated keys."""
    suppliers = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = A.lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey")
    return lines.join(unique_rows(suppliers, ["l_suppkey"]), "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey")


@query("union_of_groups", oracle(
    """SELECT grp AS "group", count(*) AS row_count, avg(target) AS mean_target FROM (
    SELECT 'high' AS grp, target FROM c WHERE k > 0.8 UNION ALL SELECT 'low', target FROM c WHERE k <= 0.2 UNION ALL SELECT 'all', target FROM c) GROUP BY grp""",
    "mean_target", c="SELECT target, cume_dist() OVER (PARTITION BY date ORDER BY prediction) AS k FROM xsec"))
def union_of_groups(spark, sf):
    rows = add_value_ranks(A.xsec(spark, sf), ["date"], "prediction", {"cume": "k"})
    groups = F.array_compact(F.array(F.when(F.col("k") > 0.8, "high"), F.when(F.col("k") <= 0.2, "low"), F.lit("all")))
    return tidy(rows.select("target", F.explode(groups).alias("group")).groupBy("group").agg(
        F.count("*").alias("row_count"), F.avg("target").alias("mean_target")))


@query("cumulative_wealth", oracle(
    """SELECT date, wealth, wealth / max(wealth) OVER (ORDER BY date) - 1 AS drawdown FROM
    (SELECT date, product(1+r) OVER (ORDER BY date) AS wealth FROM (SELECT date, avg(target) AS r FROM xsec GROUP BY date))""", "wealth drawdown"))
def cumulative_wealth(spark, sf):
    from ..operators.returns import equity_curve

    daily = A.xsec(spark, sf).groupBy("date").agg(F.avg("target").alias("r"))
    return tidy(equity_curve(daily, "r"))


@query("windowed_chunks", oracle(
    """SELECT CAST((k-1)//60 AS INT) AS chunk, min(date) AS start_date, count(*) AS day_count FROM
    (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM xsec)) GROUP BY 1"""))
def windowed_chunks(spark, sf):
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    days = A.xsec(spark, sf).select("date").distinct()
    return days.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / 60).cast("int")).groupBy("chunk").agg(
        F.min("date").alias("start_date"), F.count("*").alias("day_count"))
