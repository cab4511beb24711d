"""Streaming jobs run to completion over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import scratch, stored
from ..streaming import jobs as X
from . import adapters as A
from .adapters import tidy
from .bookkeeping import BAND
from .catalog import query
from .sql import oracle


def _table_stream(spark, sf, name):
    """A given table as a file stream; the pattern suits a file and a folder."""
    return X.read_stream(spark, f"{sf}/{name}.parque[t]", A.table(spark, sf, name).schema)


@query("ingest_days", oracle("SELECT Date, count(*) AS row_count, sum(Vol) AS volume FROM bars GROUP BY Date", "volume"))
def ingest_days(spark, sf):
    bars = A.bars(spark, sf)
    source, out = scratch(spark), scratch(spark)
    bars.write.parquet(source)
    X.ingest_days(spark, source, bars.schema, f"{out}/table", f"{out}/progress")
    # A second run finds nothing new and appends nothing.
    table = X.ingest_days(spark, source, bars.schema, f"{out}/table", f"{out}/progress")
    return tidy(table.groupBy("Date").agg(F.count("*").alias("row_count"), F.sum("Vol").alias("volume")))


@query("ingest_versions", oracle(
    """SELECT Date, version, count(*) AS row_count, sum(Vol * version) AS volume FROM
    (SELECT *, CASE WHEN Date // 100 % 6 = 0 THEN 3 WHEN Date // 100 % 3 = 0 THEN 2 ELSE 1 END AS version FROM bars)
    WHERE version < 3 OR StockCode % 2 = 0 GROUP BY Date, version""", "volume"))
def ingest_versions(spark, sf):
    """Every third month is sent again with other volumes, every sixth a third time with fewer codes, then an old one once more."""
    bars = stored(A.bars(spark, sf))
    source, out = scratch(spark), scratch(spark)
    month = F.floor(F.col("Date") / 100)

    def send(rows, version):
        sent = rows.withColumns({"Vol": F.col("Vol") * version, "version": F.lit(version)})
        sent.write.mode("append").parquet(source)
        return X.ingest_versions(spark, source, sent.schema, f"{out}/table", f"{out}/progress")

    send(bars, 1)
    send(bars.where(month % 3 == 0), 2)
    send(bars.where((month % 6 == 0) & (F.col("StockCode") % 2 == 0)), 3)
    table = send(bars.where(month % 6 == 0), 1)  # an older version that comes late changes nothing
    return tidy(table.groupBy("Date", "version").agg(F.count("*").alias("row_count"), F.sum("Vol").alias("volume")))


@query("stream_bars", oracle(
    """SELECT user_id AS "StockCode", strftime(b, '%Y-%m-%d %H:%M:%S') AS bar_start, min_by(value, ts) AS "Open", max_by(value, ts) AS "Close", max(value) AS "High", min(value) AS "Low",
    CAST(count(*) AS DOUBLE) AS "Vol", sum(value) AS "Amount" FROM (SELECT *, date_trunc('hour', ts) AS b FROM events) GROUP BY user_id, b""", "Open Close High Low Vol Amount"))
def stream_bars(spark, sf):
    """All bars: those the stream emits and, the stream being over, those still open."""
    def bars(rows):
        return X.bars_from_events(rows.select("ts", "user_id", "value"), width="1 hour")

    out = scratch(spark)
    done = X.run_available(bars(_table_stream(spark, sf, "events")), f"{out}/bars", f"{out}/progress")
    whole = X.close_windows(done, A.table(spark, sf, "events"), bars, width="1 hour")
    return tidy(whole.select("StockCode", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss").alias("bar_start"), "Open", "Close", "High", "Low", "Vol", "Amount"))


@query("stream_ic", oracle(
    """SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, CASE WHEN isfinite(corr(l_discount, l_tax)) THEN corr(l_discount, l_tax) END AS ic, count(*) AS count, avg(l_tax) AS mean_target,
    stddev_samp(l_tax) AS std_target FROM lineitem GROUP BY l_shipdate""", "ic mean_target std_target"))
def stream_ic(spark, sf):
    """All cross-sections: those the stream emits and, the stream being over, those still open."""
    def shown(rows):
        return rows.select(F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_discount").alias("prediction"), F.col("l_tax").alias("target"))

    def ic(rows):
        return X.running_ic(rows, width="1 day", delay="1 day")

    out = scratch(spark)
    done = X.run_available(ic(shown(_table_stream(spark, sf, "lineitem"))), f"{out}/ic", f"{out}/progress")
    whole = X.close_windows(done, shown(A.lineitem(spark, sf)), ic, width="1 day", delay="1 day")
    return tidy(whole.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "ic", "count", "mean_target", "std_target"))


@query("stream_band_state", oracle("SELECT date, code, bar FROM band WHERE active", **BAND))
def stream_band_state(spark, sf):
    """Years arrive one by one and out of order, each pair reversed, in any number of files; nothing is lost."""
    rows = stored(A.pred(spark, sf).select(
        "code", "date", F.floor((F.col("time") - 93000) / 100).cast("int").alias("bar"),
        S.timestamp_key("date", "time", False).alias("ts"),
        (F.col("prediction") >= 0.2).alias("enter"), (F.col("prediction") >= -0.2).alias("hold")))
    path, out = scratch(spark), scratch(spark)
    year = F.floor(F.col("date") / 10000).cast("int")
    years = [r["year"] for r in rows.select(year.alias("year")).distinct().orderBy("year").collect()]
    for i in range(0, len(years), 2):
        for y in reversed(years[i:i + 2]):
            rows.where(year == y).repartition("code").write.mode("append").parquet(path)
            # The stream goes on with what has arrived: a year is one batch, however many files it has.
            stream = X.band_state_stream(X.read_stream(spark, path, rows.schema), delay="800 days")
            done = X.run_available(stream, f"{out}/held", f"{out}/progress")
    return X.close_bands(done, rows, delay="800 days").select("date", "code", "bar")
