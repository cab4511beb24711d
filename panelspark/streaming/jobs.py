"""Streaming jobs. Sources are file streams; sinks are exactly-once Parquet.

The aggregations work on batch and streaming DataFrames alike, so a batch run
over the same rows is the reference for a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import stats
from ..functions.scalar import is_finite
from ..operators.positions import band_state
from ..sources.readers import DATE_COLUMN


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked rows; a watermark needs a timestamp with time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_available(
    df: DataFrame, out: str, checkpoint: str, partition_by: str | None = None, timeout: int | None = None,
) -> DataFrame:
    """Process everything that is there into Parquet and stop.

    With the same checkpoint the next call resumes after the last finished
    batch, so a lost driver or a later arrival neither repeats nor skips rows.
    """
    writer = (df.writeStream.format("parquet").outputMode("append").option("path", out)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    query = writer.start()
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if query.exception():
        raise query.exception()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def ingest_days(
    spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, date: str = "Date",
    files_per_trigger: int = 64,
) -> DataFrame:
    """Append newly arrived day files to a date-partitioned table, resumably."""
    stream = read_stream(spark, source, schema, files_per_trigger).withColumn(DATE_COLUMN, F.col(date))
    return run_available(stream, out, checkpoint, DATE_COLUMN)


def ingest_versions(
    spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, date: str = "Date",
    version: str = "version", files_per_trigger: int = 64,
) -> DataFrame:
    """Days that may arrive again: the rows of a day's highest ``version`` replace all its earlier ones.

    Every micro-batch writes the partitions (date, version, batch) it brings,
    and then the ledger of them. A batch that is run again after a failure
    overwrites its own partitions only, so it counts once; one version may come
    in many files and batches; an older version that comes late changes
    nothing. Rows without a date are left out; no version counts as 0.
    """
    keys = [DATE_COLUMN, version, "batch"]

    def land(rows: DataFrame, batch_id: int) -> None:
        dated = rows.where(F.col(date).isNotNull()).withColumns({
            DATE_COLUMN: F.col(date).cast("int"), version: F.coalesce(F.col(version).cast("int"), F.lit(0)),
            "batch": F.lit(batch_id).cast("bigint")})
        for table, part, by in ((dated, "days", keys), (dated.select(*keys).distinct(), "ledger", ["batch"])):
            (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*by).parquet(f"{out}/{part}"))

    stream = read_stream(spark, source, schema, files_per_trigger)
    query = (stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return read_versions(spark, out, schema, version)


def read_versions(spark: SparkSession, out: str, schema: T.StructType, version: str = "version") -> DataFrame:
    """The current rows of a table of ``ingest_versions``: the batches in the ledger that hold a day's highest version.

    The ledger has a row a day and batch; it prunes the partitions that are read.
    """
    keys = [T.StructField(DATE_COLUMN, T.IntegerType()), T.StructField(version, T.IntegerType()), T.StructField("batch", T.LongType())]
    kinds = T.StructType([f for f in schema.fields if f.name != version] + keys)
    ledger = spark.read.schema(f"{DATE_COLUMN} int, {version} int, batch bigint").parquet(f"{out}/ledger")
    latest = ledger.groupBy(DATE_COLUMN).agg(F.max(version).alias(version))
    live = ledger.join(latest, [DATE_COLUMN, version], "left_semi")
    days = spark.read.schema(kinds).parquet(f"{out}/days")
    return days.join(live, [DATE_COLUMN, version, "batch"], "left_semi").drop("batch")


def bars_from_events(
    events: DataFrame, ts: str = "ts", code: str = "user_id", price: str = "value", size: Column | None = None,
    width: str = "1 minute", delay: str = "10 minutes",
) -> DataFrame:
    """OHLCV bars of ticks per code and time window; late ticks are dropped.

    min_by/max_by over the event time keep two rows of state per window, not
    the ticks.
    """
    volume = F.lit(1.0) if size is None else size
    bars = _event_time(events, ts, delay).groupBy(F.col(code), F.window(ts, width)).agg(
        F.min_by(price, ts).alias("Open"), F.max_by(price, ts).alias("Close"),
        F.max(price).alias("High"), F.min(price).alias("Low"),
        F.sum(volume).alias("Vol"), F.sum(F.col(price) * volume).alias("Amount"))
    return bars.select(
        F.col(code).alias("StockCode"), F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"),
        "Open", "Close", "High", "Low", "Vol", "Amount")


def running_ic(rows: DataFrame, ts: str = "ts", x: str = "prediction", y: str = "target", width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Pearson correlation and score moments per time window.

    The state of a window is its central moments, whatever its row count; it
    is final once the watermark has passed, so every emitted cross-section is
    whole.
    """
    both = is_finite(x) & is_finite(y)
    out = _event_time(rows, ts, delay).groupBy(F.window(ts, width)).agg(
        stats.pearson(x, y).alias("ic"), F.count(F.when(both, 1)).alias("count"),
        F.avg(F.when(both, F.col(y))).alias("mean_target"), F.stddev_samp(F.when(both, F.col(y))).alias("std_target"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ic", "count", "mean_target", "std_target")


def _watermark(rows: DataFrame, ts: str, delay: str) -> Column:
    """Where the watermark stands after all of ``rows``."""
    edge = rows.select(F.max(F.col(ts).cast("timestamp")).alias("_m")).select(F.expr(f"_m - INTERVAL {delay}"))
    return F.date_trunc("millisecond", edge.scalar())


def close_windows(
    done: DataFrame, rows: DataFrame, aggregate: Callable[[DataFrame], DataFrame], ts: str = "ts",
    width: str = "1 minute", delay: str = "10 minutes",
) -> DataFrame:
    """``done`` with the windows that a finished stream has not emitted.

    A stream emits a window once the watermark has passed it. When no more
    rows will come, the windows still open are aggregated from the stored
    rows; only rows of those windows are read.
    """
    edge = _watermark(rows, ts, delay)
    open_rows = rows.where(F.window(F.col(ts).cast("timestamp"), width)["end"] > edge)
    return done.unionByName(aggregate(open_rows))


def _held(enter: np.ndarray, hold: np.ndarray, follows: np.ndarray, before: bool) -> np.ndarray:
    """Which rows are held: from an entry on, while rows follow each other in the hold band.

    ``before`` says whether the row ahead of the first was held.
    """
    at = np.arange(len(hold))
    cut = np.maximum.accumulate(np.where(~follows | ~hold, at, -1))
    entered = np.maximum.accumulate(np.where(enter & hold, at, 0 if before and len(at) and follows[0] and hold[0] else -2))
    return hold & (entered >= np.maximum(cut, 0)) if len(at) else hold


def band_state_stream(
    rows: DataFrame, code: str = "code", date: str = "date", bar: str = "bar", ts: str = "ts",
    delay: str = "10 minutes", width_ms: int = 60_000,
) -> DataFrame:
    """Held rows of a one-sided band, in order of event time, as rows arrive.

    Input: code, date, bar (a gap-free bar number per date), ts (its time),
    enter, hold. A code is held from an ``enter`` on while each following bar
    has ``hold``; a missing bar or a new date ends it.

    Rows wait in the state until the watermark has passed them, so files may
    come in any order within ``delay``; only rows behind the watermark are
    dropped. The state of a code is its last emitted bar and the waiting rows;
    it expires when no row can follow that bar any more (``width_ms`` is the
    length of a bar). ``close_bands`` adds what waits when a stream is over.
    """
    schema = f"{code} {rows.schema[code].dataType.simpleString()}, {date} int, {bar} int"
    state_schema = ("last_date int, last_bar int, held boolean, last_ts bigint, ts array<bigint>, date array<int>, "
                    "bar array<int>, enter array<boolean>, hold array<boolean>")

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        last_date, last_bar, held, last_ts, *waiting = state.get if state.exists else (0, 0, False, 0, [], [], [], [], [])
        columns = [[np.array(w, kind)] for w, kind in zip(waiting, ("int64", "int64", "int64", bool, bool))]
        if not state.hasTimedOut:
            for batch in batches:
                stamp = pd.to_datetime(batch[ts], utc=True).astype("datetime64[ms, UTC]").astype("int64")
                for have, new in zip(columns, (stamp, batch[date], batch[bar], batch["enter"], batch["hold"])):
                    have.append(new.to_numpy().astype(have[0].dtype))
        stamps, dates, bars, enter, hold = (np.concatenate(c) for c in columns)
        order = np.lexsort((bars, dates))
        ready = stamps[order] < mark
        now, later = order[ready], order[~ready]
        if len(now):
            d, b = dates[now], bars[now]
            before_d, before_b = np.concatenate([[last_date], d[:-1]]), np.concatenate([[last_bar], b[:-1]])
            on = _held(enter[now], hold[now], (d == before_d) & (b == before_b + 1), bool(held))
            last_date, last_bar, held, last_ts = int(d[-1]), int(b[-1]), bool(on[-1]), int(stamps[now].max())
            yield pd.DataFrame({code: [key[0]] * int(on.sum()), date: d[on], bar: b[on]})
        if len(later) == 0 and mark > last_ts + width_ms:
            if state.exists:
                state.remove()
            return
        state.update((last_date, last_bar, held, last_ts, *[c[later].tolist() for c in (stamps, dates, bars, enter, hold)]))
        wake = int(stamps[later].min()) if len(later) else last_ts + width_ms
        state.setTimeoutTimestamp(max(wake, mark) + 1)

    stamped = _event_time(rows, ts, delay)
    return stamped.groupBy(code).applyInPandasWithState(
        advance, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def close_bands(
    done: DataFrame, rows: DataFrame, code: str = "code", date: str = "date", bar: str = "bar", ts: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """``done`` with the held rows that still waited when the stream ended.

    Only the dates that reach past the watermark are folded again.
    """
    edge = _watermark(rows, ts, delay)
    open_dates = rows.where(F.col(ts).cast("timestamp") >= edge).select(date).distinct()
    again = band_state(rows.join(open_dates, date, "left_semi"), [date, code], bar, F.col("enter"), F.col("hold"))
    keys = [code, date, bar]
    return done.select(*keys).unionByName(again.select(*keys).join(done.select(*keys), keys, "left_anti"))
