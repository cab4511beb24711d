"""Table readers. All push the column list and date range into the scan."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

try:
    import yaml
except ImportError:  # JSON manifests still load
    yaml = None

from ..functions import scalar as S
from ..schema import (
    BARS, ContractError, DAILY, INFERENCE, NAME_HISTORY, PREDICTIONS, SYMBOLS, require_columns,
)
from .files import path_exists, read_text

OPEN_END = 99991231
DATE_COLUMN = "trade_date"


def read_bars(
    spark: SparkSession, path: str, start: int | None = None, end: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Minute bars written with ``write_bars``: one partition per trade date.

    The date bounds prune partitions; ``columns`` prunes the Parquet read.
    """
    schema = T.StructType([*BARS.fields, T.StructField(DATE_COLUMN, T.IntegerType())])
    df = spark.read.schema(schema).parquet(path)
    if start is not None:
        df = df.where(F.col(DATE_COLUMN) >= start)
    if end is not None:
        df = df.where(F.col(DATE_COLUMN) <= end)
    return df.select(*(columns or BARS.fieldNames()))


def list_trade_dates(df: DataFrame, start: int | None = None, end: int | None = None, date: str = "Date") -> DataFrame:
    """Sorted distinct dates in the range."""
    out = df.select(F.col(date).alias("date")).distinct()
    if start is not None:
        out = out.where(F.col("date") >= start)
    if end is not None:
        out = out.where(F.col("date") <= end)
    return out.orderBy("date")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return clean_symbols(spark.read.schema(SYMBOLS).option("header", True).csv(path))


def clean_symbols(raw: DataFrame) -> DataFrame:
    """(ts_code, code): rows with a symbol, integer code, distinct."""
    return (raw.where(F.col("symbol").isNotNull())
            .select("ts_code", F.col("symbol").cast("int").alias("code")).distinct())


def read_st_periods(spark: SparkSession, path: str, symbols: DataFrame) -> DataFrame:
    return st_periods(spark.read.schema(NAME_HISTORY).option("header", True).csv(path), symbols)


def st_periods(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Intervals (code, start_date, end_date) in which a name carried "ST"."""
    return (names.where(F.col("name").contains("ST"))
            .join(symbols, "ts_code")
            .select("code", "start_date", F.coalesce("end_date", F.lit(OPEN_END)).cast("int").alias("end_date"))
            .distinct())


def read_daily(spark: SparkSession, path: str, symbols: DataFrame) -> DataFrame:
    schema = T.StructType([*DAILY.fields, T.StructField(DATE_COLUMN, T.IntegerType())])
    return clean_daily(spark.read.schema(schema).parquet(path).withColumnRenamed(DATE_COLUMN, "Date"), symbols)


def clean_daily(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Daily limits and amount keyed by numeric code, without repeats."""
    return (raw.join(symbols, "ts_code")
            .select("code", "Date", "up_limit", "down_limit", F.col("amount").cast("double").alias("daily_amount"))
            .dropDuplicates())


def read_predictions(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
    schema: T.StructType = PREDICTIONS,
) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(schema).parquet(*paths)
    return df.select(*columns) if columns else df


def read_inference(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scored rows without target; the stored columns must match exactly."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    require_columns(df, INFERENCE)
    extra = [c for c in df.columns if c not in INFERENCE.fieldNames()]
    if extra:
        raise ContractError(f"unexpected columns: {extra}")
    return df.select(*INFERENCE.fieldNames())


def manifest_paths(spark: SparkSession, manifest: str, field: str = "chunk_files") -> list[str]:
    """The exact file list of a prediction manifest, on any file system.

    Entries may be absolute, relative to the manifest's folder, or bare names
    next to it. The listed files count, not whatever else lies in the folder.
    """
    text = read_text(spark, manifest)
    payload = (yaml.safe_load(text) if yaml else json.loads(text)) or {}
    entries = payload.get(field) or []
    if not entries:
        raise ContractError(f"{manifest}: no entries under {field}")
    root = posixpath.dirname(manifest)
    out = []
    for entry in map(str, entries):
        tried = [entry] if "://" in entry or posixpath.isabs(entry) else [
            posixpath.join(root, entry), posixpath.join(posixpath.dirname(root), entry),
            posixpath.join(root, posixpath.basename(entry)),
        ]
        hit = next((p for p in tried if path_exists(spark, p)), None)
        if hit is None:
            raise ContractError(f"{manifest}: file not found for {entry}")
        out.append(hit)
    return out


def read_manifest(
    spark: SparkSession, manifest: str, columns: Sequence[str] | None = None, schema: T.StructType = PREDICTIONS,
) -> DataFrame:
    return read_predictions(spark, manifest_paths(spark, manifest), columns, schema)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a feature table stored with ``split`` as partition column."""
    return spark.read.parquet(path).where(F.col("split") == split)


def read_eval_shards(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of evaluation shards, each checked for ``columns``."""
    return require_columns(spark.read.parquet(*paths), columns).select(*columns)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Dense 0-based row index in ``order`` without a single-task sort."""
    from ..functions.ranks import add_positions

    return add_positions(df, [], list(order), rn=name).withColumn(name, F.col(name) - 1)


def latest_per_step(df: DataFrame, keys: Sequence[str], wall_time: str) -> DataFrame:
    """Keep the most recent record of each key.

    An aggregate, so each task keeps one record per key before the shuffle.
    """
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, wall_time).alias("_row")).select("_row.*")
