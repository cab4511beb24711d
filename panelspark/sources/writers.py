"""Table writers and the small artifacts next to them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EXECUTION_COLUMNS, INFERENCE, ContractError, require_columns
from .files import list_files, path_exists, read_text, write_text
from .readers import DATE_COLUMN

ROWS_PER_FILE = 2_000_000


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars clustered by trade date, so date ranges prune files on read.

    Ranges over the whole key keep a date in few files and still split one
    very large date over several tasks.
    """
    (df.withColumn(DATE_COLUMN, F.col("Date"))
     .repartitionByRange(DATE_COLUMN, "StockCode", "MinuteIndex")
     .sortWithinPartitions(DATE_COLUMN, "StockCode", "MinuteIndex")
     .write.mode(mode).partitionBy(DATE_COLUMN).parquet(path))


def write_bucketed_bars(df: DataFrame, table: str, path: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Bars as a table in buckets of (StockCode, Date), for the many jobs over sessions.

    Windows and joins by session then read their bucket and need no exchange;
    the one shuffle is paid here. The layout does not prune dates: where jobs
    read few of them, ``write_bars`` is the better one. Choose ``buckets`` so
    that one holds a few hundred MB; a session is never split.
    """
    (df.repartition(buckets, "StockCode", "Date").write.mode(mode).option("path", path)
     .bucketBy(buckets, "StockCode", "Date").sortBy("StockCode", "Date", "MinuteIndex").saveAsTable(table))
    return df.sparkSession.table(table)


def write_predictions(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite") -> dict[str, Any]:
    """Prediction table in files of bounded size, plus ``manifest.yaml``.

    The counts come from an observation on the write itself, not from a
    second pass over the data. Appending is refused: a manifest describes the
    files of one write.
    """
    if mode == "append":
        raise ValueError("a manifest describes one write; write to another folder instead of appending")
    from pyspark.sql import Observation

    seen = Observation()
    (df.observe(seen, F.count("*").alias("row_count"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path))
    stats = seen.get
    spark = df.sparkSession
    names = list_files(spark, path, ".parquet")
    manifest = {
        "chunk_files": names, "chunk_count": len(names), "columns": df.columns,
        "row_count": int(stats["row_count"]),
        "date_min": None if stats["date_min"] is None else int(stats["date_min"]),
        "date_max": None if stats["date_max"] is None else int(stats["date_max"]),
    }
    # JSON is valid YAML, so either parser reads the manifest.
    write_text(spark, f"{path}/manifest.yaml", json.dumps(manifest, indent=1))
    return manifest


def write_inference(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> dict[str, Any]:
    """Scores without target, ordered by (date, time, code).

    Range partitioning by the full key keeps dates together and still splits
    one very large date over several files.
    """
    ordered = (require_columns(df, INFERENCE).select(*INFERENCE.fieldNames())
               .repartitionByRange("date", "time", "code").sortWithinPartitions("date", "time", "code"))
    return write_predictions(ordered, path, rows_per_file)


def write_features(df: DataFrame, path: str) -> None:
    """Execution-feature table with its fixed columns, partitioned by date."""
    (require_columns(df, EXECUTION_COLUMNS).select(*EXECUTION_COLUMNS)
     .repartitionByRange("date", "code").write.mode("overwrite").partitionBy("date").parquet(path))


def write_split_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def export_table(df: DataFrame, path: str) -> None:
    """CSV with header or Parquet, by suffix."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown table format: {path}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Scalar metric rows (metric, value) as sorted JSON lines."""
    metrics.orderBy("metric").coalesce(1).write.mode("overwrite").json(path)


def require_artifacts(spark: SparkSession, paths: Sequence[str]) -> None:
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise ContractError(f"missing artifacts: {missing}")


def contract_hash(contract: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(contract, sort_keys=True, default=str).encode()).hexdigest()


def reuse_or_build(
    spark: SparkSession, path: str, contract: dict[str, Any], build: Callable[[], DataFrame]
) -> DataFrame:
    """Read the table at ``path`` if it was built under the same contract.

    A finished table with another contract is an error, never overwritten. The
    contract is written after the data, so an interrupted build is redone.
    """
    side = f"{path.rstrip('/')}.contract.json"
    wanted = contract_hash(contract)
    if path_exists(spark, side):
        stored = json.loads(read_text(spark, side))
        if stored.get("hash") != wanted:
            raise ContractError(f"{path} was built under another contract: {stored.get('contract')}")
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    write_text(spark, side, json.dumps({"hash": wanted, "contract": contract}, default=str))
    return spark.read.parquet(path)
