"""Session-level helpers: durable checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Rows of one task of a wide chain of windows, see ``by_groups``.
ROWS_PER_TASK = 250_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="panelspark-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where a later step must see exactly the same partition ids again,
    also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelspark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a scratch folder and read it back.

    For a table that several branches of a job read: it is computed once, each
    branch prunes its own columns, and a lost executor loses nothing.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_groups(df: DataFrame, keys: Sequence[str], rows: int, copies: int = 1) -> DataFrame:
    """``df`` of ``rows`` rows, partitioned by ``keys`` into tasks of about ``ROWS_PER_TASK`` rows, a row counted ``copies`` times.

    Exchanges that Spark plans by itself are merged to tasks of 64 MB as
    compressed. Where many windows sort the same rows, or each row is laid out
    many times behind the exchange, such a task unpacks to gigabytes; a number
    of partitions that is asked for is kept.
    """
    return df.repartition(max(1, -(-rows * copies // ROWS_PER_TASK)), *keys)
