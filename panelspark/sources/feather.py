"""Feather (Arrow IPC) files as a batch source.

Spark lists and reads the files, so any file system it reaches will do; a task
holds the files of its own partition and hands out their record batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .readers import DATE_COLUMN


def feather_schema(spark: SparkSession, pattern: str) -> T.StructType:
    """The schema of the first file by path; only that file is opened."""
    import pyarrow.ipc as ipc

    files = spark.read.format("binaryFile").load(pattern)
    first = files.select(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(pattern)
    content = files.where(F.col("path") == first).select("content").first()[0]
    return from_arrow_schema(ipc.open_file(content).schema)


def decode_feather(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of a table with a binary column ``content``, one Arrow IPC file each.

    Only the columns of ``schema`` are decoded.
    """
    def decode(batches):
        import pyarrow as pa
        import pyarrow.ipc as ipc

        wanted = to_arrow_schema(schema)
        for batch in batches:
            for content in batch.column(0):
                source = pa.py_buffer(content.as_buffer())
                names = ipc.open_file(source).schema.names
                fields = sorted(names.index(f.name) for f in wanted)
                reader = ipc.open_file(source, options=ipc.IpcReadOptions(included_fields=fields))
                for i in range(reader.num_record_batches):
                    part = reader.get_batch(i)
                    columns = [part.column(part.schema.get_field_index(f.name)).cast(f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    return files.select("content").mapInArrow(decode, schema)


def read_feather(
    spark: SparkSession, pattern: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of the Feather files that ``pattern`` names; ``columns`` prunes the decoding."""
    schema = schema or feather_schema(spark, pattern)
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns])
    return decode_feather(spark.read.format("binaryFile").load(pattern), schema)


def ingest_feather(spark: SparkSession, pattern: str, out: str, schema: T.StructType | None = None, date: str = "Date") -> DataFrame:
    """One-off conversion of per-day files to a date-partitioned Parquet table."""
    return store_days(read_feather(spark, pattern, schema), out, date)


def store_days(rows: DataFrame, out: str, date: str = "Date") -> DataFrame:
    rows.withColumn(DATE_COLUMN, F.col(date)).write.mode("overwrite").partitionBy(DATE_COLUMN).parquet(out)
    return rows.sparkSession.read.parquet(out)
