"""Column expressions and readers that several operators here share."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.session import ensure_checkpoint_dir, stored

__all__ = ["WORD", "ensure_checkpoint_dir", "held_out", "list_udf", "lower_ascii", "release", "share", "slices", "stored", "table", "unit_hash"]

# The word pattern and the letters that are folded.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; a text of ASCII only takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def held_out(doc_id: Column) -> Column:
    """True where the row is kept for testing: crc32 of the id as text leaves 2 after division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends only on the values of ``cols``; SQL engines compute the same."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def list_udf(setup, kind, returns: str):
    """A column function in Python over lists of values.

    ``setup()`` runs once for a task and gives the function from a list to a
    list; ``kind`` is its Arrow and ``returns`` its Spark type. An Arrow batch
    passes in slices of ``SLICE`` rows, so that few rows at a time are Python
    objects. Arrow's free memory is given back after each batch.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def batches_of(batches):
        own = setup()
        for batch in batches:
            parts = [pa.array(own(batch.slice(i, SLICE).to_pylist()), kind) for i in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
            del batch, parts
            release()
        del own  # what the task kept must not outlive it in a worker that is used again

    # arrow_udf reads its form from type hints.
    batches_of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches_of, returns)


def share(spark: SparkSession, value):
    """Broadcast a bounded object; the function returned gives it to a task."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def slices(batch):
    """The columns of an Arrow record batch as lists, ``SLICE`` rows at a time."""
    for i in range(0, batch.num_rows, SLICE):
        part = batch.slice(i, SLICE)
        yield [c.to_pylist() for c in part.columns]
    release()


def release() -> None:
    """Give the free memory of Arrow's pool back: idle workers stay alive, and their memory counts as the executor's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
