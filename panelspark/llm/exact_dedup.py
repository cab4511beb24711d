"""Exact deduplication by a tree merge of digest runs, in DataFrame operations only.

A run holds the digests of one block of input partitions, each digest once,
with the identifier that stays and the number of rows behind it. Runs meet in
rounds: in each round ``fan_in`` neighbouring runs become one, equal digests
are merged, and the identifier that stays is chosen anew, until one run is
left. A text that fills a third of the table is one row per run before the
first exchange, so no task ever receives its copies.

Every digest travels with a second, independent hash and the byte length of
its text; if two texts with one digest differ in either, the merge raises
instead of dropping a text.

Defined results:

* a null text counts as empty; empty texts are equal to each other;
* a null id stays only where the whole group has none; rows that repeat an id
  and a text all count, and all carry the same decision;
* of other columns of the input nothing is read, whatever their names;
* an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import lower_ascii, stored

RUNS = 64
FAN_IN = 8
KEEP = {"largest": F.max, "smallest": F.min}


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: doc_id, text_sha256, n_bytes, proof (a second hash)."""
    text = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_norm"),
    )
    return text.select(
        "doc_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("_norm").cast("long").alias("n_bytes"), F.xxhash64("_norm").alias("proof"),
    )


def _verified(value: str):
    """``value`` of a merged group; an error where two texts hide behind one digest."""
    return F.when((F.col("b0") == F.col("b1")) & (F.col("p0") == F.col("p1")), F.col(value)).otherwise(
        F.raise_error(F.concat(F.lit("one digest for different texts: "), F.col("text_sha256"))).cast("long")
    )


def merge_runs(rows: DataFrame, keep: str = "largest", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """text_sha256, keep_id, group_size over all rows of :func:`digest_rows`."""
    best = KEEP[keep]
    level = rows.withColumn("run", F.spark_partition_id() % runs).withColumn("n", F.lit(1).cast("long"))
    level = level.select("run", "text_sha256", F.col("doc_id").alias("keep_id"), "n", "n_bytes", "proof")
    while True:
        level = level.groupBy("run", "text_sha256").agg(
            best("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.min("n_bytes").alias("b0"),
            F.max("n_bytes").alias("b1"), F.min("proof").alias("p0"), F.max("proof").alias("p1"),
        ).select("run", "text_sha256", "keep_id", _verified("n").alias("n"), F.col("b0").alias("n_bytes"),
                 F.col("p0").alias("proof"))
        if runs == 1:
            return level.select("text_sha256", "keep_id", F.col("n").alias("group_size"))
        runs = -(-runs // fan_in)
        level = level.withColumn("run", (F.col("run") / fan_in).cast("int"))


def mark(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are read once; what is stored and merged is one narrow row each.
    Only groups of two or more go into the join back, and they come from a
    stored table, so that a group holding many rows is an ordinary join key
    that Spark may split.
    """
    rows = stored(digest_rows(docs, id_col, text_col))
    groups = stored(merge_runs(rows, keep).where("group_size > 1"))
    return rows.select("doc_id", "text_sha256").join(groups, "text_sha256", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(
            F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    Only the ids to drop are joined back. Where an id repeats, each of its
    rows is judged with its own text, and of rows that repeat both one stays.
    """
    judged = stored(mark(docs, keep, id_col, text_col).where("group_size > 1"))
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    own = docs.withColumn("_own_sha", F.sha2(
        lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary"), 256))
    here = lambda side: F.col(f"`{id_col}`").eqNullSafe(F.col(f"_{side}_id")) & (F.col("_own_sha") == F.col(f"_{side}_sha"))
    left = own.join(gone, here("gone"), "left_anti")
    twice = stored(judged.where("kept").groupBy(F.col("doc_id").alias("_twice_id"), F.col("text_sha256").alias("_twice_sha")).agg(
        F.count("*").alias("_rows")).where("_rows > 1"))
    if twice.limit(1).count():
        repeated = left.join(twice, here("twice"), "left_semi").dropDuplicates([id_col, "_own_sha"])
        left = left.join(twice, here("twice"), "left_anti").union(repeated)
    return left.drop("_own_sha")
