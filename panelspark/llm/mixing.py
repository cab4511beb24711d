"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source, targets and repetition rates follow from the
sums, and every document is emitted floor(rate) times plus once more with a
probability equal to the fraction, drawn from a seeded hash of its id.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
the total of all sizes. A target stops at ``limit`` times its source's size;
what is cut off goes to the other sources by weight until none is above. That
fixed point is found directly: with sources sorted by limit per weight, a
prefix of them is full, and one level per unit of weight fits the rest. The
table of sources has one row per source, so its windows are small.

Defined results:

* a null or empty text has size 0 and is never repeated or taken in part;
* a source without words has target 0; null is a source of its own;
* rows with a null id are drawn by their text; rows that repeat an id and a
  source are drawn alike;
* columns of the input with the names used here do not disturb it;
* an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, stored, unit_hash

LIMIT = 3
SEED = "mix-1"
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words: runs of anything but space and tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(id_col: Column, text: Column) -> Column:
    """The document's number in [0, 1): from its id, without an id from its text."""
    return unit_hash(F.lit(SEED), F.coalesce(id_col.cast("string"), F.md5(text.cast("binary")), F.lit("")))


def copies_of(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and the draw of each document."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"),
        draw_of(F.col(f"`{id_col}`"), text).alias("draw"),
    )


def source_rates(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target, rate; one row per source."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = total.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn(
        "cap", F.col("source_size") * limit)
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = (filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing),
                            W.partitionBy(F.lit(0)))
    # The level if this source and all after it in the order are not full.
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    # It grows while sources fill up and shrinks from the first that does not, where it is right.
    filled = weighed.withColumn("level", level).withColumn("right", F.max("level").over(whole))
    target = F.least(F.col("cap").cast("double"), F.col("right") * F.col("weight"))
    return filled.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(limit))))
        .otherwise(F.lit(0.0)).alias("rate"),
    )


def _attachable(rates: DataFrame) -> DataFrame:
    """The stored table of rates: broadcast up to ``BROADCAST_SOURCES`` counted rows, else an ordinary join side."""
    kept = stored(rates)
    return F.broadcast(kept) if kept.count() <= BROADCAST_SOURCES else kept


def plan_mix(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sizes = stored(sized(docs, id_col, text_col, source_col))
    rates = _attachable(source_rates(sizes, limit))
    copies = copies_of(F.col("rate"), F.col("draw"))
    return sizes.alias("s").join(rates.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source"))).select(
        "doc_id", F.col("s.source").alias("source"), "size", "source_size", "target", "rate", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def mix(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    The rate of a source is attached to its documents and the copies are laid
    out in place, so texts are not exchanged. Documents without words are not
    part of a mix.
    """
    rates = _attachable(source_rates(sized(docs, id_col, text_col, source_col), limit).select(
        F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate")))
    text = F.col(f"`{text_col}`")
    joined = docs.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col("_mix_source")))
    copies = copies_of(F.col("_mix_rate"), draw_of(F.col(f"`{id_col}`"), text))
    taken = joined.withColumn("_mix_copies", copies).where((F.col("_mix_copies") > 0) & text.rlike(WORD))
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
