"""Substring deduplication by line or paragraph hashes.

Texts are cut into units (lines, or paragraphs between blank lines), units are
normalised (A-Z lower-cased, runs of white space made one blank) and their
128-bit digests grouped over all documents. The earliest occurrence by
(doc_id, position) stays; every other occurrence is removed, with its
character offsets in the original text in the result.

Digests with one occurrence leave after the grouping. Groups are reduced
before the exchange, and the table of repeated digests is stored, so that a
line a third of all documents share is an ordinary join key that Spark may
split. Texts are exchanged once, to meet the units they lose.

Defined results:

* a null text stays null and loses nothing, an empty text stays empty;
* units of fewer than ``min_words`` words are never removed;
* rows that repeat both id and text are one document and keep the same units;
  rows that repeat an id with other texts are ranked by text hash; null ids
  rank last;
* kept units are joined by the separator they were cut at, so a text that
  loses nothing is unchanged;
* only the id and text columns are read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from .common import list_udf, stored

MIN_WORDS = 1
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
UNIT = "array<struct<digest binary, unit int, start int, end int>>"


def units_of(text: str, separator: str, min_words: int) -> list[dict]:
    """Units of at least ``min_words`` words: digest, number and character offsets."""
    out, start = [], 0
    for i, unit in enumerate(text.split(separator)):
        words = unit.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
        if len(words) >= min_words:
            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            out.append({"digest": digest, "unit": i, "start": start, "end": start + len(unit)})
        start += len(unit) + len(separator)
    return out


def _units(separator: str, min_words: int):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("digest", pa.binary()), ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    return list_udf(lambda: lambda texts: [units_of(t, separator, min_words) if t else [] for t in texts], kind, UNIT)


def _without(separator: str):
    def strip_batches(texts, removed):
        import pyarrow as pa

        out = []
        for text, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            if gone:
                drop = set(gone)
                text = separator.join([u for i, u in enumerate(text.split(separator)) if i not in drop])
            out.append(text)
        return pa.array(out, pa.string())

    import pyarrow as pa

    strip_batches.__annotations__ = {"texts": pa.Array, "removed": pa.Array, "return": pa.Array}
    return F.arrow_udf(strip_batches, "string")


def dedup(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (what is left), removed (array of unit, start, end)."""
    separator = SEPARATORS[unit]
    text = F.col(f"`{text_col}`")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = base.withColumn("key", key)
    found = stored(keyed.select("doc_id", "key", _units(separator, min_words)("text").alias("units")))
    units = found.select("doc_id", "key", F.explode("units").alias("u")).select(
        "doc_id", "key", "u.digest", "u.unit", "u.start", "u.end")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("key"), F.col("unit"))
    repeated = stored(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"))
    lost = units.join(repeated, "digest").where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
          & (F.col("unit") == F.col("first.unit"))))
    by_doc = lost.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.sort_array(F.collect_set(F.struct("unit", "start", "end"))).alias("removed"))
    joined = keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast("array<struct<unit int, start int, end int>>")
    done = joined.select("doc_id", "text", F.coalesce("removed", none).alias("removed"))
    return done.select("doc_id", _without(separator)("text", F.col("removed.unit")).alias("text"), "removed")
