"""Fixtures and brute-force versions for the operators on training text."""

from __future__ import annotations

import hashlib
import zlib

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHING = ("key", "h", "n", "size", "rate", "draw", "run", "text_sha256", "units", "removed", "component", "label")


def documents(spark, rows):
    """A table of documents from (doc_id, text, lang, source), with extra columns under clashing names."""
    full = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    line = "one shared line of more than five words stands here\n"
    return documents(spark, [
        (1, None, None, None), (2, "", "en", "a"), (3, "Same Text here", "en", "a"), (4, "same text HERE", "en", None),
        (4, "same text HERE", "en", None), (None, "same text here", None, "b"), (None, None, "fr", "b"),
        (5, long_text, "en", "b"), (6, long_text + " end", "en", "b"), (7, "   \n\t ", "en", "c"), (8, "é" * 300, "fr", "c"),
        (9, line + "first", "en", "c"), (10, line + "second", "en", "c"), (11, line, "en", "c"), (12, "12 34 !!", None, "c"),
    ])


def nothing(spark):
    return awkward(spark).where("doc_id < 0")


def in_test(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
