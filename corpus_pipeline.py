"""The corpus pipeline: raw documents to encoded training documents.

Each stage takes the documents its predecessor kept and returns a DataFrame
that is written and read again before the next stage. All but the last return
the columns of ``documents``.

Null texts and texts without letters leave in the first stage; of equal texts
the largest id stays, of near duplicates the smallest; mixing emits a document
as often as its source's rate asks for, so ids repeat from there on; the last
stage returns one row per emitted document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import bpe, exact_dedup, langid, mixing, near_dedup
from panelspark.llm.common import held_out, stored

LEAST_LANGUAGE_SHARE = 0.5
#: Documents that share this part of their shingles are near copies.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents most of whose letters are in one known language; a missing label is filled in."""
    model = langid.fit(langid.training_rows(docs, ~held_out(F.col("doc_id"))))
    found = langid.labelled(docs, model, out="_language")
    sure = found.where((F.col("_language.lang") != langid.UNKNOWN) & (F.col("_language.score") >= LEAST_LANGUAGE_SHARE))
    return sure.withColumn("lang", F.coalesce("lang", "_language.lang")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding gives the text back."""
    import public_tokenizers

    coder = bpe.Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = docs.select("doc_id", "lang", "source", "text", coder.round_trip(F.col("text")).alias("b"))
    return done.select("doc_id", "lang", "source", bpe.n_tokens(F.col("b.ids")).alias("n_tokens"), F.col("b.ids").alias("ids"),
                       (F.col("b.bytes") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]
#: SQL can express neither the language model nor the encoding; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
