"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, unit_hash


def sample_labels(labels: DataFrame, value: Column, is_training: Column, limit: int, salt: str) -> DataFrame:
    """At most ``limit`` rows (doc_id, label), the first by a seeded hash of the id.

    Rows with a null id or label are left out; an id with several labels
    keeps the largest.
    """
    rows = labels.where(is_training & F.col("doc_id").isNotNull()).select(
        "doc_id", value.cast("int").alias("label")).where("label is not null")
    picked = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(
        unit_hash(F.lit(salt), F.col("doc_id")), "doc_id").limit(limit)
    return stored(picked)


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label, text of the sampled documents; the bounded sample is broadcast, texts stay in place."""
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    return texts.join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).select("doc_id", "label", "text")
