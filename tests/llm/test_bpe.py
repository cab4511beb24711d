import base64
import random
from functools import cache

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelspark.llm.bpe import Bpe, Codec, n_tokens

from .helpers import SF2, awkward, nothing, rows_of

PATH = tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def both():
    raw = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return Codec(raw, tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(text):
    own, library = both()
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("aeioutnshr é\n\t\xa0'.,19中😀%*") + ["the", "ing", "  ", "'s", "<|endoftext|>"])))
def test_texts_as_the_library(parts):
    same("".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_joining_any_halves_gives_the_whole(data):
    own, _ = both()
    whole = own.merged(data)
    for cut in (1, len(data) // 2, len(data) - 1):
        if 0 < cut < len(data):
            assert own.join(own.merged(data[:cut]), own.merged(data[cut:])) == whole
    assert own.tree(data) == whole


def test_long_pieces_and_segments(monkeypatch):
    r = random.Random(1)
    for text in ["a" * 5001, "x" * 999 + " " * 777 + "y" * 500, "".join(r.choice("abcdetn") for _ in range(5000)), " " * 2001 + "a"]:
        same(text)
    monkeypatch.setattr("panelspark.llm.bpe.SEGMENT", 50)
    monkeypatch.setattr("panelspark.llm.bpe.BLOCK", 8)
    same("".join(r.choice(["the", " ", "\n", " and", "é", "  ", "it's"]) for _ in range(3000)))


def test_columns_on_documents(spark):
    _, library = both()
    coder = Bpe(spark, PATH, tokenizers.PATTERN)
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    done = docs.select("doc_id", "text", coder.encode(F.col("text")).alias("ids")).select(
        "*", coder.decode(F.col("ids")).alias("bytes"), n_tokens(F.col("ids")).alias("n"))
    for r in done.collect():
        expected = library.encode_ordinary(r["text"])
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected and r["n"] == len(expected)
        assert bytes(r["bytes"]) == r["text"].encode()


def test_awkward_rows(spark):
    coder = Bpe(spark, PATH, tokenizers.PATTERN)
    docs = awkward(spark)
    done = rows_of(docs.withColumn("ids", coder.encode(F.col("text"))).withColumn("bytes", coder.decode(F.col("ids"))))
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in done) and len(done) == docs.count()
    assert rows_of(nothing(spark).select(coder.encode(F.col("text")))) == []


def test_unknown_id_raises():
    with pytest.raises(IndexError):
        both()[0].decode((10**6).to_bytes(4, "little"))
