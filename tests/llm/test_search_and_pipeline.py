import base64

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import ann, mixing
from panelspark.llm.queries import ORACLES, QUERIES

from .helpers import SF2, awkward, nothing, rows_of
from .test_exact_and_mix import lower
from .test_near_and_lines import brute


def exact(ids, vectors, asked, k=10):
    out = {}
    for q in asked:
        own = vectors[ids.index(q)]
        ranked = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in zip(ids, vectors, strict=True) if i != q)
        out[q] = ranked[:k]
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF2}/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in table], [np.array(r["embedding"], float) for r in table]
    expected = exact(ids, vectors, [i for i in ids if i % 100 == 0])
    found = {}
    for r in rows_of(QUERIES["op4_multiprobe_ann"](spark, SF2)):
        found.setdefault(r["query_id"], []).append(r)
    at = {i: v for i, v in zip(ids, vectors, strict=True)}
    hits = 0
    for q, best in expected.items():
        mine = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert r["score"] == pytest.approx(float(np.sqrt(((at[q] - at[r["vec_id"]]) ** 2).sum())), rel=1e-14)
        hits += len({i for _, i in best} & {r["vec_id"] for r in mine})
    assert hits / (10 * len(expected)) >= 0.9


def test_copies_blocks_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.5]) for i in range(40)]  # copies, one of them a query
    rows += [(200, None), (300, [0.0] * 4), (400, [1.0, None, 1.0, 1.0]), (500, [float("nan")] * 4),
             (600, [float("inf"), 1.0, 1.0, 1.0]), (700, [1.0, 2.0]), (None, [1.0] * 4), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("uid", F.lit(2))
    found = {}
    for x in rows_of(ann.search(table, F.col("vec_id") % 100 == 0)):
        found.setdefault(x["query_id"], []).append((x["rank"], x["id"], x["score"]))
    assert set(found) == {0, 100}
    assert sorted(found[100]) == [(k, 100 + k, 0.0) for k in range(1, 11)]
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows[:100]]
    best = exact([i for i, _ in good], [v for _, v in good], [0])[0]
    assert len({i for _, i in best} & {i for _, i, _ in found[0]}) >= 8
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>")
    assert [(x["query_id"], x["rank"]) for x in rows_of(ann.search(few, F.col("vec_id") == 0).orderBy("rank"))] == [(0, 1), (0, 2)]
    assert rows_of(ann.search(few.where("false"), F.col("vec_id") == 0)) == []


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append([r.asDict() for r in docs.collect()])
        stage(spark, docs, SF2).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    last = rows_of(docs)
    raw, known, distinct, apart, mixed = seen
    assert {r["doc_id"] for r in known} == {r["doc_id"] for r in raw}  # every raw document is in one of the four languages
    largest = {}
    for r in known:
        largest[lower(r["text"])] = max(r["doc_id"], largest.get(lower(r["text"]), -1))
    assert sorted(r["doc_id"] for r in distinct) == sorted(largest.values())
    named = brute([(r["doc_id"], r["text"]) for r in distinct], percent=80)
    assert sorted(r["doc_id"] for r in apart) == sorted(i for i, (_, c) in named.items() if i == c)
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in apart], "doc_id bigint, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in rows_of(mixing.plan_mix(frame))}
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert len(last) == len(mixed)
    for r in last:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text[r["doc_id"]]) and r["round_trip"]
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in rows_of(corpus_pipeline.run(spark, SF2))) == sorted(
        (r["doc_id"], bytes(r["ids"])) for r in last)


def test_stages_on_awkward_rows(spark):
    for make in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, make(spark), SF2).collect()


def test_isolated_queries_have_their_neighbours(spark):
    """Dense clusters reach the target with few probes; vectors far from them, and ids with many vectors, get k others too."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(8, 8)) * 50
    rows = [(i, (centres[i % 8] + r.normal(size=8) * 0.01).tolist()) for i in range(1, 2400)]
    far = {10_000 * (j + 1): (r.normal(size=8) * 400).tolist() for j in range(6)}
    rows += list(far.items())
    rows += [(50_001, [900.0 + x / 100] * 8) for x in range(1, 30)] + [(50_000, [900.0] * 8)]
    rows = [(i, v) for i, v in rows if not (i == 50_000 and v != [900.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {}
    for x in rows_of(ann.search(table, F.col("vec_id") % 10_000 == 0)):
        found.setdefault(x["query_id"], []).append((x["rank"], x["id"], x["score"]))
    assert set(found) == {i for i, _ in rows if i % 10_000 == 0}
    for q, mine in found.items():
        own, nearest = np.array(dict(rows)[q]), {}
        for i, v in rows:
            if i != q:
                d = float(np.sqrt(((np.array(v) - own) ** 2).sum()))
                nearest[i] = min(d, nearest.get(i, d))
        best = sorted((d, i) for i, d in nearest.items())[:10]
        assert [k for k, _, _ in sorted(mine)] == list(range(1, 11))
        assert [i for _, i, _ in sorted(mine)] == [i for _, i in best]


def test_repeated_rows_of_an_id_take_one_place(spark):
    rows = [(100, [1.0, 0.0])] + [(5, [1.0, 0.1])] * 12 + [(6, [1.0, 0.1]), (7, [1.0, 0.1])] + [(10 + i, [9.0, float(i)]) for i in range(10)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {x["rank"]: x["id"] for x in rows_of(ann.search(table, F.col("vec_id") % 100 == 0))}
    assert [found[r] for r in range(1, 11)] == [5, 6, 7, 10, 11, 12, 13, 14, 15, 16]
