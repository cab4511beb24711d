import pytest
from pyspark.sql import functions as F

from panelspark.llm import exact_dedup, mixing

from .helpers import SF2, awkward, documents, nothing, rows_of, sha


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("runs,fan_in", [(64, 8), (5, 2), (1, 8)])
def test_merge_rounds_agree_with_brute_force(spark, runs, fan_in):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").repartition(7)
    merged = rows_of(exact_dedup.merge_runs(exact_dedup.digest_rows(docs), "largest", runs, fan_in))
    expected = {}
    for r in docs.collect():
        expected.setdefault(sha(lower(r["text"])), []).append(r["doc_id"])
    assert {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in merged} == {
        k: (max(v), len(v)) for k, v in expected.items()}


def test_a_false_digest_raises(spark):
    rows = exact_dedup.digest_rows(documents(spark, [(1, "a", None, None), (2, "b", None, None)]))
    forged = rows.withColumn("text_sha256", F.lit("same"))
    with pytest.raises(Exception, match="one digest for different texts"):
        exact_dedup.merge_runs(forged).collect()


def test_exact_on_awkward_rows(spark):
    found = rows_of(exact_dedup.mark(awkward(spark)))
    assert len(found) == awkward(spark).count()
    by = {}
    for r in found:
        by.setdefault(r["text_sha256"], []).append(r)
    same = by[sha("same text here")]
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in same} == {
        (3, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False)}
    empty = by[sha("")]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in empty} == {(1, 2, False), (2, 2, True), (None, 2, False)}
    assert rows_of(exact_dedup.mark(nothing(spark))) == []


def test_drop_copies_keeps_columns(spark):
    docs = awkward(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 7, 8, 9, 10, 11, 12]  # of the two equal rows of 4 one stays


def fixed_point(sizes, limit=3):
    """Targets by resharing the excess until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > limit * sizes[s]]
        if not above:
            return full | share
        full |= {s: float(limit * sizes[s]) for s in above}


def test_targets_are_the_fixed_point(spark):
    sizes = {"b": 10, "a": 1000, None: 7, "c": 0, "d": 5, "é": 400, "Z": 1}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    found = {r["source"]: r for r in rows_of(mixing.source_rates(table))}
    expected = fixed_point(sizes)
    for s, n in sizes.items():
        assert found[s]["target"] == pytest.approx(expected[s])
        assert found[s]["rate"] <= 3 and found[s]["source_size"] == n
    assert sum(r["target"] for r in found.values()) == pytest.approx(sum(sizes.values()))


def test_mix_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    plan = rows_of(mixing.plan_mix(docs))
    again = rows_of(mixing.plan_mix(docs.repartition(5)))
    key = lambda rows: sorted((r["doc_id"], r["copies"]) for r in rows)
    assert key(plan) == key(again)
    by = {}
    for r in plan:
        assert r["taken"] <= 3 * r["size"] and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        taken, variance, target = by.get(r["source"], (0, 0.0, 0.0))
        f = r["rate"] - int(r["rate"])
        by[r["source"]] = (taken + r["taken"], variance + r["size"] ** 2 * f * (1 - f), r["target"])
    for taken, variance, target in by.values():
        assert abs(taken - target) <= 4 * variance ** 0.5 + 1
    emitted = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in emitted} == {r["doc_id"]: r["copies"] for r in plan if r["copies"] and r["size"]}


def test_mix_on_awkward_rows(spark):
    plan = rows_of(mixing.plan_mix(awkward(spark)))
    assert len(plan) == awkward(spark).count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in plan if r["doc_id"] in (1, 2, 7))
    mixed = mixing.mix(awkward(spark))
    assert mixed.columns == awkward(spark).columns and mixed.count() > 0
    assert rows_of(mixing.plan_mix(nothing(spark))) == [] and mixing.mix(nothing(spark)).count() == 0
    no_words = documents(spark, [(1, "", "en", "a"), (2, None, "en", "b")])
    assert {r["target"] for r in rows_of(mixing.plan_mix(no_words))} == {0.0}
