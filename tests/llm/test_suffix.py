import random

import pytest
from hypothesis import given, settings, strategies as st

from panelspark.llm import suffix_dedup
from panelspark.llm.suffix_sort import neighbour_matches, suffix_array

from .helpers import SF, awkward, documents, nothing, rows_of, sha

LENGTH = suffix_dedup.LENGTH


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(symbols):
    order = suffix_array(symbols)
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    match = lambda i, j: next((k for k in range(len(symbols)) if symbols[i + k:i + k + 1] != symbols[j + k:j + k + 1]
                               or i + k >= len(symbols) or j + k >= len(symbols)), 0)
    expected = [max((match(i, j) for j in range(len(symbols)) if j != i), default=0) for i in range(len(symbols))]
    assert neighbour_matches(symbols, order) == expected


def brute(texts):
    """Per text the removed spans, by a dictionary of all strings of LENGTH bytes."""
    seen = {}
    data = [t.encode() if t else b"" for t in texts]
    for d in data:
        for i in range(len(d) - LENGTH + 1):
            seen[d[i:i + LENGTH]] = seen.get(d[i:i + LENGTH], 0) + 1
    out = []
    for d in data:
        spans = suffix_dedup.united([(i, i + LENGTH) for i in range(len(d) - LENGTH + 1) if seen[d[i:i + LENGTH]] > 1])
        out.append((spans, b"".join(d[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(d)], strict=True))))
    return out


def check(spark, rows):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    found = {r["doc_id"]: r for r in rows_of(suffix_dedup.repeats(docs))}
    assert len(found) == len(rows)
    for i, (spans, kept) in enumerate(brute(rows)):
        r = found[i]
        assert [(s["start"], s["end"]) for s in r["spans"]] == spans, i
        text = (rows[i] or "").encode()
        assert bytes(r["kept"] if r["kept"] is not None else text) == kept
        assert r["n_bytes"] == len(text) and r["text_sha256"] == sha(text)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(120), prose(400)
    rows = [prose(200) for _ in range(5)] + [base, base, None, "", "ab" * 700, "a" * 1500, passage[:399], passage[:400]]
    rows += [prose(r.randint(0, 60)) + passage + prose(r.randint(0, 60)) for _ in range(12)]  # shared by many
    rows += [prose(30) + passage[50:500] + prose(30), passage + prose(20) + passage, passage[1:401] + passage[:400]]
    for _ in range(12):  # near copies
        words = base.split(" ")
        for _ in range(r.randint(1, 3)):
            words[r.randrange(len(words))] = word()
        rows.append(" ".join(words))
    return rows


@pytest.mark.parametrize("seed,large,huge", [(1, 200, 8192), (2, 3, 8192), (3, 3, 5)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, large, huge):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(suffix_dedup, "HUGE", huge)
    check(spark, texts(seed))


def aligned(seed, many):
    """(lead, context) of one anchor: a common middle of random reach, some contexts alike at one side, some cut short."""
    r, size = random.Random(seed), LENGTH - suffix_dedup.GRAM
    draw = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    base, out = draw(size + LENGTH), set()
    for _ in range(many):
        a, b = r.randint(0, size), r.randint(size + suffix_dedup.GRAM, size + LENGTH)
        text = draw(a) + base[a:b] + draw(size + LENGTH - b)
        out.add((size, text))
        if r.random() < 0.4:
            out.add((size, text[:-1] + b"_"))
        if r.random() < 0.3:
            cut = r.randint(0, size)
            out.add((size - cut, text[cut:size + r.randint(suffix_dedup.GRAM, LENGTH)]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stretches_by_hash_are_one_span_a_context(spark, seed):
    group = aligned(seed, 40)
    wide = spark.createDataFrame([(7, k, lead, bytearray(x)) for k, (lead, x) in enumerate(group)],
                                 "h bigint, c bigint, lead int, context binary")
    huge = spark.createDataFrame([(7,)], "h bigint")
    found = {r["c"]: [(s["low"], s["high"]) for s in r["spans"]] for r in suffix_dedup._stretches(wide, huge).collect()}
    expected = suffix_dedup.repeated_in_large_group(group)
    assert found == {k: spans for k, spans in enumerate(expected) if spans}


def test_documents_against_brute_force(spark):
    check(spark, [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()])


def test_segments_agree():
    finder = suffix_dedup.AnchorFinder()
    r = random.Random(4)
    import numpy as np

    data = np.array([r.randrange(97, 102) for _ in range(9000)], np.uint8)
    whole = finder.places(data)[0].tolist()
    before, suffix_dedup.SEGMENT = suffix_dedup.SEGMENT, 1000
    try:
        assert finder.places(data)[0].tolist() == whole
    finally:
        suffix_dedup.SEGMENT = before
    for start in range(0, len(data) - LENGTH):  # every string of LENGTH bytes holds an anchor
        assert any(start <= a <= start + LENGTH - suffix_dedup.GRAM for a in whole)


def test_groups_by_sorting_and_by_pairs():
    r = random.Random(9)
    for _ in range(60):
        left, right = bytes(r.choice(b"ab") for _ in range(40)), bytes(r.choice(b"ab") for _ in range(60))
        group = set()
        for _ in range(r.randint(2, 8)):
            a, b = bytearray(left[r.randint(0, 40):]), bytearray(right[:r.randint(20, 60)])
            for x in (a, b):
                if x and r.random() < 0.7:
                    x[r.randrange(len(x))] = 99
            group.add((len(a), bytes(a + b)))
        group = sorted(group)
        for length in (10, 25, 40):
            found = suffix_dedup.repeated_in_group(group, length)
            for k, (lead, text) in enumerate(group):
                runs = []
                for j, (lead2, text2) in enumerate(group):
                    if j == k:
                        continue
                    start = None
                    for p in range(-41, 62):
                        inside = (0 <= p + lead < len(text) and 0 <= p + lead2 < len(text2)
                                  and text[p + lead] == text2[p + lead2])
                        if inside and start is None:
                            start = p
                        if not inside and start is not None:
                            if p - start >= length:
                                runs.append((start, p))
                            start = None
                # All stretches through the anchor are found; nothing that does not repeat is.
                covered = {p for a, b in found[k] for p in range(a, b)}
                assert covered >= {p for a, b in runs if a <= 0 < b for p in range(a, b)}
                assert covered <= {p for a, b in runs for p in range(a, b)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = rows_of(suffix_dedup.repeats(docs))
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1]["n_bytes"] == 0 and by[1]["spans"] == [] and by[5]["spans"] and by[6]["spans"]
    assert rows_of(suffix_dedup.repeats(nothing(spark))) == []
