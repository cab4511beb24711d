"""Periodic runs, benchmark decontamination and conversation repair against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, repair, runs
from panelspark.llm.queries import QUERIES

from .helpers import SF, awkward, nothing, rows_of, sha

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


# --- runs ---------------------------------------------------------------------

def plain_runs(s, least=12):
    """Every period is tried from every place."""
    found = {}
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = random.Random(7)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(0, 4)):
            s = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 70))]
            if s and rng.random() < 0.5:
                a, p = rng.randrange(len(s)), 1 + rng.randrange(9)
                s = [s[i] if i < a else s[a + (i - a) % p] if a + (i - a) % p < len(s) else 0 for i in range(len(s))]
            texts.append(s)
        starts = np.cumsum([0] + [len(s) for s in texts])
        found = runs.runs_of(np.array([x for s in texts for x in s], np.int64), starts)
        assert found == [(a + t, b + t, p) for t, s in zip(starts.tolist(), texts) for a, b, p in plain_runs(s)]


def test_long_periodic_texts_stay_cheap():
    s = np.array([0] * 60_000 + [1, 2] * 30_000)
    assert runs.runs_of(s, np.array([0, len(s)])) == [(0, 60_000, 1), (60_000, 120_000, 2)]
    with pytest.raises(ValueError):
        runs.add_runs(None, least=5)


def collapse(text):
    words = WORDS.findall(text or "")
    gone = set()
    found = plain_runs(words)
    for a, b, p in found:
        gone.update(range(a + p, b))
    return [{"start": a, "length": b - a, "period": p} for a, b, p in found], " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_on_awkward_rows(spark):
    extra = spark.createDataFrame(
        [(20, "x y z " * 7 + " x y z\x0b x y z x"), (20, "a " * 30), (21, "a " * 11), (22, ("あ " * 13 + "b ") * 3)], "doc_id long, text string")
    docs = awkward(spark).where("doc_id is null or doc_id not in (5, 6)").unionByName(extra, allowMissingColumns=True).withColumn("periodic", F.lit(1))
    found = rows_of(runs.add_runs(docs))
    assert len(found) == docs.count()
    for r in found:
        assert (r["periodic"]["runs"], r["periodic"]["collapsed"]) == collapse(r["text"])
        assert r["key"] is None or r["key"] == "x"
    assert sum(len(r["periodic"]["runs"]) for r in found) >= 4
    assert runs.add_runs(nothing(spark)).count() == 0
    tails = rows_of(runs.repeat_tails(spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (3, "")], "doc_id long, text string"),
                                      F.lit(12), F.lit(True)))
    assert [r["text"] for r in tails] == ["a b c d e f"[:4] + "c d c d c d c d", None, ""]


# --- decontamination ----------------------------------------------------------

def plain_hits(docs, items, window):
    """Every window of every item is looked for at every place."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    ids |= windows[tuple(w[s : s + m])]
        spans = [(s, next(e for e in range(s, len(w) + 1) if e not in hit)) for s in sorted(hit) if s - 1 not in hit]
        out.append((doc_id, len(w), spans, sorted(ids)))
    return sorted(out, key=repr)


def marked(docs, items, **kw):
    found = rows_of(decontaminate.mark(docs, items, **kw))
    return sorted(((r["doc_id"], r["contamination"]["n_words"], [(s["start"], s["stop"]) for s in r["contamination"]["spans"]],
                    r["contamination"]["items"]) for r in found), key=repr)


DOCS = [(1, "A b c d e"), (2, None), (None, "x-y z one two three four five six seven eight"), (3, ""), (3, "b C"), (3, "b C"), (None, None),
        (4, "q " * 30 + "b c d e f g"), (5, "12 ÉTÉ ΣΑΣ K k...l'" * 9), (6, "...")]
ITEMS = [(1, "b c"), (2, "One two three four five six seven eight"), (2, None), (None, "c d"), (5, "..."), (6, "q q q q q q q q q q q"),
         (7, ""), (8, "ÉTÉ ΣΑΣ K K l 12 ÉTÉ ΣΑΣ K k l"), (1, "b c")]


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_on_awkward_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)  # 0: the salted joins
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("items", "width", "_id", "words")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(3))
    want = plain_hits(DOCS, ITEMS, 10)
    assert marked(docs, items) == want and sum(bool(r[2]) for r in want) == 6
    if rows:
        assert marked(docs, items, window=4, gram=2) == plain_hits(DOCS, ITEMS, 4)
        assert marked(docs, items.where("false")) == plain_hits(DOCS, [], 10)
        assert marked(docs.where("false"), items) == []


def test_winnowing_keeps_few_fingerprints(spark):
    text = " ".join(f"w{i * 7919 % 5003}" for i in range(4000))
    kept = spark.createDataFrame([(text,)], "text string").select(
        F.size(decontaminate.fingerprints(decontaminate.words_of(F.col("text")), [10]))).first()[0]
    assert 0.2 * 4000 < kept < 0.4 * 4000


# --- conversation repair ------------------------------------------------------

def plain_repair(kinds):
    """The least (cost, audit), state by state, with whole audits."""
    letters = "xsua"

    def inserted(states):
        for _ in range(3):
            for q, t in ((0, 2), (1, 2), (2, 3), (3, 2)):
                if q in states:
                    made = (states[q][0] + 5, states[q][1] + "I")
                    states[t] = min(states.get(t, made), made)
        return states

    states = {0: (0, "")}
    for kind in kinds:
        role, must, extra, made = letters[kind % 4], kind % 8 >= 4, 5 * (kind >= 8), []
        for q, (cost, audit) in inserted(states).items():
            made.append((q, cost + 2, audit + "D"))
            if not must:
                made.append((3 if q == 2 else 2, cost + 1 + extra, audit + "R"))
                if (q, role) in {(0, "s"), (0, "u"), (1, "u"), (2, "a"), (3, "u")}:
                    made.append(({"s": 1, "u": 2, "a": 3}[role], cost + extra, audit + "K"))
        states = {}
        for q, cost, audit in made:
            states[q] = min(states.get(q, (cost, audit)), (cost, audit))
    return min(v for q, v in inserted(states).items() if q in (0, 3))


def test_rebuild_against_whole_audits():
    rng = random.Random(3)
    for _ in range(3000):
        kinds = bytes(rng.choice((0, 1, 2, 3, 2, 3, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)) for _ in range(rng.randint(0, 14)))
        cost, audit = plain_repair(kinds)
        assert repair.before(repair.matrix_of(kinds), repair.END)[0] == cost
        edits = repair.rebuild(kinds, 0, repair.END)
        state = repair.state_after(kinds, edits)
        while repair.END[state]:
            edits, state = edits + "I", repair.NEXT[state]
        assert edits == audit


def plain_conversation(rows):
    """All columns of one conversation's (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank = not WORDS.search(text)
        again = not blank and (role, text) in seen
        cut = not blank and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        seen.add((role, text))
        counts = [n + x for n, x in zip(counts, (blank, again, cut))]
        kinds.append(repair.kind_of(role[:1], blank or again, cut))
    cost, audit = plain_repair(kinds)
    lines, at, state = [], 0, 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            lines.append(f"{rows[at][1]}:{rows[at][2]}")
            state = kinds[at] % 4
        else:
            state = 3 if state == 2 else 2
            lines.append({2: "user:", 3: "assistant:"}[state] + (rows[at][2] if edit == "R" else ""))
        at += edit != "I"
    initials = [r[1][:1] or " " for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *counts, illegal, cost, audit, sha("\n".join(lines))


def talks(seed, conversations=40, longest=60):
    rng, out = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest if conv % 10 == 0 else 8)):
            row = (conv if conv else None, rng.choice([turn, turn, turn, turn + 3, None]),
                   rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                   rng.choice(["Yes.", "No!", f"Text {turn}.", f"text {turn}", " \n", "", None, "Why?\t"]))
            out.extend([row] * rng.choice([1, 1, 1, 1, 3]))
    return out


@pytest.mark.parametrize("block", [repair.BLOCK, 4])
def test_repair_on_awkward_rows(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # 4: conversations of many blocks
    rows = talks(block)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("x") for c in ("copies", "pid", "seq", "first", "said", "audit")})
    found = {r["conv_id"]: tuple(list(r.values())[1:]) for r in rows_of(repair.repair(table.repartition(5)))}
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).append(tuple(row))
    assert found == {conv: plain_conversation(r) for conv, r in want.items()}
    if block == 4:
        assert repair.repair(table.where("false")).count() == 0


def test_repair_query_keeps_every_conversation(spark):
    found = rows_of(QUERIES["op13_conversation_repair"](spark, SF))
    assert len(found) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert all(re.fullmatch("[DIKR]*", r["audit"]) for r in found)
