"""Language, quality and toxicity: held-out accuracy on the whole small table, and defined results."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import common, labelled, langid, quality, toxicity
from panelspark.llm.common import held_out, table
from panelspark.llm.queries import QUERIES

from .helpers import SF, SF2, awkward, documents, in_test, nothing, rows_of


def held(spark, name, *columns):
    docs = table(spark, SF2, "documents").select("doc_id", "lang", "text")
    labels = table(spark, SF2, "labels")
    joined = QUERIES[name](spark, SF2).join(docs, "doc_id").join(labels, "doc_id", "left")
    return [r for r in rows_of(joined) if r["held_out"]]


def test_held_out_is_the_crc_rule(spark):
    ids = spark.range(500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == in_test(r["id"]) for r in ids)


def test_language_of_held_out_documents(spark):
    rows = held(spark, "op6_language_id")
    assert len(rows) > 200
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def model_of(spark):
    docs = table(spark, SF2, "documents")
    return langid.fit(langid.training_rows(docs, ~held_out(F.col("doc_id")))), docs


def test_spans_of_mixed_texts(spark):
    model, docs = model_of(spark)
    texts = {r["lang"]: r["text"] for r in docs.where("lang in ('en', 'fr', 'de')").orderBy(F.length("text").desc()).collect()[::-1]}
    own = langid.Labeller(model)
    parts = [(" ".join(texts[lang].split()[:80]), lang) for lang in ("en", "fr", "de")]
    found = own.label(" ".join(t for t, _ in parts))
    assert [s["lang"] for s in found["spans"]] == ["en", "fr", "de"]
    whole, at = " ".join(t for t, _ in parts), 0
    for span, (text, _) in zip(found["spans"], parts, strict=True):
        assert abs(span["start"] - at) < 60
        at += len(text) + 1
    assert found["spans"][0]["start"] == 0 and found["spans"][-1]["end"] == len(whole)


def test_shortcut_gives_the_best_path(spark):
    model, _ = model_of(spark)
    own, r = langid.Labeller(model, switch=2.0), random.Random(3)

    def cost(path, scores):
        return sum(scores[i][p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    import itertools

    for _ in range(200):
        n = r.randint(1, 5)
        scores = np.array([[r.uniform(-3, 0) for _ in range(own.width)] for _ in range(n)])
        best = max(cost(p, scores) for p in itertools.product(range(own.width), repeat=n))
        assert cost(own.path(scores).tolist(), scores) == pytest.approx(best)


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(
        [("the house and the garden of the people", "en"), ("дом и сад этого города и людей", "ru")] * 20)]
    model = langid.fit(documents(spark, rows).select("lang", "text"))
    own = langid.Labeller(model)
    assert own.label("людей сад")["lang"] == "ru" and own.label("garden house")["lang"] == "en"
    assert own.label("дом zzz сад города and people of the house")["spans"]


def test_language_on_awkward_rows(spark):
    model, _ = model_of(spark)
    found = {(r["doc_id"], r["text"]): r["language"] for r in rows_of(langid.labelled(awkward(spark), model))}
    for key in ((1, None), (2, ""), (7, "   \n\t "), (12, "12 34 !!")):
        assert found[key] == {"lang": "und", "score": 0.0, "spans": []}
    empty = langid.fit(langid.training_rows(nothing(spark), F.lit(True)))
    assert {r["language"]["lang"] for r in rows_of(langid.labelled(awkward(spark), empty))} == {"und"}
    assert rows_of(langid.labelled(nothing(spark), model)) == []


def test_quality_of_held_out_documents(spark):
    rows = [r for r in held(spark, "op5_ordinal_quality") if r["quality"] is not None]
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.95
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"])
    low, high = ([r["expected_grade"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert np.mean(low) < 0.7 < 1.7 < np.mean(high)


def test_ordinal_fit_orders_grades():
    own, r = quality.Features(), random.Random(2)
    texts = [(g, " ".join(r.choice(["good"] * g + ["bad"] * (3 - g) + ["and", "so"]) for _ in range(40)))
             for g in (0, 1, 2, 3) for _ in range(60)]
    model = quality.fit([(g, *own.of_text(t)) for g, t in texts], grades=4)
    assert model.thresholds == sorted(model.thresholds)
    means = [np.mean([sum(model.tails(float((model.weights[a] * w).sum()))) for a, w in
                      (own.of_text(t) for g, t in texts if g == grade)]) for grade in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2
    tails = model.tails(0.3)
    assert tails == sorted(tails, reverse=True)


def test_quality_on_awkward_rows(spark):
    model = quality.fit([], grades=3)
    done = rows_of(quality.graded(awkward(spark), model))
    assert len(done) == awkward(spark).count() and all(len(r["quality"]["tails"]) == 2 for r in done)
    assert rows_of(quality.graded(nothing(spark), model)) == []
    one = quality.fit([(2, *quality.Features().of_text("a b c"))] * 3, grades=3)
    assert sum(one.tails(float(one.weights.sum()))) > 1.0


def test_toxicity_of_held_out_documents(spark):
    rows = [r for r in held(spark, "op8_toxicity") if r["toxic"] is not None]
    toxic, clean = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([r["predicted"] for r in toxic]) > 0.65  # the sample has 38 toxic texts in four languages
    assert np.mean([r["predicted"] for r in clean]) < 0.02
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_block_max_search_is_exact():
    r = random.Random(5)
    idf = [r.uniform(1, 5) for _ in range(30)]
    examples = [(i, r.randint(0, 1), {r.randrange(30): r.randint(1, 4) for _ in range(r.randint(0, 6))}) for i in range(400)]
    index = toxicity.BlockMaxIndex(examples, idf, block=16)
    for _ in range(100):
        counts = {r.randrange(30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        q = index.unit(counts)
        exact = []
        for doc, label, other in examples:
            v = index.unit(other)
            cosine = sum(w * v.get(t, 0.0) for t, w in q.items())
            if cosine > 0:
                exact.append((-round(cosine, 12), doc, label))
        exact = sorted(exact)[:15]
        found = index.nearest(counts, 15)
        assert [round(s, 9) for s, _, _ in found] == [round(-s, 9) for s, _, _ in exact]


def test_toxicity_on_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (2, 3, 4, 5, 9, 10, 11)] + [(None, 1, 1), (8, 1, None)],
                                   "doc_id bigint, quality int, toxic int")
    sample = labelled.sample_labels(labels, F.col("toxic"), F.lit(True), 100, "t")
    done = rows_of(toxicity.classify(docs, sample))
    assert len(done) == docs.count() and all(0 <= r["toxicity"]["score"] <= 1 for r in done)
    none = labelled.sample_labels(labels.where("false"), F.col("toxic"), F.lit(True), 100, "t")
    assert {r["toxicity"]["score"] for r in rows_of(toxicity.classify(docs, none))} == {0.0}
    assert rows_of(toxicity.classify(nothing(spark), sample)) == []


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_toxicity_with_balanced_and_mostly_toxic_labels(spark, share):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    plain, foul, kind = [word() for _ in range(400)], [word() for _ in range(3)], [word() for _ in range(3)]
    rows = []
    for i in range(300):
        toxic = int(r.random() < share)
        rows.append((i, " ".join(r.choices(plain, k=20) + r.choices(foul if toxic else kind, k=2)), toxic))
    docs = documents(spark, [(i, t, "en", "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200], "doc_id bigint, toxic int")
    sample = labelled.sample_labels(labels, F.col("toxic"), F.lit(True), 1000, "t")
    score = {r["doc_id"]: r["toxicity"]["score"] for r in rows_of(toxicity.classify(docs, sample))}
    assert all((score[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i >= 200)


def test_no_language_is_starved_by_others(spark):
    """More trigrams than a model once held, and two languages with one short row each, one in a script of its own."""
    han = "".join(chr(c) for c in range(0x4E00, 0x9F00))
    r = random.Random(12)
    rows = [(i, " ".join("".join(r.choices(han, k=100)) for _ in range(30)), "zh", "s") for i in range(70)] * 2
    rows += [(500, "ilunabarrean etxera", "eu", "s"), (501, "სახლი ხე", "ka", "s")]
    model = langid.fit(langid.training_rows(documents(spark, rows), F.lit(True)))
    assert len(model.grams) > 200_000
    own = langid.Labeller(model)
    found = [own.label(t) for t in ("etxera ilunabarrean", "ხე სახლი")]
    assert [(x["lang"], x["score"]) for x in found] == [("eu", 1.0), ("ka", 1.0)]


def test_every_labelled_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[i // 26**k % 26] * 3 for k in range(3))
    rows = [(i, word(i), f"l{i:04}", "s") for i in range(1100)]
    model = langid.fit(langid.training_rows(documents(spark, rows), F.lit(True)))
    assert model.languages == [f"l{i:04}" for i in range(1100)]
    own = langid.Labeller(model)
    assert [own.label(word(i))["lang"] for i in (0, 555, 1099)] == ["l0000", "l0555", "l1099"]


def test_block_bounds_skip_blocks_and_lose_nothing():
    """Families of alike examples: the search of one family's text leaves most blocks out, with the neighbours of a full scan."""
    r = random.Random(15)
    idf = [r.uniform(1, 5) for _ in range(400)]
    families = [r.sample(range(400), 12) for _ in range(40)]
    examples = [(i, i % 2, {t: r.randint(1, 4) for t in r.sample(families[i % 40], 8)}) for i in range(2000)]
    small, whole = toxicity.BlockMaxIndex(examples, idf, 16), toxicity.BlockMaxIndex(examples, idf, 2000)
    visited = []
    for _ in range(50):
        counts = {t: r.randint(1, 4) for t in r.sample(families[r.randrange(40)], 8)}
        found = small.nearest(counts, 15, 7)
        assert [(round(s, 9), d) for s, d, _ in found] == [(round(s, 9), d) for s, d, _ in whole.nearest(counts, 15, 7)]
        assert len(found) == 15 and 7 not in {d for _, d, _ in found}
        visited.append(small.visited[0])
    assert small.n_blocks == 125 and np.mean(visited) < 40


def test_whole_query_against_a_plain_loop(spark):
    """op8's search over all documents of the small table equals cosines over all examples, one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = labelled.sample_labels(labels, F.col("toxic"), ~common.held_out(F.col("doc_id")), toxicity.MAX_EXAMPLES, "t")
    terms = toxicity.choose_terms(labelled.sample_texts(docs, sample))
    at = {t: i for i, t in enumerate(terms)}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counted = {d: Counter(at[x] for w in t.lower().split() for x in toxicity.terms_of(w) if x in at) for d, t in texts.items()}
    df = Counter(t for c in counted.values() for t in c)
    idf = [math.log((1 + len(texts)) / (1 + df[i])) + 1.0 for i in range(len(terms))]

    def unit(c):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    examples = [(r["doc_id"], r["label"], unit(counted[r["doc_id"]])) for r in sample.collect() if r["doc_id"] in counted]
    rate = sum(y for _, y, _ in examples) / len(examples)
    without = [y for _, y, v in examples if not v]
    found = {r["doc_id"]: r["toxicity"] for r in rows_of(toxicity.classify(docs, sample))}
    assert found.keys() == texts.keys()
    for d, c in counted.items():
        q = unit(c)
        near = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i, y) for i, y, v in examples)
        near = [x for x in near if x[0] < 0][:toxicity.NEIGHBOURS]
        total = -sum(s for s, _, _ in near)
        want = (-sum(s * y for s, _, y in near) + rate) / (total + 1) if near else (sum(without) + rate) / (len(without) + 1)
        assert found[d]["score"] == pytest.approx(want, abs=1e-9)
        assert [round(e["cosine"], 9) for e in found[d]["evidence"]] == [round(-s, 9) for s, _, _ in near]


def test_every_labelled_example_can_be_found(spark):
    """Words of one toxic example only are too little evidence to be chosen; its copy finds it all the same."""
    r = random.Random(16)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    plain = [word(6) for _ in range(200)]
    rows = [(i, " ".join(r.choices(plain, k=20)), 0) for i in range(180)]
    rows += [(i, " ".join([word(9) for _ in range(10)]), 1) for i in range(180, 200)]
    copies = [(1000 + i, t, y) for i, t, y in rows[170:]]
    docs = documents(spark, [(i, t, "en", "s") for i, t, _ in rows + copies])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    sample = labelled.sample_labels(labels, F.col("toxic"), F.lit(True), 1000, "t")
    found = {r["doc_id"]: r["toxicity"] for r in rows_of(toxicity.classify(docs, sample))}
    for i, _, y in copies:
        assert i - 1000 in {e["doc_id"] for e in found[i]["evidence"] if e["cosine"] > 0.999}
        assert (found[i]["score"] >= toxicity.THRESHOLD) == bool(y)


def test_numerals_are_no_letters():
    assert [langid.letters_of(w) for w in ("½", "²①", "x²y", "Été,", "_a1b")] == ["", "", "xy", "été", "ab"]


def test_word_scores_equal_a_plain_loop():
    languages = ["el", "en", "zh"]
    rng = np.random.default_rng(5)
    grams = ["^th", "the", "he^", "he$", "^κα", "καλ", "^我", "^我$", "爱$$", "^a$"]
    grams = {g: i for i, g in enumerate(g for g in grams if len(g) == 3)}
    many = rng.integers(1, 4, len(grams))
    at = np.concatenate([rng.permutation(3)[:m] for m in many]).astype(np.int32)
    scripts = {"latin": [False, True, False], "greek": [True, False, False], "han": [False, False, True]}
    model = langid.Model(languages, scripts, grams, rng.normal(-9, 1, 3), np.cumsum([0, *many]), at, rng.uniform(1, 9, len(at)))
    labeller = langid.Labeller(model)
    words = ["the", "The,", "a", "καλή", "我", "我爱", "123", "!", "½", "мир", "𐐀𐐁", "th", "theκα", "İ", "x" * 90, "the"]
    for words in (words, ["12"], ["the"], [w for w in words for _ in range(3)]):
        got = labeller.rows_of(words)
        for word, row in zip(words, got, strict=True):
            letters = langid.letters_of(word)
            ok = scripts.get(langid.script_of(letters)) if letters else None
            own = [grams[g] for g in langid.grams_of(letters) if g in grams] if ok else []
            want = len(own) * model.unseen
            for g in own:
                for e in range(model.first[g], model.first[g + 1]):
                    want[at[e]] += model.gain[e]
            if ok:
                want = want + np.where(ok, 0.0, langid.WRONG_SCRIPT)
            assert np.allclose(row[:-2], want, atol=1e-9) and row[-2] == len(letters)
            assert row[-1] == (bool(own) or ok is not None)
    empty = langid.Labeller(langid.Model([], {}, {}, np.zeros(0), np.zeros(1, int), np.zeros(0, np.int32), np.zeros(0)))
    assert empty.label("some text") == {"lang": "und", "score": 0.0, "spans": []}


def test_quality_features_equal_their_definition():
    """Every word's buckets and marks by the plain rules, also for the words that take the short way."""
    made = quality.Features()
    words = ["word", "Word", "WORD", "wOrd", "a", "A", "aa", "AB", "x1", "12", "don't", "--", "ß", "ÄÖ", "Äö", "½", "a_b", "!!!", "é" * 80]
    for word in words * 2:
        letters = re.sub(r"[\W_]+", "", word)
        shape = re.sub(r"(.)\1+", r"\1", "".join(
            "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))[:quality.LONGEST_KEPT]
        marks = (len(letters) > 1 and letters.isupper(), bool(re.search(r"[^\w\s]{2,}", word)), not letters)
        got = made.of_word(word)
        assert got[:2] == (made.bucket("w:" + letters.lower()), made.bucket("s:" + shape))
        assert (got[2] or (False, False, False)) == marks


def test_search_multiplies_frequent_terms_only_and_stays_exact():
    """More terms than FREQUENT: only frequent ones are laid out as tables, and neighbours and cosines are those of a full scan."""
    r = random.Random(21)
    n_terms = 3 * toxicity.FREQUENT
    idf = [r.uniform(1, 5) for _ in range(n_terms)]
    draw = lambda: {int(n_terms * r.random() ** 3): r.randint(1, 4) for _ in range(60)}
    examples = [(i, i % 2, draw()) for i in range(600)]
    examples += [(600 + i, 0, examples[i][2]) for i in range(100)]  # copies tie
    index = toxicity.BlockMaxIndex(examples, idf, block=16)
    assert len(index.frequent) == toxicity.FREQUENT and len(index.other_rows)
    units = {doc: index.unit(counts) for doc, _, counts in examples}
    for counts in [draw() for _ in range(40)] + [examples[5][2], {}, {n_terms - 1: 1}]:
        q = index.unit(counts)
        exact = sorted((-round(c, 12), doc) for doc, v in units.items() if (c := sum(w * v.get(t, 0.0) for t, w in q.items())) > 0)[:15]
        found = index.nearest(counts, 15)
        assert [round(s, 10) for s, _, _ in found] == [round(-s, 10) for s, _ in exact]
        assert [d for _, d, _ in found] == [d for _, d in exact]


def test_terms_of_many_tokens_at_once():
    r = random.Random(22)
    letters = "abcdeé日😀"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(2000)]
    tokens = ["", "^", "$^ab", "ab_cd", "a-bcde.fgh", "x" * 500, *words, *[f"{a},{b}" for a, b in zip(words, words[1:])]]
    every = sorted({t for w in tokens for t in toxicity.terms_of(w)})
    for chosen in ([], r.sample(every, 300), every):
        at = {t: i for i, t in enumerate(chosen)}
        assert [sorted(x) for x in toxicity.TermFinder(at).find(tokens)] == [sorted(at[t] for t in toxicity.terms_of(w) if t in at) for w in tokens]
