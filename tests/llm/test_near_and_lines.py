import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.llm import line_dedup, near_dedup
from panelspark.llm.components import components
from panelspark.llm.queries import ORACLES, QUERIES

from .helpers import SF, SF2, awkward, documents, nothing, rows_of


def shingles(text):
    w = text.encode().lower().split() if text else []
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    """doc_id -> (set size, smallest id of its component)."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    posted = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in posted[s])
        for s in sets[i]:
            posted[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows):
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(near_dedup.cluster(docs))}
    assert found == brute(rows)


def families(seed):
    """Near copies with one to many edits, chains, and a passage that many documents share."""
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    shared = [word() for _ in range(40)]
    for _ in range(6):
        base = [word() for _ in range(r.randint(5, 200))]
        now = list(base)
        for _ in range(14):
            rows.append(" ".join(now))
            now = list(base if r.random() < 0.5 else now)
            for _ in range(r.randint(1, 3)):
                now[r.randrange(len(now))] = word()
    rows += [" ".join(shared + [word() for _ in range(r.randint(5, 60))]) for _ in range(40)]
    rows += [" ".join([word()] * r.randint(1, 4)) for _ in range(5)] + ["one two", "ONE  two", None, "", " "]
    order = list(range(len(rows)))
    r.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    check(spark, families(seed))


def test_documents_against_brute_force(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()])


def test_large_group_of_near_copies(spark):
    """A group whose members mostly miss the threshold pairwise, held together by its base."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [" ".join(base)]
    for _ in range(250):
        now = list(base)
        for _ in range(r.randint(1, 3)):
            now[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append(" ".join(now))
    check(spark, list(enumerate(rows)))


def below_threshold(seed, many):
    """A family whose members all miss the threshold pairwise, but share most coordinates' values."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(many):
        now = list(base)
        for at in r.sample(range(5, 145), 3):
            now[at] = f"x{k}_{at}"
        rows.append(" ".join(now))
    return list(enumerate(rows))


def test_family_below_the_threshold_makes_few_pairs(spark):
    rows = below_threshold(9, 120)
    sets = {i: shingles(t) for i, t in rows}
    links = sum(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for i in sets for j in range(i))
    signed = near_dedup.signed(documents(spark, [(i, t, "en", "s") for i, t in rows])).withColumnRenamed("doc_id", "v")
    posts = signed.select("v", "n", F.posexplode("coordinates").alias("at", "token"))
    alone = spark.createDataFrame([], "node bigint, component bigint")
    pairs = near_dedup._pairs_across(posts, alone, signed, 85)
    assert links <= pairs.count() <= links + 60 < len(rows) * (len(rows) - 1) / 2 / 10
    check(spark, rows)


def test_parities_lose_no_link():
    r, own = random.Random(3), near_dedup.Shingler()
    for n in (1, 20, 400, 5000):
        a = {r.randrange(1 << 64) for _ in range(n)}
        b = {x for x in a if r.random() < 0.93} | {r.randrange(1 << 64) for _ in range(n // 20)}
        bits = [own.parities(own.np.array(sorted(x), "uint64")).tobytes() for x in (a, b)]
        assert len(bits[0]) * 8 == near_dedup.PARITY_BITS
        assert (int.from_bytes(bits[0]) ^ int.from_bytes(bits[1])).bit_count() <= len(a ^ b)


def test_connected_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1200)]
    noise = [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    links = spark.createDataFrame(chain + star + noise, "x bigint, y bigint")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    near = defaultdict(set)
    for a, b in chain + star + noise:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert found[node] == min(seen)
    assert set(found) == set(near)
    assert components(links.where("x < 0")).count() == 0


def test_near_on_awkward_rows(spark):
    docs = awkward(spark)
    found = rows_of(near_dedup.cluster(docs))
    assert len(found) == docs.count()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert {(r["n_shingles"], r["component_id"], r["kept"]) for i in (1, 2, 7) for r in by[i]} == {
        (0, 1, True), (0, 2, True), (0, 7, True)}
    assert [(r["component_id"], r["kept"]) for r in by[3] + by[4]] == [(3, True), (3, False), (3, False)]
    assert {(r["n_shingles"], r["component_id"], r["kept"]) for r in by[None]} == {(1, 3, False), (0, None, True)}
    assert by[6][0]["component_id"] == 5
    left = near_dedup.drop_near(docs)
    assert left.columns == docs.columns and 6 not in {r["doc_id"] for r in left.collect()}
    assert rows_of(near_dedup.cluster(nothing(spark))) == []


def test_lines_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.sql(ORACLES["op1_line_dedup"]).fetchall()
    found = [(r["doc_id"], r["n_removed"], r["n_spans"], r["text"]) for r in rows_of(QUERIES["op1_line_dedup"](spark, SF))]
    assert sorted(found) == sorted(expected)


def test_lines_on_awkward_rows(spark):
    docs = awkward(spark)
    found = rows_of(line_dedup.dedup(docs))
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    line = "one shared line of more than five words stands here"
    assert by[9]["text"] == f"{line}\nfirst" and by[10]["text"] == "second" and by[11]["text"] == ""
    assert by[10]["removed"] == [{"unit": 0, "start": 0, "end": len(line)}]
    assert by[1]["text"] is None and by[2]["text"] == "" and by[4]["text"] == ""
    kept = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.dedup(docs, min_words=5)) if r["doc_id"] is not None}
    assert kept[4] == "same text HERE" and by[3]["text"] == "Same Text here"
    paragraphs = documents(spark, [(1, "a b c d e\nf\n\nx", "en", "s"), (2, "A  b c d E\nF\n\ny", "en", "s")])
    assert {r["doc_id"]: r["text"] for r in rows_of(line_dedup.dedup(paragraphs, "paragraph"))} == {1: "a b c d e\nf\n\nx", 2: "y"}
    assert rows_of(line_dedup.dedup(nothing(spark))) == []


def test_threshold_reaches_bounds_and_exact_check(spark):
    """Pairs of similarity 0.80 to 0.85, and the components of whole families, at 80 percent."""
    assert near_dedup.coordinates_for(85) == 32 and near_dedup.coordinates_for(80) == 44
    base = [f"w{i}" for i in range(94)]  # 90 shingles
    pair = [(1, " ".join(base)), (2, " ".join([*base[:92 - 10], *[f"x{i}" for i in range(12)]])), (3, " ".join(base[:94 - 16]))]
    rows = pair + [(10 + i, t) for i, t in families(3)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    sets = {i: shingles(t) for i, t in rows}
    joined, parent = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]), {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and joined(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert find(3) == 1 and 100 * len(sets[1] & sets[3]) < 85 * len(sets[1] | sets[3])
    found = {r["doc_id"]: r["component_id"] for r in rows_of(near_dedup.cluster(docs, percent=80))}
    assert found == {i: find(i) for i in sets}
    left = [r["doc_id"] for r in near_dedup.drop_near(docs, percent=80).collect()]
    assert sorted(left) == sorted(i for i in sets if find(i) == i)
    assert 3 in {r["doc_id"] for r in near_dedup.drop_near(docs).collect()}


def test_repeated_and_null_ids_keep_each_text_once(spark):
    r = random.Random(14)
    x, y, z, w = ([f"{c}{r.randrange(10**6)}" for _ in range(120)] for c in "xyzw")
    near = lambda words: " ".join([*words[:-1], "changed"])
    rows = [(3, " ".join(x)), (5, " ".join(x)), (5, " ".join(y)), (None, near(x)), (None, " ".join(z)), (None, near(z)),
            (7, " ".join(w)), (7, " ".join(w)), (8, near(w)), (9, ""), (9, "")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    left = [(r["doc_id"], r["text"]) for r in near_dedup.drop_near(docs).collect()]
    fixed = [p for p in left if p[0] is not None]
    assert sorted(fixed) == [(3, " ".join(x)), (5, " ".join(y)), (7, " ".join(w)), (9, ""), (9, "")]
    assert len(left) == len(fixed) + 1 and {t for i, t in left if i is None} <= {" ".join(z), near(z)}
    by = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows_of(near_dedup.cluster(docs)) if r["doc_id"] in (3, 5, 8))
    assert by == [(3, 3, True), (5, 3, False), (5, 5, True), (8, 7, False)]
