"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its distinct 5-word shingles; two are near copies at
a Jaccard similarity of ``percent`` or more (85 unless stated). Its signature
has a number of coordinates, each mixed from ``MINIMA`` independent minima over
the set, so two sets of Jaccard similarity J agree in a coordinate with
probability J**MINIMA; a passage that makes up a share s of two documents
makes a coordinate collide with about s**MINIMA only.

Sets are posted under each coordinate-value pair. To be kept, a pair must
agree in at least ``MATCHES`` coordinates, so it meets in all but the last
``MATCHES - 1`` of them and only that prefix is posted. The number of
coordinates follows from the threshold: the least with which a pair at the
threshold is missed with a probability of at most ``MISSED`` (32 coordinates
for 85 percent, 44 for 80). Posting lists
are merged by skipping rather than by listing their pairs:

1. equal sets are one entry from the start, lists with one entry are dropped;
2. every entry of a list meets three pivots of the list, no other entry;
3. pairs pass the length bound, the match threshold, the parity bound, and
   then an exact comparison of their full shingle sets; links give components;
4. lists that still span several components are merged once more: entries
   outside the list's largest component meet the entries of other components
   in full, so no link between different components can be left out. Pairs
   inside one component are skipped, as they cannot change it.

The parity bound loses no link: shingles are dealt over ``PARITY_BITS`` bins and
a bit of a set tells whether its bin holds an odd number of them. Two sets whose
bits differ in d bins differ in at least d shingles. It parts the members of a
large family of texts just below the threshold, up to some 2,500 shingles a set;
of longer sets the bits fill up, and more pairs are left to the exact comparison.

The result is one row per document with its component, so copies are never
expanded into pairs.

Defined results:

* null and empty texts and texts without words have an empty set, are linked
  with nothing and stay;
* fewer than five words are one shingle of the whole sequence;
* every row is judged with its own text, also where an id repeats: rows that
  share nothing but an id are in components of their own, maybe of one name;
* a component is named by its smallest id, null only if it has no other; the
  row kept is the one with the smallest (id, digest of the text), nulls last;
* rows that repeat id and text carry the same decision in :func:`cluster`;
  :func:`drop_near` keeps one of them (all, if their set is empty);
* only the id and text columns are read; an empty table gives an empty one.

Shingles are compared as 64-bit hashes of five 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import comb
from operator import add

from pyspark.sql import DataFrame, functions as F

from .common import list_udf, stored
from .components import components

SHINGLE = 5
PERCENT = 85
MINIMA = 4
MATCHES = 4
MISSED = 4.5e-7
PARITY_BITS = 1024
PIVOT_SALTS = (1, 2)
KEPT_WORDS = 200_000
LONGEST_KEPT = 64
CHUNK = 4096


def coordinates_for(percent: int) -> int:
    """The least number of coordinates, in fours, that misses a pair at the threshold with at most ``MISSED``."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100, not {percent}")
    agree, count = (percent / 100) ** MINIMA, MATCHES
    while sum(comb(count, k) * agree**k * (1 - agree) ** (count - k) for k in range(MATCHES)) > MISSED:
        count += 4
    return count


COORDINATES = coordinates_for(PERCENT)


class Shingler:
    """Shingle sets and signatures of texts; keeps the hashes of words it has met."""

    def __init__(self, coordinates: int = COORDINATES, minima: int = MINIMA):
        import numpy as np

        self.np, self.known = np, {}
        self.coordinates, self.minima = coordinates, minima
        random = np.random.default_rng(20240607)
        draw = lambda n: random.integers(0, 1 << 64, n, dtype=np.uint64)
        self.position = draw(SHINGLE) | np.uint64(1)
        self.mask, self.factor = draw(coordinates * minima)[:, None], (draw(coordinates * minima) | np.uint64(1))[:, None]
        self.fold, self.base = draw(minima) | np.uint64(1), draw(coordinates)

    def mixed(self, x):
        """A bijection of 64-bit numbers that spreads every bit."""
        u = self.np.uint64
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
        return x ^ (x >> u(31))

    def word(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KEPT:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = value
        return value

    def shingles(self, text: str | None):
        """The sorted distinct shingle hashes of a whole text."""
        np = self.np
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # ASCII letters and white space
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < SHINGLE:
            whole = hashlib.blake2b(b" ".join(words), digest_size=8, person=b"short").digest()
            return np.frombuffer(whole, "<u8")
        known = self.known
        hashes = [known.get(w) for w in words]
        if None in hashes:
            hashes = [self.word(words[i]) if h is None else h for i, h in enumerate(hashes)]
        hashes = np.array(hashes, np.uint64)
        n = len(hashes) - SHINGLE + 1
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total += self.mixed(hashes[k:k + n] + self.position[k]) * self.position[k]
        return np.unique(self.mixed(total))

    def set_id(self, shingles) -> bytes:
        return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()

    def signature(self, shingles):
        np, low = self.np, None
        for start in range(0, len(shingles), CHUNK):
            values = ((shingles[None, start:start + CHUNK] ^ self.mask) * self.factor).min(1)
            low = values if low is None else np.minimum(low, values)
        return self.mixed((low.reshape(self.coordinates, self.minima) * self.fold).sum(1, dtype=np.uint64) ^ self.base)

    def parities(self, shingles):
        """``PARITY_BITS`` bits in 64-bit numbers: whether a bin has an odd number of shingles."""
        np = self.np
        odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view("int64")


def _sign(coordinates: int):
    own = Shingler(coordinates)

    def sign(text: str | None) -> dict:
        found = own.shingles(text)
        some = len(found) > 0
        return {"n": len(found), "set_id": own.set_id(found) if some else None,
                "coordinates": own.signature(found).view("int64") if some else None,
                "parities": own.parities(found) if some else None}

    return lambda texts: [sign(t) for t in texts]


def _sets():
    own = Shingler()

    return lambda texts: [own.shingles(t).view("int64") for t in texts]


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, sha, n, set_id, coordinates, parities of every document."""
    import pyarrow as pa

    kind = pa.struct([("n", pa.int64()), ("set_id", pa.binary()), ("coordinates", pa.list_(pa.int64())),
                      ("parities", pa.list_(pa.int64()))])
    udf = list_udf(lambda: _sign(coordinates), kind, "n bigint, set_id binary, coordinates array<bigint>, parities array<bigint>")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), _digest(text_col).alias("sha"), udf(F.col(f"`{text_col}`")).alias("s")
                       ).select("doc_id", "sha", "s.*")


def _close_sizes(a: str, b: str, percent: int):
    """The length bound: the smaller set has at least the threshold's share of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _close_parities(a: str, b: str, size_a: str, size_b: str, percent: int):
    """The parity bound: sets at the threshold differ in at most (100 - percent) / (100 + percent) of both sizes."""
    differ = reduce(add, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY_BITS // 64)])
    return differ * (100 + percent) <= (F.col(size_a) + F.col(size_b)) * (100 - percent)


def _pairs_by_pivot(shared: DataFrame, percent: int) -> DataFrame:
    """(x, y) of every entry of a posting list with the list's pivots."""
    entry = F.struct("v", "n")
    pivots = shared.groupBy("token").agg(
        F.min(entry).alias("p0"),
        *[F.min(F.struct(F.xxhash64("v", F.lit(s)).alias("h"), entry.alias("e"))).alias(f"p{s}") for s in PIVOT_SALTS])
    pivots = stored(pivots.select("token", F.array_distinct(F.array(
        "p0", *[F.col(f"p{s}.e") for s in PIVOT_SALTS])).alias("pivots")))
    met = shared.join(pivots, "token").select("v", "n", F.explode("pivots").alias("p"))
    met = met.select("v", "n", F.col("p.v").alias("pv"), F.col("p.n").alias("pn"))
    return met.where((F.col("v") != F.col("pv")) & _close_sizes("n", "pn", percent)).select(
        F.least("v", "pv").alias("x"), F.greatest("v", "pv").alias("y")).distinct()


def _equal(a: str, b: str):
    """Which coordinates of two signatures agree."""
    return F.zip_with(a, b, lambda x, y: x == y)


def _pairs_across(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y) of entries of one posting list in different components that agree in ``MATCHES`` coordinates.

    The sizes and parities of a pair let it reach the threshold. A pair is taken from the list of the first coordinate it agrees in and
    skipped in all others, so it comes out once.
    """
    entries = shared.join(labels.withColumnRenamed("node", "v"), "v", "left").select(
        "token", "at", "v", "n", F.coalesce("component", "v").alias("c"))
    largest = entries.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(
        F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("top")).where("parts > 1")
    open_lists = entries.join(largest.select("token", F.col("top.c").alias("top")), "token")
    open_lists = stored(open_lists.join(sets.select("v", F.col("coordinates").alias("s"), "parities"), "v"))
    minor = open_lists.where("c <> top").select("token", *[F.col(c).alias(f"a{c}") for c in ("v", "n", "c", "s", "parities")])
    equal = _equal("as", "s")
    apart = (F.col("ac") != F.col("c")) & ((F.col("c") == F.col("top")) | (F.col("av") < F.col("v")))
    met = apart & _close_sizes("an", "n", percent) & _close_parities("aparities", "parities", "an", "n", percent)
    first = F.array_position(equal, True) == F.col("at") + 1
    enough = F.size(F.filter(equal, lambda e: e)) >= MATCHES
    return minor.join(open_lists.withColumnRenamed("token", "_token"), (F.col("token") == F.col("_token")) & met & first & enough).select(
        F.least("av", "v").alias("x"), F.greatest("av", "v").alias("y")).distinct()


def _matching(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that agree in at least ``MATCHES`` coordinates and whose parities let them reach the threshold."""
    side = lambda c: sets.select(
        F.col("v").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "coordinates", "parities")])
    equal = F.size(F.filter(_equal("coordinates_x", "coordinates_y"), lambda e: e))
    near = _close_parities("parities_x", "parities_y", "n_x", "n_y", percent)
    return pairs.join(side("x"), "x").join(side("y"), "y").where(near & (equal >= MATCHES)).select("x", "y")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """v, shingles of the wanted (v, doc_id, sha); the text is found by id and digest."""
    import pyarrow as pa

    kind = pa.list_(pa.int64())
    udf = list_udf(_sets, kind, "array<bigint>")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), _digest(text_col).alias("_sha"), F.col(f"`{text_col}`").alias("text"))
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("sha")))
    return found.select("v", udf("text").alias("shingles")).groupBy("v").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    side = lambda c: full.select(F.col("v").alias(c), F.col("shingles").alias(f"s{c}"))
    joined = pairs.join(side("y"), "y").join(side("x"), "x").withColumn(
        "common", F.size(F.array_intersect("sx", "sy")).cast("long"))
    union = F.size("sx") + F.size("sy") - F.col("common")
    return joined.where(F.col("common") * 100 >= union * percent).select("x", "y").distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _judged(docs, id_col, text_col, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per document: doc_id, sha, n_shingles, component_id, kept."""
    coordinates = coordinates_for(percent)
    rows = stored(signed(docs, id_col, text_col, coordinates))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")
    # v numbers the sets; it is stored before anything else reads it.
    sets = stored(rows.where("n > 0").groupBy("set_id").agg(
        F.min(first).alias("first"), F.first("n").alias("n"), F.first("coordinates").alias("coordinates"),
        F.first("parities").alias("parities")).withColumn("v", F.monotonically_increasing_id()))
    prefix = coordinates - MATCHES + 1
    posts = sets.select("v", "n", F.posexplode(F.slice("coordinates", 1, prefix)).alias("at", "token"))
    lists = posts.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    shared = stored(posts.join(lists, "token"))
    first = stored(_matching(_pairs_by_pivot(shared, percent), sets, percent))
    # Full sets of the documents that share a coordinate with another: one pass over their texts for both merges.
    wanted = sets.select("v", "first.doc_id", "first.sha").join(shared.select("v").distinct(), "v")
    full = stored(shingle_sets(docs, wanted, id_col, text_col))
    links = stored(_confirmed(first, full, percent))
    labels = components(links)
    second = stored(_pairs_across(shared, labels, sets, percent).join(first, ["x", "y"], "left_anti"))
    if second.limit(1).count():
        links = links.union(_confirmed(second, full, percent))
        labels = components(links)
    named = stored(sets.join(labels, F.col("v") == F.col("node"), "left").select(
        "set_id", "first", F.coalesce("component", "v").alias("component")))
    # Sets without links name themselves; only linked ones meet.
    chosen = stored(sets.select("v", "first").join(labels, F.col("v") == F.col("node")).groupBy("component").agg(
        F.min("first").alias("chosen")))
    named = named.join(chosen, "component", "left").select("set_id", F.coalesce("chosen", "first").alias("chosen"))
    judged = rows.select("doc_id", "sha", "n", "set_id").join(named, "set_id", "left")
    own = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("sha") == F.col("chosen.sha"))
    return judged.select("doc_id", "sha", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("chosen.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         F.when(F.col("n") > 0, own).otherwise(True).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    judged = stored(_judged(docs, id_col, text_col, percent).where("n_shingles > 0"))
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("sha").alias("_gone_sha")).distinct()
    own = docs.withColumn("_own_sha", _digest(text_col))
    here = lambda side: F.col(f"`{id_col}`").eqNullSafe(F.col(f"_{side}_id")) & (F.col("_own_sha") == F.col(f"_{side}_sha"))
    left = own.join(gone, here("gone"), "left_anti")
    twice = stored(judged.where("kept").groupBy(F.col("doc_id").alias("_twice_id"), F.col("sha").alias("_twice_sha")).agg(
        F.count("*").alias("_rows")).where("_rows > 1"))
    if twice.limit(1).count():
        repeated = left.join(twice, here("twice"), "left_semi").dropDuplicates([id_col, "_own_sha"])
        left = left.join(twice, here("twice"), "left_anti").union(repeated)
    return left.drop("_own_sha")
