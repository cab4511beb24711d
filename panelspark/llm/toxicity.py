"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

Terms are lower-cased words and the 4- and 5-letter pieces of words (with word
ends), so that forms of a word are near each other. Those whose presence goes
with either label in the sample span the space: odds of the label of at least
``LEAST_ODDS`` times the sample's (odds have no ceiling, so this holds for any
share of labels), and a likelihood ratio of at least ``LEAST_EVIDENCE`` in
logarithms. An example without any of them, toxic or clean, adds its own
``OWN_TERMS`` strongest terms, so that every example with words is in the index
and can be found. A text without any term of the space gets the rate of the
sample. Document frequencies
cover all documents. Examples are kept in blocks; an inverted index holds the
postings of each term by block, with the largest weight in the block. A query
adds these maxima to an upper bound for each block, visits blocks from the
highest bound down and stops when no block left can reach the k-th best cosine.
Blocks are scored in single precision: postings of the ``FREQUENT`` terms that
most examples have are multiplied as tables, those of all other terms are few and
are added up one by one. Examples that the error of that leaves in reach of the
k-th best are scored again in double precision. The neighbours vote with their cosine as
weight, smoothed towards the rate of the sample:

    score = (sum of weight * label + PRIOR * rate) / (sum of weight + PRIOR)

Defined results:

* null and empty texts have no terms; like all texts without terms they get
  the (smoothed) rate of the examples without terms;
* ties between examples go to the smaller id; rows are scored one by one, so
  repeated rows score alike, and an empty table gives an empty one;
* without labelled rows every score is 0;
* whole texts are counted; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import SLICE, share, slices, stored
from .labelled import sample_texts

MAX_EXAMPLES = 8192
LEAST_EVIDENCE = 8.0
LEAST_ODDS = 4.25
OWN_TERMS = 8
PIECES = (4, 5)
KEPT_TOKENS = 100_000
LONGEST_KEPT = 64
NEIGHBOURS = 15
PRIOR = 1.0
BLOCK = 64
FREQUENT = 1024
GROUP = 32
LETTERS = 1 << 17
CELLS = 1 << 21
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W_]+")


def terms_of(token: str) -> list[str]:
    """Words of a token without white space, and their pieces, as often as they occur."""
    out = []
    for word in (token,) if token.isalnum() else WORDS.findall(token):
        out.append(word)
        padded = f"^{word}$"
        for size in PIECES:
            out += [padded[i:i + size] for i in range(len(padded) - size + 1)]
    return out


class TermFinder:
    """Finds the chosen terms of many tokens at once.

    The letters of all words form one array of code points. Three letters are
    one 64-bit number; the place of these among the beginnings of chosen pieces
    and the next letter are the next number, and so on to the longest piece.
    """

    def __init__(self, at: dict[str, int]):
        self.at = at
        chosen = [t for t in at if len(t) in PIECES]
        heads = sorted({t[:3] for t in chosen})  # by code point, as their numbers are
        place = {h: i for i, h in enumerate(heads)}
        self.heads, self.steps = self._heads(self._codes("".join(heads)), np.arange(len(heads)) * 3), []
        for size in range(4, max(PIECES) + 1):
            pieces = {(place[t[:size - 1]] << 21) | ord(t[size - 1]): t[:size] for t in chosen if len(t) >= size}
            keys = sorted(pieces)
            own = [at.get(pieces[k], -1) if size in PIECES else -1 for k in keys]
            self.steps.append((np.array(keys, np.int64), np.array(own, np.int64)))
            place = {pieces[k]: i for i, k in enumerate(keys)}

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)

    @staticmethod
    def _heads(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return (codes[starts] << 42) | (codes[starts + 1] << 21) | codes[starts + 2]  # a code point has 21 binary digits

    def find(self, tokens: list[str]) -> list[tuple[int, ...]]:
        """For each token the numbers of its chosen terms, as often as they occur."""
        out, i = [], 0
        while i < len(tokens):
            first, letters = i, 0
            while i < len(tokens) and (i == first or letters + len(tokens[i]) <= LETTERS):
                letters += len(tokens[i])
                i += 1
            out += self._find(tokens[first:i])
        return out

    def _find(self, tokens: list[str]) -> list[tuple[int, ...]]:
        words, owner = [], []
        for i, token in enumerate(tokens):
            if token.isalnum():
                words.append(token)
                owner.append(i)
            else:
                own = WORDS.findall(token)
                words += own
                owner += [i] * len(own)
        owner = np.array(owner, np.int64)
        whole = np.array([self.at.get(w, -1) for w in words], np.int64)
        found, owners = [whole[whole >= 0]], [owner[whole >= 0]]
        codes = self._codes("".join([f"^{w}$" for w in words]))
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        ends = np.cumsum(sizes)
        many = np.maximum(sizes - 3, 0)
        starts = np.arange(many.sum()) + np.repeat(ends - sizes - np.cumsum(many) + many, many)
        word, keys, known = np.repeat(np.arange(len(words)), many), self._heads(codes, starts), self.heads
        for size, (following, numbers) in enumerate(self.steps, 4):
            if not len(known) or not len(starts):
                break
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            on = (known[place] == keys) & (starts + size <= ends[word])
            starts, word, place = starts[on], word[on], place[on]
            known, keys = following, (place << 21) | codes[starts + size - 1]
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            own = np.where(known[place] == keys, numbers[place], -1)
            found.append(own[own >= 0])
            owners.append(owner[word[own >= 0]])
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        numbers, cuts = np.concatenate(found)[order].tolist(), np.searchsorted(owners[order], np.arange(len(tokens) + 1)).tolist()
        return [tuple(numbers[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _term_counts(batches):
    """(label, text) to (term, a, m): texts with the term and a label of 1, and all texts with it."""
    import pyarrow as pa

    kind = pa.schema([("term", pa.string()), ("a", pa.int64()), ("m", pa.int64())])
    with_term, with_label = Counter(), Counter()

    def flushed():
        terms = list(with_term)
        out = pa.RecordBatch.from_arrays([
            pa.array(terms, pa.string()), pa.array([with_label[t] for t in terms], pa.int64()),
            pa.array([with_term[t] for t in terms], pa.int64())], schema=kind)
        with_term.clear()
        with_label.clear()
        return out

    for batch in batches:
        for labels, texts in slices(batch):
            for label, text in zip(labels, texts, strict=True):
                terms = {x for w in set(text.lower().split()) for x in terms_of(w)} if text else ()
                with_term.update(terms)
                if label:
                    with_label.update(terms)
            if len(with_term) > KEPT_TOKENS:
                yield flushed()
    yield flushed()


def choose_terms(examples: DataFrame, least: float = LEAST_EVIDENCE, odds: float = LEAST_ODDS) -> list[str]:
    """Terms of a bounded table (doc_id, label, text) whose presence goes with either label, strongest first, then own terms."""
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    seen = examples.select("label", "text").mapInArrow(_term_counts, "term string, a bigint, m bigint").groupBy("term").agg(
        F.sum("a").cast("double").alias("a"), F.sum("m").cast("double").alias("m"))
    rate, own, rest = n1 / (n1 + n0), F.col("a") / F.col("m"), F.col("m") - F.col("a")
    # Log likelihood of the term's labels at its own rate against the sample's rate.
    evidence = F.when(F.col("a") > 0, F.col("a") * F.log(own / rate)).otherwise(0.0) + F.when(
        rest > 0, rest * F.log((1 - own) / (1 - rate))).otherwise(0.0)
    with_one, with_zero = F.col("a") * n0, rest * n1  # their ratio is that of the odds
    seen = stored(seen.select("term", "m", evidence.alias("evidence"), with_one.alias("with_one"), with_zero.alias("with_zero")))
    telling = (F.col("with_one") >= odds * F.col("with_zero")) | (F.col("with_zero") >= odds * F.col("with_one"))
    kept = seen.where(telling & (F.col("evidence") >= least))
    chosen = [r["term"] for r in kept.orderBy(F.desc("evidence"), "term").collect()]  # bounded by the sample
    return chosen + _own_terms(examples, seen, chosen)


def _own_terms(examples: DataFrame, seen: DataFrame, chosen: list[str]) -> list[str]:
    """The strongest terms of every example that has none of the chosen ones; rarer ones first among equals."""
    shared = share(examples.sparkSession, frozenset(chosen))

    def lacking(batches):
        import pyarrow as pa

        have, kind = shared(), pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("term", pa.string())])
        for batch in batches:
            for ids, labels, texts in slices(batch):
                for doc, label, text in zip(ids, labels, texts, strict=True):
                    terms = {x for w in set(text.lower().split()) for x in terms_of(w)} if text else set()
                    if terms and have.isdisjoint(terms):
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(terms), pa.int64()), pa.array(
                            [label] * len(terms), pa.int32()), pa.array(sorted(terms), pa.string())], schema=kind)

    own = examples.select("doc_id", "label", "text").mapInArrow(lacking, "doc_id bigint, label int, term string").join(seen, "term")
    agrees = (F.col("with_one") > F.col("with_zero")) == (F.col("label") == 1)
    order = W.partitionBy("doc_id").orderBy(agrees.desc(), F.desc("evidence"), "m", "term")
    best = own.withColumn("at", F.row_number().over(order)).where(F.col("at") <= OWN_TERMS)
    return sorted(r["term"] for r in best.select("term").distinct().collect())  # OWN_TERMS for an example at most


def with_counts(docs: DataFrame, terms: list[str], text_col: str = "text", out: str = "term_counts") -> DataFrame:
    """``docs`` with array<struct<term: int, n: int>>: how often each chosen term occurs in the whole text."""
    shared = share(docs.sparkSession, {t: i for i, t in enumerate(terms)})  # bounded by the sample

    def count_all(batches):
        import pyarrow as pa

        finder, known = TermFinder(shared()), {}

        def counts_of(texts: list[str | None]) -> Iterator[list[tuple[int, int]]]:
            if len(known) >= KEPT_TOKENS:
                known.clear()
            tokens = [t.lower().split() if t and finder.at else [] for t in texts]
            fresh = list(dict.fromkeys([w for own in tokens for w in own if w not in known]))
            known.update(zip(fresh, finder.find(fresh), strict=True))
            for own in tokens:
                yield sorted(Counter(chain.from_iterable(map(known.__getitem__, own))).items())
            for w in fresh:
                if len(w) > LONGEST_KEPT:
                    del known[w]

        for batch in batches:
            ends, terms, counts = [0], [], []
            for i in range(0, len(batch), GROUP):
                for pairs in counts_of(batch.slice(i, GROUP).to_pylist()):
                    if pairs:
                        own, times = zip(*pairs, strict=True)
                        terms.extend(own)
                        counts.extend(times)
                    ends.append(len(terms))
            flat = pa.StructArray.from_arrays([pa.array(terms, pa.int32()), pa.array(counts, pa.int32())], ["term", "n"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    import pyarrow as pa

    # arrow_udf reads its form from type hints.
    count_all.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(count_all, "array<struct<term int, n int>>")
    return docs.withColumn(out, udf(F.col(f"`{text_col}`")))


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors in blocks, as flat arrays.

    For each term a list of (block, largest weight in it); for each example its
    postings (term, weight); for each block those of ``frequent`` terms again, and
    for each other term its own. Queries are answered many at a time. ``visited``
    has the number of blocks that each query of the last search scored.
    """

    def __init__(self, examples: Iterable[tuple[int, int, dict[int, int]]], idf: Sequence[float], block: int = BLOCK):
        self.idf, self.block = np.asarray(idf, np.float64), block
        self.dense, self.visited = None, np.zeros(0, np.int64)
        vectors = [(doc, label, self.unit(counts)) for doc, label, counts in examples]
        empty = [label for _, label, v in vectors if not v]
        # Alike examples share a block, so that bounds are tight.
        filled = sorted((x for x in vectors if x[2]), key=lambda x: (sorted(x[2], key=lambda t: -x[2][t]), x[0]))
        self.ids = np.array([x[0] for x in filled], np.int64)
        self.labels = np.array([x[1] for x in filled], np.int32)
        self.n_blocks = -(-len(filled) // block)
        rows = np.repeat(np.arange(len(filled), dtype=np.int32), [len(x[2]) for x in filled])
        terms = np.array([t for x in filled for t in x[2]], np.int32)
        weights = np.array([w for x in filled for w in x[2].values()], np.float64)
        order = np.lexsort((rows, terms, rows // block))
        rows, terms, weights = rows[order], terms[order], weights[order]
        # A list entry is a run of one term in one block; the lists are then laid out by term.
        at = rows // block
        starts = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(at) != 0)]) if len(at) else np.zeros(0, np.int64)
        tops = np.maximum.reduceat(weights, starts) if len(starts) else np.zeros(0)
        by_term = np.lexsort((at[starts], terms[starts]))
        self.list_blocks, self.list_tops = at[starts][by_term], tops[by_term]
        self.list_at = np.searchsorted(terms[starts][by_term], np.arange(len(self.idf) + 1))
        # Frequent terms by block, all others by term.
        self.frequent = np.sort(np.argsort(-np.bincount(terms, minlength=len(self.idf)), kind="stable")[:FREQUENT])
        column = np.full(len(self.idf), -1)
        column[self.frequent] = np.arange(len(self.frequent))
        often = column[terms] >= 0
        self.often_rows, self.often_columns, self.often_weights = rows[often], column[terms[often]], weights[often].astype(np.float32)
        self.block_at = np.searchsorted(self.often_rows // block, np.arange(self.n_blocks + 1))
        others = np.flatnonzero(~often)
        others = others[np.argsort(terms[others], kind="stable")]
        self.other_rows, self.other_weights = rows[others], weights[others]
        self.other_at = np.searchsorted(terms[others], np.arange(len(self.idf) + 1))
        by_row = np.argsort(rows, kind="stable")
        self.terms, self.weights = terms[by_row], weights[by_row]
        self.row_at = np.searchsorted(rows[by_row], np.arange(len(filled) + 1))
        n = len(vectors)
        self.rate = sum(label for _, label, _ in vectors) / n if n else 0.0
        self.rate_without_terms = (sum(empty) + PRIOR * self.rate) / (len(empty) + PRIOR) if n else 0.0

    def _weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1.0 + np.log(counts)) * self.idf[terms]
        norm = math.sqrt(float(raw @ raw))
        return raw / norm if norm > 0 else raw

    def unit(self, counts: dict[int, int]) -> dict[int, float]:
        terms = np.fromiter(counts, np.int64, len(counts))
        found = self._weights(terms, np.fromiter(counts.values(), np.float64, len(counts)))
        return dict(zip(counts, found.tolist(), strict=True)) if found.any() else {}

    def _maxima(self) -> np.ndarray:
        """terms x blocks: the largest weight of each term in each block; laid out once in a task."""
        if self.dense is None:
            self.dense = np.zeros((len(self.idf), self.n_blocks))
            self.dense[np.repeat(np.arange(len(self.idf)), np.diff(self.list_at)), self.list_blocks] = self.list_tops
        return self.dense

    def _others(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """queries x examples: what the terms that are not frequent add to the cosines."""
        found = np.zeros((len(ends) - 1, len(self.ids)), np.float32)
        for i in range(0, len(found), GROUP):
            own = ends[i:i + GROUP + 1]
            asked, first = terms[own[0]:own[-1]], self.other_at[terms[own[0]:own[-1]]]
            sizes = self.other_at[asked + 1] - first
            entries = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            query = np.repeat(np.arange(len(own) - 1), np.diff(own))
            cells = np.repeat(query * len(self.ids), sizes) + self.other_rows[entries]
            added = np.repeat(weights[own[0]:own[-1]], sizes) * self.other_weights[entries]
            found[i:i + GROUP] = np.bincount(cells, added, (len(own) - 1) * len(self.ids)).reshape(len(own) - 1, -1)
        return found

    def _score(self, often: np.ndarray, others: np.ndarray, wanted: np.ndarray, scores: np.ndarray) -> None:
        """Cosines of the wanted (query, block) pairs; each block is opened once for all its queries."""
        for b in np.flatnonzero(wanted.any(axis=0)).tolist():
            part = slice(self.block_at[b], self.block_at[b + 1])
            first, last = b * self.block, min((b + 1) * self.block, len(self.ids))
            opened = np.zeros((len(self.frequent), last - first), np.float32)
            opened[self.often_columns[part], self.often_rows[part] - first] = self.often_weights[part]
            asked = np.flatnonzero(wanted[:, b])
            scores[asked, first:last] = often[asked] @ opened + others[asked, first:last]

    def _exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Cosines of a query with the examples ``at``, in double precision."""
        sizes = self.row_at[at + 1] - self.row_at[at]
        starts = np.cumsum(sizes) - sizes
        entries = np.arange(sizes.sum()) + np.repeat(self.row_at[at] - starts, sizes)
        return np.round(np.add.reduceat(query[self.terms[entries]] * self.weights[entries], starts), 12) if len(at) else np.zeros(0)

    def search(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS):
        """For each query i, with the terms ends[i] to ends[i + 1]: cosines and positions of its k nearest examples.

        All cosines are above 0, ties go to the smaller id. Every query first
        visits its blocks of highest bound, enough for k examples twice, and
        then those whose bound reaches its k-th best cosine so far.
        """
        n, begin = len(ends) - 1, ends[0]
        ends, terms, counts = ends - begin, terms[begin:ends[-1]], counts[begin:ends[-1]]
        weights = np.zeros(len(terms))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            weights[a:b] = self._weights(terms[a:b], counts[a:b])
        none = (np.zeros(0), np.zeros(0, np.int64))
        self.visited = np.zeros(n, np.int64)
        if not self.n_blocks:
            return [none] * n
        queries, scores = np.zeros((n, len(self.idf))), np.zeros((n, len(self.ids)), np.float32)
        queries[np.repeat(np.arange(n), np.diff(ends)), terms] = weights
        bounds, often = queries @ self._maxima(), queries[:, self.frequent].astype(np.float32)
        others = self._others(ends, terms, weights)
        # Unit vectors of m shared terms: each cosine is off by (m + 3) roundings at most, so twice that is between two of them.
        slack = 2.0 * (np.diff(ends) + 3) * 2.0**-24
        first = min(self.n_blocks, 2 * -(-k // self.block))
        wanted = np.zeros(bounds.shape, bool)
        opened = np.argpartition(-bounds, first - 1, axis=1)[:, :first]
        np.put_along_axis(wanted, opened, True, axis=1)
        wanted &= bounds > 0
        self._score(often, others, wanted, scores)
        k = min(k, len(self.ids))
        # The k-th best of the opened blocks; places behind the last example count as 0.
        places = (opened[:, :, None] * self.block + np.arange(self.block)).reshape(n, -1)
        seen = np.where(places < len(self.ids), np.take_along_axis(scores, np.minimum(places, len(self.ids) - 1), axis=1), 0.0)
        least = np.partition(seen, -k, axis=1)[:, -k] if k <= seen.shape[1] else np.zeros(n)
        rest = (bounds > 0) & (bounds >= (least - slack)[:, None]) & ~wanted
        self._score(often, others, rest, scores)
        self.visited = (wanted | rest).sum(axis=1)
        out = []
        for query, own, floor, off in zip(queries, scores, least, slack, strict=True):
            at = np.flatnonzero((own >= floor - off) & (own > 0))
            if len(at) > k:
                at = at[own[at] >= np.partition(own[at], -k)[-k] - off]
            cosines = self._exact(query, at)
            order = np.lexsort((self.ids[at], -cosines))
            order = order[cosines[order] > 0][:k]
            out.append((cosines[order], at[order]))
        return out

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int, int]]:
        """(cosine, id, label) of the k examples of largest cosine, of a text with these term counts."""
        terms, values = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
        [(scores, at)] = self.search(np.array([0, len(counts)]), terms, values, k + (without is not None))
        found = zip(scores.tolist(), self.ids[at].tolist(), self.labels[at].tolist(), strict=True)
        return [x for x in found if x[1] != without][:k]

    def vote(self, scores: np.ndarray, at: np.ndarray) -> float:
        """The score of a text with these neighbours."""
        if not len(at):
            return self.rate_without_terms
        return (float(scores @ self.labels[at]) + PRIOR * self.rate) / (float(scores.sum()) + PRIOR)


def build_index(counted: DataFrame, sample: DataFrame, n_terms: int) -> BlockMaxIndex:
    """Index the bounded sample (doc_id, label); ``counted`` (doc_id, term_counts) has all documents."""
    n_docs = counted.count()
    df = {r["term"]: r["n"] for r in counted.select(F.explode("term_counts.term").alias("term")).groupBy("term").agg(
        F.count("*").alias("n")).collect()}  # one row a term
    idf = [math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1.0 for t in range(n_terms)]
    rows = counted.withColumnRenamed("doc_id", "_id").join(
        F.broadcast(sample), F.col("_id") == F.col("doc_id")).select(
        "doc_id", "label", F.col("term_counts.term").alias("terms"), F.col("term_counts.n").alias("counts")).toArrow()
    seen: dict[int, int] = {}
    part = lambda i: tuple(zip(rows["terms"][i].as_py(), rows["counts"][i].as_py(), strict=True))
    for i, doc in enumerate(rows["doc_id"].to_pylist()):
        if doc not in seen or part(i) < part(seen[doc]):  # of rows that repeat an id, one whatever their order
            seen[doc] = i
    # One example at a time is Python objects.
    return BlockMaxIndex(((doc, rows["label"][i].as_py(), dict(part(i))) for doc, i in sorted(seen.items())), idf)


def scored(counted: DataFrame, index: BlockMaxIndex, k: int = NEIGHBOURS, out: str = "toxicity") -> DataFrame:
    """``counted`` with a struct column ``out``: score, evidence (id, cosine and label of the neighbours)."""
    shared = share(counted.sparkSession, index)  # at most MAX_EXAMPLES vectors

    def score_all(batches):
        import pyarrow as pa

        own = shared()
        step = max(1, min(SLICE, CELLS // max(len(own.idf), len(own.ids), 1)))  # so that a group's tables stay small
        for batch in batches:
            ends = batch.offsets.to_numpy().astype(np.int64)
            terms = batch.values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = batch.values.field(1).to_numpy(zero_copy_only=False).astype(np.float64)
            found = [x for i in range(0, len(batch), step) for x in own.search(ends[i:i + step + 1], terms, counts, k)]
            cosines, at = (np.concatenate([np.zeros(0, x), *[f[i] for f in found]]) for i, x in enumerate((np.float64, np.int64)))
            sizes = np.cumsum([0, *[len(f[1]) for f in found]]).astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(
                [pa.array(own.ids[at]), pa.array(cosines), pa.array(own.labels[at])], ["doc_id", "cosine", "label"]))
            yield pa.StructArray.from_arrays([pa.array([own.vote(*f) for f in found], pa.float64()), evidence], ["score", "evidence"])

    import pyarrow as pa

    score_all.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(score_all, "score double, evidence array<struct<doc_id bigint, cosine double, label int>>")
    return counted.withColumn(out, udf(F.col("term_counts")))


def classify(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, toxicity for every document, from a bounded sample (doc_id, label).

    Texts are read for the sample's terms and once for all counts; the
    counts of chosen terms are a few numbers per document and are stored.
    """
    terms = choose_terms(stored(sample_texts(docs, sample)))
    counted = stored(with_counts(docs.select("doc_id", "text"), terms).select("doc_id", "term_counts"))
    return scored(counted, build_index(counted, sample, len(terms))).select("doc_id", "toxicity")
