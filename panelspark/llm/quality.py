"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = logistic(threshold_k - w . x): one weight vector over
hashed text features is shared by all grades, and ordered thresholds separate
them. Features are words and word shapes (letters folded to ``a``, digits to
``0``, runs shortened, other signs kept, a mark for a repeated word), hashed
into a fixed number of buckets, with weights 1 + log(count) scaled to unit
length. The model is fitted on a bounded sample of rated rows; its expected
grade and tail probabilities then score every document.

Defined results:

* null and empty texts have no features: they score by the thresholds alone;
* whole texts are read; rows are scored one by one, so repeated rows score
  alike; an empty table gives an empty one; other columns stay as they are;
* with no rated rows every grade is as likely as the next; with one grade in
  the sample that grade is certain up to the prior.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from operator import eq

from pyspark.sql import DataFrame, functions as F

from .common import list_udf, share

MAX_EXAMPLES = 6000
BUCKETS = 1 << 15
STEPS = 300
RATE = 0.1
L2 = 2e-4
MARK = 4.0
BINS = (0.0, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95)
KEPT_WORDS = 100_000
KEPT_SHAPES = 10_000
LONGEST_KEPT = 64


class Features:
    """Hashed features of texts; keeps the buckets of words it has met."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known, self.shapes = buckets, {}, {}

    def bucket(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.buckets

    def of_word(self, word: str) -> tuple[int, int, tuple[bool, bool, bool] | None]:
        """Buckets of the word and its shape, and its marks if any: shouted, signed (more than one closing sign), wordless."""
        if word.isascii() and word.isalpha() and (word.islower() or word.isupper()):  # most words: no signs, one shape
            upper = word.isupper()
            return self.bucket("w:" + word.lower()), self.shape("A" if upper else "a"), (True, False, False) if upper and len(word) > 1 else None
        letters = re.sub(r"[\W_]+", "", word)
        folded = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
        marks = (len(letters) > 1 and letters.isupper(), bool(re.search(r"[^\w\s]{2,}", word)), not letters)
        return (self.bucket("w:" + letters.lower()), self.shape(re.sub(r"(.)\1+", r"\1", folded)[:LONGEST_KEPT]),
                marks if any(marks) else None)

    def shape(self, name: str) -> int:
        found = self.shapes.get(name)
        if found is None:
            if len(self.shapes) >= KEPT_SHAPES:
                self.shapes.clear()
            found = self.shapes[name] = self.bucket("s:" + name)
        return found

    def of_text(self, text: str | None):
        """(buckets, weights), weights of unit length."""
        import numpy as np

        counts: dict[int, int] = {}
        words = text.split() if text else []
        once, marked = Counter(words), [0, 0, 0]
        have = self.known
        for word, n in once.items():
            known = have.get(word)
            if known is None:
                known = self.of_word(word)
                if len(word) <= LONGEST_KEPT:
                    if len(have) >= KEPT_WORDS:
                        have.clear()
                    have[word] = known
            own, shape, marks = known
            counts[own] = counts.get(own, 0) + n
            counts[shape] = counts.get(shape, 0) + n
            if marks:
                marked = [m + n * k for m, k in zip(marked, marks, strict=True)]
        weights = {b: 1.0 + math.log(n) if n > 1 else 1.0 for b, n in counts.items()}
        if words:
            shares = (sum(map(eq, words, words[1:])), *marked, len(once))
            for name, share in zip(("repeated", "shouted", "signed", "wordless", "distinct"), shares, strict=True):
                b = self.bucket(f"{name}:{bisect.bisect_left(BINS, share / len(words))}")
                weights[b] = weights.get(b, 0.0) + MARK
        at = np.fromiter(weights, np.int64, len(weights))
        weight = np.fromiter(weights.values(), float, len(weights))
        return at, weight / max(1e-12, float(np.sqrt((weight * weight).sum())))


class OrdinalModel:
    """Weights and ordered thresholds; grades are 0 to len(thresholds)."""

    def __init__(self, weights, thresholds, buckets: int):
        self.weights, self.thresholds, self.buckets = weights, thresholds, buckets

    def tails(self, value: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ... of a text whose features add up to ``value``."""
        return [1.0 / (1.0 + math.exp(min(700.0, max(-700.0, t - value)))) for t in self.thresholds]


def features_of(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text", out: str = "features") -> DataFrame:
    """``docs`` with a struct column ``out``: bucket and weight arrays, of at most ``buckets`` entries."""

    def setup():
        features = Features(buckets)
        return lambda texts: [dict(zip(("at", "weight"), features.of_text(t), strict=True)) for t in texts]

    import pyarrow as pa

    kind = pa.struct([("at", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32()))])
    return docs.withColumn(out, list_udf(setup, kind, "at array<int>, weight array<float>")(F.col(f"`{text_col}`")))


def fit(rows: list[tuple[int, list[int], list[float]]], grades: int, buckets: int = BUCKETS,
        steps: int = STEPS) -> OrdinalModel:
    """Fit on a bounded list of (grade, buckets, weights) by Adam on the mean negative log likelihood."""
    import numpy as np

    weights, base, gaps = np.zeros(buckets), np.array(-(grades - 1) / 2.0), np.zeros(max(0, grades - 2))
    if not rows:
        return OrdinalModel(weights, np.cumsum([float(base), *np.exp(gaps)]).tolist(), buckets)
    row = np.repeat(np.arange(len(rows)), [len(at) for _, at, _ in rows])
    at = np.concatenate([np.array(a, np.int64) for _, a, _ in rows])
    weight = np.concatenate([np.array(w, float) for _, _, w in rows])
    grade = np.array([g for g, _, _ in rows])
    state = [weights, base, gaps]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    sigmoid = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1):
        weights, base, gaps = state
        thresholds = np.concatenate([[-np.inf], np.cumsum([float(base), *np.exp(gaps)]), [np.inf]])
        value = np.bincount(row, weights[at] * weight, len(rows))
        high, low = sigmoid(thresholds[grade + 1] - value), sigmoid(thresholds[grade] - value)
        high, low = np.where(grade == grades - 1, 1.0, high), np.where(grade == 0, 0.0, low)
        mass = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
        d_value = (d_high - d_low) / len(rows)
        g_weights = np.bincount(at, d_value[row] * weight, buckets) + L2 * weights
        g_threshold = (np.bincount(grade, -d_high, grades)[:grades - 1]
                       + np.bincount(grade, d_low, grades)[1:]) / len(rows)
        g_gaps = np.array([g_threshold[k + 1:].sum() for k in range(len(gaps))]) * np.exp(gaps)
        for i, g in enumerate((g_weights, np.array(g_threshold.sum()), g_gaps)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            state[i] = state[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    weights, base, gaps = state
    return OrdinalModel(weights, np.cumsum([float(base), *np.exp(gaps)]).tolist(), buckets)


def graded(docs: DataFrame, model: OrdinalModel, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: expected_grade and tails, P(grade >= k) for k = 1, 2, ..."""
    shared = share(docs.sparkSession, model)  # BUCKETS weights

    def setup():
        model = shared()
        features = Features(model.buckets)

        def grade_of(text: str | None) -> dict:
            at, weight = features.of_text(text)
            tails = model.tails(float((model.weights[at] * weight).sum()))
            return {"expected_grade": float(sum(tails)), "tails": tails}

        return lambda texts: [grade_of(t) for t in texts]

    import pyarrow as pa

    kind = pa.struct([("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])
    return docs.withColumn(out, list_udf(setup, kind, "expected_grade double, tails array<double>")(F.col(f"`{text_col}`")))
