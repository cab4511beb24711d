"""Language identification: spans of mixed text by a Viterbi path over word scores.

Learning counts letter trigrams (with word ends) per language over a bounded
sample of labelled rows; every trigram of the sample and every language counts.
A word is scored under each language as the sum of
its trigrams' log probabilities; the ranges its letters lie in (Latin, Greek,
Cyrillic, ...) narrow the candidates to languages whose sample was written in
that script. The best path through the words, paying ``SWITCH`` for each
change of language, labels the spans; the language with most letters is the
document's, and its share of the letters (words without evidence count for
one language among all) is the score.

Most documents stay in one language. That is proven without walking the
words: if no other language gains more than ``SWITCH`` over the best one on any
run of words, a path that leaves it and comes back, or begins or ends
elsewhere, loses at least as much by its changes as it gains; and if the
largest gains on a beginning and on an ending add up to no more than
``SWITCH``, neither does a path that avoids it.

Defined results:

* null, empty and letterless texts, and all texts if nothing was learned, are
  ``und`` with score 0 and no spans;
* whole texts are labelled, whatever their length; ties go to the language
  that stands first by code point;
* rows are labelled one by one: repeated rows alike, an empty table gives an
  empty one; other columns are neither read nor changed;
* labelled rows with a null text or label teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from .common import list_udf, share, slices, unit_hash

DOCS_PER_LANGUAGE = 2000
SWITCH = 8.0
SMOOTH = 0.1
WRONG_SCRIPT = -12.0
SCRIPT_SHARE = 0.005
KEPT_WORDS = 200_000
KEPT_CELLS = 4_000_000
LONGEST_KEPT = 64
UNKNOWN = "und"

# First and last code points of script ranges.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)


def script_of(letters: str) -> str:
    code = ord(letters[0])
    for name, first, last in SCRIPTS:
        if first <= code <= last:
            return name
    return "other"


def letters_of(word: str) -> str:
    return (word if word.isalpha() else "".join(filter(str.isalpha, word))).lower()


def grams_of(letters: str) -> list[str]:
    padded = f"^{letters}$"
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


class Model:
    """Languages, their scripts, and log probabilities of trigrams.

    ``unseen`` has the log probability of a trigram that a language's sample
    lacks. Entries ``first[g]`` to ``first[g + 1]`` of ``at`` and ``gain`` are
    the languages that have trigram g and what it is worth above ``unseen``.
    """

    def __init__(self, languages, scripts, grams, unseen, first, at, gain):
        self.languages, self.scripts, self.grams = languages, scripts, grams
        self.unseen, self.first, self.at, self.gain = unseen, first, at, gain


def training_rows(docs: DataFrame, is_training: Column, lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A hash sample of about ``per_language`` labelled rows of each language: lang, text."""
    labelled = docs.where(is_training & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
        unit_hash(F.lit("lang"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("draw"))
    rates = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("rate"))
    # One row a language; texts stay in place.
    return labelled.join(F.broadcast(rates), F.col("lang") == F.col("_lang")).where("draw < rate").select("lang", "text")


def _count_batches(batches):
    """Per batch: words per (lang, script) as rows with gram null, and trigrams per lang."""
    import pyarrow as pa

    for batch in batches:
        words: dict[str, Counter] = {}
        for langs, texts in slices(batch):
            for lang, text in zip(langs, texts, strict=True):
                words.setdefault(lang, Counter()).update(text.split())
        out: Counter = Counter()
        for lang, counted in words.items():
            for word, n in counted.items():
                letters = letters_of(word)
                if letters:
                    out[lang, script_of(letters), None] += n
                    for gram in grams_of(letters):
                        out[lang, None, gram] += n
        yield pa.RecordBatch.from_pylist(
            [{"lang": k[0], "script": k[1], "gram": k[2], "n": n} for k, n in out.items()],
            pa.schema([("lang", pa.string()), ("script", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))


def fit(sample: DataFrame) -> Model:
    """Learn from a bounded table (lang, text); counting runs in Spark, the driver gets the counts."""
    import numpy as np

    counts = sample.select("lang", "text").mapInArrow(_count_batches, "lang string, script string, gram string, n long")
    rows = counts.groupBy("lang", "script", "gram").agg(F.sum("n").alias("n")).toArrow()
    of_gram = np.array(rows["gram"].is_valid(), bool)
    words = rows.filter(~of_gram).select(["lang", "script", "n"]).to_pylist()
    languages = sorted({r["lang"] for r in words})
    at = {lang: i for i, lang in enumerate(languages)}
    total = Counter()
    for r in words:
        total[r["lang"]] += r["n"]
    scripts: dict[str, list[bool]] = {}
    for r in words:
        if r["n"] >= SCRIPT_SHARE * total[r["lang"]]:
            scripts.setdefault(r["script"], [False] * len(languages))[at[r["lang"]]] = True
    rows = rows.filter(of_gram).select(["gram", "lang", "n"]).sort_by([("gram", "ascending"), ("lang", "ascending")])
    grams: dict[str, int] = {}
    gram = np.array([grams.setdefault(g, len(grams)) for g in rows["gram"].to_pylist()], np.int64)
    lang = np.array([at[x] for x in rows["lang"].to_pylist()], np.int32)
    n = rows["n"].to_numpy().astype(float)
    unseen = np.log(SMOOTH / np.maximum(np.bincount(lang, n, len(languages)) + SMOOTH * len(grams), SMOOTH))
    return Model(languages, scripts, grams, unseen, np.searchsorted(gram, np.arange(len(grams) + 1)), lang, np.log(n / SMOOTH + 1))


class Labeller:
    """Applies a model; keeps the scores of words it has met.

    New words of a text are scored together: their letters form one array of
    code points, a trigram is three of these in one 64-bit number, and all
    trigrams are looked up at once.
    """

    def __init__(self, model: Model, switch: float = SWITCH):
        import numpy as np

        self.np, self.model, self.switch = np, model, switch
        self.width = len(model.languages)
        self.kept = min(KEPT_WORDS, KEPT_CELLS // (self.width + 2))
        codes = self.codes_of("".join(model.grams)).reshape(-1, 3)
        codes = self.trigrams(codes[:, 0], codes[:, 1], codes[:, 2])
        order = np.argsort(codes)
        self.gram_codes, self.gram_at = codes[order], np.array(list(model.grams.values()), np.int64)[order]
        # The masks of the script ranges in their order, then of letters outside them and of scripts without a sample.
        self.firsts, self.lasts = (np.array([s[i] for s in SCRIPTS]) for i in (1, 2))
        rows = [model.scripts.get(name) for name in [*(s[0] for s in SCRIPTS), "other", None]]
        self.has_mask = np.array([r is not None for r in rows])
        self.masks = np.array([np.zeros(self.width) if r is None else np.where(r, 0.0, WRONG_SCRIPT) for r in rows])
        self.evident = self.masks.any(1)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.used, self.matrix = 0, self.np.zeros((1024, self.width + 2))

    def codes_of(self, text: str):
        return self.np.frombuffer(text.encode("utf-32-le"), self.np.uint32).astype(self.np.int64)

    def trigrams(self, a, b, c):
        return (a << 42) | (b << 21) | c  # a code point has 21 binary digits

    def rows_of(self, words: list[str]):
        """For each word a row: its score under each language, its number of letters, whether there is evidence."""
        np, model = self.np, self.model
        letters = [letters_of(w) for w in words]
        sizes = np.array([len(x) for x in letters], np.int64)
        padded = np.where(sizes > 0, sizes + 2, 0)
        codes = self.codes_of("".join([f"^{x}$" for x in letters if x]))
        firsts = np.cumsum(padded) - padded
        # The script of a word is that of its first letter; words without letters take the last, empty mask.
        script = np.full(len(words), len(self.masks) - 1)
        filled = np.flatnonzero(sizes)
        lead = codes[firsts[filled] + 1]
        at = np.searchsorted(self.firsts, lead, side="right") - 1
        script[filled] = np.where((at >= 0) & (lead <= self.lasts[at]), at, len(SCRIPTS))
        # Trigram starts: all places of a word but its last two.
        known = np.where(self.has_mask[script], sizes, 0)
        owner = np.repeat(np.arange(len(words)), known)
        starts = np.arange(known.sum()) + np.repeat(firsts - np.cumsum(known) + known, known)
        found = np.zeros(len(words), np.int64)
        gains = np.zeros((len(words), self.width))
        if len(starts) and len(self.gram_codes):
            asked = self.trigrams(codes[starts], codes[starts + 1], codes[starts + 2])
            place = np.minimum(np.searchsorted(self.gram_codes, asked), len(self.gram_codes) - 1)
            hit = self.gram_codes[place] == asked
            grams, owner = self.gram_at[place[hit]], owner[hit]
            found = np.bincount(owner, minlength=len(words))
            first, many = model.first[grams], model.first[grams + 1] - model.first[grams]
            entries = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
            cells = np.repeat(owner, many) * self.width + model.at[entries]
            gains = np.bincount(cells, model.gain[entries], len(words) * self.width).reshape(len(words), self.width)
        rows = np.empty((len(words), self.width + 2))
        rows[:, :-2] = gains + found[:, None] * model.unseen + self.masks[script]
        rows[:, -2] = sizes
        rows[:, -1] = (found > 0) | self.evident[script]
        return rows

    def look_up(self, words: list[str]):
        """The rows of a text's words; those met before are kept."""
        np = self.np
        if self.used > self.kept:
            self.reset()
        known = self.known
        places = [known.get(w) for w in words]
        if None in places:
            fresh = list(dict.fromkeys([w for w, p in zip(words, places, strict=True) if p is None]))
            if self.used + len(fresh) > len(self.matrix):
                grown = np.zeros((1 << (self.used + len(fresh)).bit_length(), self.width + 2))
                grown[:self.used] = self.matrix[:self.used]
                self.matrix = grown
            self.matrix[self.used:self.used + len(fresh)] = self.rows_of(fresh)
            own = dict(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
            self.used += len(fresh)
            known.update({w: p for w, p in own.items() if len(w) <= LONGEST_KEPT})
            places = [own[w] if p is None else p for w, p in zip(words, places, strict=True)]
        return self.matrix[places]

    def path(self, scores):
        """The best language of each word."""
        np = self.np
        by_lang = np.ascontiguousarray(scores.T)  # sums run along the words of a language
        best = int(np.cumsum(by_lang, 1)[:, -1].argmax())
        gained = np.cumsum(by_lang - by_lang[best], 1)
        low = np.zeros_like(gained)
        np.minimum.accumulate(np.minimum(gained[:, :-1], 0.0), 1, out=low[:, 1:])
        opening, closing = gained.max(), (gained[:, -1] - np.minimum(low[:, -1], gained[:, -1])).max()
        if (gained - low).max() <= self.switch and max(opening, 0.0) + closing <= self.switch:
            return np.full(len(scores), best)
        rows, value, back = scores.tolist(), [0.0] * self.width, []
        for row in rows:
            top = max(value)
            entry, source = top - self.switch, value.index(top)
            back.append([k if value[k] >= entry else source for k in range(self.width)])
            value = [max(value[k], entry) + row[k] for k in range(self.width)]
        state, out = value.index(max(value)), np.empty(len(rows), int)
        for i in range(len(rows) - 1, -1, -1):
            out[i] = state
            state = back[i][state]
        return out

    def label(self, text: str | None) -> dict:
        """{lang, score, spans: [{start, end, lang}]} of a text; spans by character."""
        np, words = self.np, text.split() if text else []
        if not words or not self.width:
            return {"lang": UNKNOWN, "score": 0.0, "spans": []}
        found = self.look_up(words)
        scores, sizes, evident = found[:, :-2], found[:, -2], found[:, -1]
        total = sizes.sum()
        if not total:
            return {"lang": UNKNOWN, "score": 0.0, "spans": []}
        path = self.path(scores)
        letters = np.bincount(path, sizes, self.width)
        best = int(letters.argmax())
        sure = np.bincount(path, sizes * np.where(evident > 0, 1.0, 1.0 / self.width), self.width)[best]
        breaks = np.flatnonzero(np.diff(path)) + 1
        if len(breaks) == 0:
            spans = [{"start": 0, "end": len(text), "lang": self.model.languages[best]}]
        else:
            starts = [m.start() for m in re.finditer(r"\S+", text)]
            if len(starts) != len(words):  # split() knows a few more separators
                starts, at = [], 0
                for w in words:
                    at = text.index(w, at)
                    starts.append(at)
                    at += len(w)
            cuts = [0, *[starts[b] for b in breaks], len(text)]
            firsts = [0, *breaks.tolist()]
            spans = [{"start": cuts[i], "end": cuts[i + 1], "lang": self.model.languages[int(path[firsts[i]])]}
                     for i in range(len(firsts))]
        return {"lang": self.model.languages[best], "score": float(min(1.0, sure / total)), "spans": spans}


def labelled(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score, spans."""
    shared = share(docs.sparkSession, model)  # the trigrams of the bounded sample

    def setup():
        labeller = Labeller(shared())
        return lambda texts: [labeller.label(t) for t in texts]

    import pyarrow as pa

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])
    udf = list_udf(setup, kind, "lang string, score double, spans array<struct<start int, end int, lang string>>")
    return docs.withColumn(out, udf(F.col(f"`{text_col}`")))
