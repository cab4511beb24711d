"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z only) and cut into words. A window is ``WINDOW``
consecutive words of a benchmark item; an item of fewer words is one window. A
document word is hit where an occurrence of any window covers it.

1. Of the k-gram hashes inside each window only the least is kept, k being
   ``GRAM`` or the window's words, if fewer. Neighbouring windows mostly keep
   the same one, so a text of n words has about 2 n / (w - k + 2) fingerprints.
2. Fingerprints of documents and items are joined. Equal windows have equal
   fingerprints, so every shared window is met: nothing of a window's length is
   missed.
3. A hit is extended over all windows that kept this fingerprint: their words
   are compared, as whole strings, with those of the items. What is equal is
   covered, and overlapping windows join into spans.

Items of one text all bear the same windows, so windows are compared once as
texts; texts that occur in the same items form a class, and a document carries
its few classes, not its windows, to the list of items.

Everything is built of DataFrame functions. The benchmark's side of a join is
broadcast up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes, which is
counted; beyond that the document's side is salted ``SALT`` ways against as many
copies of the benchmark's, so that a passage that many documents share is dealt
out. What is gathered to one row is bounded by one document's words, and by the
items found in it.

Defined results: null and empty texts have no words and are never hit; an item
without words has no window; an empty benchmark hits nothing; items with the
same id are one item, a null id being the id ''. Rows that repeat id and text
each get the same result; a null doc_id is an id like others. Other columns
pass through, and only the column ``out`` is added or replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, stored

# What stands between words (after lower-casing A-Z, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` is a word),
# and the words of a window.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ENDS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())
WINDOW = 10

#: Words of a fingerprint.
GRAM = 5
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SALT = 16


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, out: str = "contamination") -> DataFrame:
    """``docs`` (doc_id, text) with a struct ``out``: n_words, spans of hit words (start, stop), and the ids of
    the items with windows in them, sorted as strings."""
    rows = docs.select(F.struct("*").alias("_row"), *_key(docs), _n_words(F.col("text")).alias("_n"))
    found = matches(docs, items, window, gram)
    joined = rows.join(found, _same(rows, found), "left").select(rows["_row"], rows["_n"], found["spans"], found["items"])
    none = F.array().cast("array<struct<start: int, stop: int>>"), F.array().cast("array<string>")
    return joined.select("_row.*", F.struct(
        F.col("_n").alias("n_words"), F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"),
    ).alias("_found")).drop(out).withColumnRenamed("_found", out)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row (_id, _sha, spans, items) for each id and text that has a hit."""
    windows = stored(item_windows(items, window))
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # at most ``window`` values
    if not widths:
        return docs.select(*_key(docs), F.lit(None).cast("array<struct<start: int, stop: int>>").alias("spans"),
                           F.lit(None).cast("array<string>").alias("items")).where("false")

    # Documents whose fingerprints some item has, with the windows that kept them.
    prints = _lookup(
        docs.select(*_key(docs), F.explode(fingerprints(_folded_words(F.col("text")), widths, gram)).alias("_p"))
        .select("_id", "_sha", "_p.*"),
        stored(_item_prints(windows, widths, gram)), ["width", "print"])
    hits = prints.groupBy("_id", "_sha").agg(F.collect_set(F.struct("width", "start", "stop")).alias("_hits"))

    # The words of these windows against the words of the items.
    rows = docs.select(*_key(docs), "text")
    texts = rows.join(hits, _same(rows, hits)).select(rows["_id"], rows["_sha"], F.explode(
        _bound(words_of(F.col("text")), lambda w: F.flatten(F.transform("_hits", lambda h: F.transform(
            F.sequence(h["start"], h["stop"] - 1), lambda s: F.struct(
                s.alias("start"), h["width"].alias("width"), _joined(w, s, h["width"]).alias("words"))))))).alias("_w"),
    ).select("_id", "_sha", "_w.*")
    member = windows.select("words", "item").distinct()
    classes = stored(member.groupBy("words").agg(F.struct(
        F.count("*"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64("item", F.lit("second")))).cast("string").alias("class")))
    equal = stored(_lookup(texts, classes, ["words"]).groupBy("_id", "_sha").agg(
        F.collect_set(F.struct("start", "width")).alias("_places"), F.collect_set("class").alias("_classes")))
    class_items = stored(_lookup(member, classes, ["words"]).select("class", "item").distinct())
    listed = _lookup(equal.select("_id", "_sha", F.explode("_classes").alias("class")), class_items, ["class"]).groupBy(
        "_id", "_sha").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = equal.select("_id", "_sha", _spans(F.col("_places")).alias("spans"))
    return covered.join(listed, _same(covered, listed)).select(covered["_id"], covered["_sha"], "spans", "items")


def words_of(text: Column) -> Column:
    return _split(lower_ascii(F.coalesce(text, F.lit(""))))


def _folded_words(text: Column) -> Column:
    """The words in lower case of all scripts, which is cheaper: words that are equal stay equal. Only the small
    form of a sigma depends on what follows, so texts with one are folded like :func:`words_of`."""
    return _split(F.when(F.contains(text, F.lit("\u03a3")), lower_ascii(text)).otherwise(F.coalesce(F.lower(text), F.lit(""))))


def _n_words(text: Column) -> Column:
    return F.size(_split(F.coalesce(text, F.lit("")))).cast("long")


def _split(text: Column) -> Column:
    """Words between blanks and signs; without those at the ends no part is empty."""
    inner = F.trim(text, F.lit(ENDS))
    return F.when(inner != "", F.split(inner, BETWEEN)).otherwise(F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, width, words: every window of every item."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    cut = cut.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(window)))
    return cut.select("item", "width", F.explode(_bound(F.col("w"), lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - F.col("width")), lambda s: _joined(w, s, F.col("width"))))).alias("words")).distinct()


def _item_prints(windows: DataFrame, widths: list[int], gram: int) -> DataFrame:
    """width, print: the fingerprints of all windows."""
    found = F.lit(None).cast("bigint")
    for width in widths:
        found = F.when(F.col("width") == width, F.get(_prints(_folded_words(F.col("words")), width, gram), 0)).otherwise(found)
    return windows.select("width", found.alias("print")).distinct()


def fingerprints(words: Column, widths: list[int], gram: int = GRAM) -> Column:
    """Array of (width, start, stop, print): the windows from ``start`` up to ``stop`` keep the hash ``print``."""

    def of_width(words: Column, width: int) -> Column:
        def runs(kept: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(kept) - 1), lambda s: (s == 0) | (F.get(kept, s - 1) != F.get(kept, s)))
            return _bound(first, lambda starts: F.transform(starts, lambda s, i: F.struct(
                F.lit(width).alias("width"), s.alias("start"), F.coalesce(F.get(starts, i + 1), F.size(kept)).alias("stop"),
                F.get(kept, s).alias("print"))))

        empty = F.array().cast("array<struct<width: int, start: int, stop: int, print: bigint>>")
        return F.when(F.size(words) >= width, _bound(_prints(words, width, gram), runs)).otherwise(empty)

    return _bound(words, lambda w: F.flatten(F.array(*[of_width(w, width) for width in widths])))


def _prints(words: Column, width: int, gram: int) -> Column:
    """The least k-gram hash of each window of ``width`` words; there must be one window at least."""
    k = min(gram, width)

    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - k),
                           lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))

    def least(values: Column, over: int) -> Column:
        """The least of each ``over`` values in a row: of three at once, then of those a step apart."""
        if over == 1:
            return values
        step = 3 if over > 3 else over
        part = F.transform(F.sequence(F.lit(0), F.size(values) - step), lambda i: F.least(*[F.get(values, i + j) for j in range(step)]))
        if over == step:
            return part
        at = [*range(0, over - step, step), over - step]
        return _bound(part, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1 - at[-1]), lambda i: F.least(*[F.get(p, i + j) for j in at])))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _bound(grams(h), lambda g: least(g, width - k + 1)))


def _spans(places: Column) -> Column:
    """The stretches that windows (start, width) cover together."""
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(
        places, lambda p: F.sequence(p["start"], p["start"] + p["width"] - 1)))))

    def stretches(hit: Column) -> Column:
        starts = F.filter(hit, lambda x, i: (i == 0) | (F.get(hit, i - 1) != x - 1))
        stops = F.filter(hit, lambda x, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != x + 1))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))

    return _bound(hit, stretches)


def _joined(words: Column, start: Column, width: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, width), " ")


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def _key(docs: DataFrame) -> list[Column]:
    """Rows with the same id and text have the same result; that names them, also when they are read again."""
    return [F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")]


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_sha"] == right["_sha"])


def _lookup(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a table of the benchmark: broadcast if it is small, else salted."""
    text = F.coalesce(F.sum(sum((F.octet_length(c) for c, t in table.dtypes if t == "string"), F.lit(0))), F.lit(0))
    size = table.agg(F.count("*").alias("n"), text.alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")
