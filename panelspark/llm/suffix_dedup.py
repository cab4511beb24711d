"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers.

A string of LENGTH bytes that starts at two places (of any documents) makes
all its bytes go, at both. All such strings are found without sending texts
around that share nothing:

1. Anchors. Of the hashes of all GRAM-byte strings, those that are smallest
   within some LENGTH bytes are anchors. Two equal strings of LENGTH bytes
   have an equal anchor at an equal place, so every repeat lies in the
   contexts (up to LENGTH - GRAM bytes before, LENGTH after) of anchors with
   equal hashes. Anchors are counted; those with one occurrence are done.
2. Equal contexts repeat as a whole and need no further work, however many
   there are.
3. Anchors with several different contexts are open: one text per distinct
   context is fetched. Aligned at the anchor, the contexts are cut where any
   two of them part, and each piece is numbered by place and content. The
   suffixes of this short symbol text are sorted by linear grouping
   (``suffix_sort``); the longest match of a suffix with its neighbours is
   the longest string from there that occurs in another context, so matches
   of LENGTH bytes or more are exactly the repeated stretches.
4. Anchors with more than ``LARGE`` different contexts (a passage that many
   documents share has as many at its edges) would make long symbol texts: of
   their contexts each LENGTH bytes that hold the anchor are hashed, and
   stretches follow from the hashes that repeat. Up to ``HUGE`` contexts this
   is done for the anchor at once; beyond that hashes are exchanged and
   counted, so that no anchor is ever too large for a task. Strings of one
   context that start within ``STEP`` bytes form a range: those of ranges
   whose common bytes occur once are done, those of ranges that repeat as a
   whole repeat, and only what is left is hashed string by string.

Spans are united per text, and equal texts share one result.

Defined results:

* a null text counts as empty; texts shorter than LENGTH lose nothing;
* equal texts of LENGTH bytes or more are removed whole, every copy, also
  rows that repeat an id;
* strings are judged on the input; overlaps within a document count;
* matches may cut a multi-byte character, so what is left is bytes;
* only the id and text columns are read; an empty table gives an empty one.

Contexts are told apart by bytes in step 3 and by 64-bit hashes, under an
equal 64-bit anchor hash, in steps 2 and 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import list_udf, slices, stored
from .suffix_sort import neighbour_matches, suffix_array

LENGTH = 400
GRAM = 128
LARGE = 24
HUGE = 8192
STEP = 16
SEGMENT = 1 << 20
ANCHORS = "array<struct<h bigint, c bigint, pos bigint>>"


class AnchorFinder:
    """Anchors of byte strings. GRAM is a power of two, so its hash is built by doubling."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        import numpy as np

        if gram & (gram - 1) or not 0 < gram < length:
            raise ValueError("gram is a power of two below length")
        self.np, self.length, self.gram, self.window = np, length, gram, length - gram + 1
        random = np.random.default_rng(20240608)
        self.bytes = random.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.factors = random.integers(0, 1 << 64, gram.bit_length(), dtype=np.uint64) | np.uint64(1)

    def gram_hashes(self, data):
        np = self.np
        h, size = self.bytes[data], 1
        for factor in self.factors[:self.gram.bit_length() - 1]:
            h = h[:-size] * factor + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
        return h * self.factors[-1]

    def slide(self, values, best):
        """``best`` over each run of ``window`` values."""
        width = 1
        while width * 2 <= self.window:
            values = best(values[:-width], values[width:])
            width *= 2
        rest = self.window - width
        return best(values[:-rest], values[rest:]) if rest else values

    def places(self, data):
        """(positions, hashes) of the anchors, found in segments that overlap enough to agree."""
        np, out, hashes = self.np, [], []
        n, margin = len(data), 2 * self.length
        for start in range(0, max(1, n), SEGMENT):
            low, high = max(0, start - margin), min(n, start + SEGMENT + margin)
            if high - low < self.length:
                continue
            h = self.gram_hashes(data[low:high])
            least = self.slide(h, np.minimum)
            pad = np.zeros(self.window - 1, np.uint64)
            found = np.flatnonzero(self.slide(np.concatenate([pad, least, pad]), np.maximum) == h)
            found = found[(found + low >= start) & (found + low < start + SEGMENT)]
            out.append(found + low)
            hashes.append(h[found])
        return (np.concatenate(out), np.concatenate(hashes)) if out else (np.empty(0, int), np.empty(0, np.uint64))

    def left(self, pos: int) -> int:
        return min(pos, self.length - self.gram)

    def context(self, text: bytes, pos: int) -> bytes:
        return text[pos - self.left(pos):pos + self.length]

    def anchors(self, text: bytes):
        """(h, c, pos): anchor hash, context hash, position."""
        import xxhash

        np = self.np
        places, hashes = self.places(np.frombuffer(text, np.uint8))
        own = [xxhash.xxh3_64_intdigest(self.context(text, p), seed=self.left(p)) for p in places.tolist()]
        return hashes.view("int64").tolist(), np.array(own, np.uint64).view("int64").tolist(), places.tolist()


def _anchors():
    finder = AnchorFinder()

    def anchors_of(text: str | None) -> list[dict]:
        found = finder.anchors(text.encode("utf-8", "surrogatepass")) if text else ((), (), ())
        return [{"h": h, "c": c, "pos": p} for h, c, p in zip(*found, strict=True)]

    return lambda texts: [anchors_of(t) for t in texts]


def _context_batches(batches):
    """(text, wanted anchors) to (h, c, left, context)."""
    import pyarrow as pa

    finder = AnchorFinder()
    kind = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("lead", pa.int32()), ("context", pa.binary())])
    for batch in batches:
        rows: list[dict] = []
        for texts, wanted in slices(batch):
            for text, anchors in zip(texts, wanted, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for a in anchors:
                    rows.append({"h": a["h"], "c": a["c"], "lead": finder.left(a["pos"]),
                                 "context": finder.context(data, a["pos"])})
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, kind)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    import numpy as np

    n = min(len(a), len(b))
    parted = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(parted[0]) if len(parted) else n


def repeated_in_group(contexts: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For distinct contexts (bytes before the anchor, context) of one anchor: stretches, relative to the
    anchor, of ``length`` bytes or more that another context has at the same place."""
    lefts = [c[:lead][::-1] for lead, c in contexts]
    rights = [c[lead:] for lead, c in contexts]
    if len(contexts) == 2:
        low, high = -common_prefix(*lefts), common_prefix(*rights)
        return [[(low, high)] if high - low >= length else []] * 2
    cuts = {0}
    for sign, sides in ((-1, lefts), (1, rights)):
        ordered = sorted(sides)
        cuts.update(sign * common_prefix(a, b) for a, b in zip(ordered, ordered[1:], strict=False))
        cuts.update(sign * len(s) for s in sides)
    bounds = sorted(cuts)
    symbols: list[int] = []
    begins: list[int] = []
    names: dict[tuple[int, bytes], int] = {}
    owner: list[int] = []
    for k, (lead, context) in enumerate(contexts):
        for low, high in zip(bounds, bounds[1:], strict=False):
            if low + lead >= 0 and high + lead <= len(context):
                piece = (low, context[low + lead:high + lead])
                symbols.append(names.setdefault(piece, len(names)) + len(contexts))
                begins.append(low)
                owner.append(k)
        symbols.append(k)  # ends the context; no other has it
        begins.append(len(context) - lead)
        owner.append(k)
    matches = neighbour_matches(symbols, suffix_array(symbols))
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for i, size in enumerate(matches):
        if size and begins[i + size] - begins[i] >= length:
            found[owner[i]].append((begins[i], begins[i + size]))
    return [united(spans) for spans in found]


def repeated_in_large_group(contexts: list[tuple[int, bytes]], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """As :func:`repeated_in_group` for stretches that hold the anchor's gram, by hashes of all strings of ``length``."""
    import numpy as np

    reach = length - gram
    random = np.random.default_rng(20240609)
    letters = random.integers(0, 1 << 64, 257, dtype=np.uint64)
    powers = np.cumprod(np.full(reach + length, random.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64)
    table = np.full((len(contexts), reach + length), 256, np.uint16)  # aligned at the anchor, 256 outside the context
    for row, (lead, context) in zip(table, contexts, strict=True):
        row[reach - lead:reach - lead + len(context)] = np.frombuffer(context, np.uint8)
    sums = np.zeros((len(contexts), reach + length + 1), np.uint64)
    np.cumsum(letters[table] * powers, 1, out=sums[:, 1:])
    lead = np.array([x for x, _ in contexts])
    tail = np.array([len(c) - x for x, c in contexts])
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for low in range(-reach, 1):
        rows = np.flatnonzero((lead >= -low) & (tail >= low + length))
        hashes = sums[rows, reach + low + length] - sums[rows, reach + low]
        _, names, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        for k in rows[counts[names] > 1].tolist():
            own = found[k]
            if own and low <= own[-1][1]:
                own[-1] = (own[-1][0], low + length)
            else:
                own.append((low, low + length))
    return found


def _group_batches(batches):
    """Rows (h, c, lead, context) in the order of h to (h, c, stretches); a group may span batches."""
    import pyarrow as pa

    kind = pa.schema([("h", pa.int64()), ("c", pa.int64()),
                      ("spans", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))])
    out: list[dict] = []

    def close(key, group):
        repeated = repeated_in_group if len(group) <= LARGE else repeated_in_large_group
        for (c, _, _), spans in zip(group, repeated([(lead, x) for _, lead, x in group]), strict=True):
            if spans:
                out.append({"h": key, "c": c, "spans": [{"low": a, "high": b} for a, b in spans]})

    key, group = None, []
    for batch in batches:
        for columns in slices(batch):
            for h, c, lead, context in zip(*columns, strict=True):
                if h != key:
                    if len(group) > 1:
                        close(key, group)
                    key, group = h, []
                group.append((c, lead, context))
        yield pa.RecordBatch.from_pylist(out, kind)
        out.clear()
    if len(group) > 1:
        close(key, group)
    yield pa.RecordBatch.from_pylist(out, kind)


def ranges_of(lead: int, size: int) -> list[tuple[int, int, int, int]]:
    """(part, core, low, high) of each range of LENGTH-byte strings of a context that hold the anchor's gram.

    The strings start ``low`` to ``high`` bytes from the anchor. All strings of a part, of any context, hold the
    bytes from ``core`` on, up to where the first string of the part ends.
    """
    reach, out = LENGTH - GRAM, []
    for part, first in enumerate(range(-reach, 1, STEP)):
        last = min(first + STEP - 1, 0)
        low, high = max(first, -lead), min(last, size - LENGTH - lead)
        if low <= high:
            out.append((part, last, low, high))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _range_batches(batches):
    """Rows (h, c, lead, context) to (h, c, part, low, high, core, hull): hashes of the bytes that all strings of a
    range share and of all its bytes."""
    import pyarrow as pa
    import xxhash

    kind = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("part", pa.int32()), ("low", pa.int32()), ("high", pa.int32()),
                      ("core", pa.int64()), ("hull", pa.int64())])
    reach = LENGTH - GRAM
    for batch in batches:
        for columns in slices(batch):
            rows: list[list] = [[] for _ in kind]
            for h, c, lead, context in zip(*columns, strict=True):
                view = memoryview(context)
                for part, core, low, high in ranges_of(lead, len(context)):
                    first = part * STEP - reach
                    own = xxhash.xxh3_64_intdigest(view[core + lead:first + LENGTH + lead])
                    # Equal only with equal ends.
                    hull = xxhash.xxh3_64_intdigest(view[low + lead:high + LENGTH + lead], seed=(reach + low) * LENGTH + reach + high)
                    for column, value in zip(rows, (h, c, part, low, high, _signed(own), _signed(hull)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, kind, strict=True)], schema=kind)


def _window_batches(batches):
    """Rows (h, c, lead, context, wanted ranges with the contexts they stand for) to (h, c, low, w, m): the hash of
    each string of LENGTH bytes in these ranges."""
    import pyarrow as pa
    import xxhash

    kind = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("low", pa.int32()), ("w", pa.int64()), ("m", pa.int64())])
    for batch in batches:
        for columns in slices(batch):
            rows: list[list] = [[] for _ in kind]
            for h, c, lead, context, wanted in zip(*columns, strict=True):
                view, times = memoryview(context), {r["part"]: r["m"] for r in wanted}
                for part, _, low, high in ranges_of(lead, len(context)):
                    for at in range(low, high + 1) if part in times else ():
                        w = xxhash.xxh3_64_intdigest(view[at + lead:at + lead + LENGTH])
                        for column, value in zip(rows, (h, c, at, _signed(w), times[part]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, kind, strict=True)], schema=kind)


def _stretches_by_hash(wide: DataFrame) -> DataFrame:
    """(h, c, spans) of contexts (h, c, lead, context) by counting hashes over the cluster, one span a context.

    All strings of a context hold the anchor's gram, so those that repeat overlap, and the first and the last tell
    what they cover.
    """
    ranges = stored(wide.mapInArrow(
        _range_batches, "h bigint, c bigint, part int, low int, high int, core bigint, hull bigint"))
    kinds = stored(ranges.groupBy("h", "part", "core", "hull").agg(F.count("*").alias("m"), F.min("c").alias("c")))
    whole = ranges.join(kinds.where("m > 1").select("h", "part", "hull"), ["h", "part", "hull"]).select("h", "c", "low", "high")
    # Ranges that share their core and do not all repeat as a whole; one context stands for those that are alike.
    unsure = kinds.groupBy("h", "part", "core").agg(F.count("*").alias("n"), F.min("m").alias("least")).where(
        "n > 1 and least = 1").select("h", "part", "core")
    wanted = kinds.join(unsure, ["h", "part", "core"]).groupBy("h", "c").agg(
        F.collect_list(F.struct("part", "m")).alias("wanted"))
    windows = stored(wide.join(wanted, ["h", "c"]).select("h", "c", "lead", "context", "wanted").mapInArrow(
        _window_batches, "h bigint, c bigint, low int, w bigint, m bigint"))
    again = windows.groupBy("h", "low", "w").agg(F.sum("m").alias("n")).where("n > 1").select("h", "low", "w")
    alone = windows.where("m = 1").join(again, ["h", "low", "w"]).select("h", "c", "low", F.col("low").alias("high"))
    low, high = F.min("low").cast("long"), F.max("high").cast("long") + LENGTH
    return whole.union(alone).groupBy("h", "c").agg(low.alias("low"), high.alias("high")).select(
        "h", "c", F.array(F.struct("low", "high")).alias("spans"))


SPANS = "h bigint, c bigint, spans array<struct<low bigint, high bigint>>"


def _stretches(contexts: DataFrame, huge: DataFrame) -> DataFrame:
    """(h, c, spans) of the contexts that share LENGTH bytes or more with another context of their anchor."""
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = contexts.join(huge, "h", "left_anti").repartition(n, "h").sortWithinPartitions("h")
    sorted_groups = small.select("h", "c", "lead", "context").mapInArrow(_group_batches, SPANS)
    wide = contexts.join(huge, "h", "left_semi").select("h", "c", "lead", "context")
    return sorted_groups.union(_stretches_by_hash(wide))


def _cut_batches(batches):
    """(key, text, spans) to (key, spans united, kept bytes)."""
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.schema([("key", pa.binary()), ("spans", span), ("kept", pa.binary())])
    for batch in batches:
        for columns in slices(batch):
            rows = []
            for key, text, spans in zip(*columns, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = united([(s["start"], s["end"]) for s in spans])
                kept, at = [], 0
                for start, end in gone:
                    kept.append(data[at:start])
                    at = end
                kept.append(data[at:])
                rows.append({"key": key, "spans": [{"start": a, "end": b} for a, b in gone], "kept": b"".join(kept)})
            yield pa.RecordBatch.from_pylist(rows, kind)


def text_key(text: Column) -> Column:
    """The first half of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, text_sha256, spans (start, end in bytes), kept.

    ``kept`` holds the bytes that are left where something was removed; it is
    null where the text stays as it is.
    """
    rows, cuts = cut_texts(docs, id_col, text_col)
    return rows.join(cuts, "key", "left").select(
        "doc_id", "n_bytes", "text_sha256", F.coalesce("spans", F.array().cast(CUT)).alias("spans"), "kept")


CUT = "array<struct<start bigint, end bigint>>"


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, texts): key, doc_id, n_bytes, text_sha256 of every document, and key, spans, kept of each
    text that loses something, once for all its copies."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    import pyarrow as pa

    kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("pos", pa.int64())]))
    find = list_udf(_anchors, kind, ANCHORS)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    signed = stored(base.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("text_sha256"),
        F.unhex(F.substring(sha, 1, 32)).alias("key"), find("text").alias("anchors")))
    rows = signed.select("key", "doc_id", "n_bytes", "text_sha256")
    long_rows = signed.where(F.col("n_bytes") >= LENGTH)
    copies = stored(long_rows.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")).where(
        "copies > 1").select("key", "n_bytes"))

    places = long_rows.select("key", "n_bytes", F.explode("anchors").alias("a")).select("key", "n_bytes", "a.h", "a.c", "a.pos")
    often = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    met = stored(places.join(often, "h"))
    contexts = met.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("key", "pos")).alias("at"))
    per_anchor = contexts.groupBy("h").agg(F.count("*").alias("parts"))
    contexts = stored(contexts.join(per_anchor, "h").select("h", "c", "m", "parts", "at.key", "at.pos"))
    huge = stored(contexts.where(F.col("parts") > HUGE).select("h").distinct())

    # Texts that share an anchor with another place, once each, for contexts and for the cut.
    own_key = text_key(F.col("text"))
    involved = met.select("key").distinct()
    texts = stored(base.where(F.octet_length("text") >= LENGTH).select(own_key.alias("key"), "text").join(
        involved.join(copies, "key", "left_anti").withColumn("alone", F.lit(True)).union(
            involved.join(copies, "key", "left_semi").withColumn("alone", F.lit(False))), "key"))
    once = texts.where("alone").select("key", "text").union(
        texts.where("not alone").groupBy("key").agg(F.first("text").alias("text")))
    wanted = contexts.where("parts > 1").groupBy("key").agg(F.collect_list(F.struct("h", "c", "pos")).alias("wanted"))
    fetched = stored(once.join(wanted, "key").select("text", "wanted").mapInArrow(
        _context_batches, "h bigint, c bigint, lead int, context binary"))
    stretches = _stretches(fetched, huge)

    met = met.join(copies.select("key"), "key", "left_anti")
    lead, tail = F.least("pos", F.lit(LENGTH - GRAM)), F.least(F.col("n_bytes") - F.col("pos"), F.lit(LENGTH))
    whole = met.join(contexts.where("m > 1").select("h", "c"), ["h", "c"]).where(lead + tail >= LENGTH).select(
        "key", (F.col("pos") - lead).alias("start"), (F.col("pos") + tail).alias("end"))
    # A context with one place: others are whole already, however many places they have.
    single = contexts.where("m = 1").select("h", "c", "key", "pos")
    part = single.join(stretches, ["h", "c"]).select("key", "pos", F.explode("spans").alias("s")).select(
        "key", (F.col("pos") + F.col("s.low")).alias("start"), (F.col("pos") + F.col("s.high")).alias("end"))
    spans = whole.union(part).groupBy("key").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = texts.where("alone").join(spans, "key").select("key", "text", "spans").mapInArrow(
        _cut_batches, "key binary, spans array<struct<start bigint, end bigint>>, kept binary")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return rows, cut.union(copies.select("key", everything.alias("spans"), F.lit("").cast("binary").alias("kept")))
