"""Periodic runs of words, found by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) that no neighbouring word extends, at least ``LEAST_WORDS`` and two
periods long. Collapsing a text keeps of each run its first q words.

Each text is a sequence of word numbers, and texts are worked on in bundles of
about ``BUNDLE`` bytes with Numpy:

1. Suffix array, inverse (ISA) and LCP values of the suffixes that share
   ``DEPTH`` words with another suffix of their text. The others stand in no
   interval that is looked at: a run of at least 12 words whose period is 1, 2
   or 3 also has period 6, so depths under 4 are never needed.
2. Every LCP interval of depth d and its children, from the nearest smaller
   LCP values on both sides; no tree nodes are built.
3. For each suffix i of all children but the largest: where ISA[i + d] or
   ISA[i - d] lies in the same interval, and the word after the pair differs
   (so both lie in different children), i and i + d, or i - d and i, start a
   square that cannot be moved right: the last square of a run. A suffix is
   looked at once for each smaller child it is in, O(n log n) times together.
4. Squares that end at one word are taken by growing period. One whose period
   is a multiple of that of a run reaching over it belongs to that run;
   another is rotated left as long as words agree, which gives a run.

All rows are independent: no shuffle, no state, and a lost task is repeated.

Defined results: a null text has no words, no runs and an empty collapsed
text, as has an empty one; equal rows give equal results; an empty table gives
an empty one. Other columns pass through; only the column ``out`` is added, and
one of that name is replaced. Memory is bounded by a bundle or by the largest
single text: about 100 bytes a word, and 4 more for each doubling of the
longest repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD

#: Fewest words of a run.
LEAST_WORDS = 12
#: Bytes of text that are worked on together.
BUNDLE = 4 << 20
#: Suffixes that share fewer words are not sorted; at most 6, and over 3, see above.
DEPTH = 4
#: Suffixes of children that are tested together.
CHUNK = 1 << 22

SCHEMA = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def add_runs(docs: DataFrame, text: str = "text", out: str = "periodic", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with a struct ``out``: ``runs`` by start, then period, in word numbers from 0, and the text
    without the words that runs repeat, ``collapsed``, joined by one space."""
    if least < LEAST_WORDS:
        raise ValueError(f"runs of fewer than {LEAST_WORDS} words are not found")
    return docs.withColumn(out, _found(least)(F.coalesce(F.col(text), F.lit(""))))


def repeat_tails(docs: DataFrame, number: Column, chosen: Column) -> DataFrame:
    """doc_id and text, where the tail of each chosen text repeats, a planted fault: with n words, a = number mod n
    and p = 1 + floor((n - a) / (3 + number mod 8)), each word i >= a becomes word a + (i - a) mod p."""
    words = F.when(chosen, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1)).otherwise(F.array())
    rows = docs.select("doc_id", "text", number.alias("_number"), words.alias("_w"))
    n = F.size("_w")
    a = F.when(n > 0, F.col("_number") % n).otherwise(0).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + F.col("_number") % 8))).cast("int")
    whole = F.flatten(F.array_repeat(F.slice("_w", a + 1, p), F.floor((n - a) / p).cast("int") + 1))
    made = F.array_join(F.slice(F.concat(F.slice("_w", 1, a), whole), 1, n), " ")
    return rows.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def _found(least: int):
    from collections.abc import Iterator

    import pyarrow as pa

    def bundles(batches):
        for batch in batches:
            parts = [_of_texts(part, least) for part in _parts(batch)]
            yield pa.chunked_array(parts).combine_chunks() if parts else pa.array([], type=_arrow_type())

    # arrow_udf reads its form from type hints.
    bundles.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not to be repeated for each use of its result.
    return F.arrow_udf(bundles, SCHEMA).asNondeterministic()


def _arrow_type():
    import pyarrow as pa

    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    return pa.struct([("runs", pa.list_(run)), ("collapsed", pa.large_string())])


def _parts(texts):
    """Slices of an array of texts of about ``BUNDLE`` bytes each; a longer text is one by itself."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + BUNDLE, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _of_texts(texts, least: int):
    """The struct of ``SCHEMA`` for each text of a bundle."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # Arrow's ASCII blanks are those of WORD; blanks at the ends leave empty strings.
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = split.flatten()
    real = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[real]
    words = words.filter(pa.array(real))
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    symbols = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    found = runs_of(symbols, starts, least)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, stop, period in found:
        gone[start + period] += 1
        gone[stop] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    sizes = np.concatenate([[0], np.cumsum(kept)])[starts]
    lists = pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), words.filter(pa.array(kept)) if found else words)
    per_text = [[] for _ in range(len(texts))]
    for start, stop, period in found:
        text = owner[start]
        per_text[text].append({"start": int(start - starts[text]), "length": int(stop - start), "period": int(period)})
    kind = _arrow_type()
    return pa.StructArray.from_arrays(
        [pa.array(per_text, kind[0].type), pc.binary_join(lists, pa.scalar(" ", pa.large_string()))], names=["runs", "collapsed"])


def runs_of(symbols, starts, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs in ``symbols``, by start, then period.

    ``starts`` are the first places of the texts, and the end of the last one;
    no run crosses from one text into another.
    """
    import numpy as np

    n = len(symbols)
    symbols = np.asarray(symbols, np.int64)
    if n and not 0 <= symbols.min() <= symbols.max() < n:
        symbols = _dense(symbols)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = np.asarray(starts, np.int64)[1:][owner]
    begin = np.asarray(starts, np.int64)[:-1][owner]
    places, isa, lcp = _suffixes(symbols, owner, end)
    runs = []
    last, over = None, []
    for i, period in _squares(symbols, begin, end, places, isa, lcp):
        stop = i + 2 * period
        if stop != last:
            last, over = stop, []
        if any(period % q == 0 and start <= i for q, start in over):
            continue
        for q in range(1, DEPTH):
            if period % q == 0 and (symbols[i : stop - q] == symbols[i + q : stop]).all():
                period = q
                break
        start = _rotated(symbols, i, int(begin[i]), period)
        over.append((period, start))
        if stop - start >= max(least, 2 * period):
            runs.append((start, stop, period))
    return sorted(runs, key=lambda r: (r[0], r[2])) if n else []


def _rotated(symbols, i: int, begin: int, period: int) -> int:
    """The first place from which words ``period`` apart are equal up to place ``i``."""
    step = 16
    while i > begin:
        low = max(begin, i - step)
        same = symbols[low:i] == symbols[low + period : i + period]
        if not same.all():
            return low + int(same.size - same[::-1].argmin())
        i, step = low, step * 2
    return i


def _suffixes(symbols, owner, end):
    """Suffix array, its inverse (-1 elsewhere) and the LCP of neighbours, with 0 at both ends, of the suffixes
    that share ``DEPTH`` words with another one of their text. Values under ``DEPTH`` are given as 0."""
    import numpy as np

    n = len(symbols)
    isa = np.full(n, -1, np.int64)
    if n == 0:
        return np.zeros(0, np.int64), isa, np.zeros(1, np.int64)

    def following(rank, at, width):
        """The rank ``width`` places on, from 1; 0 past the end of the text."""
        there = at + width
        return np.where(there < end[at], rank[np.minimum(there, n - 1)] + 1, 0)

    everywhere = np.arange(n)
    # levels[width][i]: the same number for two places of one text where the next ``width`` words are equal.
    levels, rank, width = [(1, symbols.astype(np.int32))], symbols, 1
    while width < DEPTH:
        key = rank * (n + 2) + following(rank, everywhere, width)
        if width == 1:  # texts are told apart from here on
            key = _dense(key) + owner * (n + 1)
        rank = _dense(key)
        width *= 2
        levels.append((width, rank.astype(np.int32)))
    sizes = np.bincount(rank)
    # A group's rank is its first place in the order, so that splitting one leaves the others as they are.
    first_place = np.cumsum(sizes) - sizes
    shared = np.flatnonzero(sizes[rank] > 1)
    group, rank = rank[shared], first_place[rank]
    levels[-1] = (width, rank.astype(np.int32))
    active = shared
    while len(active):
        key = rank[active] * (n + 2) + following(rank, active, width)
        order = np.argsort(key)
        active, key = active[order], key[order]
        old = rank[active]
        at = np.arange(len(active))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group_first = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        own_first = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active] = old + own_first - group_first
        single = new & np.concatenate([new[1:], [True]])
        active = active[~single]
        width *= 2
        levels.append((width, rank.astype(np.int32)))
    order = np.argsort(rank[shared])
    places, group = shared[order], group[order]
    isa[places] = np.arange(len(places))
    lcp = np.zeros(len(places) + 1, np.int64)
    near = 1 + np.flatnonzero(group[1:] == group[:-1])
    i, j = places[near - 1], places[near]
    for width, rank in reversed(levels):
        inside = (i + width <= end[places[near - 1]]) & (j + width <= end[places[near]])
        same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        i, j = i + width * same, j + width * same
    lcp[near] = i - places[near - 1]
    return places, isa, lcp


def _dense(key):
    """Numbers from 0 in the order of the values of ``key``, equal ones for equal values."""
    import numpy as np

    order = np.argsort(key)
    ranked = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return out


def _nearest(lcp, step: int, strict: bool):
    """For each place the nearest one before (``step`` -1) or after (1) with a smaller value, or an equal one unless ``strict``."""
    import numpy as np

    found = np.arange(len(lcp)) + step
    found[0] = found[-1] = 0 if step < 0 else len(lcp) - 1
    todo = np.flatnonzero(lcp > 0)
    while len(todo):
        at = found[todo]
        todo = todo[lcp[at] >= lcp[todo] if strict else lcp[at] > lcp[todo]]
        # All values between are larger, and those between that place and its own pointer are no smaller than its own.
        found[todo] = found[found[todo]]
    return found


def _squares(symbols, begin, end, places, isa, lcp):
    """(place, period) of each square that the next word ends, by end, then period."""
    import numpy as np

    inner = np.flatnonzero(lcp)
    if not len(inner):
        return []
    low, high = _nearest(lcp, -1, True), _nearest(lcp, 1, True)
    first = inner[lcp[_nearest(lcp, -1, False)[inner]] < lcp[inner]]
    # Children: one from each place of the interval's depth on, and one before the first such place.
    child_from = np.concatenate([inner, low[first]])
    child_to = np.concatenate([_nearest(lcp, 1, False)[inner], first])
    at = np.concatenate([inner, first])
    size = child_to - child_from
    interval = low[at] * (len(lcp) + 1) + high[at]
    order = np.lexsort((size, interval))
    smaller = order[np.concatenate([interval[order][1:] == interval[order][:-1], [False]])]
    found = []
    ends = np.cumsum(size[smaller])
    part = 0
    while part < len(smaller):
        before = ends[part - 1] if part else 0
        stop = max(part + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        own = smaller[part:stop]
        part = stop
        member = np.repeat(np.arange(len(own)), size[own])
        i = places[np.arange(len(member)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + child_from[own][member]]
        depth, left, right = lcp[at[own]][member], low[at[own]][member], high[at[own]][member]
        for square in (i, i - depth):
            other = square + depth if square is i else square
            inside = (other >= begin[i]) & (other < end[i])
            place = np.where(inside, isa[np.where(inside, other, 0)], -1)
            after = square + 2 * depth
            good = inside & (place >= left) & (place < right)
            good &= (after >= end[i]) | (symbols[np.minimum(square + depth, len(symbols) - 1)] != symbols[np.minimum(after, len(symbols) - 1)])
            found.append(np.stack([square[good], depth[good]], 1))
    found = np.unique(np.concatenate(found), axis=0)
    found = found[np.lexsort((found[:, 1], found[:, 0] + 2 * found[:, 1]))]
    return found.tolist()
