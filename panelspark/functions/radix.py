"""Exact quantiles of whole columns by radix selection: values stay where they are, only counts are exchanged.

A double is turned into a whole number of the same order, the number's digits
are counted from the highest down, and after each pass only the bins that hold
a wanted place are counted on by their next digit. A pass sends at most
2 ** ``DIGIT`` counts for each wanted bin and task, however many rows there
are; it stops as soon as every wanted bin holds one value. The input is read
once a pass, at most 64 / ``DIGIT`` times, so it should be stored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

#: Binary digits of a pass.
DIGIT = 16
MANTISSA = 52


def order_key(value: Column | str) -> Column:
    """A bigint of the same order as a double: equal numbers get equal keys, both zeros 0, NaN the largest.

    For numbers it is the pattern of bits that holds them, negated below zero;
    every step is exact. NULL stays NULL.
    """
    v = F.col(value) if isinstance(value, str) else value
    size, one = F.abs(v), F.lit(1 << MANTISSA)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int")
    # The logarithm may be off by one next to a power of two.
    exponent = (F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1)
                .otherwise(guess))
    exponent = F.greatest(exponent, F.lit(-1022))
    part = size / F.pow(F.lit(2.0), exponent)  # below 1 for the numbers next to zero, which have no leading digit
    whole = F.when(part >= 1, (exponent + 1023).cast("bigint") * one + ((part - 1) * one).cast("bigint")).otherwise(
        (part * one).cast("bigint"))
    key = F.when(v < 0, -whole).otherwise(whole)
    infinite = 2047 << MANTISSA
    return (F.when(v.isNull(), F.lit(None).cast("bigint")).when(F.isnan(v), F.lit(infinite + 1)).when(v == 0, F.lit(0).cast("bigint"))
            .when(v == float("inf"), F.lit(infinite)).when(v == float("-inf"), F.lit(-infinite)).otherwise(key))


def counted_bins(cells: DataFrame, open_bins: dict[tuple[int, int], None] | None, shift: int, above: int) -> DataFrame:
    """Rows by column, wanted bin of the pass before and next digit: _c, _parent, _bin, n, lo, hi.

    ``cells`` has _c, _key and _v; ``open_bins`` are the (column, bin) pairs at
    ``above`` binary digits from the right that are counted on; None: all.
    """
    bin_of = F.shiftright("_key", shift)
    if open_bins is None:
        rows = cells.select("_c", F.lit(0).cast("bigint").alias("_parent"), bin_of.alias("_bin"), "_v")
    else:
        parent = F.shiftright("_key", above)
        by_column: dict[int, list[int]] = {}
        for c, b in open_bins:
            by_column.setdefault(c, []).append(b)
        # Two bins for a quantile at most.
        wanted = reduce(lambda a, b: a | b, [(F.col("_c") == c) & parent.isin(bins) for c, bins in sorted(by_column.items())])
        rows = cells.where(wanted).select("_c", parent.alias("_parent"), bin_of.alias("_bin"), "_v")
    return rows.groupBy("_c", "_parent", "_bin").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def _found(bins: DataFrame, places: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], tuple[int, int, float, float]]:
    """For each (column, parent, place inside the parent): bin, rows of the parent before it, least and largest value."""
    ahead = Window.partitionBy("_c", "_parent").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))  # 2 ** DIGIT bins of a parent at most
    asked = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).cast("bigint").alias("p"), F.lit(i).cast("bigint").alias("i"))
                      for c, p, i in places])
    hits = F.filter(asked, lambda x: (x["c"] == F.col("_c")) & (x["p"] == F.col("_parent")) & (x["i"] >= F.col("before"))
                    & (x["i"] < F.col("before") + F.col("n")))
    rows = placed.withColumn("hit", F.explode(hits)).select("hit.*", "_bin", "before", "lo", "hi").collect()
    return {(r["c"], r["p"], r["i"]): (r["_bin"], r["before"], r["lo"], r["hi"]) for r in rows}


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias("_c", "_v")
    return df.select(parts).where(F.col("_v").isNotNull()).select("_c", "_v", order_key("_v").alias("_key"))


def select_quantiles(df: DataFrame, points: dict[str, dict[str, float]], store: bool = True) -> DataFrame:
    """Exact linear-interpolation quantiles of columns over all rows; one row.

    ``points`` has {output: share} for each column. NULLs are left out, NaN
    counts as the largest value; a column without values gives NULLs.
    ``store`` writes the columns first, for an input that is dear to compute;
    pass False for a table that is stored already.
    """
    columns = [c for c in points if points[c]]
    outputs = [(i, name, float(p)) for i, c in enumerate(columns) for name, p in points[c].items()]
    if not outputs:
        return df.sparkSession.range(1).select()
    if any(not 0.0 <= p <= 1.0 for _, _, p in outputs):
        raise ValueError("quantiles lie between 0 and 1")
    held = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    cells = _cells(stored(held) if store else held, columns)
    totals = {r["_c"]: r["n"] for r in cells.groupBy("_c").agg(F.count("*").alias("n")).collect()}  # one row a column
    place = {(i, name): p * (totals[i] - 1) for i, name, p in outputs if i in totals}
    # Wanted places: (column, place) to (parent, place inside it), then to the value.
    wanted = {(i, at): (0, at) for (i, _), x in place.items() for at in (math.floor(x), math.ceil(x))}
    values: dict[tuple[int, int], float] = {}
    open_bins, above = None, 64
    while wanted:
        shift = above - DIGIT
        found = _found(counted_bins(cells, open_bins, shift, above), sorted({(i, parent, at) for (i, _), (parent, at) in wanted.items()}))
        left = {}
        for (i, at), (parent, inside) in wanted.items():
            own, before, lo, hi = found[i, parent, inside]
            if lo == hi or lo != lo or shift == 0:
                values[i, at] = lo
            else:
                left[i, at] = (own, inside - before)
        wanted, above = left, shift
        open_bins = dict.fromkeys((i, parent) for (i, _), (parent, _) in left.items())

    def value_of(i: int, name: str) -> float | None:
        if (i, name) not in place:
            return None
        x = place[i, name]
        low, high = values[i, math.floor(x)], values[i, math.ceil(x)]
        return low if low == high else low + (high - low) * (x - math.floor(x))

    return df.sparkSession.range(1).select(*[F.lit(value_of(i, name)).cast("double").alias(name) for i, name, _ in outputs])
