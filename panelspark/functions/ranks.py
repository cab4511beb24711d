"""Ranks, positions, totals and quantiles within groups, safe for huge groups.

Every function has two physical plans with the same result and schema:

* ``window`` - a window per group, for groups that are bounded by their
  meaning: a cross-section or a session holds at most the names of a market or
  the minutes of a day, however much data there is.
* ``ranged`` - the ordered values are range-partitioned, so one group spreads
  over many tasks; each piece is ranked on its own and shifted by the totals
  of the pieces before it. For everything else: all rows, years, tags, groups.

The keys decide, not the size of the input: keys with a date get the window.
``plan`` overrides that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .radix import select_quantiles

WINDOW, RANGED = "window", "ranged"
#: Key columns that bound a group by its meaning.
BOUNDED_KEYS = frozenset({"date", "Date"})


def choose_plan(keys: Sequence[str], plan: str | None = None) -> str:
    """The plan for groups of ``keys``: window where a date bounds them, else ranged."""
    if plan is not None:
        return plan
    return WINDOW if BOUNDED_KEYS.intersection(keys) else RANGED


def _match(left: str, right: str, names: Sequence[str]) -> Column:
    parts = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _order(order: Sequence[str | tuple[str, bool]]) -> list[Column]:
    out = []
    for item in order:
        name, ascending = item if isinstance(item, tuple) else (item, True)
        out.append(F.col(name).asc_nulls_first() if ascending else F.col(name).desc_nulls_last())
    return out


def _whole(window):
    """The whole group as a frame of an ordered window."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, bool]], weight: Column
) -> DataFrame:
    """Add ``_before`` and ``_total``: the weight ahead of each row in its
    group's order, and the weight of the whole group. Ranged plan; ``order``
    must put every row of a group in its own place."""
    ordering = [F.col(k).asc() for k in keys] + _order(order)
    pieces = cut_lineage(
        df.withColumn("_w", weight).repartitionByRange(*ordering).withColumn("_pid", F.spark_partition_id())
    )
    inside = Window.partitionBy("_pid", *keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = pieces.withColumn("_local", F.sum("_w").over(inside) - F.col("_w"))
    # One row per (group, piece): at most groups + partitions rows.
    totals = pieces.groupBy("_pid", *keys).agg(F.sum("_w").alias("_piece"))
    if keys:
        ahead = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
    else:
        totals = totals.withColumn("_one", F.lit(1))
        ahead = Window.partitionBy("_one").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("_one")
    offsets = totals.select(
        "_pid", *keys,
        F.coalesce(F.sum("_piece").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_piece").over(whole).alias("_total"),
    )
    joined = local.alias("l").join(offsets.alias("o"), _match("l", "o", ["_pid", *keys]), "inner")
    return joined.select(
        "l.*", (F.col("l._local") + F.col("o._offset")).alias("_before"), F.col("o._total").alias("_total")
    ).drop("_pid", "_w", "_local")


def _rank_outputs(first: Column, ties: Column, n: Column, names: dict[str, str]) -> dict[str, Column]:
    """Rank flavours from the first place of a tie group, its size and n."""
    avg = first + (ties - 1) / 2
    made = {
        "rank": first.cast("bigint"),
        "avg": avg.cast("double"),
        "pct": (avg / n).cast("double"),
        "cume": ((first + ties - 1) / n).cast("double"),
        "percent": F.when(n > 1, (first - 1) / (n - 1)).otherwise(0.0).cast("double"),
        "n": n.cast("bigint"),
    }
    return {names[k]: made[k] for k in names}


def add_value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, names: dict[str, str], plan: str | None = None
) -> DataFrame:
    """Add rank columns of ``value`` within ``keys``; equal values tie.

    ``names`` maps a flavour to its output column: rank (first place of the
    tie group), avg (average place), pct (avg / n), cume (last place / n),
    percent ((rank - 1) / (n - 1)), n (number of ranked rows). Rows without a
    value are kept, unranked.
    """
    keys = list(keys)
    if choose_plan(keys, plan) == WINDOW:
        # Frames of one ordered window: ranks, ties and size in a single pass.
        ordered = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        ties = F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        outputs = _rank_outputs(F.rank().over(ordered), ties, F.count(value).over(_whole(ordered)), names)
        return df.withColumns({name: F.when(F.col(value).isNotNull(), c) for name, c in outputs.items()})

    # Rank distinct values, so that a value held by most rows is one row here.
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    placed = _with_running_total(distinct, keys, [value], F.col("_ties"))
    ranked = placed.select(
        *keys, value,
        *[c.alias(name) for name, c in _rank_outputs(F.col("_before") + 1, F.col("_ties"), F.col("_total"), names).items()],
    )
    joined = df.alias("d").join(ranked.alias("r"), _match("d", "r", [*keys, value]), "left")
    return joined.select("d.*", *[F.col(f"r.{name}") for name in names.values()])


def add_ranks_of(
    df: DataFrame, keys: Sequence[str], names: dict[str, dict[str, str]], plan: str | None = None
) -> DataFrame:
    """:func:`add_value_ranks` for several double columns at once.

    Ranged plan: the columns are laid out as (column, value) cells, so all of
    them are ranked in one ranged pass and joined back once; the other columns
    travel with the first cell of their row.
    """
    keys, values = list(keys), list(names)
    if choose_plan(keys, plan) == WINDOW:
        for value in values:
            df = add_value_ranks(df, keys, value, names[value], WINDOW)
        return df
    rest = [c for c in df.columns if c not in keys and c not in values]
    base = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    cell = F.array(*[F.col(v).cast("double") for v in values])
    carried = F.when(F.col("_c") == 0, F.struct(F.lit(0).alias("_"), *rest)).alias("_rest")
    cells = base.select("*", F.posexplode(cell).alias("_c", "_v")).select("_row", *keys, "_c", "_v", carried)
    flavours = sorted({f for wanted in names.values() for f in wanted})
    distinct = cells.where(F.col("_v").isNotNull()).groupBy(*keys, "_c", "_v").agg(F.count("*").alias("_ties"))
    placed = _with_running_total(distinct, [*keys, "_c"], ["_v"], F.col("_ties"))
    outputs = _rank_outputs(F.col("_before") + 1, F.col("_ties"), F.col("_total"), {f: f"_{f}" for f in flavours})
    ranked = placed.select(*keys, "_c", "_v", F.struct(*[c.alias(n) for n, c in outputs.items()]).alias("_ranks"))
    joined = cells.alias("d").join(ranked.alias("r"), _match("d", "r", [*keys, "_c", "_v"]), "left").select("d.*", "r._ranks")
    at = lambda i, c: F.max(F.when(F.col("_c") == i, c))
    made = [at(i, F.col(f"_ranks._{f}")).alias(out) for i, v in enumerate(values) for f, out in names[v].items()]
    found = joined.groupBy("_row", *keys).agg(
        *[at(i, F.col("_v")).alias(v) for i, v in enumerate(values)], F.first("_rest", ignorenulls=True).alias("_rest"), *made)
    outs = [out for wanted in names.values() for out in wanted.values()]
    return found.select(*[F.col(c) if c in keys or c in values else F.col(f"_rest.{c}").alias(c) for c in df.columns], *outs)


def add_member_ranks(df: DataFrame, values: dict[str, str], members: Sequence[str]) -> DataFrame:
    """Add the average ranks of ``values`` (column: output) inside each of several overlapping groups, as arrays.

    ``members`` are boolean columns, one a group; a rank is NULL where the row is not in the group. Ranged plan: the
    distinct values of all columns are placed in one pass with a running count for each group, and a row is never
    copied. ``df`` is read once for each value and once for itself, so it should be stored.
    """
    ties = [f"_t{i}" for i in range(len(members))]
    counts = [F.sum(F.col(m).cast("bigint")).alias(t) for m, t in zip(members, ties)]
    distinct = reduce(DataFrame.unionByName, [
        df.where(F.col(v).isNotNull()).groupBy(F.lit(i).alias("_c"), F.col(v).cast("double").alias("_v")).agg(*counts)
        for i, v in enumerate(values)])
    pieces = cut_lineage(distinct.repartitionByRange("_c", "_v").withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    # One row per column and piece.
    ahead = Window.partitionBy("_c").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("_pid", "_c").agg(*[F.sum(t).alias(t) for t in ties])
    offsets = totals.select("_pid", "_c", *[F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(f"_o{t}") for t in ties])
    local = pieces.select("_pid", "_c", "_v", *ties, *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_l{t}") for t in ties])
    first = [F.when(F.col(t) > 0, F.col(f"_l{t}") + F.col(f"_o{t}") + (F.col(t) + 1) / 2).cast("double") for t in ties]
    ranked = local.join(offsets, ["_pid", "_c"]).select("_c", "_v", F.array(*first).alias("_ranks"))
    for i, (value, name) in enumerate(values.items()):
        own = F.array(*[F.when(F.col(m), F.get("_ranks", F.lit(k))) for k, m in enumerate(members)])
        found = ranked.where(F.col("_c") == i).drop("_c")
        df = df.join(found, df[value].cast("double") == found["_v"], "left").select(*[df[c] for c in df.columns], own.alias(name))
    return df


def _tile(rn: Column, n: Column, k: int) -> Column:
    """ntile(k) from a row number: the first n mod k tiles hold one row more."""
    base = F.floor(n / k)
    extra = n % k
    head = extra * (base + 1)
    return (F.when(rn <= head, F.floor((rn - 1) / (base + 1)) + 1)
            .otherwise(F.floor((rn - 1 - head) / F.greatest(base, F.lit(1))) + extra + 1)).cast("int")


def add_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | tuple[str, bool]],
    rn: str | None = None,
    n: str | None = None,
    tiles: dict[str, int] | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Add row number, group size and ntile columns within ``keys``.

    ``order`` lists columns, or (column, ascending) pairs; it must be unique
    within a group so that the result does not depend on the partitioning.
    """
    keys, tiles = list(keys), tiles or {}
    if choose_plan(keys, plan) == WINDOW:
        ordered = Window.partitionBy(*keys).orderBy(*_order(order))
        out = {name: F.ntile(k).over(ordered) for name, k in tiles.items()}
        if rn:
            out[rn] = F.row_number().over(ordered).cast("bigint")
        if n:
            out[n] = F.count("*").over(_whole(ordered)).cast("bigint")
        return df.withColumns(out)
    placed = _with_running_total(df, keys, order, F.lit(1).cast("bigint"))
    row, total = F.col("_before") + 1, F.col("_total")
    out = {name: _tile(row, total, k) for name, k in tiles.items()}
    if rn:
        out[rn] = row.cast("bigint")
    if n:
        out[n] = total
    return placed.withColumns(out).drop("_before", "_total")


def add_group_stats(
    df: DataFrame, keys: Sequence[str], stats: dict[str, Column], plan: str | None = None
) -> DataFrame:
    """Add aggregates of the whole group to each of its rows.

    The ranged plan aggregates first (map-side partials) and joins back; AQE
    broadcasts the small side or splits a skewed one.
    """
    keys = list(keys)
    if choose_plan(keys, plan) == WINDOW:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: c.over(group) for name, c in stats.items()})
    totals = df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    if not keys:
        return df.withColumns({name: totals.select(name).scalar() for name in stats})
    joined = df.alias("d").join(totals.alias("t"), _match("d", "t", keys), "inner")
    return joined.select("d.*", *[F.col(f"t.{name}") for name in stats])


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], plan: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per group, one row each.

    The window-sized plan uses the built-in exact percentile, whose state is
    one group's distinct values; the ranged plan looks the two neighbouring
    values up by position instead and keeps no such state. Over all rows the
    ranged plan is a radix selection, which moves no values.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    if choose_plan(keys, plan) == WINDOW:
        return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in points.items()])
    if not keys:
        return select_quantiles(rows, {value: points})
    distinct = rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_ties"))
    placed = _with_running_total(distinct, keys, ["_v"], F.col("_ties"))
    picks, made = _interpolated(points, F.lit(True))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *made)


def column_quantiles(df: DataFrame, points: dict[str, dict[str, float]], store: bool = True) -> DataFrame:
    """Exact quantiles of several columns over all rows by radix selection; one row.

    Values are not moved, only counts of their digits. ``df`` is read a few
    times; pass ``store=False`` if it is stored already.
    """
    return select_quantiles(df, points, store)


def _interpolated(points: dict[str, float], own: Column) -> tuple[list[Column], list[Column]]:
    """Aggregates that pick the neighbours of each quantile among placed distinct values, and the quantiles."""
    last = F.col("_before") + F.col("_ties")

    def at(index: Column) -> Column:
        return F.max(F.when(own & (F.col("_before") <= index) & (index < last), F.col("_v")))

    picks, made = [], []
    for name, p in points.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(F.when(own, place - F.floor(place))).alias(f"_f_{name}"),
        ]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        made.append((low + (high - low) * F.col(f"_f_{name}")).alias(name))
    return picks, made
