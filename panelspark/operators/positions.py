"""From execution features to target positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S
from ..functions.ranks import WINDOW, add_group_stats, add_positions, add_value_ranks, choose_plan
from ..schema import POSITIONS
from ..session import by_groups, stored
from ..settings import CostSettings
from . import market as M
from .ic import CROSS_SECTION
from .signal import cost_tier

LONG, SHORT = 1, -1


def keep_count(frac: Column, n: Column) -> Column:
    """ceil(frac * n) in decimal arithmetic, so 0.1 * 30 is 3 and not 4."""
    return F.ceil(frac.cast("decimal(9,8)") * n.cast("decimal(20,0)")).cast("bigint")


def eligible_signals(features: DataFrame, positive_sigma: bool = False) -> DataFrame:
    ok = F.col("current_tradable") & F.col("prediction_available") & S.falsy(F.col("adv_amount") > 0) & F.col(
        "sigma_intraday").isNotNull()
    if positive_sigma:
        ok = ok & (F.col("sigma_intraday") > 0)
    return features.where(ok)


def directional_fillable(side: int, price: str) -> Column:
    """Whether an order of this side can fill at entry and be closed at exit.

    A short must not enter at the lower limit nor leave at the upper one; a
    long the other way round; neither on a day locked at a limit.
    """
    entry, leave = ("down", "up") if side == SHORT else ("up", "down")
    return (F.col(f"fillable_{price}") & ~F.col("is_limit_up_all_day") & ~F.col("is_limit_down_all_day")
            & ~F.col(f"entry_{price}_is_{entry}_limit") & ~F.col(f"exit_{price}_is_{leave}_limit"))


def liquidity_tercile(df: DataFrame, plan: str | None = None) -> DataFrame:
    """liq_bucket 1..3 by signal amount, 1 = most liquid."""
    return add_positions(df, CROSS_SECTION, [("signal_amount", False), "code"], tiles={"liq_bucket": 3}, plan=plan)


def number_bars(df: DataFrame, by: Sequence[str], name: str = "slot_bar_id", order: Sequence[str] = ("date", "time")) -> DataFrame:
    """Dense 1-based bar number within ``by``.

    Only the distinct bars are ordered, a few per date; they are stored, so
    that their size is known and the rows need not move to be joined to them.
    """
    bars = number_table(df, by, name, order)
    return df.join(bars, [c for c in bars.columns if c != name])


def number_table(df: DataFrame, by: Sequence[str], name: str = "slot_bar_id", order: Sequence[str] = ("date", "time")) -> DataFrame:
    """The distinct bars of ``df`` with their numbers within ``by``, stored."""
    keys = [*by, *[c for c in order if c not in by]]
    w = Window.partitionBy(*by).orderBy(*[c for c in order if c not in by])
    return stored(df.select(*keys).distinct().withColumn(name, F.row_number().over(w)))


def signal_columns(rows: DataFrame, price: str) -> DataFrame:
    """What positions and bands need of the execution features at ``price``; the plans move these rows several times."""
    return rows.select(
        "date", "time", "code", "minute_slot", "prediction", "prediction_available", "current_tradable", "signal_amount",
        "sigma_intraday", "adv_amount", F.col(f"ret_{price}_exec_10").cast("double").alias("simple_return"),
        directional_fillable(LONG, price).alias("long_fillable"), directional_fillable(SHORT, price).alias("short_fillable"))


def _numbered_terciles(rows: DataFrame, plan: str | None, copies: int = 1) -> DataFrame:
    """Liquidity terciles and slot_bar_id of eligible rows.

    Every cross-section has a row in its first tercile and every selection
    keeps at least one row, so the bars are the same for all plans and are
    numbered once, before rows are laid out per plan, ``copies`` times each.
    All windows of a cross-section then run in tasks of bounded rows, counted
    first: the features should be stored.
    """
    numbered = number_bars(rows, ["minute_slot"])
    if plan == WINDOW:
        numbered = by_groups(numbered, CROSS_SECTION, rows.count(), copies)
    return liquidity_tercile(numbered, plan)


def top_bottom_select(
    df: DataFrame, frac: Column, long_on: Column, short_on: Column, by: Sequence[str] = (), plan: str | None = None,
) -> DataFrame:
    """The lowest and highest ceil(frac * n) scores of each cross-section.

    Adds keep_count, side and target_weight: 0.5 per side when both are on,
    1.0 when only one is. The low end wins where the two overlap.
    """
    rows = add_positions(df, [*by, *CROSS_SECTION], ["prediction", "code"], rn="_rank", n="_names", plan=plan)
    rows = rows.withColumn("keep_count", keep_count(frac, F.col("_names")))
    low = short_on & (F.col("_rank") <= F.col("keep_count"))
    high = long_on & (F.col("_rank") > F.col("_names") - F.col("keep_count"))
    short_gross = F.when(long_on, 0.5).otherwise(1.0)
    long_gross = F.when(short_on, 0.5).otherwise(1.0)
    return rows.where(low | high).withColumns({
        "side": F.when(low, SHORT).otherwise(LONG),
        "target_weight": F.when(low, -short_gross / F.col("keep_count")).otherwise(long_gross / F.col("keep_count")),
        "_at_low_end": F.col("_rank") <= F.col("keep_count"),
    }).drop("_rank", "_names")


PLAN_COLUMNS = ("top_frac", "long_enabled", "short_enabled", "max_liq_bucket")


def _positions(rows: DataFrame, by: Sequence[str], costs: CostSettings, plan: str | None) -> DataFrame:
    """Selection, weights and fill rules; ``rows`` carry liq_bucket, the bar
    number and the plan columns."""
    kept = rows.where(F.col("liq_bucket") <= F.col("max_liq_bucket"))
    kept = top_bottom_select(kept, F.col("top_frac"), F.col("long_enabled"), F.col("short_enabled"), by, plan)
    kept = kept.withColumns({
        "spread_bps": cost_tier("liq_bucket", costs),
        "fillable": F.when(F.col("_at_low_end"), F.col("short_fillable")).otherwise(F.col("long_fillable")),
    })
    return kept.select(*by, *POSITIONS.fieldNames())


def build_positions(
    features: DataFrame, top_frac: float = 0.1, long_enabled: bool = True, short_enabled: bool = True,
    max_liq_bucket: int = 3, price: str = "vwap", costs: CostSettings = CostSettings(), plan: str | None = None,
) -> DataFrame:
    """Target positions of one trade plan.

    Order matters: liquidity terciles over all eligible names, then the
    liquidity filter, then ranks among what is left.
    """
    if not (long_enabled or short_enabled):
        raise ValueError("at least one side must be enabled")
    rows = signal_columns(eligible_signals(features), price)
    plan = choose_plan(CROSS_SECTION, plan)
    rows = _numbered_terciles(rows, plan).withColumns({
        "top_frac": F.lit(top_frac), "long_enabled": F.lit(long_enabled), "short_enabled": F.lit(short_enabled),
        "max_liq_bucket": F.lit(max_liq_bucket)})
    return _positions(rows, [], costs, plan)


def lay_out_variants(rows: DataFrame, variants: Sequence[dict], name: str = "variant") -> DataFrame:
    """Each row once per variant, with the variant's parameters as columns.

    The matrix is a literal of a few dozen entries in the plan itself.
    """
    fields = [f for f in variants[0] if f != name]
    cells = F.array(*[
        F.struct(F.lit(v[name]).alias(name), *[F.lit(v[f]).alias(f) for f in fields]) for v in variants])
    return rows.select("*", F.inline(cells))


def build_position_variants(
    features: DataFrame, variants: Sequence[dict], price: str = "vwap", costs: CostSettings = CostSettings(),
    plan: str | None = None,
) -> DataFrame:
    """Target positions of many trade plans in one job, keyed by ``variant``."""
    rows = signal_columns(eligible_signals(features), price)
    plan = choose_plan(CROSS_SECTION, plan)
    return _positions(lay_out_variants(_numbered_terciles(rows, plan, len(variants)), variants), ["variant"], costs, plan)


def signal_trips(rows: DataFrame, slots: Sequence[int], price: str = "vwap") -> DataFrame:
    """Eligible rows with ``trips``: slot, return and fill rules of each of their ``exits``, for slots of these lengths."""
    for i, length in enumerate(slots):
        rows = rows.withColumns({f"exit_{p}": F.col("exits")[i][p] for p in ("open", "vwap")} | {
            "minute_slot": S.minute_slot("base_minute", length)})
        rows = M.limit_touch_flags(M.fillable_flags(M.execution_returns(rows)))
        rows = rows.withColumn(f"_trip{i}", F.struct(
            "minute_slot", F.col(f"ret_{price}_exec_10").cast("double").alias("simple_return"),
            directional_fillable(LONG, price).alias("long_fillable"), directional_fillable(SHORT, price).alias("short_fillable")))
    return rows.select(
        "date", "time", "code", "prediction", "prediction_available", "current_tradable", "signal_amount", "sigma_intraday",
        "adv_amount", F.array(*[f"_trip{i}" for i in range(len(slots))]).alias("trips"))


def build_trip_variants(signals: DataFrame, variants: Sequence[dict], costs: CostSettings = CostSettings()) -> DataFrame:
    """Target positions of many trade plans with several holding times and slot lengths.

    ``signals`` come stored from :func:`signal_trips`; ``variants`` name the
    trip they take beside their plan columns. Names are ranked before a trip
    is chosen; its bar numbers are joined to the selected rows.
    """
    slot = F.posexplode("trips.minute_slot").alias("trip", "minute_slot")
    bars = number_table(signals.select("date", "time", slot), ["trip", "minute_slot"])
    rows = liquidity_tercile(by_groups(signals, CROSS_SECTION, signals.count(), len(variants)))
    rows = lay_out_variants(rows, variants).where(F.col("liq_bucket") <= F.col("max_liq_bucket"))
    kept = top_bottom_select(rows, F.col("top_frac"), F.col("long_enabled"), F.col("short_enabled"), ["variant"])
    kept = kept.withColumn("_trip", F.get("trips", F.col("trip"))).withColumns({
        "spread_bps": cost_tier("liq_bucket", costs), "minute_slot": F.col("_trip.minute_slot"),
        "simple_return": F.col("_trip.simple_return"),
        "fillable": F.when(F.col("_at_low_end"), F.col("_trip.short_fillable")).otherwise(F.col("_trip.long_fillable"))})
    return kept.join(bars, ["trip", "minute_slot", "date", "time"]).select("variant", *POSITIONS.fieldNames())


# --- bands --------------------------------------------------------------------

def buffer_bands(
    features: DataFrame, variants: Sequence[dict], price: str = "vwap", costs: CostSettings = CostSettings(),
    plan: str | None = None,
) -> DataFrame:
    """Entry and hold bands of the score rank, both ends, per variant.

    ``variants`` give entry_frac, hold_frac and max_liq_bucket. Only rows in a
    hold band are kept; no other row can be held.
    """
    rows = signal_columns(eligible_signals(features), price)
    plan = choose_plan(CROSS_SECTION, plan)
    rows = lay_out_variants(_numbered_terciles(rows, plan, len(variants)), variants).where(F.col("liq_bucket") <= F.col("max_liq_bucket"))
    rows = add_positions(rows, ["variant", *CROSS_SECTION], ["prediction", "code"], rn="_rank", n="_n", plan=plan)
    enter, hold = keep_count(F.col("entry_frac"), F.col("_n")), keep_count(F.col("hold_frac"), F.col("_n"))
    from_top = F.col("_n") - F.col("_rank") + 1
    return _band_rows(rows, F.col("_rank"), from_top, enter, hold, cost_tier("liq_bucket", costs))


def cost_bands(
    features: DataFrame, variants: Sequence[dict], max_liq_bucket: int = 1, entry_frac: float = 0.1,
    hold_frac: float = 0.2, price: str = "vwap", costs: CostSettings = CostSettings(), plan: str | None = None,
) -> DataFrame:
    """Bands of a score that is penalised by expected trading cost.

    ``variants`` give entry_cost_penalty and sizing_method. The cost rank is
    percent_rank of sigma / sqrt(ADV) within the liquid names.
    """
    rows = signal_columns(eligible_signals(features, positive_sigma=True), price)
    plan = choose_plan(CROSS_SECTION, plan)
    rows = _numbered_terciles(rows, plan, len(variants)).where(F.col("liq_bucket") <= max_liq_bucket)
    rows = rows.withColumn("_cost", F.col("sigma_intraday") / F.sqrt("adv_amount"))
    rows = add_value_ranks(rows, CROSS_SECTION, "_cost", {"percent": "cost_pct", "n": "_n"}, plan)
    rows = lay_out_variants(rows, variants)
    penalty = F.col("entry_cost_penalty") * F.col("cost_pct")
    rows = rows.withColumns({"_long": F.col("prediction") - penalty, "_short": F.col("prediction") + penalty})
    keys = ["variant", *CROSS_SECTION]
    rows = add_positions(rows, keys, [("_long", False), "code"], rn="_rank_long", plan=plan)
    rows = add_positions(rows, keys, ["_short", "code"], rn="_rank_short", plan=plan)
    enter, hold = keep_count(F.lit(entry_frac), F.col("_n")), keep_count(F.lit(hold_frac), F.col("_n"))
    return _band_rows(rows, F.col("_rank_short"), F.col("_rank_long"), enter, hold, F.lit(costs.spread_high))


def _band_rows(rows: DataFrame, from_low: Column, from_top: Column, enter: Column, hold: Column, spread: Column) -> DataFrame:
    out = rows.withColumns({
        "spread_bps": spread,
        "long_entry": from_top <= enter, "long_hold": from_top <= hold,
        "short_entry": from_low <= enter, "short_hold": from_low <= hold,
    }).where(F.col("long_hold") | F.col("short_hold"))
    sizing = ["sizing_method"] if "sizing_method" in rows.columns else []
    return out.select(
        "variant", *sizing, "date", "time", "code", "minute_slot", "slot_bar_id", "prediction", "simple_return",
        "sigma_intraday", "adv_amount", "spread_bps", "long_fillable", "short_fillable",
        "long_entry", "long_hold", "short_entry", "short_hold")


BAND_BLOCK = 256


def _with_run(df: DataFrame, unit: Sequence[str], bar: str) -> DataFrame:
    """Tag gap-free runs of bars per unit (gaps and islands)."""
    w = Window.partitionBy(*unit).orderBy(bar)
    return df.withColumn("_run", F.col(bar) - F.row_number().over(w))


def band_state(df: DataFrame, unit: Sequence[str], bar: str, enter: Column, hold: Column) -> DataFrame:
    """Rows at which a unit is held: from an entry on, for as long as it stays
    in the hold band. A bar without a row counts as an exit.

    ``bar`` numbers the bars without gaps; a unit is one name in one book, so
    its window holds one row per bar.
    """
    inside = _with_run(df.withColumn("_enter", enter).where(hold), unit, bar)
    path = Window.partitionBy(*unit, "_run").orderBy(bar).rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("_on", F.max(F.col("_enter").cast("int")).over(path)).where("_on = 1").drop("_enter", "_run", "_on")


def pair_band_state(df: DataFrame, unit: Sequence[str], bar: str) -> DataFrame:
    """Held rows of a two-sided band, with ``side`` +1 or -1.

    At each bar a unit keeps its side while that side's hold band contains it,
    else takes a long entry, else a short one, else is flat. Where the bands
    overlap the next side depends on the last, so a gap-free run is folded in
    order, in blocks of ``BAND_BLOCK`` bars: each block is folded once for
    every side it may start from, the resulting maps are composed along the
    run, and each block is replayed from the side it does start from. No array
    is longer than a block or than the number of blocks, and all steps share
    the shuffle on the unit.
    """
    columns = df.columns
    place = Window.partitionBy(*unit, "_run").orderBy(bar)
    runs = _with_run(df, unit, bar).withColumn("_block", F.floor((F.row_number().over(place) - 1) / BAND_BLOCK))
    blocks = runs.groupBy(*unit, "_run", "_block").agg(F.array_sort(F.collect_list(
        F.struct(F.col(bar).alias("_bar"), *[F.col(c) for c in columns]))).alias("_rows"))

    def following(side: Column, row: Column) -> Column:
        return (F.when((side == LONG) & row["long_hold"], LONG).when((side == SHORT) & row["short_hold"], SHORT)
                .when(row["long_entry"], LONG).when(row["short_entry"], SHORT).otherwise(0))

    ends = ("flat", "long", "short")
    start = F.struct(*[F.lit(side).alias(name) for name, side in zip(ends, (0, LONG, SHORT))])
    mapped = blocks.withColumn("_ends", F.aggregate(
        "_rows", start, lambda acc, row: F.struct(*[following(acc[name], row).alias(name) for name in ends])))
    before = Window.partitionBy(*unit, "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.aggregate(F.collect_list("_ends").over(before), F.lit(0), lambda side, ends_of: (
        F.when(side == LONG, ends_of["long"]).when(side == SHORT, ends_of["short"]).otherwise(ends_of["flat"])))
    begun = mapped.withColumn("_first", first)

    def step(acc: Column, row: Column) -> Column:
        side = following(acc["side"], row)
        return F.struct(side.alias("side"), F.concat(acc["path"], F.array(side)).alias("path"))

    replay = F.struct(F.col("_first").alias("side"), F.array().cast("array<int>").alias("path"))
    sides = F.aggregate("_rows", replay, step)["path"]
    pairs = begun.select(F.explode(F.arrays_zip(F.col("_rows").alias("row"), sides.alias("side"))).alias("_p"))
    out = pairs.select(*[F.col(f"_p.row.{c}").alias(c) for c in columns], F.col("_p.side").alias("side"))
    return out.where(F.col("side") != 0)


def side_weights(held: DataFrame, by: Sequence[str], gross: float = 0.5, plan: str | None = None) -> DataFrame:
    """target_weight of held rows: each side sums to ``gross``.

    Equal weights, or sqrt(ADV) / sigma where sizing_method is "cost_aware".
    """
    if "sizing_method" in held.columns:
        score = F.when(F.col("sizing_method") == "equal", 1.0).otherwise(F.sqrt("adv_amount") / F.col("sigma_intraday"))
    else:
        score = F.lit(1.0)
    rows = add_group_stats(held.withColumn("_score", score), [*by, "side"], {"_sum": F.sum("_score")}, plan)
    return rows.withColumn("target_weight", F.col("side") * gross * F.col("_score") / F.col("_sum")).drop("_score", "_sum")


def rebalance_step(
    prev: DataFrame, target: DataFrame, by: Sequence[str], band: float = 0.0, budget: float = 0.0,
    plan: str | None = None,
) -> DataFrame:
    """One rebalance from ``prev`` to ``target`` weights under two gates.

    Changes smaller than ``band`` on names in both books are skipped; if the
    planned turnover still exceeds ``budget``, all trades shrink alike.
    """
    keys = [*by, "code"]
    both = (prev.select(*keys, F.col("weight").alias("prev_weight"))
            .join(target.select(*keys, F.col("weight").alias("target_weight")), keys, "full_outer"))
    p, t = F.coalesce("prev_weight", F.lit(0.0)), F.coalesce("target_weight", F.lit(0.0))
    small = F.col("prev_weight").isNotNull() & F.col("target_weight").isNotNull() & (F.abs(t - p) < band)
    gated = both.withColumns({"_prev": p, "_goal": F.when(small, p).otherwise(t)})
    out = add_group_stats(gated, by, {"planned_turnover": F.sum(0.5 * F.abs(F.col("_goal") - F.col("_prev")))}, plan)
    over = (F.lit(budget) > 0) & (F.col("planned_turnover") > budget)
    scale = F.when(over, F.lit(budget) / F.col("planned_turnover")).otherwise(1.0)
    weight = F.when(over, F.col("_prev") + scale * (F.col("_goal") - F.col("_prev"))).otherwise(F.col("_goal"))
    return out.select(*keys, F.col("_prev").alias("prev_weight"), weight.alias("weight"), "planned_turnover")
