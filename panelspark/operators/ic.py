"""Information coefficients: how scores line up with realised targets.

A cross-section is one (date, time). Ranks inside it follow ``plan``, see
``functions.ranks``; pooled ranks are always range-partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S, stats as T
from ..functions.ranks import (
    RANGED, WINDOW, add_group_stats, add_member_ranks, add_positions, add_ranks_of, add_value_ranks, choose_plan, group_quantiles,
)
from ..schema import unique_rows
from ..session import by_groups, stored
from .features import finite_pairs, forward_vol, linear_score, with_short_keys

CROSS_SECTION = ("date", "time")


def _calendar_window():
    """One row per date: a few thousand rows at most, fit for one task."""
    return Window.partitionBy(F.lit(0)).orderBy("date")


def _ranked_pairs(df: DataFrame, keys: Sequence[str], x: str, y: str, plan: str | None) -> DataFrame:
    pairs = finite_pairs(df, x, y).withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")})
    return add_ranks_of(pairs, keys, {x: {"avg": "_rx"}, y: {"avg": "_ry"}}, plan)


def _ic_columns(x: str, y: str) -> list[Column]:
    return [T.pearson(x, y).alias("ic"), T.pearson("_rx", "_ry").alias("rank_ic"), F.count("*").alias("count")]


def ic_by_timestamp(df: DataFrame, x: str = "prediction", y: str = "target", keys: Sequence[str] = CROSS_SECTION, plan: str | None = None) -> DataFrame:
    """Pearson and Spearman correlation of each cross-section."""
    return _ranked_pairs(df, keys, x, y, plan).groupBy(*keys).agg(*_ic_columns(x, y))


def pooled_ic(df: DataFrame, x: str = "prediction", y: str = "target", plan: str | None = None) -> DataFrame:
    """Pearson and exact Spearman correlation over all rows, one row."""
    return _ranked_pairs(df, [], x, y, plan).agg(*_ic_columns(x, y))


def annual_ic(df: DataFrame, x: str = "prediction", y: str = "target", plan: str | None = None) -> DataFrame:
    """Pooled correlations per calendar year (four digits)."""
    return ic_by_timestamp(df.withColumn("year", S.year_of("date")), x, y, ["year"], plan)


def ic_summary(series: DataFrame, value: str = "ic", by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, t-statistic, positive share and mean/deviation of a series."""
    return series.groupBy(*by).agg(*T.series_summary(value))


def daily_ic(by_timestamp: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Mean of a day's defined cross-section correlations."""
    return by_timestamp.groupBy(*by).agg(
        F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count("ic").alias("timestamps"))


def icir_windows(daily: DataFrame, value: str = "ic", days: int = 60) -> DataFrame:
    """Non-overlapping blocks of ``days`` dates: mean, deviation and ratio."""
    rows = daily.where(F.col(value).isNotNull())
    block = F.floor((F.row_number().over(_calendar_window()) - 1) / days)
    return (rows.withColumn("block", block.cast("int")).groupBy("block").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("day_count"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        .withColumn("icir", S.ratio("mean", "std")))


def icir_mean(windows: DataFrame) -> DataFrame:
    return windows.agg(F.avg("icir").alias("mean_icir"), F.count("icir").alias("windows"))


def intraday_ic(by_timestamp: DataFrame) -> DataFrame:
    """Mean and deviation of cross-section correlations per time of day."""
    return by_timestamp.groupBy("time").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"),
        F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("std_rank_ic"),
        F.count("ic").alias("count"))


def intraday_ic_compare(train: DataFrame, test: DataFrame) -> DataFrame:
    """Intraday Pearson curves of two sets, on the times both have."""
    pick = [F.col("mean_ic"), F.col("std_ic"), F.col("count")]
    a = intraday_ic(train).select("time", *[c.alias(f"train_{n}") for c, n in zip(pick, ("mean_ic", "std_ic", "count"))])
    b = intraday_ic(test).select("time", *[c.alias(f"test_{n}") for c, n in zip(pick, ("mean_ic", "std_ic", "count"))])
    return a.join(b, "time")


# --- group labels and regimes ----------------------------------------------

def liquidity_regime(bars: DataFrame, days: int = 5) -> DataFrame:
    """(date, prior_amount, regime 0..2): market amount of the previous
    ``days`` sessions, cut at its terciles (right-closed)."""
    market = bars.groupBy("Date").agg(F.sum("Amount").alias("amount")).select(S.short_date("Date").alias("date"), "amount")
    before = _calendar_window().rowsBetween(-days, -1)
    scored = (market.withColumn("prior_amount", F.when(F.count("amount").over(before) == days, F.sum("amount").over(before)))
              .where(F.col("prior_amount").isNotNull()))
    return tercile_cut(scored, "prior_amount", "regime").drop("amount")


def quantile_cut(df: DataFrame, column: str, name: str, parts: int) -> DataFrame:
    """Bucket 0..parts-1 by interpolated quantiles, right-closed.

    For aggregated tables (days, curve points): stored, then read twice.
    """
    df = stored(df)
    points = {f"_q{i}": i / parts for i in range(1, parts)}
    edges = group_quantiles(df, [], column, points, WINDOW).select(F.array(*points)).scalar()
    bucket = F.lit(parts - 1)
    for i in range(parts - 1, 0, -1):
        bucket = F.when(F.col(column) <= F.element_at(edges, i), i - 1).otherwise(bucket)
    return df.withColumn(name, bucket.cast("int"))


def tercile_cut(df: DataFrame, column: str, name: str) -> DataFrame:
    return quantile_cut(df, column, name, 3)


def group_labels(bars: DataFrame, horizon: int) -> DataFrame:
    """Price, liquidity and forward-volatility label of every bar, by (date, time, code)."""
    labelled = forward_vol(bars, horizon)
    return with_short_keys(labelled).select(
        "date", "time", "code", F.col("Close").cast("double").alias("price_label"),
        F.col("Amount").cast("double").alias("liquidity_label"), "volatility_label")


def attach_group_labels(pred: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Group labels onto scores; a bar that repeats fails the job."""
    keys = ["date", "time", "code"]
    return pred.join(unique_rows(group_labels(bars, horizon), keys), keys, "left")


GROUP_SPLITS = (
    # label, split point, name of the low part, name of the high part
    ("prediction", 0.9, "prediction_low_p90", "prediction_high_p10"),
    ("liquidity_label", 0.5, "liquidity_low", "liquidity_high"),
    ("volatility_label", 0.5, "volatility_low", "volatility_high"),
)
REGIME_NAMES = ("regime_low", "regime_mid", "regime_high")


def grouped_ic(df: DataFrame, regime: DataFrame, plan: str | None = None) -> DataFrame:
    """Pooled correlations inside overlapping groups of rows.

    ``df`` carries prediction, target and the group labels; ``regime`` one row
    per date. Groups are flags of a row, never copies of it: ranks inside all
    groups come from one ranged pass over the distinct values with a running
    count for each group.
    """
    rows = finite_pairs(df)
    rows = rows.withColumns({c: S.clean(c) for c, *_ in GROUP_SPLITS})
    inner = choose_plan(CROSS_SECTION, plan)
    members = {}
    for label, point, low, high in GROUP_SPLITS:
        rows = add_value_ranks(rows, CROSS_SECTION, label, {"cume": f"_c_{label}"}, inner)
        place = F.col(f"_c_{label}")
        members |= {low: place <= point, high: place > point}
    rows = rows.join(regime.select("date", "regime"), "date", "left")
    members |= {name: F.col("regime") == i for i, name in enumerate(REGIME_NAMES)}
    names = list(members)
    flags = [F.coalesce(c, F.lit(False)).alias(f"_in{i}") for i, c in enumerate(members.values())]
    slim = stored(rows.select(F.col("prediction").cast("double"), F.col("target").cast("double"), *flags))
    inside = [f"_in{i}" for i in range(len(names))]
    ranked = add_member_ranks(slim, {"prediction": "_rx", "target": "_ry"}, inside)
    # Laid out by group only inside a task: what leaves it is one partial sum a group.
    cells = [F.when(F.col(f), F.struct(F.lit(name).alias("group"), "prediction", "target", F.get("_rx", F.lit(i)).alias("_rx"),
                                       F.get("_ry", F.lit(i)).alias("_ry"))) for i, (f, name) in enumerate(zip(inside, names))]
    return ranked.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("group").agg(*_ic_columns("prediction", "target"))


# --- rolling groups ---------------------------------------------------------

#: Rows of a piece of the two-level scan.
SCAN_PIECE = 4096


def _corr(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Correlation from raw sums of columns that vary."""
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((vx > 0) & (vy > 0), S.ratio(n * xy - x * y, F.sqrt(vx) * F.sqrt(vy)))


def _rolling_windows(
    df: DataFrame, keys: Sequence[str], label: str, window: int, step: int, order: Sequence[str],
    plan: str | None,
) -> DataFrame:
    """One row per window of ``window`` rows stepping ``step`` along ``label``.

    A window is the difference of two prefix sums, so its cost depends on
    neither its length nor the step. The scan has two levels: running sums
    inside pieces of ``SCAN_PIECE`` consecutive rows, and the totals of the pieces
    before, one row a piece. Only rows that begin, halve or end a window go on,
    each once for each part. Values are centred first; that a column is constant
    in a window is told by counting its changes, exactly, not by a small variance.
    """
    middle = window // 2
    rows = finite_pairs(df).withColumns({c: S.clean(c) for c in ("prediction", "target", label)})
    rows = rows.where(F.col(label).isNotNull())
    plan = choose_plan(keys, plan)
    if plan == WINDOW:
        # The windows of a cross-section sort its rows several times; tasks hold a bounded number of narrow rows.
        rows = stored(rows.select(*dict.fromkeys([*keys, "prediction", "target", label, *order])))
        rows = by_groups(rows, keys, rows.count())
    rows = add_ranks_of(rows, keys, {"prediction": {"avg": "_r"}, "target": {"avg": "_s"}}, plan)
    rows = add_positions(rows, keys, [label, *order], rn="_rn", n="_n", plan=plan)
    rows = add_group_stats(rows, keys, {"_mx": F.avg("prediction"), "_my": F.avg("target")}, plan)
    # Correlations do not change when values and ranks are centred; their rounding errors do.
    x, y = F.col("prediction") - F.col("_mx"), F.col("target") - F.col("_my")
    r, s = F.col("_r") - (F.col("_n") + 1) / 2, F.col("_s") - (F.col("_n") + 1) / 2
    place = F.col("_rn") - 1
    piece = F.floor(place / SCAN_PIECE) if plan == RANGED else F.lit(0).cast("bigint")
    products = {"x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "r": r, "s": s, "rr": r * r, "ss": s * s, "rs": r * s}
    rows = rows.where(F.col("_n") >= window).select(
        *keys, "_n", place.alias("_place"), piece.alias("_piece"), F.col(label).alias("_label"), "prediction", "target",
        *[c.alias(name) for name, c in products.items()])
    inside = Window.partitionBy(*keys, "_piece").orderBy("_place")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)

    def changed(value: str, window_spec=inside) -> Column:
        """1 where a value differs from the one before it; 0 for the first."""
        return F.coalesce((F.lag(value).over(window_spec) != F.col(value)).cast("bigint"), F.lit(0).cast("bigint"))

    rows = rows.withColumns({"dx": changed("prediction"), "dy": changed("target")})
    sums = [*products, "dx", "dy"]
    if plan == RANGED:
        rows = stored(rows)
        across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_piece")
        totals = rows.groupBy(*keys, "_piece").agg(
            *[F.sum(c).alias(c) for c in sums], *[F.min_by(v, "_place").alias(f"_first_{v}") for v in ("prediction", "target")],
            *[F.max_by(v, "_place").alias(f"_last_{v}") for v in ("prediction", "target")])
        # The change from one piece to the next counts with the first row of the later one.
        entering = {c: F.coalesce((F.lag(f"_last_{v}").over(across) != F.col(f"_first_{v}")).cast("bigint"), F.lit(0).cast("bigint"))
                    for c, v in (("dx", "prediction"), ("dy", "target"))}
        totals = totals.withColumns({f"_e_{c}": e for c, e in entering.items()})
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, "_piece", *[
            (F.coalesce(F.sum(F.col(c) + (F.col(f"_e_{c}") if c in entering else F.lit(0))).over(earlier), F.lit(0))
             + (F.col(f"_e_{c}") if c in entering else F.lit(0))).alias(f"_o_{c}") for c in sums])
        scanned = rows.withColumns({f"_p_{c}": F.sum(c).over(running) for c in sums}).join(offsets, [*keys, "_piece"])
        upto = {c: F.col(f"_p_{c}") + F.col(f"_o_{c}") for c in sums}
    else:
        scanned = rows.withColumns({f"_p_{c}": F.sum(c).over(running) for c in sums})
        upto = {c: F.col(f"_p_{c}") for c in sums}

    c = F.col

    def part(at: int, exclusive: bool) -> Column:
        """What row ``at`` of a window adds to it: prefix sums without it, or with it, and its label."""
        start = c("_place") - at
        fits = (start >= 0) & (start % step == 0) & (start + window <= c("_n"))
        # Changes are counted from the second row of a window on.
        values = [(upto[m] - c(m) if exclusive and m not in ("dx", "dy") else upto[m]).alias(m) for m in sums]
        return F.when(fits, F.struct(start.alias("_start"), F.lit(at).alias("_at"), c("_label"), *values))

    parts = F.array_compact(F.array(part(0, True), part(middle, False), part(window - 1, False)))
    sent = scanned.select(*keys, "_n", F.explode(parts).alias("_part")).select(*keys, "_n", "_part.*")
    at = lambda place, value: F.max(F.when(c("_at") == place, c(value)))
    out = sent.groupBy(*keys, "_n", "_start").agg(
        *[(at(window - 1, m) - at(0, m)).alias(m) for m in sums], at(0, "_label").alias("label_left"),
        at(middle, "_label").alias("label_center"), at(window - 1, "_label").alias("label_right"))
    varies = (c("dx") > 0) & (c("dy") > 0)
    n = F.lit(float(window))
    return out.select(
        *keys, c("_start").alias("window_start"), (c("_start") + window - 1).alias("window_end"),
        ((c("_start") + window * 0.5) / c("_n")).alias("group_center_rank"),
        "label_left", "label_center", "label_right",
        F.when(varies, _corr(n, c("x"), c("y"), c("xx"), c("yy"), c("xy"))).alias("ic"),
        F.when(varies, _corr(n, c("r"), c("s"), c("rr"), c("ss"), c("rs"))).alias("rank_ic"))


def rolling_group_ic(df: DataFrame, label: str, window: int = 2000, step: int = 50, unique: str = "code", plan: str | None = None) -> DataFrame:
    """Correlation along the ``label`` axis of each cross-section, averaged
    over all cross-sections per centre rank (rounded to 0.001)."""
    rows = _rolling_windows(df, CROSS_SECTION, label, window, step, [unique], plan)

    def std(c: str) -> Column:
        return F.when(F.count(c) > 1, F.stddev_pop(c))

    return rows.groupBy(S.rank_bin("group_center_rank").alias("rank_bin")).agg(
        F.avg("group_center_rank").alias("group_center_rank"),
        F.avg("ic").alias("mean_ic"), std("ic").alias("std_ic"),
        F.avg("rank_ic").alias("mean_rank_ic"), std("rank_ic").alias("std_rank_ic"),
        F.count("*").alias("count"))


def rolling_group_ic_rows(df: DataFrame, label: str, window: int = 2000, step: int = 50, unique: Sequence[str] = ("date", "time", "code"), plan: str = RANGED) -> DataFrame:
    """The same along one axis over all rows, with the label at the window's edges and centre."""
    rows = _rolling_windows(df, [], label, window, step, list(unique), plan)
    return rows.withColumnsRenamed({"ic": "mean_ic", "rank_ic": "mean_rank_ic"}).withColumn("count", F.lit(window).cast("bigint"))


def curve_summary(curve: DataFrame, x: str = "group_center_rank", y: str = "mean_ic", count: str = "count") -> DataFrame:
    """Range, extremes and first sign change of a binned curve: one point per
    centre rank rounded to 0.001, so about 1000 points at most."""
    before = Window.partitionBy(F.lit(0)).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(y, ignorenulls=True).over(before)
    crossed = ((prev <= 0) & (F.col(y) > 0)) | ((prev >= 0) & (F.col(y) < 0))
    marked = curve.withColumn("_cross", F.when(crossed, F.col(x)))
    defined = F.col(y).isNotNull()
    return marked.agg(
        F.min(x).alias("center_rank_min"), F.max(x).alias("center_rank_max"),
        F.sum(count).cast("bigint").alias("count_sum"),
        F.max(y).alias("max_value"), F.max_by(x, F.when(defined, F.struct(F.col(y), -F.col(x)))).alias("max_rank"),
        F.min(y).alias("min_value"), F.min_by(x, F.when(defined, F.struct(F.col(y), F.col(x)))).alias("min_rank"),
        F.min("_cross").alias("first_sign_flip"))


# --- turnover, residuals, deciles -------------------------------------------

def rank_turnover(df: DataFrame, x: str = "prediction", plan: str | None = None) -> DataFrame:
    """Rank correlation of each cross-section with the one before it on the
    same day, over the codes both have.

    The previous score comes from a lag over (date, code), a group of one
    session at most, instead of a self-join.
    """
    rows = stored(df.withColumn(x, S.clean(x)).where(F.col(x).isNotNull()).select("date", "time", "code", x))
    ordinal = Window.partitionBy("date").orderBy("time")
    times = rows.select("date", "time").distinct().withColumns({
        "_t": F.row_number().over(ordinal), "prev_time": F.lag("time").over(ordinal)})
    rows = rows.join(times, ["date", "time"])
    by_code = Window.partitionBy("date", "code").orderBy("_t")
    pairs = (rows.withColumns({"_px": F.lag(x).over(by_code), "_pt": F.lag("_t").over(by_code)})
             .where(F.col("_pt") == F.col("_t") - 1))
    ranked = _ranked_pairs(pairs, [*CROSS_SECTION, "prev_time"], "_px", x, plan)
    return (ranked.groupBy("date", "prev_time", "time")
            .agg(T.pearson("_rx", "_ry").alias("rank_corr"), F.count("*").alias("count"))
            .where(F.col("count") >= 2)
            .withColumn("rank_turnover", 1 - F.col("rank_corr")))


def turnover_by_time(turnover: DataFrame) -> DataFrame:
    return turnover.groupBy("time").agg(
        F.avg("rank_corr").alias("mean_rank_corr"), F.avg("rank_turnover").alias("mean_rank_turnover"),
        F.stddev_samp("rank_turnover").alias("std_rank_turnover"), F.count("rank_turnover").alias("count"))


def turnover_summary(turnover: DataFrame) -> DataFrame:
    """One row: overall means and the times of lowest and highest turnover."""
    turnover = stored(turnover)  # a row per timestamp, read twice
    overall = turnover.agg(
        F.count("*").alias("row_count"), F.avg("rank_corr").alias("mean_rank_corr"),
        F.avg("rank_turnover").alias("mean_rank_turnover"),
        T.share(F.col("rank_corr") > 0).alias("positive_rank_corr_ratio")).withColumn("_k", F.lit(0))
    v = "mean_rank_turnover"
    curve = turnover_by_time(turnover).where(F.col(v).isNotNull()).agg(
        F.min_by("time", F.struct(v, "time")).alias("lowest_turnover_time"), F.min(v).alias("lowest_turnover_value"),
        F.max_by("time", F.struct(F.col(v), -F.col("time"))).alias("highest_turnover_time"),
        F.max(v).alias("highest_turnover_value")).withColumn("_k", F.lit(0))
    return overall.join(curve, "_k").drop("_k")


def residual_diagnostics(df: DataFrame, sample: bool = False, x: str = "prediction", y: str = "target") -> DataFrame:
    """Moments and error measures of target - prediction, one row.

    ``sample`` switches to ddof 1 and bias-corrected skew and kurtosis.
    """
    rows = finite_pairs(df, x, y).withColumn("_e", F.col(y).cast("double") - F.col(x).cast("double"))
    e = F.col("_e")
    return rows.agg(
        F.count("*").alias("count"), F.avg(e).alias("mean"), T.spread(e, 1 if sample else 0).alias("std"),
        T.skew(e, bias=not sample).alias("skew"), T.excess_kurtosis(e, bias=not sample).alias("kurtosis"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        T.pearson(x, "_e").alias("corr_prediction_residual"))


def decile_curve(df: DataFrame, x: str = "prediction", y: str = "target", plan: str | None = None) -> DataFrame:
    """Mean target and win rate per decile 0..9 of the average-tie rank."""
    rows = add_value_ranks(finite_pairs(df, x, y), CROSS_SECTION, x, {"pct": "_pct"}, plan)
    decile = F.least(F.floor(F.col("_pct") * 10), F.lit(9)).cast("int")
    found = rows.groupBy(decile.alias("decile")).agg(
        F.avg(y).alias("mean_target"), T.share(F.col(y) > 0).alias("win_rate"), F.count("*").alias("count"))
    every = df.sparkSession.range(10).select(F.col("id").cast("int").alias("decile"))
    return every.join(found, "decile", "left").withColumn("count", F.coalesce("count", F.lit(0)))


# --- baselines ----------------------------------------------------------------

def baseline_ic(
    df: DataFrame, specs: dict[str, dict[str, float]], scopes: dict[str, Column] | None = None,
    target: str = "label_ret", ddof: int = 0, source: str | None = None,
) -> DataFrame:
    """Pooled and daily Pearson IC of every baseline score in every scope.

    All (scope, spec) pairs run as one job: a row is laid out once per pair it
    takes part in, and the pair joins every grouping key. ``source`` names a
    column that keeps several data sources apart.
    """
    extra = [source] if source else []
    scopes = scopes or {"all": F.lit(True)}
    cells = [
        F.when(cond, F.struct(F.lit(scope).alias("scope"), F.lit(name).alias("baseline"), linear_score(w).alias("score")))
        for scope, cond in scopes.items() for name, w in specs.items()
    ]
    rows = df.select(*extra, "date", "time", F.col(target).cast("double").alias("_y"), F.inline(F.array_compact(F.array(*cells))))
    rows = finite_pairs(rows, "score", "_y")
    by = ["scope", "baseline", *extra]
    # One pass over the rows; a pooled figure is the merge of its cross-sections' co-moments.
    n, x, y = F.count("*").cast("double"), F.col("score"), F.col("_y")
    stamps = stored(rows.groupBy(*by, "date", "time").agg(
        T.pearson("score", "_y").alias("ic"), n.alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        (F.var_pop(x) * n).alias("_xx"), (F.var_pop(y) * n).alias("_yy"), (F.covar_pop(x, y) * n).alias("_xy")))
    c = F.col
    centre = stamps.groupBy(*by).agg(
        F.sum("_n").alias("_all"), (F.sum(c("_n") * c("_mx")) / F.sum("_n")).alias("_cx"),
        (F.sum(c("_n") * c("_my")) / F.sum("_n")).alias("_cy"))
    dx, dy = c("_mx") - c("_cx"), c("_my") - c("_cy")
    merged = stamps.join(centre, by).groupBy(*by).agg(
        F.first("_all").cast("bigint").alias("rows"), F.sum(c("_xx") + c("_n") * dx * dx).alias("_xx"),
        F.sum(c("_yy") + c("_n") * dy * dy).alias("_yy"), F.sum(c("_xy") + c("_n") * dx * dy).alias("_xy"))
    pooled = merged.select(*by, "rows", F.when(
        (c("rows") > 1) & (c("_xx") > 0) & (c("_yy") > 0), c("_xy") / F.sqrt(c("_xx") * c("_yy"))).alias("pooled_ic"))
    # Correlations of a day that cancel leave a mean of rounding errors; its sign must not count.
    mean = F.avg("ic")
    days = stamps.groupBy(*by, "date").agg(F.when(F.abs(mean) < 1e-12, 0.0).otherwise(mean).alias("ic")).where(F.col("ic").isNotNull())
    daily = days.groupBy(*by).agg(
        F.avg("ic").alias("daily_ic_mean"), T.spread("ic", ddof).alias("daily_ic_std"),
        F.count("ic").alias("daily_count"), T.positive_ratio("ic").alias("daily_positive_ratio"))
    return pooled.join(daily, by, "left")


def topk_return(df: DataFrame, k: int = 50, x: str = "prediction", y: str = "target", plan: str | None = None) -> DataFrame:
    """Mean target of the k highest scores per date, with the day's correlations."""
    plan = choose_plan(["date"], plan)
    rows = add_positions(_ranked_pairs(df, ["date"], x, y, plan), ["date"], [(x, False), "time", "code"], rn="_rn", plan=plan)
    return rows.groupBy("date").agg(*_ic_columns(x, y), F.avg(F.when(F.col("_rn") <= k, F.col(y))).alias("topk_return"))
