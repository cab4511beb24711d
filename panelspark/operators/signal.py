"""Signal profiles: how returns vary with the rank of the score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S, stats as T
from ..functions.ranks import WINDOW, add_positions, add_value_ranks, choose_plan, column_quantiles, group_quantiles
from ..session import stored
from ..settings import CostSettings
from .features import finite_pairs
from .ic import CROSS_SECTION, quantile_cut
from .quality import complete_cross_sections

BPS = 10_000.0


def cost_tier(bucket: str | Column, costs: CostSettings = CostSettings()) -> Column:
    """Spread in bps by liquidity tercile, 1 = most liquid."""
    b = S.col(bucket)
    return F.when(b == 1, costs.spread_high).when(b == 2, costs.spread_mid).otherwise(costs.spread_low)


def _with_deciles(df: DataFrame, name: str, buckets: int, plan: str | None) -> DataFrame:
    return add_positions(finite_pairs(df), CROSS_SECTION, ["prediction", "code"], tiles={name: buckets}, plan=plan)


def signal_bucket_daily(df: DataFrame, buckets: int = 10, plan: str | None = None) -> DataFrame:
    """(date, signal_bucket): rows, mean score, mean return in bps, hit rate."""
    rows = _with_deciles(df, "signal_bucket", buckets, plan)
    return rows.groupBy("date", "signal_bucket").agg(
        F.count("*").alias("row_count"), F.avg("prediction").alias("mean_prediction"),
        (F.avg("target") * BPS).alias("mean_return_bps"), T.share(F.col("target") > 0).alias("hit_rate"))


def signal_buckets(df: DataFrame, buckets: int = 10, plan: str | None = None) -> DataFrame:
    """Per bucket: the daily figures averaged over days, with a t-statistic."""
    return signal_bucket_daily(df, buckets, plan).groupBy("signal_bucket").agg(
        F.avg("row_count").alias("row_count"), F.avg("mean_prediction").alias("mean_prediction"),
        F.avg("mean_return_bps").alias("mean_return_bps"), T.t_stat("mean_return_bps").alias("t_stat"),
        F.avg("hit_rate").alias("hit_rate"))


def signal_base(features: DataFrame, min_names: int, grid: int = 10, ret: str = "ret_vwap_exec_10", costs: CostSettings = CostSettings(), plan: str | None = None) -> DataFrame:
    """Grid-time rows of complete cross-sections with decile, tercile and spread."""
    rows = (features.where(F.col("prediction").isNotNull() & F.col(ret).isNotNull() & F.col("signal_amount").isNotNull()
                           & (F.col("minute_slot") % grid == 0))
            .select("date", "time", "minute_slot", "code", "prediction", F.col(ret).alias("simple_return"), "signal_amount"))
    plan = choose_plan(CROSS_SECTION, plan)
    rows = complete_cross_sections(rows, min_names, plan=plan)
    rows = add_positions(rows, CROSS_SECTION, ["prediction", "code"], tiles={"signal_decile": 10}, plan=plan)
    rows = add_positions(rows, CROSS_SECTION, [("signal_amount", False), "code"], tiles={"liq_bucket": 3}, plan=plan)
    return rows.withColumn("spread_bps", cost_tier("liq_bucket", costs))


def decile_daily(base: DataFrame) -> DataFrame:
    return base.groupBy("date", "signal_decile").agg(
        F.count("*").alias("row_count"), F.avg("prediction").alias("mean_prediction"),
        F.avg("simple_return").alias("mean_return"), F.avg("spread_bps").alias("mean_spread_bps"))


def decile_summary(daily: DataFrame) -> DataFrame:
    """Daily decile returns over all days; the t-statistic uses the number of dates."""
    daily = stored(daily)
    days = daily.select(F.count_distinct("date")).scalar()
    out = daily.groupBy("signal_decile").agg(
        F.avg("mean_return").alias("mean_daily_return"), F.stddev_samp("mean_return").alias("std_daily_return"),
        T.positive_ratio("mean_return").alias("hit_rate"), F.avg("mean_prediction").alias("mean_prediction"),
        F.avg("mean_spread_bps").alias("mean_spread_bps"), F.avg("row_count").alias("mean_row_count"))
    return out.withColumns({
        "daily_return_bps": F.col("mean_daily_return") * BPS,
        "t_stat": S.ratio(F.col("mean_daily_return") * F.sqrt(days.cast("double")), "std_daily_return")})


def decile_pivot(daily: DataFrame, bucket: str = "signal_decile", value: str = "mean_return", buckets: int = 10) -> DataFrame:
    """One row per date, one column per decile (d1..dn)."""
    return daily.groupBy("date").agg(*[
        F.max(F.when(F.col(bucket) == k, F.col(value))).alias(f"d{k}") for k in range(1, buckets + 1)])


def monotonicity(daily: DataFrame, bucket: str = "signal_decile", value: str = "mean_return", buckets: int = 10) -> DataFrame:
    """Per date: outer decile returns, their spread, the rank correlation of
    decile and return, and the compounded spread."""
    rows = daily.where(F.col(value).isNotNull()).select("date", F.col(bucket).cast("double").alias("_b"), F.col(value).alias("_v"))
    # A date has one row per bucket: windows of ten rows.
    ranked = add_value_ranks(rows, ["date"], "_b", {"avg": "_rb"}, WINDOW)
    ranked = add_value_ranks(ranked, ["date"], "_v", {"avg": "_rv"}, WINDOW)
    top, bottom = F.max(F.when(F.col("_b") == buckets, F.col("_v"))), F.max(F.when(F.col("_b") == 1, F.col("_v")))
    out = ranked.groupBy("date").agg(
        top.alias("top_decile_return"), bottom.alias("bottom_decile_return"), (top - bottom).alias("top_minus_bottom"),
        T.pearson("_rb", "_rv").alias("spearman_decile_return"))
    path = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(
        "cum_top_minus_bottom", F.product(1 + F.col("top_minus_bottom")).over(path) - 1)


def monotonicity_summary(mono: DataFrame) -> DataFrame:
    return mono.agg(
        F.count("*").alias("day_count"), F.avg("top_minus_bottom").alias("mean_top_minus_bottom"),
        T.positive_ratio("top_minus_bottom").alias("positive_spread_ratio"),
        F.avg("spearman_decile_return").alias("mean_spearman"),
        T.positive_ratio("spearman_decile_return").alias("positive_spearman_ratio"))


def liquidity_by_signal(base: DataFrame, costs: CostSettings = CostSettings()) -> DataFrame:
    """(liq_bucket, signal_decile): mean return and return after entry cost."""
    net = F.col("simple_return") - 0.5 * F.col("spread_bps") / BPS - costs.fee_bps / BPS
    return base.groupBy("liq_bucket", "signal_decile").agg(
        F.count("*").alias("row_count"), F.avg("simple_return").alias("mean_return"),
        F.avg("spread_bps").alias("mean_spread_bps"), F.avg(net).alias("mean_entry_net_proxy"),
    ).withColumns({
        "gross_return_bps": F.col("mean_return") * BPS, "entry_net_proxy_bps": F.col("mean_entry_net_proxy") * BPS})


def time_bucket_metrics(df: DataFrame) -> DataFrame:
    """Per time of day: rows, mean return in bps, distinct codes."""
    return finite_pairs(df).groupBy("time").agg(
        F.count("*").alias("row_count"), (F.avg("target") * BPS).alias("mean_return_bps"),
        F.count_distinct("code").alias("code_count"))


def best_worst_time(buckets: DataFrame, value: str = "mean_return_bps") -> DataFrame:
    v = F.col(value)
    return buckets.agg(
        F.max_by("time", F.struct(v, -F.col("time"))).alias("best_time"), F.max(v).alias("best_value"),
        F.min_by("time", F.struct(v, F.col("time"))).alias("worst_time"), F.min(v).alias("worst_value"))


def extreme_target_profile(df: DataFrame, hi: float = 0.995, lo: float = 0.005, plan: str | None = None) -> DataFrame:
    """Rows beyond the outer target quantiles and the deciles they sat in.

    The input is read once: the rows with their deciles are stored.
    """
    base = stored(_with_deciles(df, "signal_bucket", 10, plan).select("signal_bucket", F.col("target").cast("double")))
    edges = column_quantiles(base, {"target": {"lo": lo, "hi": hi}}, store=False).select(F.array("lo", "hi")).scalar()
    total = base.select(F.count("*")).scalar()
    target = F.col("target")
    kinds = F.array_compact(F.array(
        F.when(target >= F.element_at(edges, 2), F.lit("extreme_positive_target")),
        F.when(target <= F.element_at(edges, 1), F.lit("extreme_negative_target"))))
    found = base.select("signal_bucket", "target", F.explode(kinds).alias("extreme_type"))
    return found.groupBy("extreme_type").agg(
        F.count("*").alias("row_count"),
        T.share(F.col("signal_bucket") == 10).alias("top_decile_share"),
        T.share(F.col("signal_bucket") == 1).alias("bottom_decile_share"),
        (F.avg("target") * BPS).alias("mean_return_bps"),
    ).withColumn("row_ratio", S.ratio(F.col("row_count"), total))


def prediction_scale(df: DataFrame, ddof: int = 1) -> DataFrame:
    """One row: location, spread and tails of score and target, and the ratio
    of their deviations. The input is read once and stored for the two passes."""
    rows = stored(finite_pairs(df).select(F.col("prediction").cast("double"), F.col("target").cast("double")))
    moments = rows.agg(*[
        e for c in ("prediction", "target") for e in (
            F.avg(c).alias(f"{c}_mean"), T.spread(c, ddof).alias(f"{c}_std"), F.avg(F.abs(c)).alias(f"{c}_abs_mean"))
    ]).withColumn("_k", F.lit(0))
    tails = column_quantiles(rows, {
        c: {f"{c}_p01": 0.01, f"{c}_p50": 0.50, f"{c}_p99": 0.99} for c in ("prediction", "target")}, store=False).withColumn("_k", F.lit(0))
    return moments.join(tails, "_k").drop("_k").withColumn("std_ratio", S.ratio("prediction_std", "target_std"))


def mse(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error and row count per candidate; candidates with the same errors have the same mean."""
    rows = finite_pairs(df)
    e = F.col("prediction").cast("double") - F.col("target").cast("double")
    return rows.groupBy(*by).agg(T.exact_avg(e * e).alias("mse"), F.count("*").alias("count"))


def best_candidate(scores: DataFrame, metric: str = "mse") -> DataFrame:
    """Rank candidates (one row each) by a metric; the minimum is promoted."""
    ranked = add_value_ranks(scores, [], metric, {"rank": "metric_rank"})
    return ranked.withColumn("decision", F.when(F.col("metric_rank") == 1, "promote").otherwise("reject"))


def bootstrap_ci(series: DataFrame, value: str, order: str = "date", samples: int = 2000, seed: int = 7) -> DataFrame:
    """Mean, deviation and 95 % bootstrap interval of the mean of a series.

    Draws come from a hash of (seed, sample, draw), so a re-run or a lost
    task draws the same rows. The numbered series is the small side.
    """
    rows = add_positions(series.where(F.col(value).isNotNull()).select(order, value), [], [order], rn="_rn", n="_n")
    draws = rows.select("_rn", "_n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_b"))
    picked = draws.select("_b", (F.conv(F.substring(S.seeded_hash(seed, "_b", "_rn"), 1, 15), 16, 10).cast("bigint") % F.col("_n") + 1).alias("_pick"))
    means = (picked.join(rows.select(F.col("_rn").alias("_pick"), value), "_pick")
             .groupBy("_b").agg(F.avg(value).alias("_mean")))
    interval = means.agg(
        F.percentile("_mean", F.lit(0.025)).alias("ci_025"), F.percentile("_mean", F.lit(0.5)).alias("ci_500"),
        F.percentile("_mean", F.lit(0.975)).alias("ci_975"), F.count("*").alias("bootstrap_samples"),
    ).withColumn("_k", F.lit(0))
    plain = rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                     F.count("*").alias("sample_count")).withColumn("_k", F.lit(0))
    return plain.join(interval, "_k").drop("_k")


# --- stability ---------------------------------------------------------------

def monthly_stability(daily: DataFrame, value: str = "top_minus_bottom") -> DataFrame:
    v = F.col(value)
    return daily.groupBy(S.month_of("date").alias("month")).agg(
        (F.avg(v) * BPS).alias("mean_bps"), T.positive_ratio(value).alias("positive_ratio"), F.count(v).alias("day_count"))


def join_monthly(signal: DataFrame, trading: DataFrame) -> DataFrame:
    """Monthly signal and trading tables side by side, months of either."""
    return signal.join(trading, "month", "full_outer")


def regime_stability(daily: DataFrame, value: str = "top_minus_bottom") -> DataFrame:
    """Daily returns by tercile of their size."""
    names = F.array(F.lit("low_abs_gross"), F.lit("mid_abs_gross"), F.lit("high_abs_gross"))
    cut = quantile_cut(daily.withColumn("_abs", F.abs(value)), "_abs", "_cut", 3)
    return cut.groupBy(F.element_at(names, F.col("_cut") + 1).alias("regime")).agg(
        F.count("*").alias("day_count"), (F.avg(value) * BPS).alias("mean_bps"))


def curve_stability(curve: DataFrame) -> DataFrame:
    """A rolling-group curve by quintile of its centre rank."""
    cut = quantile_cut(curve, "group_center_rank", "_cut", 5)
    return cut.groupBy((F.col("_cut") + 1).alias("bucket")).agg(
        F.sum("count").cast("bigint").alias("row_count"), F.avg("mean_ic").alias("mean_ic"),
        F.avg("mean_rank_ic").alias("mean_rank_ic"), F.min("group_center_rank").alias("center_rank_min"),
        F.max("group_center_rank").alias("center_rank_max"))


# --- strategy-level tables ------------------------------------------------------

def alpha_per_turnover(daily: DataFrame, by: str = "strategy_name") -> DataFrame:
    """Per strategy: gross, net and cost per unit of turnover in bps, best first."""
    cost = F.col("spread_cost") + F.col("fee_cost")
    t = F.sum("turnover")
    return daily.groupBy(by).agg(
        F.avg("gross_return").alias("mean_gross_return"), F.avg("net_return").alias("mean_net_return"),
        F.avg("turnover").alias("mean_turnover"), F.avg(cost).alias("mean_total_cost"),
        (S.ratio(F.sum("gross_return"), t) * BPS).alias("gross_bps_per_turnover"),
        (S.ratio(F.sum("net_return"), t) * BPS).alias("net_bps_per_turnover"),
        (S.ratio(F.sum(cost), t) * BPS).alias("cost_bps_per_turnover"),
        T.positive_ratio("gross_return").alias("positive_gross_day_rate"),
        T.positive_ratio("net_return").alias("positive_net_day_rate"),
    ).orderBy(F.col("gross_bps_per_turnover").desc(), by)


def compare_to_parent(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(metric, baseline, experiment, absolute and relative change) of two metric tables."""
    a = parent.select("metric", F.col("value").alias("baseline"))
    b = child.select("metric", F.col("value").alias("experiment"))
    diff = F.col("experiment") - F.col("baseline")
    return a.join(b, "metric", "full_outer").withColumns({
        "absolute_change": diff, "relative_change": S.ratio(diff, F.abs("baseline"))})


def to_metrics(row: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns or row.columns])
    return row.select(F.inline(cells))


def signal_proxy_strategy(buckets: DataFrame, name: str = "top_minus_bottom", top: int = 10) -> DataFrame:
    """Top minus bottom bucket as a strategy row with one unit of turnover a day."""
    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("signal_bucket") == k, F.col(c)))

    gross = at(top, "mean_return_bps") - at(1, "mean_return_bps")
    return buckets.agg(gross.alias("gross_daily_return_bps"), at(top, "row_count").alias("active_names")).select(
        F.lit(name).alias("strategy_name"), "gross_daily_return_bps",
        F.col("gross_daily_return_bps").alias("net_daily_return_bps"), F.lit(1.0).alias("daily_turnover"),
        F.col("gross_daily_return_bps").alias("gross_bps_per_turnover"),
        F.col("gross_daily_return_bps").alias("net_bps_per_turnover"), "active_names")


def headline_summary(buckets: DataFrame, liquidity: DataFrame, times: DataFrame, top: int = 10) -> DataFrame:
    """One row of the figures a reader looks at first.

    Includes what a short side would have to earn: the bottom decile's return
    and the spread over the mean of all deciles.
    """
    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("signal_bucket") == k, F.col(c)))

    head = buckets.agg(
        at(top, "mean_return_bps").alias("top_decile_return_bps"),
        at(1, "mean_return_bps").alias("bottom_decile_return_bps"),
        F.avg("mean_return_bps").alias("universe_return_bps"),
    ).withColumns({
        "top_minus_bottom_bps": F.col("top_decile_return_bps") - F.col("bottom_decile_return_bps"),
        "short_avoidance_bps": F.col("universe_return_bps") - F.col("bottom_decile_return_bps"),
        "_k": F.lit(0)})
    liquid = liquidity.agg(F.max(F.when((F.col("liq_bucket") == 1) & (F.col("signal_decile") == top),
                                        F.col("entry_net_proxy_bps"))).alias("high_liq_top_net_bps")).withColumn("_k", F.lit(0))
    clock = best_worst_time(times).withColumn("_k", F.lit(0))
    return head.join(liquid, "_k").join(clock, "_k").drop("_k")


def turnover_decomposition(daily: DataFrame) -> DataFrame:
    """(component, total, daily mean) of turnover and each cost."""
    parts = ("turnover", "spread_cost", "fee_cost")
    rows = F.array(*[
        F.struct(F.lit(p).alias("component"), F.col(f"s_{p}").alias("total"), F.col(f"m_{p}").alias("daily_mean")) for p in parts])
    return daily.agg(*[e for p in parts for e in (F.sum(p).alias(f"s_{p}"), F.avg(p).alias(f"m_{p}"))]).select(F.inline(rows))


def step_summary(metrics: DataFrame, tail: int = 100) -> DataFrame:
    """Per tag of a (tag, step, value) log: last step, tail mean/deviation, extremes."""
    numbered = add_positions(metrics, ["tag"], [("step", False)], rn="_rn")
    recent = F.when(F.col("_rn") <= tail, F.col("value"))
    return numbered.groupBy("tag").agg(
        F.max("step").alias("last_step"), F.max_by("value", "step").alias("last_value"),
        F.avg(recent).alias("tail_mean"), F.stddev_pop(recent).alias("tail_std"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def smoothed_log(metrics: DataFrame, window: int = 1000) -> DataFrame:
    """Sliding mean of each tag's values; NULL until the window is full.

    Rows are cut into blocks of ``window``; a block is averaged together with
    the block before it, so no task holds more than two windows of a tag.
    """
    rows = add_positions(metrics, ["tag"], ["step"], rn="_rn")
    block = F.floor((F.col("_rn") - 1) / window)
    # Each row once in its own block, once as the lead-in of the next.
    rows = rows.withColumn("_own", block).withColumn("_block", F.explode(F.array(block, block + 1)))
    frame = Window.partitionBy("tag", "_block").orderBy("_rn").rowsBetween(-(window - 1), 0)
    smooth = F.when(F.count("value").over(frame) == window, F.avg("value").over(frame))
    return rows.withColumn("smooth", smooth).where(F.col("_own") == F.col("_block")).drop("_rn", "_own", "_block")
