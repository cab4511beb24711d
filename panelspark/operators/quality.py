"""Data-quality counts and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S, stats as T
from ..functions.ranks import add_group_stats
from ..settings import FeatureSettings
from .features import at_minute, bar_features, drop_horizon_tail, keep_finite

INF = float("inf")


def _per_field(df: DataFrame, columns: Sequence[str], build) -> DataFrame:
    """Aggregate all fields in one pass, then lay them out as one row each.

    ``build(value, raw)`` returns named aggregates of a field. No unpivot of
    the rows: the table is read once and the reduction is columnar.
    """
    aggs, rows = [], []
    for i, c in enumerate(columns):
        named = build(S.clean(c), F.col(c).cast("double"))
        aggs += [e.alias(f"_{i}_{name}") for name, e in named.items()]
        rows.append(F.struct(F.lit(c).alias("field"), *[F.col(f"_{i}_{name}").alias(name) for name in named]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def invalid_value_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per field: totals by kind of value, and moments of the finite ones.

    NULL and NaN both count as nan, as missing values do in the source tables.
    """
    def build(v: Column, raw: Column) -> dict[str, Column]:
        return {
            "total_count": F.count("*"),
            "finite_count": F.count(v),
            "nan_count": F.count(F.when(raw.isNull() | F.isnan(raw), 1)),
            "posinf_count": F.count(F.when(raw == INF, 1)),
            "neginf_count": F.count(F.when(raw == -INF, 1)),
            "mean": F.avg(v), "std": F.stddev_pop(v), "skew": T.skew(v), "kurtosis": T.excess_kurtosis(v),
            "min_finite": F.min(v), "max_finite": F.max(v),
        }

    out = _per_field(df, columns, build)
    total = F.col("total_count")
    return out.withColumns({
        "nan_ratio": S.ratio(F.col("nan_count"), total),
        "invalid_ratio": S.ratio(total - F.col("finite_count"), total),
    })


def feature_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per field: count, mean, std, skew and excess kurtosis (population)."""
    return _per_field(df, columns, lambda v, raw: {
        "count": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v),
        "skew": T.skew(v), "kurtosis": T.excess_kurtosis(v),
    })


def feature_shift(moments: DataFrame) -> DataFrame:
    """Headline of ``feature_moments``: the largest departures from a standard normal."""
    return moments.agg(
        F.max(F.abs("mean")).alias("max_abs_mean"),
        F.max(F.abs(F.col("std") - 1)).alias("max_std_shift"),
        F.max(F.abs("skew")).alias("max_abs_skew"),
        F.max("kurtosis").alias("max_kurtosis"),
    )


def fixed_histogram(df: DataFrame, columns: Sequence[str], lo: float = -5.0, hi: float = 5.0, bins: int = 80) -> DataFrame:
    """(field, bin, count) of finite values; out-of-range ones fall in the edge bins."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), S.clean(c).alias("v")) for c in columns])
    long = df.select(F.inline(cells)).where(F.col("v").isNotNull())
    return (long.select("field", T.histogram_bin("v", lo, hi, bins).alias("bin"))
            .groupBy("field", "bin").agg(F.count("*").alias("count")))


def label_audit(df: DataFrame, cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Per date: rows without a usable label, by reason.

    A forward minute can be absent from the raw bars or have been dropped by
    the price filter; the entry minute can be missing; anything else is other.
    """
    raw = df.withColumn("_raw_fwd", at_minute(F.lit(1), cfg.horizon))
    bars = bar_features(raw, cfg).withColumns({
        "_fwd": at_minute("log_close", cfg.horizon), "_entry": at_minute("log_close", cfg.entry_lag)})
    rows = drop_horizon_tail(bars, cfg.horizon, cfg.last_index)
    no_fwd, no_entry = F.col("_fwd").isNull(), F.col("_entry").isNull()
    invalid = ~S.is_finite(F.col("_fwd") - F.col("_entry"))
    flags = {
        "invalid": invalid,
        "raw_absent": no_fwd & F.col("_raw_fwd").isNull(),
        "filtered": no_fwd & F.col("_raw_fwd").isNotNull(),
        "missing_entry": no_entry,
        "other": invalid & ~no_fwd & ~no_entry,
    }
    return rows.groupBy("Date").agg(
        F.count("*").alias("row_count"),
        *[F.count(F.when(c, 1)).alias(f"{name}_rows") for name, c in flags.items()],
        *[T.share(c).alias(f"{name}_ratio") for name, c in flags.items()],
    )


def kept_by_minute(df: DataFrame, horizon: int, last_index: int = 239) -> DataFrame:
    """Rows kept per minute, with zero where none were."""
    counts = df.groupBy("MinuteIndex").agg(F.count("*").alias("kept_rows"))
    minutes = df.sparkSession.range(last_index + 1 - horizon).select(F.col("id").cast("int").alias("MinuteIndex"))
    return minutes.join(counts, "MinuteIndex", "left").select(
        "MinuteIndex", F.coalesce("kept_rows", F.lit(0)).cast("bigint").alias("kept_rows"))


def drop_by_code(df: DataFrame, cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Per code: share of the expected minutes that were not kept."""
    expected = cfg.last_index + 1 - cfg.horizon - cfg.warmup
    daily = (df.select("StockCode", "Date", "MinuteIndex").distinct()
             .groupBy("StockCode", "Date").agg(F.count("*").alias("_kept")))
    out = daily.groupBy("StockCode").agg(
        F.count("*").alias("days"), F.sum("_kept").alias("kept_minutes"))
    missing = F.col("days") * expected - F.col("kept_minutes")
    return out.select(
        "StockCode", "days", "kept_minutes", missing.alias("missing_minutes"),
        S.ratio(missing, F.col("days") * expected).alias("drop_ratio"),
    ).orderBy(F.col("drop_ratio").desc(), F.col("missing_minutes").desc(), "StockCode")


def audit_rates(raw: DataFrame, kept: DataFrame, sampled: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split and date: raw, kept and sampled rows and their ratios.

    The three tables are counted on their own and only the counts are joined.
    """
    out = splits.withColumnRenamed("date", "Date")
    for name, df in (("raw", raw), ("kept", kept), ("sampled", sampled)):
        out = out.join(df.groupBy("Date").agg(F.count("*").alias(f"{name}_rows")), "Date", "left")
    out = out.fillna(0, [f"{n}_rows" for n in ("raw", "kept", "sampled")])
    return out.withColumns({
        "kept_rate": S.ratio("kept_rows", "raw_rows"), "sampled_rate": S.ratio("sampled_rows", "kept_rows")})


def feature_audit(features: DataFrame) -> DataFrame:
    """Per date: universe size and how much of it has scores and can be traded."""
    def hits(c: str) -> Column:
        return F.count(F.when(F.col(c), 1))

    return features.groupBy("date").agg(
        F.count("*").alias("raw_universe_rows"),
        hits("prediction_available").alias("prediction_rows"),
        hits("current_tradable").alias("current_tradable_rows"),
        hits("fillable_open").alias("fillable_open_rows"),
        hits("fillable_vwap").alias("fillable_vwap_rows"),
    ).withColumn("coverage_ratio", S.ratio("prediction_rows", "raw_universe_rows"))


def join_validation(left: DataFrame, right: DataFrame, keys: Sequence[str], horizon: str | None = None) -> DataFrame:
    """One row: counts, duplicates, matches and orphans of a keyed join.

    Both sides are reduced to distinct keys with counts first, so a repeated
    key travels once and the full join is one to one.
    """
    keys = list(keys)
    h = F.count(F.when(F.col(horizon).isNull(), 1)) if horizon else F.lit(0).cast("bigint")
    a = left.groupBy(*keys).agg(F.count("*").alias("_l"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_r"), h.alias("_null"))
    both = a.join(b, keys, "full_outer")
    l, r = F.col("_l"), F.col("_r")
    out = both.agg(
        F.coalesce(F.sum(l), F.lit(0)).cast("bigint").alias("left_rows"),
        F.coalesce(F.sum(r), F.lit(0)).cast("bigint").alias("right_rows"),
        F.count(l).alias("left_keys"), F.count(r).alias("right_keys"),
        F.count(F.when(l > 1, 1)).alias("left_duplicate_keys"),
        F.count(F.when(r > 1, 1)).alias("right_duplicate_keys"),
        F.count(F.when(l.isNotNull() & r.isNotNull(), 1)).alias("joined_keys"),
        F.count(F.when(r.isNull(), 1)).alias("left_unmatched"),
        F.count(F.when(l.isNull(), 1)).alias("right_unmatched"),
        F.coalesce(F.sum(F.when(l.isNotNull(), F.col("_null"))), F.lit(0)).cast("bigint").alias("null_horizon_rows"),
        *[f(c).cast("bigint").alias(f"{n}_{c}") for c in keys if c in ("date", "time")
          for n, f in (("min", F.min), ("max", F.max))],
    )
    failures = F.concat_ws(
        ",",
        F.when(F.col("left_rows") == 0, "left_empty"),
        F.when(F.col("left_duplicate_keys") > 0, "left_duplicates"),
        F.when(F.col("right_duplicate_keys") > 0, "right_duplicates"),
        F.when(F.col("left_unmatched") > 0, "left_unmatched"),
    )
    return out.withColumn("failures", failures).withColumn(
        "status", F.when(F.col("failures") == "", "passed").otherwise("failed"))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, tagged by side."""
    keys = list(keys)
    rows = left.select(*keys, F.lit(1).alias("_side")).unionByName(right.select(*keys, F.lit(2).alias("_side")))
    sides = rows.groupBy(*keys).agg(F.bit_or("_side").alias("_sides"))
    # A NULL in a key matches nothing, as in a join: such keys stand on each side that has them.
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    found = (F.when(F.col("_sides") == 1, F.array(F.lit("left"))).when(F.col("_sides") == 2, F.array(F.lit("right")))
             .when(~known, F.array(F.lit("left"), F.lit("right"))))
    return sides.select(*keys, F.explode(found).alias("side"))


def label_coverage(features: DataFrame, price: str = "vwap") -> DataFrame:
    """(reason, rows, ratio): why a signal row has no usable execution return."""
    def touched(leg: str) -> Column:
        return F.col(f"{leg}_{price}_is_up_limit") | F.col(f"{leg}_{price}_is_down_limit")

    reasons = {
        "not_fillable_vwap": ~F.col("fillable_vwap"),
        "not_fillable_open": ~F.col("fillable_open"),
        "limit_up_all_day": F.col("is_limit_up_all_day"),
        "limit_down_all_day": F.col("is_limit_down_all_day"),
        "limit_at_entry": touched("entry"),
        "limit_at_exit": touched("exit"),
    }
    total = features.agg(F.count("*").alias("_n"), *[F.count(F.when(c, 1)).alias(n) for n, c in reasons.items()])
    rows = F.array(*[
        F.struct(F.lit(n).alias("reason"), F.col(n).alias("row_count"), S.ratio(F.col(n), F.col("_n")).alias("row_ratio"))
        for n in reasons])
    return total.select(F.inline(rows))


def compare_sources(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: agreement of a value that two tables both carry."""
    joined = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), list(keys))
    diff = F.abs(F.col("_a") - F.col("_b"))
    return joined.agg(
        F.count("*").alias("matched_rows"), F.max(diff).alias("max_abs_diff"),
        F.avg(diff).alias("mean_abs_diff"), T.pearson("_a", "_b").alias("correlation"))


def complete_cross_sections(df: DataFrame, min_names: int, keys: Sequence[str] = ("date", "time"), plan: str | None = None) -> DataFrame:
    """Rows of the cross-sections that hold at least ``min_names`` rows."""
    return (add_group_stats(df, keys, {"_n": F.count(F.lit(1))}, plan)
            .where(F.col("_n") >= min_names).drop("_n"))
