"""Statistics of columns kept as mergeable states, a few rows a day.

A state is (n, mean, central sums of order two to four, least, greatest) of the
finite values of one field, day and histogram bin. States merge exactly, so the
moments and histograms of any set of days come from their states, and a new or
corrected day costs its own rows only: its partition is replaced, the others are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalar as S, stats as T

STATE = ("n", "mean", "m2", "m3", "m4", "least", "greatest")


def day_states(df: DataFrame, columns: Sequence[str], date: str = "Date", lo: float = -5.0, hi: float = 5.0, bins: int = 80) -> DataFrame:
    """One row per (date, field, bin) with the state of its finite values.

    Bins are those of ``stats.histogram_bin``; missing and infinite values are in none.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("field"), S.clean(c).cast("double").alias("value")) for c in columns])
    values = df.select(date, F.inline(cells)).where(F.col("value").isNotNull())
    v, n = F.col("value"), F.count("*").cast("double")
    variance = F.var_pop(v)
    varies = variance > 0
    return values.groupBy(date, "field", T.histogram_bin("value", lo, hi, bins).alias("bin")).agg(
        n.cast("bigint").alias("n"), F.avg(v).alias("mean"), (variance * n).alias("m2"),
        F.when(varies, F.skewness(v) * n * F.pow(variance, F.lit(1.5))).otherwise(0.0).alias("m3"),
        F.when(varies, (F.kurtosis(v) + 3) * n * variance * variance).otherwise(0.0).alias("m4"),
        F.min(v).alias("least"), F.max(v).alias("greatest"))


def merge(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The states of unions: one row per ``by``."""
    keys = list(by)
    n, c = F.col("n"), F.col
    centre = states.groupBy(*keys).agg(F.sum(n).alias("_n"), (F.sum(n * c("mean")) / F.sum(n)).alias("_mean"))
    d = c("mean") - c("_mean")
    parts = states.join(centre, keys)
    merged = parts.groupBy(*keys).agg(
        F.sum(n).cast("bigint").alias("n"), F.first("_mean").alias("mean"), F.sum(c("m2") + n * d * d).alias("m2"),
        F.sum(c("m3") + 3 * d * c("m2") + n * d * d * d).alias("m3"),
        F.sum(c("m4") + 4 * d * c("m3") + 6 * d * d * c("m2") + n * d * d * d * d).alias("m4"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    # A constant has no variance, not even one of rounding errors.
    varies = c("least") < c("greatest")
    return merged.withColumns({"mean": F.when(varies, c("mean")).otherwise(c("least"))} | {
        m: F.when(varies, c(m)).otherwise(0.0) for m in ("m2", "m3", "m4")})


def moments(states: DataFrame, by: Sequence[str] = ("field",)) -> DataFrame:
    """count, mean, std (ddof 0), skew, kurtosis (excess), least and greatest from states."""
    variance = F.col("m2") / F.col("n")
    shape = lambda m, p: F.when(F.col("m2") > 0, F.col(m) / F.col("n") / F.pow(variance, F.lit(p)))
    return merge(states, by).select(
        *by, F.col("n").alias("count"), "mean", F.sqrt(variance).alias("std"), shape("m3", 1.5).alias("skew"),
        (shape("m4", 2.0) - 3).alias("kurtosis"), "least", "greatest")


def histogram(states: DataFrame, by: Sequence[str] = ("field",)) -> DataFrame:
    return states.groupBy(*by, "bin").agg(F.sum("n").cast("bigint").alias("count"))


def update_states(states: DataFrame, path: str, date: str = "Date") -> DataFrame:
    """Store the states of the days they cover, in place of what those days had, and return all states."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    return read_states(states.sparkSession, path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def zscore_params(states: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each field; one row a field reaches the driver."""
    return {r["field"]: (r["mean"], r["std"]) for r in moments(states).collect()}
