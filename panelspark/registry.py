"""Metrics as named aggregate expressions, evaluated together in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .functions import scalar as S, stats as T
from .functions.ranks import add_ranks_of
from .operators.features import finite_pairs
from .operators.quality import fixed_histogram

Metric = Callable[[Column, Column], Column]


@dataclass
class MetricRegistry:
    """Named scalar metrics of (prediction, target).

    A metric is a function of the two columns that returns an aggregate. Those
    registered with ``on_ranks`` get pooled average-tie ranks instead.
    """

    scalars: dict[str, Metric] = field(default_factory=dict)
    rank_scalars: dict[str, Metric] = field(default_factory=dict)

    def register(self, name: str, metric: Metric, on_ranks: bool = False) -> MetricRegistry:
        if name in self.scalars or name in self.rank_scalars:
            raise ValueError(f"metric {name!r} is already registered")
        (self.rank_scalars if on_ranks else self.scalars)[name] = metric
        return self

    @property
    def names(self) -> list[str]:
        return sorted([*self.scalars, *self.rank_scalars])

    def evaluate(self, df: DataFrame, namespace: str, names: Sequence[str] | None = None) -> DataFrame:
        """(metric, value) rows, prefixed with the namespace. No names = all."""
        wanted = list(names) if names else self.names
        unknown = [n for n in wanted if n not in self.names]
        if unknown:
            raise KeyError(f"unknown metrics: {unknown}")
        rows = finite_pairs(df).select(F.col("prediction").cast("double"), F.col("target").cast("double"))
        if any(n in self.rank_scalars for n in wanted):
            rows = add_ranks_of(rows, [], {"prediction": {"avg": "_rp"}, "target": {"avg": "_rt"}})
        plain, ranked = (F.col("prediction"), F.col("target")), (F.col("_rp"), F.col("_rt"))
        aggs = [
            (self.scalars[n](*plain) if n in self.scalars else self.rank_scalars[n](*ranked)).cast("double").alias(n)
            for n in wanted]
        cells = F.array(*[F.struct(F.lit(f"{namespace}/{n}").alias("metric"), F.col(f"`{n}`").alias("value")) for n in wanted])
        return rows.agg(*aggs).select(F.inline(cells))

    def histograms(self, df: DataFrame, namespace: str, lo: float = -5.0, hi: float = 5.0, bins: int = 80) -> DataFrame:
        """(metric, bin, count) of score and target over all rows."""
        found = fixed_histogram(finite_pairs(df), ["prediction", "target"], lo, hi, bins)
        return found.select(F.concat(F.lit(f"{namespace}/dist/"), "field").alias("metric"), "bin", "count")


def default_registry() -> MetricRegistry:
    reg = MetricRegistry()
    reg.register("quality/global_ic", T.pearson)
    reg.register("quality/rank_ic", T.pearson, on_ranks=True)
    reg.register("objective/mse", lambda p, t: F.avg((p - t) * (p - t)))
    for side, pick in (("pred", 0), ("target", 1)):
        reg.register(f"dist/mean/{side}", lambda p, t, i=pick: F.avg((p, t)[i]))
        reg.register(f"dist/std/{side}", lambda p, t, i=pick: F.stddev_pop((p, t)[i]))
        reg.register(f"dist/abs_mean/{side}", lambda p, t, i=pick: F.avg(F.abs((p, t)[i])))
    reg.register("dist/pred_std_over_target_std", lambda p, t: S.ratio(F.stddev_pop(p), F.stddev_pop(t)))
    return reg
