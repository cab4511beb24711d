"""Aggregate expressions. All are declarative, so partial aggregation applies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import ColumnLike, clean, col, is_finite, ratio


def _paired(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    both = is_finite(x) & is_finite(y)
    return F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))


def pearson(x: ColumnLike, y: ColumnLike) -> Column:
    """Correlation over finite pairs; NULL below two pairs or at zero variance.

    Central moments keep a constant column at exactly zero variance; the
    built-in ``corr`` raises there under ANSI mode. A value that is zero up to
    rounding is zero, so its sign does not hang on the order of summation.
    """
    a, b = _paired(x, y)
    c = ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.abs(c) < 1e-12, 0.0).otherwise(c)


def exact_avg(x: ColumnLike) -> Column:
    """Mean that does not hang on the order of summation, so that equal sets of values have equal means.

    Values are summed as decimals of 18 places. That is finer than sums of
    doubles where the greatest magnitude is from 0.001 to 1e9; beyond that the
    plain mean is taken.
    """
    v = col(x).cast("double")
    most = F.max(F.abs(v))
    total = F.sum(F.when(F.abs(v) < 1e9, v).cast("decimal(38,18)")).cast("double")
    return F.when((most == 0) | most.between(1e-3, 1e9 - 1), total / F.count(v)).otherwise(F.avg(v))


def spread(x: ColumnLike, ddof: int = 1) -> Column:
    return F.stddev_samp(col(x)) if ddof == 1 else F.stddev_pop(col(x))


def t_stat(x: ColumnLike) -> Column:
    """mean / (std / sqrt(n)) with the sample deviation."""
    return ratio(F.avg(col(x)) * F.sqrt(F.count(col(x))), F.stddev_samp(col(x)))


def share(condition: Column) -> Column:
    """Fraction of rows where ``condition`` holds; a NULL condition counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def positive_ratio(x: ColumnLike) -> Column:
    """Fraction of the non-NULL values that are above zero."""
    return F.avg((col(x) > 0).cast("double"))


def series_summary(x: ColumnLike) -> list[Column]:
    """count, mean, std, t-stat, positive ratio and mean/std over finite values."""
    v = clean(x)
    return [
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        t_stat(v).alias("t_stat"),
        positive_ratio(v).alias("positive_ratio"),
        ratio(F.avg(v), F.stddev_samp(v)).alias("icir"),
    ]


def _nan_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def skew(x: ColumnLike, bias: bool = True) -> Column:
    """Skewness; population by default, bias-corrected (G1) with bias=False."""
    v = col(x)
    g1 = F.when(F.stddev_pop(v) > 0, _nan_null(F.skewness(v)))
    if bias:
        return g1
    n = F.count(v).cast("double")
    return F.when(n > 2, ratio(g1 * F.sqrt(n * (n - 1)), n - 2))


def excess_kurtosis(x: ColumnLike, bias: bool = True) -> Column:
    """Excess kurtosis; population by default, bias-corrected (G2) with bias=False."""
    v = col(x)
    g2 = F.when(F.stddev_pop(v) > 0, _nan_null(F.kurtosis(v)))
    if bias:
        return g2
    n = F.count(v).cast("double")
    return F.when(n > 3, ratio((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))


def compound(r: ColumnLike) -> Column:
    """prod(1 + r) - 1."""
    return F.product(1 + col(r)) - 1


def quantile(x: ColumnLike, p: float | list[float], approx: bool = False, accuracy: int = 10000) -> Column:
    """Linear-interpolation quantile; ``approx`` bounds the state per group."""
    arg = F.array(*[F.lit(v) for v in p]) if isinstance(p, list) else F.lit(p)
    if approx:
        return F.percentile_approx(col(x), p, accuracy)
    return F.percentile(col(x), arg)


def histogram_bin(x: ColumnLike, lo: float = -5.0, hi: float = 5.0, bins: int = 80) -> Column:
    """1-based bin number; values beyond the range fall in the edge bins."""
    width = (hi - lo) / bins
    return F.least(F.greatest(F.floor((col(x) - F.lit(lo)) / F.lit(width)) + 1, F.lit(1)), F.lit(bins)).cast("int")
