"""Score tables to evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ic as I, quality as Q, signal as G
from ..registry import default_registry


def evaluate_predictions(pred: DataFrame, icir_days: int = 60, plan: str | None = None) -> dict[str, DataFrame]:
    """The IC report of one score table (date, time, code, prediction, target)."""
    stamps = I.ic_by_timestamp(pred, plan=plan)
    daily = I.daily_ic(stamps)
    return {
        "ic_by_timestamp": stamps,
        "ic_summary": I.ic_summary(stamps),
        "rank_ic_summary": I.ic_summary(stamps, "rank_ic"),
        "daily_ic": daily,
        "icir_windows": I.icir_windows(daily, days=icir_days),
        "annual_ic": I.annual_ic(pred, plan=plan),
        "intraday_ic": I.intraday_ic(stamps),
        "rank_turnover": I.turnover_by_time(I.rank_turnover(pred, plan=plan)),
        "residuals": I.residual_diagnostics(pred),
        "decile_curve": I.decile_curve(pred, plan=plan),
        "metrics": default_registry().evaluate(pred, "test"),
    }


def baseline_evaluation(pred: DataFrame, features: DataFrame, min_names: int = 1000, grid: int = 10, plan: str | None = None) -> dict[str, DataFrame]:
    """The benchmark tables of a score table and its execution features."""
    buckets = G.signal_buckets(pred, plan=plan)
    base = G.signal_base(features, min_names, grid, plan=plan)
    daily = G.decile_daily(base)
    mono = G.monotonicity(daily)
    times = G.time_bucket_metrics(pred)
    liquidity = G.liquidity_by_signal(base)
    return {
        "join_validation": Q.join_validation(pred, features, ["date", "time", "code"], "ret_vwap_exec_10"),
        "label_coverage": Q.label_coverage(features),
        "signal_buckets": buckets,
        "decile_summary": G.decile_summary(daily),
        "monotonicity": mono,
        "liquidity_by_signal": liquidity,
        "time_buckets": times,
        "extremes": G.extreme_target_profile(pred, plan=plan),
        "scale": G.prediction_scale(pred),
        "residuals": I.residual_diagnostics(pred, sample=True),
        "bootstrap": G.bootstrap_ci(mono, "top_minus_bottom"),
        "monthly": G.monthly_stability(mono),
        "regimes": G.regime_stability(mono),
        "proxy": G.signal_proxy_strategy(buckets),
        "headline": G.headline_summary(buckets, liquidity, times),
    }
