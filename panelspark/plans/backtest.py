"""Scores to strategy summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from ..operators import book as B, market as M, positions as P, returns as R
from ..session import stored
from ..settings import CostSettings, MarketSettings
from .variants import TRADE_PLANS, feature_groups, plan_parameters


def build_features(pred: DataFrame, bars: DataFrame, daily: DataFrame, st_days: DataFrame | None = None, cfg: MarketSettings = MarketSettings()) -> DataFrame:
    """Execution features; the ADV history runs over the dates with scores only."""
    return M.execution_features(pred, M.market_state(bars, scored_history(pred, daily), st_days, cfg), cfg)


def scored_history(pred: DataFrame, daily: DataFrame) -> DataFrame:
    """Amounts of dates without scores are blanked: a missing amount never counts."""
    scored = pred.select(S.full_date("date").alias("Date")).distinct().withColumn("_scored", F.lit(True))
    return daily.join(scored, "Date", "left").withColumn(
        "daily_amount", F.when(F.col("_scored"), F.col("daily_amount"))).drop("_scored")


def run_backtest(
    features: DataFrame, top_frac: float = 0.1, max_liq_bucket: int = 3, price: str = "vwap",
    aums: Sequence[float] = (10e6, 100e6), costs: CostSettings = CostSettings(), plan: str | None = None,
) -> dict[str, DataFrame]:
    """Positions, bar ledger, daily series and summary of one strategy."""
    positions = P.build_positions(features, top_frac, max_liq_bucket=max_liq_bucket, price=price, costs=costs, plan=plan)
    ledger = B.slot_book(positions, costs, plan=plan)
    by_slot = R.slot_daily(ledger)
    daily = R.combine_slots(by_slot)
    return {
        "positions": positions, "ledger": ledger, "slot_daily": by_slot,
        "daily": R.net_returns(daily, aums),
        "slot_summary": R.slot_summary(by_slot, costs.annual_days),
        "summary": R.strategy_summary(daily, aums, annual_days=costs.annual_days),
    }


def compare_variants(
    features: DataFrame, variants: Sequence[dict], aum: float = 10e6, price: str = "vwap",
    costs: CostSettings = CostSettings(), plan: str | None = None,
) -> DataFrame:
    """One ranked row per trade plan, all from one job."""
    return rank_ledgers(B.run_variants(features, variants, price, costs, plan=plan), aum, costs)


def trade_plan_matrix(
    pred: DataFrame, bars: DataFrame, daily: DataFrame, st_days: DataFrame | None = None,
    plans: Sequence[dict] = TRADE_PLANS, aum: float = 10e6, cfg: MarketSettings = MarketSettings(),
    costs: CostSettings = CostSettings(),
) -> DataFrame:
    """One ranked row per shipped trade plan.

    Which names are eligible, their terciles and their ranks hang on neither
    the holding time nor the slot length. So the state of the market and the
    scores are joined once, a row carries one trip for each pair of the two,
    and only selected rows are laid out by plan.
    """
    groups = list(feature_groups(plans))
    state = M.market_state(bars, scored_history(pred, daily), st_days, cfg, [holding for holding, _ in groups])
    signals = stored(P.signal_trips(P.eligible_signals(M.scored_universe(state, pred, "exits")), [slots for _, slots in groups]))
    variants = [v | {"trip": groups.index((p["holding_bars"], p["slot_mod_bars"]))} for p, v in zip(plans, plan_parameters(plans), strict=True)]
    positions = P.build_trip_variants(signals, variants, costs)
    return rank_ledgers(B.slot_book_fast(positions, costs, ["variant"]), aum, costs)


def rank_ledgers(ledger: DataFrame, aum: float = 10e6, costs: CostSettings = CostSettings()) -> DataFrame:
    """One ranked row per variant of a bar ledger."""
    daily = R.combine_slots(R.slot_daily(ledger, ["variant"]), ["variant"])
    summary = R.strategy_summary(daily, [aum], annual_days=costs.annual_days, by=["variant"])
    return R.rank_variants(summary, R.net_name(aum))
