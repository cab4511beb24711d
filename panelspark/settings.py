"""Immutable parameter sets. Defaults describe 240-minute sessions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FeatureSettings:
    return_lags: tuple[int, ...] = (1, 2, 3, 5, 10)
    vol_window: int = 10
    vol_min_count: int = 2
    mean_window: int = 5
    signed_log_returns: bool = True
    squash_scale: float | None = None
    zero_sources: tuple[str, ...] = ()
    include_session_id: bool = False
    horizon: int = 10
    entry_lag: int = 1
    last_index: int = 239
    warmup: int = 10

    @property
    def return_names(self) -> list[str]:
        return [f"ret_{k}m" for k in self.return_lags]

    @property
    def stock_features(self) -> list[str]:
        return [*self.return_names, "hl", "oc", "log_vol", "log_amount", f"vol_{self.vol_window}m",
                f"log_vol_{self.mean_window}m_mean", f"log_amount_{self.mean_window}m_mean"]

    @property
    def feature_names(self) -> list[str]:
        time = ["minute_norm", "session_id", "session_minute_norm"] if self.include_session_id else [
            "minute_norm", "session_minute_norm"]
        return [*self.stock_features, *[f"{c}_is_zero" for c in self.zero_sources], *time]


@dataclass(frozen=True)
class MarketSettings:
    entry_delay: int = 1
    holding: int = 10
    slot_mod: int = 10
    adv_days: int = 20
    sigma_window: int = 20
    sigma_min_count: int = 5


@dataclass(frozen=True)
class CostSettings:
    spread_high: float = 5.0
    spread_mid: float = 10.0
    spread_low: float = 20.0
    impact_eta: float = 0.5
    fee_bps: float = 1.0
    annual_days: int = 252
