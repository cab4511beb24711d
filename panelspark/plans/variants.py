"""Parameter matrices of the shipped strategy variants."""

from __future__ import annotations


def _plan(name: str, holding: int = 10, top: float = 0.10, long_on: bool = True, short_on: bool = True, liq: int = 3) -> dict:
    return {"variant": name, "holding_bars": holding, "slot_mod_bars": holding, "top_frac": top,
            "long_enabled": long_on, "short_enabled": short_on, "max_liq_bucket": liq}


# The trade plans, bands, cost penalties and quantiles compared.
TRADE_PLANS = (
    _plan("baseline_h10_top10_ls_liq3"),
    _plan("holding_h20_top10_ls_liq3", holding=20),
    _plan("holding_h30_top10_ls_liq3", holding=30),
    _plan("holding_h60_top10_ls_liq3", holding=60),
    _plan("width_h10_top05_ls_liq3", top=0.05),
    _plan("width_h10_top20_ls_liq3", top=0.20),
    _plan("width_h10_top30_ls_liq3", top=0.30),
    _plan("leg_h10_top10_long_only_liq3", short_on=False),
    _plan("leg_h10_top10_short_only_liq3", long_on=False),
    _plan("liq_h10_top10_ls_liq2", liq=2),
    _plan("liq_h10_top10_ls_liq1", liq=1),
)
BUFFERS = tuple(
    {"variant": f"buffer_h60_entry10_hold200_ls_liq{liq}", "entry_frac": 0.10, "hold_frac": 0.20, "max_liq_bucket": liq}
    for liq in (3, 2, 1))
COST_AWARE = (
    {"variant": "equal_score_cost_sizing_liq1_buffer", "sizing_method": "equal", "entry_cost_penalty": 0.0},
    {"variant": "entry_cost000_cost_sizing_liq1_buffer", "sizing_method": "cost_aware", "entry_cost_penalty": 0.0},
    {"variant": "entry_cost025_cost_sizing_liq1_buffer", "sizing_method": "cost_aware", "entry_cost_penalty": 0.00025},
    {"variant": "entry_cost050_cost_sizing_liq1_buffer", "sizing_method": "cost_aware", "entry_cost_penalty": 0.0005},
    {"variant": "entry_cost100_cost_sizing_liq1_buffer", "sizing_method": "cost_aware", "entry_cost_penalty": 0.001},
    {"variant": "entry_cost150_cost_sizing_liq1_buffer", "sizing_method": "cost_aware", "entry_cost_penalty": 0.0015},
)
HYSTERESIS = (
    {"variant": "q90_q80", "open_quantile": 0.90, "close_quantile": 0.80},
    {"variant": "q90_q70", "open_quantile": 0.90, "close_quantile": 0.70},
    {"variant": "q95_q85", "open_quantile": 0.95, "close_quantile": 0.85},
    {"variant": "q95_q80", "open_quantile": 0.95, "close_quantile": 0.80},
    {"variant": "q85_q75", "open_quantile": 0.85, "close_quantile": 0.75},
)


def plan_parameters(plans=TRADE_PLANS) -> list[dict]:
    """The columns position building needs, without the feature-side ones."""
    keep = ("variant", "top_frac", "long_enabled", "short_enabled", "max_liq_bucket")
    return [{k: p[k] for k in keep} for p in plans]


def feature_groups(plans=TRADE_PLANS) -> dict[tuple[int, int], list[dict]]:
    """Plans by (holding, slot length): one execution-feature table serves each."""
    groups: dict[tuple[int, int], list[dict]] = {}
    for p in plans:
        groups.setdefault((p["holding_bars"], p["slot_mod_bars"]), []).append(p)
    return groups
