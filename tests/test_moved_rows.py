"""How far rows are moved: plans that shuffle wide rows no more often than their work needs, with the same results."""

import re
from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from panelspark.operators import book as B, market as M, positions as P
from panelspark.plans import backtest as T
from panelspark.plans.variants import TRADE_PLANS, feature_groups, plan_parameters
from panelspark.session import stored
from panelspark.settings import MarketSettings
from tests.helpers import assert_same, rows_of

CFG = MarketSettings(entry_delay=1, holding=2, slot_mod=2, adv_days=2, sigma_window=3, sigma_min_count=2)
PLANS = [p | {"holding_bars": p["holding_bars"] // 5, "slot_mod_bars": p["slot_mod_bars"] // 5} for p in TRADE_PLANS]


def panel(spark, codes=9, days=4, minutes=16):
    rows, k = [], 0
    for code in range(1, codes + 1):
        for day in range(days):
            for minute in range(minutes):
                k += 1
                if (k * 7) % 11 == 0:
                    continue
                px = 100.0 + (k * 37) % 101 / 10
                rows.append((code, 20260105 + day, minute, px, px + (k % 5) / 10 - 0.2, px + 1, px - 1, float(k % 13), px * (k % 13)))
    bars = stored(spark.createDataFrame(
        rows, "StockCode int, Date int, MinuteIndex int, Open double, Close double, High double, Low double, Vol double, Amount double"))
    daily = bars.groupBy(F.col("StockCode").alias("code"), "Date").agg(
        F.max("High").alias("up_limit"), F.min("Low").alias("down_limit"), F.sum("Amount").alias("daily_amount"))
    state = M.market_state(bars, daily, cfg=CFG)
    pred = stored(M.universe(state).where("(code + base_minute) % 7 != 0").select(
        "date", "time", "code", ((F.col("code") * 31 + F.col("base_minute") * 17) % 10).cast("double").alias("prediction")))
    return bars, daily, state, pred


def test_scores_come_to_the_sessions(spark):
    bars, daily, state, pred = panel(spark)
    want = M.signal_left_join(M.allowed_times(M.universe(state), pred), pred)
    got = M.scored_universe(state, pred).select(*want.columns)
    keys = ["date", "time", "code"]
    assert_same(rows_of(got, *keys), rows_of(want, *keys))
    many = spark.range(2_000_000).select(  # too many to be broadcast
        F.lit(260105).alias("date"), F.lit(93000).alias("time"), F.col("id").cast("int").alias("code"), F.lit(1.0).alias("prediction"))
    plan = M.execution_features(many, state, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert not re.search(r"hashpartitioning\(date#\d+, time#\d+, code#\d+", plan)


def test_repeated_score_still_fails(spark):
    _, _, state, pred = panel(spark, codes=3, days=2)
    twice = pred.unionByName(pred.limit(1))
    with pytest.raises(Exception, match="duplicate key"):
        M.execution_features(twice, state, CFG).collect()


def test_trade_plans_share_one_market_state(spark, monkeypatch):
    bars, daily, _, pred = panel(spark)
    ledgers = []
    for (holding, slots), group in feature_groups(PLANS).items():
        features = stored(T.build_features(pred, bars, daily, None, replace(CFG, holding=holding, slot_mod=slots)))
        ledgers.append(B.run_variants(features, plan_parameters(group)))
    want = rows_of(T.rank_ledgers(reduce(DataFrame.unionByName, ledgers)), "variant")
    states, build = [], M.market_state
    monkeypatch.setattr(M, "market_state", lambda *a, **k: states.append(1) or build(*a, **k))
    got = rows_of(T.trade_plan_matrix(pred, bars, daily, None, PLANS, cfg=CFG), "variant")
    assert len(want) == len(PLANS) and len(states) == 1
    assert_same(got, want)


def test_positions_move_only_what_they_need(spark):
    _, _, state, pred = panel(spark, codes=3, days=2)
    narrow = P.signal_columns(M.execution_features(pred, state, CFG), "vwap")
    assert len(narrow.columns) == 13 and not [c for c in narrow.columns if c.startswith(("entry_", "exit_", "ret_"))]
