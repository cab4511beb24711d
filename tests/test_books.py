"""Plans against plain loops over bars."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.operators import book as B, ic as I, market as M, positions as P, returns as R
from panelspark.plans.variants import TRADE_PLANS, feature_groups, plan_parameters
from tests.helpers import assert_same, avg_ranks, feature_frame, pearson, random_features, rows_of


def cross_section():
    return [dict(
        date=260101, time=93000, code=i + 1, minute_slot=0, prediction=float(i), prediction_available=True, current_tradable=True,
        signal_amount=float(30 - i), sigma_intraday=0.01, adv_amount=1e6, is_limit_up_all_day=False, is_limit_down_all_day=False,
        fillable_vwap=True, ret_vwap_exec_10=0.001, entry_vwap_is_up_limit=False, entry_vwap_is_down_limit=False,
        exit_vwap_is_up_limit=False, exit_vwap_is_down_limit=False) for i in range(30)]


@pytest.mark.parametrize("kwargs, want", [
    (dict(), (6, 0.0, 1.0)),
    (dict(short_enabled=False), (3, 1.0, 1.0)),
    (dict(long_enabled=False), (3, -1.0, 1.0)),
    (dict(max_liq_bucket=1), (2, 0.0, 1.0)),
])
def test_selection_cases(spark, kwargs, want):
    pos = P.build_positions(feature_frame(spark, cross_section()), 0.1, **kwargs)
    got = pos.agg(F.count("*"), F.sum("target_weight"), F.sum(F.abs("target_weight"))).first()
    assert got[0] == want[0] and got[1] == pytest.approx(want[1]) and got[2] == pytest.approx(want[2])


def test_liquidity_filter_comes_before_ranking(spark):
    pos = P.build_positions(feature_frame(spark, cross_section()), 0.1, max_liq_bucket=1)
    assert {r["code"] for r in pos.collect()} == {1, 10}


def test_no_side_is_an_error(spark):
    with pytest.raises(ValueError):
        P.build_positions(feature_frame(spark, cross_section()), 0.1, long_enabled=False, short_enabled=False)


def impact(row, delta):
    return 0.5 * row["sigma_intraday"] * delta * math.sqrt(delta / row["adv_amount"]) if delta > 0 else 0.0


def loop_book(positions):
    """Drifting slot books, one bar after the other."""
    by_bar = defaultdict(list)
    for r in positions:
        by_bar[(r["minute_slot"], r["slot_bar_id"])].append(r)
    out, state, slot = [], {}, None
    for (s, b) in sorted(by_bar):
        if s != slot:
            state, slot = {}, s
        rows = {r["code"]: r for r in by_bar[(s, b)]}
        ok = {c: bool(r["fillable"]) and r["simple_return"] is not None for c, r in rows.items()}
        done = {c: r["target_weight"] if ok[c] else 0.0 for c, r in rows.items()}
        turn = plan = spread = imp = 0.0
        for c in set(rows) | set(state):
            prev, meta = state.get(c, (0.0, None))
            meta = rows.get(c, meta)
            delta = abs(done.get(c, 0.0) - prev)
            plan += abs((rows[c]["target_weight"] if c in rows else 0.0) - prev)
            turn += delta
            spread += 0.5 * meta["spread_bps"] / 1e4 * delta
            imp += impact(meta, delta)
        gross = sum(done[c] * (r["simple_return"] or 0.0) for c, r in rows.items())
        state = {c: (done[c] * (1 + (r["simple_return"] or 0.0)) / (1 + gross), r) for c, r in rows.items() if done[c] != 0}
        out.append(dict(minute_slot=s, slot_bar_id=b, gross_return=gross, planned_turnover=plan / 2, turnover=turn / 2,
                        spread_cost=spread, impact_coeff=imp, planned_name_count=len(rows), filled_name_count=sum(ok.values())))
    return out


@pytest.mark.parametrize("seed, plan", [(1, "window"), (2, "ranged"), (3, None)])
def test_slot_book_matches_the_loop(spark, seed, plan):
    pos = P.build_positions(feature_frame(spark, random_features(seed)), 0.3, plan=plan).cache()
    want = loop_book(rows_of(pos, "minute_slot", "slot_bar_id", "code"))
    got = rows_of(B.slot_book(pos, plan=plan), "minute_slot", "slot_bar_id")
    assert_same([{k: r[k] for k in want[0]} for r in got], want)


def loop_sides(bands):
    """Two-sided band state, one bar after the other."""
    by_bar, out = defaultdict(dict), {}
    for r in bands:
        by_bar[(r["variant"], r["minute_slot"], r["slot_bar_id"])][r["code"]] = r
    held, book = {}, None
    for (v, s, b) in sorted(by_bar):
        if (v, s) != book:
            held, book = {}, (v, s)
        rows, nxt = by_bar[(v, s, b)], {}
        for c, r in rows.items():
            side = held.get(c, 0)
            if side > 0 and r["long_hold"] or side < 0 and r["short_hold"]:
                nxt[c] = side
            elif r["long_entry"]:
                nxt[c] = 1
            elif r["short_entry"]:
                nxt[c] = -1
        held = nxt
        out.update({(v, s, b, c): side for c, side in nxt.items()})
    return out


VARIANTS = (
    {"variant": "narrow", "entry_frac": 0.1, "hold_frac": 0.25, "max_liq_bucket": 3},
    {"variant": "overlap", "entry_frac": 0.2, "hold_frac": 0.8, "max_liq_bucket": 3},
    {"variant": "tiny", "entry_frac": 0.3, "hold_frac": 0.5, "max_liq_bucket": 1},
)


@pytest.mark.parametrize("seed", [5, 6])
def test_band_state_and_book_match_the_loop(spark, seed):
    feats = feature_frame(spark, random_features(seed, slots=2, bars=10)).cache()
    bands = P.buffer_bands(feats, VARIANTS).cache()
    want = loop_sides(rows_of(bands, "variant", "minute_slot", "slot_bar_id", "code"))
    held = rows_of(P.pair_band_state(bands, ["variant", "minute_slot", "code"], "slot_bar_id"), "variant", "code")
    assert {(r["variant"], r["minute_slot"], r["slot_bar_id"], r["code"]): r["side"] for r in held} == want

    # Weights, turnover and costs on top of the state.
    rows = {(r["variant"], r["minute_slot"], r["slot_bar_id"], r["code"]): r for r in bands.collect()}
    ledger, prev, book = [], {}, None
    for key in sorted({k[:3] for k in want}):
        if key[:2] != book:
            prev, book = {}, key[:2]
        mine = {k[3]: s for k, s in want.items() if k[:3] == key}
        done, turn, spread, imp = {}, 0.0, 0.0, 0.0
        for c, s in mine.items():
            r = rows[(*key, c)]
            n = sum(x == s for x in mine.values())
            done[c] = (s * 0.5 / n) if r["long_fillable" if s > 0 else "short_fillable"] else 0.0
        for c in set(done) | set(prev):
            meta = rows[(*key, c)] if c in mine else prev[c][1]
            delta = abs(done.get(c, 0.0) - prev.get(c, (0.0, None))[0])
            turn += delta
            spread += 0.5 * meta["spread_bps"] / 1e4 * delta
            imp += impact(meta, delta)
        gross = sum(w * (rows[(*key, c)]["simple_return"] or 0.0) for c, w in done.items())
        ledger.append(dict(variant=key[0], minute_slot=key[1], slot_bar_id=key[2], gross_return=gross, turnover=turn / 2,
                           spread_cost=spread, impact_coeff=imp, desired_name_count=len(mine)))
        prev = {c: (w, rows[(*key, c)]) for c, w in done.items() if w != 0}
    got = rows_of(B.buffer_book(feats, VARIANTS), "variant", "minute_slot", "slot_bar_id")
    assert_same([{k: r[k] for k in ledger[0]} for r in got], ledger)


def test_cost_aware_weights_sum_to_half_per_side(spark):
    feats = feature_frame(spark, random_features(9))
    bands = P.cost_bands(feats, ({"variant": "a", "sizing_method": "cost_aware", "entry_cost_penalty": 0.5},), 3)
    held = P.pair_band_state(bands, ["variant", "minute_slot", "code"], "slot_bar_id")
    sums = P.side_weights(held, ["variant", "date", "time"]).groupBy("date", "time", "side").agg(F.sum("target_weight").alias("w")).collect()
    assert sums and all(r["w"] == pytest.approx(0.5 * r["side"]) for r in sums)


@pytest.mark.parametrize("plan", ["window", "ranged"])
def test_hysteresis_matches_the_loop(spark, plan):
    feats = feature_frame(spark, random_features(11, slots=1, bars=12, codes=20)).cache()
    variant = {"variant": "v", "open_quantile": 0.8, "close_quantile": 0.5}
    rows = [r.asDict() for r in feats.where("ret_vwap_exec_10 IS NOT NULL").collect()]
    by_day = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by_day[r["date"]][r["time"]].append(r)
    want = []
    for date in sorted(by_day):
        active, prev = set(), {}
        for time in sorted(by_day[date]):
            group = by_day[date][time]
            if len(group) < 3:
                continue
            pct = {r["code"]: sum(x["prediction"] <= r["prediction"] for x in group) / len(group) for r in group}
            order = sorted(group, key=lambda r: (-r["signal_amount"], r["code"]))
            base, extra = divmod(len(group), 3)
            tiers = [5.0] * (base + (extra > 0)) + [10.0] * (base + (extra > 1)) + [20.0] * base
            spread = {r["code"]: t for r, t in zip(order, tiers)}
            ret = {r["code"]: r["ret_vwap_exec_10"] for r in group}
            active = {c for c in pct if pct[c] >= 0.5 and (c in active or pct[c] >= 0.8)}
            w = {c: 1 / len(active) for c in active}
            moved = {c: abs(w.get(c, 0) - prev.get(c, (0, 0))[0]) for c in set(w) | set(prev)}
            cost = sum(0.5 * (spread[c] if c in w else prev[c][1]) / 1e4 * d for c, d in moved.items())
            want.append(dict(date=date, time=time, gross_return=sum(w[c] * ret[c] for c in w), turnover=sum(moved.values()) / 2,
                             spread_cost=cost, fee_cost=sum(moved.values()) / 1e4, active_name_count=len(active)))
            prev = {c: (w[c], spread[c]) for c in w}
    got = rows_of(B.hysteresis_book(feats, (variant,), 3, 1, plan=plan), "date", "time")
    assert_same([{k: r[k] for k in want[0]} for r in got], want)


@pytest.mark.parametrize("plan", ["window", "ranged"])
@pytest.mark.parametrize("window, step", [(8, 2), (9, 3), (10, 4)])
def test_rolling_ic_matches_brute_force(spark, plan, window, step):
    import random

    rng = random.Random(2)
    data = [(d, 93000, c, rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randint(0, 30))) for d in range(3) for c in range(10 + 9 * d)]
    df = spark.createDataFrame(data, "date int, time int, code int, prediction double, target double, label double")
    bins = defaultdict(list)
    for d in range(3):
        g = sorted((r for r in data if r[0] == d), key=lambda r: (r[5], r[2]))
        rp, rt = avg_ranks([r[3] for r in g]), avg_ranks([r[4] for r in g])
        for st in range(0, len(g) - window + 1, step):
            center = (st + window * 0.5) / len(g)
            sl = slice(st, st + window)
            bins[round(center * 1000)].append((center, pearson([r[3] for r in g[sl]], [r[4] for r in g[sl]]), pearson(rp[sl], rt[sl])))
    got = rows_of(I.rolling_group_ic(df, "label", window, step, plan=plan), "rank_bin")
    assert sum(r["count"] for r in got) == sum(map(len, bins.values()))
    flat = {b: v for b, v in bins.items()}
    for r in got:
        rows = flat[r["rank_bin"]]
        assert r["count"] == len(rows)
        assert r["mean_ic"] == pytest.approx(sum(x[1] for x in rows) / len(rows))
        assert r["mean_rank_ic"] == pytest.approx(sum(x[2] for x in rows) / len(rows))


def test_rolling_rows_plans_agree(spark):
    import random

    rng = random.Random(3)
    data = [(d, 1, c, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(4) for c in range(25)]
    df = spark.createDataFrame(data, "date int, time int, code int, prediction double, target double, label double")
    a = rows_of(I.rolling_group_ic_rows(df, "label", 12, 4, plan="window"), "window_start")
    b = rows_of(I.rolling_group_ic_rows(df, "label", 12, 4, plan="ranged"), "window_start")
    assert_same(a, b)
    labels = sorted(r[5] for r in data)
    assert [r["label_left"] for r in b] == [labels[r["window_start"]] for r in b]
    assert [r["label_center"] for r in b] == [labels[r["window_start"] + 6] for r in b]
    assert [r["label_right"] for r in b] == [labels[r["window_end"]] for r in b]


def test_adv_skips_invalid_days_and_today(spark):
    amounts = [5.0, None, 0.0, 7.0, float("nan"), 9.0, 11.0, -1.0, 13.0]
    daily = spark.createDataFrame([(1, d, a) for d, a in enumerate(amounts)], "code int, Date int, daily_amount double")
    got = [r["adv_amount"] for r in rows_of(M.trailing_adv(daily, 3), "Date")]
    history, want = [], []
    for a in amounts:
        want.append(sum(history[-3:]) / len(history[-3:]) if history else None)
        if a is not None and a == a and a > 0:
            history.append(a)
    assert got == pytest.approx(want)
    keys = spark.createDataFrame([(1, 4), (1, 100), (2, 3)], "code int, Date int")
    at = {(r["code"], r["Date"]): r["adv_amount"] for r in M.trailing_adv(daily, 3, keys).collect()}
    assert at == {(1, 4): 6.0, (1, 100): 11.0, (2, 3): None}


def test_interval_days(spark):
    cal = spark.createDataFrame([(d,) for d in (20240104, 20240105, 20240108, 20240112, 20240115)], "Date int")
    periods = spark.createDataFrame([(3, 20240105, 20240112), (7, 20240112, 99991231), (8, 20230101, 20231231)], "code int, start_date int, end_date int")
    got = {(r["code"], r["Date"]) for r in M.active_days(periods, cal).collect()}
    assert got == {(3, 20240105), (3, 20240108), (3, 20240112), (7, 20240112), (7, 20240115)}


def test_overlapping_and_open_intervals(spark):
    import random

    r = random.Random(9)
    days = [20240100 + d for d in range(1, 29)]
    cal = spark.createDataFrame([(d,) for d in r.sample(days, 20)] * 2, "Date int")
    rows = [(c, r.choice([None, *days[:20]]), r.choice([None, 99991231, *days])) for c in range(40) for _ in range(r.randint(1, 5))]
    periods = spark.createDataFrame(rows, "code int, start_date int, end_date int")
    dates = {x["Date"] for x in cal.collect()}
    want = sorted({(c, d) for c, a, b in rows for d in dates if (a or 0) <= d <= (b or 99991231)})
    found = M.active_days(periods, cal)
    assert sorted((x["code"], x["Date"]) for x in found.collect()) == want
    covers = sorted((x["code"], x["start_date"], x["end_date"]) for x in M.active_covers(periods).collect())
    assert all(p[0] != q[0] or p[2] < q[1] for p, q in zip(covers, covers[1:]))
    assert "sequence" not in found._jdf.queryExecution().toString() and M.active_days(periods, cal.where("false")).count() == 0


def test_drawdown_starts_at_the_first_wealth(spark):
    df = spark.createDataFrame([(1, -0.5), (2, 0.1), (3, -0.2)], "date int, gross_return double")
    got = rows_of(R.equity_curve(df), "date")
    assert [r["drawdown"] for r in got] == pytest.approx([0.0, 0.0, -0.2])
    row = R.return_summary(df, annual_days=3).first()
    assert row["cum_return"] == pytest.approx(0.5 * 1.1 * 0.8 - 1) == row["annualized_return"]
    assert row["max_drawdown"] == pytest.approx(-0.2)


def test_rebalance_gates(spark):
    prev = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "bar int, code string, weight double")
    goal = spark.createDataFrame([(1, "a", 0.501), (1, "c", 0.5)], "bar int, code string, weight double")
    free = {r["code"]: r["weight"] for r in P.rebalance_step(prev, goal, ["bar"], band=0.01).collect()}
    assert free == {"a": 0.5, "b": 0.0, "c": 0.5}
    tight = {r["code"]: r["weight"] for r in P.rebalance_step(prev, goal, ["bar"], band=0.01, budget=0.25).collect()}
    assert tight == pytest.approx({"a": 0.5, "b": 0.25, "c": 0.25})


def test_variant_matrix():
    assert len(TRADE_PLANS) == 11 and len(feature_groups()) == 4
    assert set(plan_parameters()[0]) == {"variant", "top_frac", "long_enabled", "short_enabled", "max_liq_bucket"}


def test_cross_section_tasks_hold_bounded_rows(spark, monkeypatch):
    """Variants and windows of cross-sections run in tasks whose rows are bounded, with the same rows as in one task."""
    from panelspark import session
    from panelspark.operators import ic, positions
    from tests.helpers import feature_frame, random_features, rows_of

    feats = feature_frame(spark, random_features(4)).cache()
    costs = [{"variant": n, "sizing_method": n, "entry_cost_penalty": p} for n, p in (("equal", 0.0), ("cost_aware", 0.3))]
    scores = feats.select("date", "time", "code", "prediction", F.col("ret_vwap_exec_10").alias("target"), "signal_amount")
    runs = {
        "bands": lambda: positions.cost_bands(feats, costs, max_liq_bucket=3, entry_frac=0.3, hold_frac=0.5),
        "rolling": lambda: ic.rolling_group_ic(scores, "signal_amount", 4, 2).select("rank_bin", "count"),
    }
    order = {"bands": ("variant", "date", "time", "code"), "rolling": ("rank_bin",)}
    whole = {name: rows_of(run(), *order[name]) for name, run in runs.items()}
    monkeypatch.setattr(session, "ROWS_PER_TASK", 60)
    for name, run in runs.items():
        df = run()
        asked = [line for line in df._jdf.queryExecution().toString().splitlines() if "REPARTITION_BY_NUM" in line]
        assert asked and "hashpartitioning(date" in asked[-1], name
        assert rows_of(df, *order[name]) == whole[name] and whole[name]


def test_unmatched_keys_with_nulls(spark):
    from panelspark.operators import quality

    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (4, None)], "k int, s string")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "k int, s string")
    got = sorted(quality.unmatched(left, right, ["k", "s"]).collect(), key=str)
    want = [(2, "b", "left"), (3, "b", "right"), (4, None, "left"), (None, "c", "left"), (None, "c", "right")]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
