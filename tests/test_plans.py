import pytest
from pyspark.sql import functions as F

from panelspark.operators import features as P
from panelspark.plans.backtest import build_features, compare_variants, run_backtest
from panelspark.plans.evaluation import baseline_evaluation, evaluate_predictions
from panelspark.settings import MarketSettings
from tests.helpers import FEATURE_SCHEMA, feature_frame, random_features

CFG = MarketSettings(entry_delay=1, holding=2, slot_mod=2, adv_days=2, sigma_window=4, sigma_min_count=2)


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for d in (20240102, 20240103, 20240104):
        for c in range(1, 6):
            for m in range(12):
                px = 10 + c + ((m * 7 + c * 3 + d) % 11) / 10
                rows.append((c, d, m, px, px + 0.05, px + 0.1, px - 0.1, 100.0 + m, (100.0 + m) * px))
    return spark.createDataFrame(
        rows, "StockCode int, Date int, MinuteIndex int, Open double, Close double, High double, Low double, Vol double, Amount double").cache()


def scores(bars):
    return P.with_short_keys(bars).select("date", "time", "code", (F.col("Close") % 1).alias("prediction"))


def test_sessions_in_buckets_are_not_exchanged(spark, bars, tmp_path):
    from panelspark.operators import market as M
    from panelspark.sources import writers as W

    table = W.write_bucketed_bars(bars, "bars_in_buckets", str(tmp_path / "bars"), 4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    featured = P.bar_features(table)
    assert "Exchange" not in plan(featured) and "Exchange" in plan(P.bar_features(bars))
    state = M.next_trade(M.tradable_flags(table.withColumns({
        "vwap": F.col("Close"), "up_limit": F.lit(99.0), "down_limit": F.lit(1.0), "is_st": F.lit(False), "adv_amount": F.lit(1e6)})))
    assert "Exchange" not in plan(state)
    assert featured.exceptAll(P.bar_features(bars)).count() == 0 and featured.count() == bars.count()
    spark.sql("DROP TABLE bars_in_buckets")


def test_adv_history_covers_scored_dates_only(spark, bars):
    daily = bars.groupBy(F.col("StockCode").alias("code"), "Date").agg(
        (F.max("High") * 2).alias("up_limit"), (F.min("Low") / 2).alias("down_limit"), F.sum("Amount").alias("daily_amount"))
    late = scores(bars).where("date >= 240103")
    feats = build_features(late, bars, daily, None, CFG)
    by_date = {r["date"]: r["a"] for r in feats.groupBy("date").agg(F.count("adv_amount").alias("a")).collect()}
    assert by_date == {240103: 0, 240104: 60}
    want = {r["code"]: r["daily_amount"] for r in daily.where("Date = 20240103").collect()}
    assert all(r["adv_amount"] == pytest.approx(want[r["code"]]) for r in feats.where("date = 240104").select("code", "adv_amount").distinct().collect())


def test_entry_and_exit_minutes(spark, bars):
    daily = bars.groupBy(F.col("StockCode").alias("code"), "Date").agg(
        (F.max("High") * 2).alias("up_limit"), (F.min("Low") / 2).alias("down_limit"), F.sum("Amount").alias("daily_amount"))
    halted = bars.withColumn("Vol", F.when((F.col("StockCode") == 1) & F.col("MinuteIndex").isin(3, 4), 0.0).otherwise(F.col("Vol")))
    feats = build_features(scores(bars), halted, daily, None, CFG)
    got = {r["base_minute"]: (r["entry_exec_minute"], r["exit_schedule_minute"], r["exit_exec_minute"]) for r in feats.where("code = 1 AND date = 240103").collect()}
    assert got[0] == (1, 3, 5)    # exit falls into the halt and waits
    assert got[2] == (5, 7, 7)    # entry waits, the exit counts from the entry
    assert got[9] == (10, 12, None) and got[11] == (None, None, None)


def test_backtest_tables(spark):
    feats = feature_frame(spark, random_features(21))
    out = run_backtest(feats, 0.3)
    row = out["summary"].where("series = 'gross_return'").first()
    assert row["day_count"] == feats.select("date").distinct().count()
    assert {r["series"] for r in out["summary"].collect()} == {"gross_return", "net_return_aum_10m", "net_return_aum_100m"}
    ranked = compare_variants(feats, [
        {"variant": n, "top_frac": f, "long_enabled": True, "short_enabled": True, "max_liq_bucket": 3} for n, f in (("a", 0.1), ("b", 0.4))]).collect()
    assert len(ranked) == 2 and ranked[0]["net_daily_return"] >= ranked[1]["net_daily_return"]


def test_evaluation_tables(spark):
    feats = feature_frame(spark, random_features(22, slots=2, bars=12, codes=30))
    pred = feats.where("ret_vwap_exec_10 IS NOT NULL").select("date", "time", "code", "prediction", F.col("ret_vwap_exec_10").alias("target")).cache()
    report = evaluate_predictions(pred, icir_days=2)
    assert {k: v.count() > 0 for k, v in report.items()} == dict.fromkeys(report, True)
    full = feats.withColumns({
        "fillable_open": F.col("fillable_vwap"), **{f"{leg}_open_is_{s}_limit": F.lit(False) for leg in ("entry", "exit") for s in ("up", "down")}})
    tables = baseline_evaluation(pred, full, 3, 1)
    assert {k: v.count() > 0 for k, v in tables.items()} == dict.fromkeys(tables, True)
    assert tables["join_validation"].first()["left_unmatched"] == 0
    assert "date" in FEATURE_SCHEMA


def test_dataset_contract_covers_splits_and_bars(spark, bars, tmp_path):
    from panelspark.plans.dataset import build_dataset
    from panelspark.schema import ContractError
    from panelspark.settings import FeatureSettings

    cfg = FeatureSettings(return_lags=(1, 2), vol_window=3, mean_window=2, horizon=2, last_index=11, warmup=2)
    dates = (20240102, 20240103, 20240104)

    def splits(*names):
        return spark.createDataFrame(list(zip(dates, names)), "date int, split string")

    out = str(tmp_path / "set")
    first = splits("train", "val", "test")
    rows, _ = build_dataset(bars, first, out, cfg, bars_id="v1")
    again, _ = build_dataset(bars, first, out, cfg, bars_id="v1")
    assert rows.count() == again.count() > 0
    with pytest.raises(ContractError):
        build_dataset(bars, splits("train", "train", "test"), out, cfg, bars_id="v1")
    with pytest.raises(ContractError):
        build_dataset(bars, first, out, cfg, bars_id="v2")


def test_long_band_runs_stay_cheap(spark):
    from panelspark.operators.positions import pair_band_state

    n = 100_000
    rows = spark.range(n).select(
        F.lit("v").alias("variant"), F.lit(1).alias("code"), F.col("id").alias("bar"),
        (F.col("id") % 997 == 0).alias("long_entry"), (F.col("id") % 5003 != 5).alias("long_hold"),
        (F.col("id") % 1301 == 1).alias("short_entry"), (F.col("id") % 3001 != 7).alias("short_hold"))
    got = {r["bar"]: r["side"] for r in pair_band_state(rows, ["variant", "code"], "bar").collect()}
    side, want = 0, {}
    for i in range(n):
        if not (side == 1 and i % 5003 != 5 or side == -1 and i % 3001 != 7):
            side = 1 if i % 997 == 0 else -1 if i % 1301 == 1 else 0
        if side:
            want[i] = side
    assert got == want
