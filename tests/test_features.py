import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.operators import datasets as D, features as P, ic as I, quality as Q
from panelspark.plans.dataset import build_dataset, normalised_splits, split_training_rows
from panelspark.settings import FeatureSettings
from tests.helpers import rows_of

DAYS = (20210104, 20210105, 20210106)


@pytest.fixture(scope="module")
def bars(spark):
    """Two codes, three days, minutes 0..24."""
    rows = []
    for code in (1, 2):
        for day in DAYS:
            for m in range(25):
                base = 10 + 0.5 * code + 0.01 * m
                at = dt.datetime(day // 10000, day // 100 % 100, day % 100, 9, 30) + dt.timedelta(minutes=m)
                rows.append((code, at, day, m, base, base + 0.01, base + 0.02, base - 0.02, 100.0 + m, (100 + m) * base))
    return spark.createDataFrame(
        rows, "StockCode int, DateTime timestamp_ntz, Date int, MinuteIndex int, Open double, Close double, High double, "
              "Low double, Vol double, Amount double").cache()


CFG = FeatureSettings(last_index=24)


def test_warmup_and_horizon_bound_the_rows(bars):
    minutes = {r["MinuteIndex"] for r in P.training_table(bars, CFG).collect()}
    assert minutes == set(range(10, 15))
    assert {r["MinuteIndex"] for r in P.inference_table(bars, CFG).collect()} == set(range(10, 25))


def test_inference_rows_outnumber_sampled_test_rows(bars):
    splits = D.split_by_counts(bars.select(F.col("Date").alias("date")), 1, 1, 1)
    test = split_training_rows(bars, splits, CFG).where("split = 'test'")
    sampled = D.sample_per_group(test, ["Date", "MinuteIndex"], 1, 7, ["StockCode"])
    live = P.inference_table(bars.where(f"Date = {DAYS[2]}"), CFG)
    assert live.count() > sampled.count() == 5
    assert live.where("target IS NOT NULL").count() == 0


def test_normalisation_uses_the_train_split_only(bars, spark, tmp_path):
    splits = D.split_by_counts(bars.select(F.col("Date").alias("date")), 1, 1, 1)
    rows, params = build_dataset(bars, splits, str(tmp_path / "table"), CFG)
    train = P.training_table(bars.where(f"Date = {DAYS[0]}"), CFG)
    want = train.agg(F.avg("log_vol"), F.stddev_pop("log_vol")).first()
    assert params["log_vol"] == pytest.approx(tuple(want))
    assert rows.where("split = 'train'").agg(F.avg("log_vol")).first()[0] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        P.fit_zscore(train, ["log_vol"], scope="all")
    again, _ = build_dataset(bars, splits, str(tmp_path / "table"), CFG)
    assert again.count() == rows.count()
    with pytest.raises(ValueError):
        build_dataset(bars, splits, str(tmp_path / "table"), FeatureSettings(last_index=24, horizon=5))


def test_constant_feature_is_rejected(bars):
    with pytest.raises(ValueError):
        P.fit_zscore(bars.withColumn("one", F.lit(1.0)), ["one"])
    params = P.fit_zscore(bars.withColumn("one", F.lit(1.0)), ["one"], exclude=["one"])
    assert params == {"one": (0.0, 1.0)}


def test_label_follows_the_clock_and_returns_follow_rows(bars):
    gappy = bars.where("MinuteIndex NOT IN (5, 11)")
    got = {(r["StockCode"], r["Date"], r["MinuteIndex"]): r for r in P.forward_label(P.bar_features(gappy, FeatureSettings(
        last_index=24, signed_log_returns=False)), 10, 1).collect()}
    close = lambda m: 10.5 + 0.01 * m + 0.01
    assert got[(1, DAYS[0], 2)]["label_ret"] == pytest.approx(math.log(close(12) / close(3)))
    assert got[(1, DAYS[0], 1)]["label_ret"] is None  # minute 11 is missing
    assert got[(1, DAYS[0], 4)]["label_ret"] is None  # minute 5 is missing
    assert got[(1, DAYS[0], 6)]["ret_1m"] == pytest.approx(math.log(close(6) / close(4)))
    assert got[(1, DAYS[1], 0)]["ret_1m"] is None  # no carry over midnight


def test_bad_lag_is_rejected(bars):
    with pytest.raises(ValueError):
        P.forward_label(bars, 5, 5)


def test_runs_and_sequences(bars):
    gappy = bars.where("MinuteIndex <> 10")
    runs = rows_of(P.contiguous_runs(gappy).where(f"StockCode = 1 AND Date = {DAYS[0]}"), "MinuteIndex")
    assert [r["run_len"] for r in runs] == [*range(1, 11), *range(1, 15)]
    seq = rows_of(P.sequence_windows(gappy, ["Close", "Vol"], 12).where(f"StockCode = 1 AND Date = {DAYS[0]}"), "MinuteIndex")
    assert [r["MinuteIndex"] for r in seq] == [22, 23, 24]
    assert all(len(r["window"]) == 12 and len(r["window"][0]) == 2 for r in seq)
    assert [round(step[1]) for step in seq[0]["window"]] == list(range(111, 123))


def test_splits(spark):
    dates = spark.createDataFrame([(d,) for d in range(1, 11)], "date int")
    split = {r["date"]: r["split"] for r in D.split_by_counts(dates, 5, 2, 3).collect()}
    assert [split[d] for d in range(1, 11)] == ["train"] * 5 + ["val"] * 2 + ["test"] * 3
    tail = {r["date"]: r["split"] for r in D.split_tail_holdout(dates, 2, 1).collect()}
    assert [tail[d] for d in range(1, 11)] == ["train"] * 7 + ["val"] * 2 + ["test"]
    with pytest.raises(ValueError):
        D.split_by_counts(dates, 9, 1, 1)
    with pytest.raises(ValueError):
        D.split_by_ranges(dates, 5, 20)
    folds = D.rolling_folds(dates, 3, 1, 1, 2).collect()
    want = {(f, d): s for f, st in enumerate(range(0, 6, 2)) for d, s in zip(range(st + 1, st + 6), ["train"] * 3 + ["val", "test"])}
    assert {(r["fold"], r["date"]): r["split"] for r in folds} == want


def test_epoch_shuffle_deals_every_epoch_anew(spark):
    df = spark.range(400).withColumnRenamed("id", "row_id")
    orders = []
    for epoch in (0, 1, 0):
        rows = D.epoch_shuffle(df.repartition(3 + epoch), ["row_id"], 3, epoch, 4).collect()
        orders.append([r["row_id"] for r in sorted(rows, key=lambda r: r["epoch_key"])])
        assert {r["shard"] for r in rows} == {0, 1, 2, 3} and len({r["epoch_key"] for r in rows}) == 400
    assert orders[0] == orders[2] != orders[1] and orders[0] != sorted(orders[0])


def test_zero_indicators_are_dropped_by_name():
    assert P.drop_zero_indicators(["ret_1m", "ret_1m_is_zero", "oc"]) == ["ret_1m", "oc"]


def test_sampling_is_repeatable(bars):
    a = D.bounded_sample(bars, 20, 1, ["StockCode", "Date", "MinuteIndex"]).select("StockCode", "Date", "MinuteIndex")
    b = D.bounded_sample(bars.repartition(7), 20, 1, ["StockCode", "Date", "MinuteIndex"]).select("StockCode", "Date", "MinuteIndex")
    assert a.exceptAll(b).count() == 0 and a.count() == 20
    c = D.bounded_sample(bars, 20, 2, ["StockCode", "Date", "MinuteIndex"]).select("StockCode", "Date", "MinuteIndex")
    assert a.exceptAll(c).count() > 0


def _panel(spark, days=12, times=6, codes=40):
    """A score that predicts the target, keyed like bars."""
    rows = spark.range(days * times * codes).select(
        (F.col("id") % codes).cast("int").alias("StockCode"), (F.floor(F.col("id") / (codes * times)) + 20210101).cast("int").alias("Date"),
        (F.floor(F.col("id") / codes) % times).cast("int").alias("MinuteIndex"), "id")
    noise = lambda k: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(10007)) / 10007.0 - 0.5)
    rows = rows.withColumn("prediction", noise(1)).withColumn("target", F.col("prediction") + noise(2))
    return rows.drop("id").cache()


def _mean_ic(df, x="prediction", y="target"):
    rows = P.with_short_keys(df).select("date", "time", "code", F.col(x).alias("prediction"), F.col(y).alias("target"))
    return I.ic_summary(I.ic_by_timestamp(rows), "rank_ic").first()["mean"]


def test_perturbed_labels_lose_the_signal(spark):
    panel = _panel(spark)
    assert _mean_ic(panel) > 0.5
    shuffled = D.shuffle_labels(panel, "target", ["Date", "MinuteIndex", "StockCode"], 3)
    assert abs(_mean_ic(shuffled)) < 0.1
    assert shuffled.agg(F.sum("target")).first()[0] == pytest.approx(panel.agg(F.sum("target")).first()[0])
    assert abs(_mean_ic(D.shift_labels_one_run(panel, "target"))) < 0.1


def test_rank_ic_invariances(spark):
    panel = _panel(spark)
    base = _mean_ic(panel)
    assert _mean_ic(panel.withColumn("prediction", -F.col("prediction"))) == pytest.approx(-base)
    assert _mean_ic(panel.withColumn("prediction", F.exp(F.col("prediction") * 3))) == pytest.approx(base)


def test_batch_score_inverts_the_label_scale(spark, bars):
    rows = P.with_short_keys(bars)
    got = D.batch_score(rows, lambda b: b["Vol"], label_scale=(1.0, 2.0))
    assert got.columns == ["date", "time", "code", "prediction"]
    assert got.agg(F.max("prediction")).first()[0] == pytest.approx(124 * 2 + 1)


def test_gaussianize_is_symmetric(spark):
    df = spark.createDataFrame([(1, 0, float(i)) for i in range(101)], "Date int, MinuteIndex int, x double")
    got = rows_of(P.cross_section_gaussianize(df, ["x"]), "x")
    assert got[50]["x_cs"] == pytest.approx(I.F and 0.0124, abs=2e-3)
    assert all(a["x_cs"] < b["x_cs"] for a, b in zip(got, got[1:]))


def test_label_audit_reasons(bars):
    dirty = bars.where("NOT (StockCode = 1 AND MinuteIndex = 12)").withColumn(
        "Close", F.when((F.col("StockCode") == 2) & (F.col("MinuteIndex") == 13), F.lit(float("nan"))).otherwise(F.col("Close")))
    row = rows_of(Q.label_audit(dirty, CFG), "Date")[0]
    assert (row["raw_absent_rows"], row["filtered_rows"]) == (1, 1)
    # Each code also lacks an entry minute once: 11 -> 12 and 12 -> 13.
    assert row["missing_entry_rows"] == 2 and row["other_rows"] == 0
