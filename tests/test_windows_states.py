"""Window blocks, prefix-sum windows, ranks in overlapping groups, stored states and the Feather source."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.ranks import add_member_ranks
from panelspark.operators import datasets as D, ic as I, partials
from panelspark.operators.windows import window_blocks
from panelspark.sources.feather_source import FeatherSource, write_feather
from panelspark.sources.files import file_versions

from tests.helpers import avg_ranks, pearson, rows_of


def gappy(spark, sessions=6, minutes=40, seed=5):
    rng = random.Random(seed)
    data = [(c, 20240101 + c % 2, m, float(c * 1000 + m), rng.random() if rng.random() > 0.05 else None)
            for c in range(sessions) for m in range(minutes) if rng.random() > 0.06]
    return spark.createDataFrame(data, "StockCode int, Date int, MinuteIndex int, Close double, Vol double"), data


@pytest.mark.parametrize("length, block", [(1, 4), (3, 4), (7, 2), (12, 512)])
def test_window_blocks_hold_every_gap_free_window(spark, length, block):
    df, data = gappy(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)  # runs cross batches
    try:
        blocks = window_blocks(df, ["Close", "Vol"], length, ["StockCode", "Date", "MinuteIndex"], block)
        found = {}
        for r in blocks.collect():
            steps = np.array(r.steps, np.float32).reshape(-1, 2)
            assert len(steps) == len(r.ends) + length - 1 and len(r.ends) <= block
            for i, e in enumerate(r.ends):
                found[tuple(e)] = steps[i : i + length]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {(c, d, m): (x, v) for c, d, m, x, v in data}
    want = {k: [at[k[0], k[1], k[2] - length + 1 + i] for i in range(length)] for k in at
            if all((k[0], k[1], k[2] - i) in at for i in range(length))}
    assert found.keys() == want.keys()
    for k, steps in want.items():
        expected = np.array([[x, math.nan if v is None else v] for x, v in steps], np.float32)
        assert np.array_equal(found[k], expected, equal_nan=True)


def test_blocks_add_little_to_the_rows_and_no_list_per_row(spark):
    rows = spark.range(3000).select(F.lit(1).alias("StockCode"), F.lit(20240101).alias("Date"), F.col("id").cast("int").alias("MinuteIndex"),
                                    F.col("id").cast("double").alias("Close"))
    blocks = window_blocks(rows, ["Close"], 60, ["MinuteIndex"])
    assert "collect_list" not in blocks._jdf.queryExecution().toString()
    total = blocks.agg(F.sum(F.size("steps")), F.sum(F.size("ends"))).first()
    assert total[0] < 1.2 * 3000 and total[1] == 3000 - 59
    scored = D.batch_score(rows, lambda w: w[:, 0, 0] + w[:, -1, 0], ["MinuteIndex"], (1.0, 2.0), ["Close"], 60)
    assert {r.MinuteIndex: r.prediction for r in scored.collect()} == {m: (2 * m - 59) * 2.0 + 1.0 for m in range(59, 3000)}
    assert D.batch_score(rows.where("false"), lambda w: w[:, 0, 0], ["MinuteIndex"], None, ["Close"], 60).count() == 0
    with pytest.raises(ValueError):
        D.batch_score(rows, lambda w: w[:, 0, 0], length=60)


@pytest.mark.parametrize("plan", ["window", "ranged"])
@pytest.mark.parametrize("window, step", [(7, 1), (8, 3), (2, 5)])
def test_prefix_windows_at_any_step(spark, monkeypatch, plan, window, step):
    monkeypatch.setattr(I, "SCAN_PIECE", 8)  # windows cross pieces
    rng = random.Random(window)
    # Long stretches of one value: windows without variance must have no correlation.
    data = [(1, 1, c, float(c // 10 % 3), rng.gauss(1e6, 1), float(c // 2)) for c in range(60)]
    df = spark.createDataFrame(data, "date int, time int, code int, prediction double, target double, label double")
    got = rows_of(I.rolling_group_ic_rows(df, "label", window, step, ["code"], plan=plan), "window_start")
    order = sorted(data, key=lambda r: (r[5], r[2]))
    x, y = [r[3] for r in order], [r[4] for r in order]
    rx, ry = avg_ranks(x), avg_ranks(y)
    assert [r["window_start"] for r in got] == list(range(0, 60 - window + 1, step))
    for r in got:
        s = slice(r["window_start"], r["window_start"] + window)
        for name, a, b in (("mean_ic", x[s], y[s]), ("mean_rank_ic", rx[s], ry[s])):
            want = None if len(set(a)) == 1 or len(set(b)) == 1 else pearson(a, b)
            assert r[name] is None if want is None else r[name] == pytest.approx(want, abs=1e-7)
        assert r["label_left"] == order[r["window_start"]][5] and r["label_center"] == order[r["window_start"] + window // 2][5]


def test_ranks_in_overlapping_groups(spark):
    rng = random.Random(11)
    data = [(rng.choice([1.0, 2.0, 3.0, None]), float(rng.randint(0, 40)), rng.random() < 0.5, rng.random() < 0.1, False) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, x double, y double, a boolean, b boolean, c boolean")
    got = rows_of(add_member_ranks(df, {"x": "rx", "y": "ry"}, ["a", "b", "c"]), "i")
    for place, name in ((0, "rx"), (1, "ry")):
        for g in range(3):
            inside = [i for i, r in enumerate(data) if r[2 + g] and r[place] is not None]
            want = dict(zip(inside, avg_ranks([data[i][place] for i in inside])))
            assert {r["i"]: r[name][g] for r in got if r[name][g] is not None} == want


def test_states_merge_to_the_whole(spark, tmp_path):
    rng = random.Random(1)
    data = [(d, rng.choice([rng.gauss(1e3, 1), math.nan, math.inf, None, 4.0]), 7.0) for d in range(6) for _ in range(50)]
    df = spark.createDataFrame(data, "Date int, a double, b double")
    path = str(tmp_path / "states")
    partials.update_states(partials.day_states(df.where("Date < 5").withColumn("b", F.when(F.col("Date") == 2, 0.0).otherwise(F.col("b"))), ["a", "b"]), path)
    for _ in range(2):  # a corrected day and a new one, sent twice
        states = partials.update_states(partials.day_states(df.where("Date in (2, 5)"), ["a", "b"]), path)
    got = {r["field"]: r for r in rows_of(partials.moments(states), "field")}
    values = np.array([v for _, v, _ in data if v is not None and math.isfinite(v)])
    z = values - values.mean()
    assert got["a"]["count"] == len(values) and got["a"]["mean"] == pytest.approx(values.mean())
    assert got["a"]["std"] == pytest.approx(values.std()) and (got["a"]["least"], got["a"]["greatest"]) == (values.min(), values.max())
    assert got["a"]["skew"] == pytest.approx((z**3).mean() / (z**2).mean() ** 1.5)
    assert got["a"]["kurtosis"] == pytest.approx((z**4).mean() / (z**2).mean() ** 2 - 3)
    assert (got["b"]["mean"], got["b"]["std"], got["b"]["skew"]) == (7.0, 0.0, None)
    assert sum(r["count"] for r in rows_of(partials.histogram(states), "field", "bin")) == len(values) + 300
    assert partials.zscore_params(states)["b"] == (7.0, 0.0)
    assert partials.moments(states.where("false")).count() == 0


def test_feather_source(spark, tmp_path):
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("name"), (F.col("id") / 7).alias("x")).repartition(3)
    folder = f"file:{tmp_path}/bars"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert write_feather(rows, folder).agg(F.sum("rows")).first()[0] == 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.dataSource.register(FeatherSource)
    back = spark.read.format("panel_feather").option("batches", 2).load(folder)
    assert back.schema.names == ["id", "name", "x"] and back.rdd.getNumPartitions() > 3
    assert sorted(back.collect()) == sorted(rows.collect())
    some = spark.read.format("panel_feather").schema("x double, id bigint").load(folder)
    assert some.agg(F.sum("id")).first()[0] == 499500
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("panel_feather").schema("y int").load(folder).collect()


def test_versions_of_files_change_with_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    files = spark.read.parquet(path).inputFiles()
    first = file_versions(spark, files)
    assert [f for f, *_ in first] == sorted(files) and first == file_versions(spark, files)
    name = next(n for n in os.listdir(path) if n.endswith(".parquet"))
    os.utime(os.path.join(path, name), (1, 1))
    assert file_versions(spark, files) != first
