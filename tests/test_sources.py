import json

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from panelspark.registry import MetricRegistry, default_registry
from panelspark.schema import ContractError, INFERENCE, assert_unique, require_columns
from panelspark.sources import readers as R, writers as W
from panelspark.sources.feather import ingest_feather, read_feather
from tests.helpers import avg_ranks, pearson


def test_feather_ingest(spark, tmp_path):
    for day in (20240102, 20240103):
        table = pa.table({"StockCode": pa.array([1, 2], pa.int32()), "Date": pa.array([day] * 2, pa.int32()), "Close": [1.5, day / 1e7]})
        feather.write_feather(table, str(tmp_path / f"{day}.feather"))
    df = read_feather(spark, str(tmp_path / "*.feather"))
    assert df.count() == 4 and df.schema["Close"].dataType.simpleString() == "double"
    some = read_feather(spark, f"file:{tmp_path}/*.feather", columns=["Close", "Date"])
    assert some.columns == ["Close", "Date"] and sorted(r["Close"] for r in some.collect())[0] == 1.5
    out = ingest_feather(spark, str(tmp_path / "*.feather"), str(tmp_path / "bars"))
    assert {r["trade_date"]: r["count"] for r in out.groupBy("trade_date").count().collect()} == {20240102: 2, 20240103: 2}


def test_bar_reader_prunes_dates_and_columns(spark, tmp_path):
    rows = [(1, d, m, 1.0 + m, 1.0, 1.0, 1.0, 10.0, 10.0) for d in (20240102, 20240103, 20240104) for m in range(3)]
    bars = spark.createDataFrame(rows, "StockCode int, Date int, MinuteIndex int, Open double, Close double, High double, Low double, Vol double, Amount double")
    W.write_bars(bars.withColumn("DateTime", F.lit("2024-01-02").cast("timestamp_ntz")), str(tmp_path / "b"))
    got = R.read_bars(spark, str(tmp_path / "b"), 20240103, 20240103, ["StockCode", "Open"])
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan and "ReadSchema: struct<StockCode:int,Open:double>" in plan


def test_manifest_lists_win_over_the_folder(spark, tmp_path):
    path = str(tmp_path / "pred")
    info = W.write_predictions(spark.range(10).select(F.lit(240101).alias("date"), F.col("id").cast("double").alias("prediction")).repartition(2), path)
    assert info["row_count"] == 10 and info["date_min"] == info["date_max"] == 240101 and info["chunk_count"] == 2
    spark.range(5).select(F.lit(240102).alias("date"), F.lit(0.0).alias("prediction")).write.mode("append").parquet(path)
    assert spark.read.parquet(*R.manifest_paths(spark, f"{path}/manifest.yaml")).count() == 10
    (tmp_path / "bad.yaml").write_text(json.dumps({"chunk_files": ["nowhere.parquet"]}))
    with pytest.raises(ContractError):
        R.manifest_paths(spark, str(tmp_path / "bad.yaml"))
    schema = "date int, prediction double"
    assert R.read_manifest(spark, f"file:{path}/manifest.yaml", ["prediction"], spark.createDataFrame([], schema).schema).count() == 10
    with pytest.raises(ValueError):
        W.write_predictions(spark.range(1).select(F.lit(1).alias("date")), path, mode="append")


def test_lookups_refuse_repeated_keys(spark):
    from panelspark.schema import unique_rows

    df = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "k int, x string, y int")
    assert sorted(map(tuple, unique_rows(df, ["k"]).collect())) == [(1, "a", 2), (2, None, 3)]
    with pytest.raises(Exception, match="duplicate key"):
        unique_rows(df.union(df), ["k"]).collect()


def test_files_hold_at_most_the_asked_rows(spark, tmp_path):
    info = W.write_predictions(spark.range(95).select(F.lit(240101).alias("date"), "id").coalesce(1), str(tmp_path / "p"), rows_per_file=20)
    assert info["chunk_count"] == 5


def test_inference_contract(spark, tmp_path):
    good = spark.createDataFrame([(0.1, 1, 260101, 93000)], INFERENCE)
    W.write_inference(good, str(tmp_path / "ok"))
    assert R.read_inference(spark, f"{tmp_path}/ok/*.parquet").collect() == good.collect()
    good.withColumn("target", F.lit(1.0)).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ContractError):
        R.read_inference(spark, f"{tmp_path}/bad/*.parquet")
    with pytest.raises(ContractError):
        W.write_inference(good.drop("code"), str(tmp_path / "never"))


def test_column_and_key_checks(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert require_columns(df, ["b", "a"]) is df
    with pytest.raises(ContractError):
        require_columns(df, ["b", "a"], exact=True)
    assert assert_unique(df, ["a", "b"]) is df
    with pytest.raises(ContractError):
        assert_unique(df, ["a"])


def test_reuse_or_build(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert W.reuse_or_build(spark, path, {"v": 1}, build).count() == 3
    assert W.reuse_or_build(spark, path, {"v": 1}, build).count() == 3
    assert built == [1]
    with pytest.raises(ContractError):
        W.reuse_or_build(spark, path, {"v": 2}, build)
    W.require_artifacts(spark, [path])
    with pytest.raises(ContractError):
        W.require_artifacts(spark, [path, f"{path}-missing"])


def test_export_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "metric string, value double")
    W.export_table(df, f"{tmp_path}/x.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/x.csv").count() == 2
    with pytest.raises(ValueError):
        W.export_table(df, f"{tmp_path}/x.xls")
    W.write_metrics(df, f"{tmp_path}/m")
    assert [r["metric"] for r in spark.read.json(f"{tmp_path}/m").collect()] == ["a", "b"]


def test_registry(spark):
    rows = [(0.1, 0.2), (0.4, 0.1), (0.4, 0.5), (0.9, 0.4), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "prediction double, target double")
    got = {r["metric"]: r["value"] for r in default_registry().evaluate(df, "val").collect()}
    x, y = [r[0] for r in rows[:4]], [r[1] for r in rows[:4]]
    assert got["val/quality/global_ic"] == pytest.approx(pearson(x, y))
    assert got["val/quality/rank_ic"] == pytest.approx(pearson(avg_ranks(x), avg_ranks(y)))
    assert got["val/objective/mse"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(x, y)) / 4)
    reg = MetricRegistry().register("n", lambda p, t: F.count(p))
    with pytest.raises(ValueError):
        reg.register("n", lambda p, t: F.count(t))
    with pytest.raises(KeyError):
        reg.evaluate(df, "val", ["other"])
