"""Exact quantiles by radix selection against sorted lists."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from panelspark.functions import radix as X

from helpers import close

EDGES = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 4.9e-324, -4.9e-324, 2.2250738585072014e-308, 2.225073858507201e-308,
         1.7976931348623157e308, -1.7976931348623157e308, 1.0000000000000002, 0.9999999999999999, float("inf"), float("-inf")]


def quantile(values, p):
    values = sorted(values)
    x = p * (len(values) - 1)
    low, high = values[math.floor(x)], values[math.ceil(x)]
    return low if low == high else low + (high - low) * (x - math.floor(x))


def near_powers():
    for e in range(-1074, 1024, 7):
        p = math.ldexp(1.0, e)
        yield from (p, math.nextafter(p, 0.0), math.nextafter(p, math.inf))


def test_keys_are_the_patterns_of_bits(spark):
    rng = random.Random(4)
    values = EDGES + list(near_powers()) + [rng.gauss(0, 1) * 10 ** rng.uniform(-300, 300) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for r in df.select("v", X.order_key("v").alias("k")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["k"] == (-bits if r["v"] < 0 else bits), r["v"]
    [odd] = spark.createDataFrame([(float("nan"), None)], "a double, b double").select(
        X.order_key("a").alias("a"), X.order_key("b").alias("b")).collect()
    assert odd["a"] > 2047 << 52 and odd["b"] is None


@pytest.mark.parametrize("kind", ["wide", "tied", "near", "third"])
def test_quantiles_equal_a_sort(spark, kind):
    rng = random.Random(9)
    make = {
        "wide": lambda: rng.choice((-1, 1)) * 10 ** rng.uniform(-200, 200), "tied": lambda: float(rng.randint(-2, 2)),
        "near": lambda: 1.0 + rng.randint(0, 400) * 2.0 ** -52, "third": lambda: 7.25 if rng.random() < 0.4 else rng.gauss(0, 1)}[kind]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v, None if i % 3 else -v) for i, v in enumerate(values)], "a double, `b.c` double").repartition(5)
    shares = {f"p{i}": p for i, p in enumerate((0.0, 0.001, 0.25, 0.5, 0.777, 0.995, 1.0))}
    [got] = X.select_quantiles(df, {"a": shares, "b.c": {f"b{n}": p for n, p in shares.items()}}).collect()
    for name, p in shares.items():
        assert close(got[name], quantile(values, p), 1e-15), (name, got[name])
        assert close(got[f"b{name}"], quantile([-v for v in values[::3]], p), 1e-15)


def test_values_without_order_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (2.0, None, 5.0), (None, None, float("inf"))], "a double, b double, c double")
    [got] = X.select_quantiles(df, {"a": {"m": 0.5}, "b": {"none": 0.5}, "c": {"low": 0.0, "mid": 0.5, "top": 1.0}}, store=False).collect()
    assert got["m"] == 1.5 and got["none"] is None
    assert got["low"] == 5.0 and got["mid"] == math.inf and math.isnan(got["top"])
    [got] = X.select_quantiles(df.where("a > 9"), {"a": {"m": 0.5}}).collect()
    assert got["m"] is None
    with pytest.raises(ValueError):
        X.select_quantiles(df, {"a": {"m": 1.5}})


def test_only_counts_are_exchanged(spark):
    df = spark.range(0, 100_000, 1, 8).select((F.col("id") * 1.25).alias("v"))
    cells = X._cells(df, ["v"])
    for bins in (X.counted_bins(cells, None, 48, 64), X.counted_bins(cells, {(0, 16560): None}, 32, 48)):
        bins.collect()
        plan = bins._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Window" not in plan
        assert "partial_count" in plan.split("Exchange")[-1]  # counted before anything is sent
        assert plan.count("Exchange hashpartitioning(_c") >= 1
    assert X.counted_bins(cells, None, 48, 64).count() < 400  # bins, not values


def test_partitioning_does_not_matter(spark):
    df = spark.range(0, 5000, 1, 4).select(F.sin(F.col("id").cast("double")).alias("v"))
    rows = {tuple(X.select_quantiles(df.repartition(n), {"v": {"a": 0.1, "b": 0.9}}).first()) for n in (1, 3, 9)}
    assert len(rows) == 1
