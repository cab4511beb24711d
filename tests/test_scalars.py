import statistics

import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalar as S, stats as T


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_calendar_round_trip(spark):
    df = spark.range(240).select(F.col("id").cast("int").alias("m"))
    got = df.select("m", S.session_minute(S.minute_time("m")).alias("back")).collect()
    assert all(r["m"] == r["back"] for r in got)
    row = one(spark, S.session_minute(F.lit(113000)).alias("noon"), S.session_minute(F.lit(145900)).alias("last"),
              S.full_date(F.lit(240229)).alias("full"), S.short_date(F.lit(20240229)).alias("short"),
              S.year_of(F.lit(240229)).alias("y1"), S.year_of(F.lit(20240229)).alias("y2"))
    assert row.asDict() == {"noon": None, "last": 239, "full": 20240229, "short": 240229, "y1": 2024, "y2": 2024}


def test_timestamp_encodings(spark):
    row = one(spark, S.timestamp_key(F.lit(240229), F.lit(93015), False).cast("string").alias("a"),
              S.timestamp_key(F.lit(19782), F.lit(34215), True).cast("string").alias("b"))
    assert row["a"] == "2024-02-29 09:30:15" == row["b"]
    assert S.uses_epoch_days(19782) and not S.uses_epoch_days(240229)


@pytest.mark.parametrize("p", [1e-9, 0.001, 0.07, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9])
def test_inverse_normal(spark, p):
    assert one(spark, S.inverse_normal(F.lit(p)).alias("z"))["z"] == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-12)


def test_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (0.0,)], "x double")
    assert [r["f"] for r in df.select(S.is_finite("x").alias("f")).collect()] == [False, False, False, False, True]
    assert df.select(F.count(S.clean("x")).alias("n")).first()["n"] == 1
    assert one(spark, S.ratio(F.lit(1.0), F.lit(0.0)).alias("r"))["r"] is None


def test_rank_bin_rounds_half_even(spark):
    got = [one(spark, S.rank_bin(F.lit(v)).alias("b"))["b"] for v in (0.0005, 0.0015, 0.0025, 0.1234)]
    assert got == [0, 2, 2, 123]


def test_moments_match_definitions(spark):
    xs = [1.0, 2.0, 4.0, 8.0, 9.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    n, mu = len(xs), sum(xs) / len(xs)
    m2, m3, m4 = (sum((x - mu) ** k for x in xs) / n for k in (2, 3, 4))
    g1, g2 = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    row = df.agg(T.skew("x").alias("a"), T.skew("x", False).alias("b"), T.excess_kurtosis("x").alias("c"),
                 T.excess_kurtosis("x", False).alias("d")).first()
    assert row["a"] == pytest.approx(g1) and row["c"] == pytest.approx(g2)
    assert row["b"] == pytest.approx(g1 * (n * (n - 1)) ** 0.5 / (n - 2))
    assert row["d"] == pytest.approx((n - 1) * ((n + 1) * g2 + 6) / ((n - 2) * (n - 3)))
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double").agg(T.skew("x").alias("s"), T.t_stat("x").alias("t")).first()
    assert flat["s"] is None and flat["t"] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-9.0,), (-5.0,), (0.0,), (4.99,), (5.0,), (99.0,)], "x double")
    assert [r["b"] for r in df.select(T.histogram_bin("x").alias("b")).collect()] == [1, 1, 41, 80, 80, 80]
