import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions import ranks as R, stats as T
from panelspark.operators import ic as I
from tests.helpers import assert_same, avg_ranks, rows_of

NAMES = {"rank": "rank", "avg": "avg", "pct": "pct", "cume": "cume", "percent": "percent", "n": "n"}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    # Group 0 holds most rows and one value most of those.
    rows = []
    for i in range(1500):
        g = 0 if rng.random() < 0.7 else rng.randint(1, 6)
        v = 1.0 if rng.random() < 0.4 else (None if rng.random() < 0.03 else round(rng.gauss(0, 2), 1))
        rows.append((g, i, v))
    return spark.createDataFrame(rows, "g int, id int, v double").cache()


@pytest.mark.parametrize("keys", [["g"], []])
def test_value_ranks_agree(table, keys):
    a = R.add_value_ranks(table, keys, "v", NAMES, plan="window")
    b = R.add_value_ranks(table, keys, "v", NAMES, plan="ranged")
    assert_same(rows_of(a, "id"), rows_of(b, "id"))


def test_value_ranks_against_counting(table):
    got = rows_of(R.add_value_ranks(table.where("g = 3"), ["g"], "v", NAMES, plan="ranged"), "id")
    ranked = [r for r in got if r["v"] is not None]
    assert [r["avg"] for r in ranked] == avg_ranks([r["v"] for r in ranked])
    assert all(r["n"] == len(ranked) for r in ranked)
    assert all(r["avg"] is None and r["rank"] is None for r in got if r["v"] is None)


@pytest.mark.parametrize("keys", [["g"], []])
def test_positions_agree(table, keys):
    def run(plan):
        out = R.add_positions(table, keys, [("v", False), "id"], "rn", "n", {"t3": 3, "t10": 10}, plan)
        return rows_of(out, "id")

    assert_same(run("window"), run("ranged"))


def test_plans_have_one_schema(table):
    made = {
        "ranks": lambda p: R.add_value_ranks(table, ["g"], "v", NAMES, p),
        "many": lambda p: R.add_ranks_of(table, ["g"], {"v": NAMES}, p),
        "positions": lambda p: R.add_positions(table, ["g"], [("v", False), "id"], "rn", "n", {"t": 3}, p),
        "stats": lambda p: R.add_group_stats(table, ["g"], {"s": F.sum("v"), "c": F.count("v")}, p),
        "quantiles": lambda p: R.group_quantiles(table, ["g"], "v", {"a": 0.5}, p),
    }
    for name, make in made.items():
        assert make("window").dtypes == make("ranged").dtypes, name


def test_ranks_of_several_columns(table):
    df = table.withColumn("w", F.when(F.col("id") % 7 > 0, (F.col("id") % 13).cast("double"))).withColumn("tag", F.lit("x"))
    names = {"v": {"avg": "av", "n": "nv"}, "w": {"avg": "aw", "pct": "pw"}}
    for keys in (["g"], []):
        one = df
        for value in names:
            one = R.add_value_ranks(one, keys, value, names[value], "ranged")
        for plan in ("window", "ranged"):
            got = R.add_ranks_of(df, keys, names, plan)
            assert got.columns == one.columns
            assert_same(rows_of(got, "id"), rows_of(one, "id"))


def test_pooled_ic_ranks_both_columns_in_one_pass(table, monkeypatch):
    passes = []
    real = R._with_running_total
    monkeypatch.setattr(R, "_with_running_total", lambda *a, **k: passes.append(1) or real(*a, **k))
    df = table.select(F.col("v").alias("prediction"), (F.col("id") % 11).cast("double").alias("target"))
    out = I.pooled_ic(df)
    assert len(passes) == 1 and out.first()["count"] > 1000
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2  # cells with ranks, pieces with totals


def test_quantiles_of_several_columns(table):
    df = table.withColumn("w", (F.col("id") % 13).cast("double"))
    got = R.column_quantiles(df, {"v": {"a": 0.1, "b": 0.5}, "w": {"c": 0.99}}).first()
    want = [R.group_quantiles(df, [], c, {"x": p}, "window").first()["x"] for c, p in (("v", 0.1), ("v", 0.5), ("w", 0.99))]
    assert list(got) == pytest.approx(want)


def test_ntile_with_fewer_rows_than_tiles(spark):
    df = spark.range(4).withColumn("g", F.lit(1))
    for plan in ("window", "ranged"):
        got = rows_of(R.add_positions(df, ["g"], ["id"], tiles={"t": 10}, plan=plan), "id")
        assert [r["t"] for r in got] == [1, 2, 3, 4]


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_agree(table, keys):
    points = {"a": 0.0, "b": 0.1, "c": 0.333, "d": 0.5, "e": 0.995, "f": 1.0}
    a = R.group_quantiles(table, keys, "v", points, plan="window")
    b = R.group_quantiles(table, keys, "v", points, plan="ranged")
    order = keys or ["a"]
    assert_same(rows_of(a, *order), rows_of(b, *order))


def test_group_stats_agree(table):
    stats = {"s": F.sum("v"), "n": F.count("v")}
    a = R.add_group_stats(table, ["g"], stats, plan="window")
    b = R.add_group_stats(table, ["g"], stats, plan="ranged")
    assert_same(rows_of(a, "id"), rows_of(b, "id"))


def test_empty_input(table):
    none = table.where("id < 0")
    for plan in ("window", "ranged"):
        assert R.add_value_ranks(none, ["g"], "v", {"avg": "a"}, plan).count() == 0
        assert R.add_positions(none, [], ["id"], rn="rn", plan=plan).count() == 0


def test_keys_choose_the_plan():
    assert R.choose_plan([]) == R.choose_plan(["year"]) == R.choose_plan(["tag"]) == "ranged"
    assert R.choose_plan(["date", "time"]) == R.choose_plan(["Date", "StockCode"]) == "window"
    assert R.choose_plan(["date"], "ranged") == "ranged" and R.choose_plan([], "window") == "window"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_rank_never_gathers_rows_in_one_task(table):
    out = R.add_value_ranks(table, [], "v", {"avg": "a"})
    lines = plan_text(out).splitlines()
    singles = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    # Only the per-piece totals meet in one task: one row per piece.
    for i in singles:
        assert any("HashAggregate(keys=[_pid" in line for line in lines[i + 1:i + 3]), lines[i:i + 3]


def test_partition_count_does_not_matter(spark, table):
    want = rows_of(R.add_value_ranks(table, ["g"], "v", NAMES, plan="ranged"), "id")
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = rows_of(R.add_value_ranks(table.repartition(n), ["g"], "v", NAMES, plan="ranged"), "id")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert_same(want, got)


def test_pearson_edge_cases(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 1.0), ("nan", float("nan"), 1.0), ("nan", 1.0, 2.0),
            ("nan", 2.0, 4.0), ("nan", float("inf"), 1.0), ("up", 1.0, 1.0), ("up", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["c"] for r in df.groupBy("g").agg(T.pearson("x", "y").alias("c")).collect()}
    assert got["flat"] is None and got["one"] is None
    assert got["nan"] == pytest.approx(1.0) and got["up"] == pytest.approx(1.0)


def test_equal_candidates_tie_in_any_order(spark):
    """Two candidates with the same errors, summed in opposite orders."""
    import random

    from panelspark.operators import signal

    rng = random.Random(3)
    errors = [round(rng.uniform(0, 0.1), 4) for _ in range(400)]
    rows = [(c, e, 0.0) for c, part in (("a", errors), ("b", errors[::-1]), ("c", sorted(errors))) for e in part]
    df = spark.createDataFrame([*rows, ("d", 1.0, 0.0)], "model string, prediction double, target double").coalesce(1)
    ranks = {r["model"]: r["metric_rank"] for r in signal.best_candidate(signal.mse(df, ["model"])).collect()}
    assert ranks == {"a": 1, "b": 1, "c": 1, "d": 4}


def test_exact_avg_over_magnitudes(spark):
    from panelspark.functions import stats

    for values in ([1e-9, 3e-9], [1e12, 3e12], [0.0, 0.0], [None, 2.0], [-5e8, 5e8]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = df.agg(stats.exact_avg("v").alias("m"), F.avg("v").alias("w")).first()
        assert math.isclose(got["m"], got["w"], rel_tol=1e-12, abs_tol=1e-30)
