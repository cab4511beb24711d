"""Table functions over whole sessions."""

import random

import numpy as np
import pytest

from panelspark.functions.tables import register_session_function, register_session_metrics


def functions():
    """A model and a metric; inner functions travel to the tasks by value."""

    def decayed(session):
        value, out = 0.0, []
        for x in session["Close"]:
            value = 0.5 * value + (0.0 if x is None else x)
            out.append(value)
        return {"trend": np.array(out)}

    def longest_rise(session):
        best = run = 0
        for a, b in zip(session["Close"], session["Close"][1:]):
            run = run + 1 if b > a else 0
            best = max(best, run)
        return float(best)

    return decayed, longest_rise


decayed, longest_rise = functions()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(c, d, m, round(rng.uniform(1, 9), 2), "other") for c in (1, 2, None) for d in (5, 6) for m in range(rng.randint(1, 40))]
    rng.shuffle(data)
    spark.createDataFrame(data, "StockCode int, Date int, MinuteIndex int, Close double, noise string").repartition(
        4).createOrReplaceTempView("session_rows")
    return data


def sessions(rows):
    out = {}
    for c, d, m, close, _ in rows:
        out.setdefault((c, d), []).append((m, close))
    return {k: sorted(v) for k, v in out.items()}


def test_a_model_scores_every_row_of_whole_sessions(spark, rows):
    register_session_function(spark, "decayed", decayed, ["Close"], {"trend": "double"})
    got = {(r["StockCode"], r["Date"], r["MinuteIndex"]): r["trend"] for r in spark.sql("SELECT * FROM decayed(TABLE(session_rows))").collect()}
    want = {(*k, m): t for k, v in sessions(rows).items() for (m, _), t in zip(v, decayed({"Close": [x for _, x in v]})["trend"])}
    assert got == want


def test_metrics_give_a_row_a_session(spark, rows):
    register_session_metrics(spark, "shape", {"rise": longest_rise, "bars": lambda s: float(len(s["Close"]))}, ["Close"])
    got = spark.sql("SELECT Date, StockCode, rise, bars FROM shape(TABLE(SELECT * FROM session_rows WHERE Date = 5)) WHERE bars > 1").collect()
    want = {k: (longest_rise({"Close": [x for _, x in v]}), float(len(v))) for k, v in sessions(rows).items() if k[1] == 5 and len(v) > 1}
    assert {(r["StockCode"], r["Date"]): (r["rise"], r["bars"]) for r in got} == want


def test_only_the_columns_asked_for_are_sent(spark, rows, tmp_path):
    spark.table("session_rows").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("session_file")
    register_session_function(spark, "decayed", decayed, ["Close"], {"trend": "double"})
    plan = spark.sql("SELECT * FROM decayed(TABLE(session_file))")._jdf.queryExecution().executedPlan().toString()
    assert "noise" not in plan and plan.count("Exchange") == 1


def test_empty_tables_and_mistakes(spark, rows):
    register_session_function(spark, "decayed", decayed, ["Close"], {"trend": "double"})
    assert spark.sql("SELECT * FROM decayed(TABLE(SELECT * FROM session_rows WHERE Date = 0))").collect() == []
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM decayed(TABLE(SELECT StockCode, Date, MinuteIndex FROM session_rows))").collect()
    with pytest.raises(ValueError):
        register_session_function(spark, "bad", decayed, ["Close"], {"date": "double"})
    register_session_function(spark, "short", lambda s: {"x": [1.0]}, ["Close"], {"x": "double"})
    with pytest.raises(Exception, match="for each of the"):
        spark.sql("SELECT * FROM short(TABLE(session_rows))").collect()


def test_a_row_is_one_step():
    """Rows are kept as they come; the values of a session are touched once, when its columns are made."""
    class Udtf:
        def register(self, name, udtf):
            self.kind = udtf.func

    class Session:
        udtf = Udtf()

    class Counted(tuple):
        looked = 0

        def __iter__(self):
            Counted.looked += 1
            return super().__iter__()

    register_session_function(Session(), "f", lambda s: {"twice": [2 * x for x in s["Close"]]}, ["Close"], {"twice": "double"})
    own = Session.udtf.kind()
    for minute in range(3):
        own.eval(Counted((7, 20200101, minute, 1.5 + minute)))
    assert Counted.looked == 0
    assert list(own.terminate()) == [(7, 20200101, 0, 3.0), (7, 20200101, 1, 5.0), (7, 20200101, 2, 7.0)]
    assert Counted.looked == 3
    assert list(Session.udtf.kind().terminate()) == []
