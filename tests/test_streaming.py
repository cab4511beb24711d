import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators.positions import band_state
from panelspark.streaming import jobs as X
from tests.helpers import assert_same, rows_of


def at(minute, second=0):
    return dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=minute, seconds=second)


def test_days_are_ingested_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    day = lambda d: spark.range(3).select(F.col("id").cast("int").alias("StockCode"), F.lit(d).alias("Date"))
    schema = day(1).schema
    day(20240102).write.mode("append").parquet(src)
    assert X.ingest_days(spark, src, schema, out, chk).count() == 3
    day(20240103).write.mode("append").parquet(src)
    table = X.ingest_days(spark, src, schema, out, chk)
    assert {r["trade_date"]: r["count"] for r in table.groupBy("trade_date").count().collect()} == {20240102: 3, 20240103: 3}


def test_resent_days_replace_themselves_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    schema = "Date int, code int, x int, version int"

    def send(rows, progress=chk):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        table = X.ingest_versions(spark, src, spark.createDataFrame([], schema).schema, out, progress, files_per_trigger=1)
        return sorted((r["Date"], r["code"], r["x"], r["version"]) for r in table.collect())

    first = [(d, c, c, 1) for d in (1, 2) for c in range(5)]
    assert send(first) == first  # a version in several files and batches is whole
    assert send([(2, 7, 70, 2), (2, 8, 80, 2)]) == first[:5] + [(2, 7, 70, 2), (2, 8, 80, 2)]
    assert send([(2, 9, 90, 3), (None, 1, 1, 9)]) == first[:5] + [(2, 9, 90, 3)]
    assert send([(2, 5, 50, 1), (3, 1, 1, None)]) == first[:5] + [(2, 9, 90, 3), (3, 1, 1, 0)]  # late and old
    # A batch whose progress was lost runs again and overwrites only its own partitions.
    import pathlib

    last = max((p for p in pathlib.Path(chk, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    pathlib.Path(chk, "commits", f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()
    assert send([(4, 1, 1, 1)]) == first[:5] + [(2, 9, 90, 3), (3, 1, 1, 0), (4, 1, 1, 1)]


def test_bars_drop_late_ticks(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "ts timestamp_ntz, user_id int, value double"
    spark.createDataFrame([(at(0, 1), 1, 5.0), (at(0, 30), 1, 7.0), (at(0, 59), 1, 6.0), (at(30), 1, 9.0)], schema).coalesce(1).write.mode("append").parquet(src)
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    stream = lambda: X.bars_from_events(X.read_stream(spark, src, spark.createDataFrame([], schema).schema))
    first = rows_of(X.run_available(stream(), out, chk), "bar_start")
    assert [(r["Open"], r["Close"], r["High"], r["Low"], r["Vol"], r["Amount"]) for r in first] == [(5.0, 6.0, 7.0, 5.0, 3.0, 18.0)]
    # A tick for the closed minute comes too late; one within the delay counts.
    spark.createDataFrame([(at(0, 45), 1, 99.0), (at(25), 1, 4.0), (at(90), 1, 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    rows = rows_of(X.run_available(stream(), out, chk), "bar_start")
    assert [r["Open"] for r in rows] == [5.0, 4.0, 9.0]


def test_running_ic_equals_batch(spark, tmp_path):
    rows = [(at(m, s), float(s % 7), float((s * 3 + m) % 11)) for m in range(5) for s in range(0, 60, 4)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, prediction double, target double")
    src = str(tmp_path / "src")
    df.union(spark.createDataFrame([(at(60), 0.0, 0.0)], df.schema)).repartition(5).write.parquet(src)
    got = X.run_available(X.running_ic(X.read_stream(spark, src, df.schema)), str(tmp_path / "out"), str(tmp_path / "chk"))
    assert_same(rows_of(got, "start"), rows_of(X.running_ic(df), "start"))


def band_rows(spark, seed=8):
    import random

    rng = random.Random(seed)
    rows = []
    for d in (1, 2):
        for b in range(1, 9):
            for c in range(6):
                if rng.random() < 0.85:
                    s = rng.random()
                    rows.append((c, d, b, dt.datetime(2024, 1, d, 9, 30) + dt.timedelta(minutes=b), s > 0.7, s > 0.35))
    return rows, "code int, date int, bar int, ts timestamp_ntz, enter boolean, hold boolean"


def run_bands(spark, tmp_path, parts, schema, delay, files=1):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    empty = spark.createDataFrame([], schema)
    done = X.run_available(X.band_state_stream(X.read_stream(spark, src, empty.schema, files), delay=delay), out, chk)
    return done, X.close_bands(done, spark.read.schema(empty.schema).parquet(src), delay=delay)


def assert_bands(spark, got, rows, schema):
    want = band_state(spark.createDataFrame(rows, schema), ["date", "code"], "bar", F.col("enter"), F.col("hold")).select("code", "date", "bar")
    got = got.select("code", "date", "bar")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 5


def test_band_state_in_any_file_order(spark, tmp_path):
    rows, schema = band_rows(spark)
    parts = [[r for r in rows if r[1] == d and r[2] in (lo, lo + 1)] for d in (1, 2) for lo in (1, 3, 5, 7)]
    for name, order in (("forward", [0, 1, 2, 3, 4, 5, 6, 7]), ("reversed", [3, 2, 1, 0, 7, 6, 5, 4])):
        folder = tmp_path / name
        done, whole = run_bands(spark, folder, [parts[i] for i in order], schema, "10 minutes")
        assert 0 < done.count() < whole.count()  # the stream itself emits what the watermark has passed
        assert_bands(spark, whole, rows, schema)


def test_band_state_whole_and_bar_by_bar(spark, tmp_path):
    rows, schema = band_rows(spark, 3)
    _, whole = run_bands(spark, tmp_path / "once", [rows], schema, "10 minutes", files=None)
    assert_bands(spark, whole, rows, schema)
    four = [(1, 1, b, dt.datetime(2024, 1, 1, 9, 30 + b), b == 1, True) for b in (1, 2, 3, 4)]
    _, late = run_bands(spark, tmp_path / "late", [four[2:], four[:2]], schema, "10 minutes")
    assert sorted(r["bar"] for r in late.collect()) == [1, 2, 3, 4]


def test_finished_streams_are_closed(spark, tmp_path):
    rows = [(at(m, s), float(s % 7), float((s * 3 + m) % 11)) for m in range(30) for s in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, prediction double, target double")
    src = str(tmp_path / "src")
    df.repartition(3).write.parquet(src)
    done = X.run_available(X.running_ic(X.read_stream(spark, src, df.schema)), str(tmp_path / "out"), str(tmp_path / "chk"))
    whole = X.close_windows(done, spark.read.schema(df.schema).parquet(src), X.running_ic)
    assert done.count() < 30 and whole.count() == 30
    assert_same(rows_of(whole, "start"), rows_of(X.running_ic(df), "start"))


def test_years_in_many_files_lose_nothing(spark):
    from panelspark.workload import load

    queries, _ = load()
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a year is four files
    try:
        got = queries["stream_band_state"](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = queries["band_state"](spark, sf).collect()
    pick = lambda rows: sorted((r["date"], r["code"], r["bar"]) for r in rows)
    assert len(want) > 100 and pick(got) == pick(want)
