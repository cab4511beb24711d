"""Panel tables derived from the given tables.

Line items play the trades: a supplier is a code, a ship month a trade date,
two days of the month one minute. Codes grow with the data, so every derived
table does. Each DataFrame here has a CTE of the same content in ``sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import features as P, market as M
from ..session import stored
from ..settings import FeatureSettings, MarketSettings

# Sessions of 16 minutes instead of 240; windows and horizons shrink alike.
LAST = 15
FEATURES = FeatureSettings(return_lags=(1, 2, 3), vol_window=3, mean_window=3, horizon=4, entry_lag=1, last_index=LAST, warmup=2)
MARKET = MarketSettings(entry_delay=1, holding=4, slot_mod=4, adv_days=5, sigma_window=5, sigma_min_count=2)
MIN_NAMES = 5
GRID = 2
ROLL_WINDOW, ROLL_STEP = 8, 2
ICIR_DAYS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return lineitem(spark, sf).select(
        F.col("l_suppkey").cast("int").alias("StockCode"),
        ((F.year("l_shipdate") + 20) * 10000 + F.month("l_shipdate") * 100 + 1).cast("int").alias("Date"),
        F.floor((F.day("l_shipdate") - 1) / 2).cast("int").alias("MinuteIndex"),
        (F.lit(100.0) + F.lit(20.0) * unit / (unit + F.lit(3000.0))).alias("px"),
        F.col("l_quantity").alias("qty"), "l_shipdate", "l_orderkey", "l_linenumber")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    # The order of trades inside a bar as one number (day, order, line, price):
    # a numeric key keeps min_by/max_by in hash aggregation.
    line = F.shiftleft(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 23)
    order = (F.shiftleft(((F.day("l_shipdate") - 1) % 2).cast("bigint"), 62) + line
             + F.floor((F.col("px") - 100) / 20 * 8388608).cast("bigint"))
    # Nearly every bar is one trade: the narrow trades are moved, to their sessions, not states of six aggregates each.
    rows = trades(spark, sf).withColumn("_order", order).select("StockCode", "Date", "MinuteIndex", "px", "qty", "_order")
    rows = rows.repartition("StockCode", "Date")
    return rows.groupBy("StockCode", "Date", "MinuteIndex").agg(
        F.min_by("px", "_order").alias("Open"), F.max_by("px", "_order").alias("Close"),
        F.max("px").alias("High"), F.min("px").alias("Low"), F.sum("qty").alias("Vol"),
        F.round(F.sum(F.col("px") * F.col("qty")), 6).alias("Amount"))


def dirty_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars in which some closes are missing, NaN, infinite or zero."""
    k = (F.col("StockCode") + F.col("Date") + F.col("MinuteIndex") * 5) % 17
    close = (F.when(k == 0, F.lit(None).cast("double")).when(k == 1, float("nan")).when(k == 2, float("inf"))
             .when(k == 3, 0.0).when(k == 4, float("-inf")).otherwise(F.col("Close")))
    return bars(spark, sf).withColumn("Close", close)


def score() -> "F.Column":
    """Deterministic score with 50 levels, so ties occur."""
    mix = (F.col("StockCode").cast("bigint") * 7919 + F.col("Date").cast("bigint") * 31 + F.col("MinuteIndex") * 104729) % 50
    return mix.cast("double") / 50 - 0.5


def pred(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    rows = bars(spark, sf) if source is None else source
    return P.with_short_keys(rows).select("date", "time", "code", score().alias("prediction"))


def daily(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    rows = bars(spark, sf) if source is None else source
    return (rows.withColumnRenamed("StockCode", "code").groupBy("code", "Date").agg(
        F.max("High").alias("up_limit"), F.min("Low").alias("down_limit"), F.sum("Amount").alias("_s"))
        .select("code", "Date", "up_limit", "down_limit",
                F.when((F.col("code") + F.col("Date")) % 11 == 0, 0.0).otherwise(F.round("_s", 6)).alias("daily_amount")))


def st_periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(3, 20150301, 20160615), (7, 20180101, 99991231)], "code int, start_date int, end_date int")


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Trade dates straight from the raw rows: no bars are built for it."""
    return trades(spark, sf).select("Date").distinct()


def xsec(spark: SparkSession, sf: str) -> DataFrame:
    """One cross-section per ship date: supplier means of discount and tax."""
    day = ((F.year("l_shipdate") + 20) % 100 * 10000 + F.month("l_shipdate") * 100 + F.day("l_shipdate")).cast("int")
    return lineitem(spark, sf).groupBy(day.alias("date"), F.col("l_suppkey").cast("int").alias("code")).agg(
        F.round(F.avg("l_discount"), 6).alias("prediction"), F.round(F.avg("l_tax") - 0.04, 6).alias("target"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount")).withColumn("time", F.lit(93000))


def labeled(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    """Scores with the forward label as target, for time-of-day operators."""
    rows = bars(spark, sf) if source is None else source
    rows = P.forward_label(rows, FEATURES.horizon, FEATURES.entry_lag)
    return (P.with_short_keys(rows).select("date", "time", "code", score().alias("prediction"), F.col("label_ret").alias("target"))
            .where(F.col("target").isNotNull()))


def state(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    rows = stored(bars(spark, sf)) if source is None else source
    st = M.active_days(st_periods(spark), rows.select("Date").distinct())
    return M.market_state(rows, daily(spark, sf, rows), st, MARKET)


def feats(spark: SparkSession, sf: str) -> DataFrame:
    """Execution features, stored once as a backtest would store them."""
    rows = stored(bars(spark, sf))
    return stored(M.execution_features(pred(spark, sf, rows), state(spark, sf, rows), MARKET))


def tidy(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Round floating columns for comparison; NaN and infinities become NULL.

    A nudge far below the last digit moves exact decimal ties off the edge,
    where two engines would round last-bit differences apart.
    """
    from ..functions.scalar import clean

    def rounded(name: str):
        d = special.get(name, digits)
        return F.round(clean(name) + F.lit(float(f"1.7e-{d + 3}")), d) + F.lit(0.0)

    return df.withColumns({
        f.name: rounded(f.name) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})
