"""Market state around each bar and the execution features of each signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S
from ..schema import EXECUTION_COLUMNS, unique_rows
from ..session import stored
from ..settings import MarketSettings
from .features import SESSION


def attach_daily(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily columns onto bars, by (code, Date); bars without a daily row stay.

    A (code, Date) that repeats in ``daily`` fails the job.
    """
    return bars.join(unique_rows(daily.withColumnRenamed("code", "StockCode"), SESSION), list(SESSION), "left")


def active_covers(periods: DataFrame) -> DataFrame:
    """(code, start_date, end_date): the days on which any interval of a code is open, as disjoint closed intervals.

    A sweep over the ends of the intervals: each start counts one up, each end
    one down after its day, and a cover lasts from the first start to where
    the running count is zero again. A missing start or end is open; an
    interval that ends before it starts has no days. One shuffle on code.
    """
    start, end = F.coalesce("start_date", F.lit(0)), F.least("end_date", F.lit(99991231))
    events = periods.withColumns({"_a": start, "_b": end}).where(F.col("_a") <= F.col("_b")).select(
        "code", F.inline(F.array(F.struct(F.col("_a").alias("_at"), F.lit(1).alias("_step")),
                                 F.struct(F.col("_b").alias("_at"), F.lit(-1).alias("_step")))))
    # Of one day the starts come first: intervals are closed.
    swept = Window.partitionBy("code").orderBy("_at", F.desc("_step"))
    counted = events.withColumn("_open", F.sum("_step").over(swept.rowsBetween(Window.unboundedPreceding, 0)))
    edges = counted.where((F.col("_open") == 0) | ((F.col("_open") == 1) & (F.col("_step") == 1)))
    paired = edges.withColumn("_end", F.lead("_at").over(swept))
    return paired.where(F.col("_step") == 1).select("code", F.col("_at").alias("start_date"), F.col("_end").alias("end_date"))


def active_days(periods: DataFrame, calendar: DataFrame) -> DataFrame:
    """(code, Date) pairs on which an interval [start_date, end_date] is open.

    The covers of a code are disjoint, so each pair comes once; the dates of
    the calendar travel as one array, a number a trade date.
    """
    dates = calendar.select(F.collect_set(F.col("Date").cast("int")))
    laid = active_covers(periods).withColumn("_dates", dates.scalar())
    inside = F.filter("_dates", lambda d: (d >= F.col("start_date")) & (d <= F.col("end_date")))
    return laid.select("code", F.explode(inside).alias("Date"))


def with_trailing_adv(daily: DataFrame, days: int = 20) -> DataFrame:
    """Add adv_amount: mean of the last ``days`` valid daily amounts strictly
    before the date, carried over gaps; NULL before the first.

    A code has one row per date, so its windows stay small. All of them share
    one shuffle on code, and there is no join.
    """
    amount = S.clean("daily_amount")
    by_date = Window.partitionBy("code").orderBy("Date")
    rows = daily.withColumn("_a", F.when(amount > 0, amount))
    # _seen counts valid days so far; a RANGE over it spans the last valid
    # ones however many invalid days lie between.
    rows = rows.withColumn("_seen", F.count("_a").over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    latest = Window.partitionBy("code").orderBy("_seen").rangeBetween(-(days - 1), 0)
    return (rows.withColumn("_mean", F.avg("_a").over(latest))
            .withColumn("adv_amount", F.lag("_mean").over(by_date)).drop("_a", "_seen", "_mean"))


def trailing_adv(daily: DataFrame, days: int = 20, keys: DataFrame | None = None) -> DataFrame:
    """(code, Date, adv_amount) of ``daily``, or at other (code, Date) ``keys``."""
    rows = daily.select("code", "Date", F.col("daily_amount").cast("double"))
    if keys is None:
        return with_trailing_adv(rows, days).select("code", "Date", "adv_amount")
    asked = keys.select("code", "Date", F.lit(None).cast("double").alias("daily_amount"), F.lit(True).alias("_wanted"))
    rows = rows.withColumn("_wanted", F.lit(False)).unionByName(asked).groupBy("code", "Date").agg(
        F.max("daily_amount").alias("daily_amount"), F.max("_wanted").alias("_wanted"))
    return with_trailing_adv(rows, days).where(F.col("_wanted")).select("code", "Date", "adv_amount")


# --- bar flags ----------------------------------------------------------------

def _equal(a: str, b: str) -> Column:
    return S.falsy(F.col(a).cast("double") == F.col(b).cast("double"))


def tradable_flags(df: DataFrame) -> DataFrame:
    """tradable_base, is_one_price_limit and current_tradable; never NULL."""
    base = S.falsy(F.col("Open") > 0) & S.falsy(F.col("Vol") > 0) & S.falsy(F.col("Amount") > 0) & ~F.col("is_st")
    one_price = _equal("High", "Low") & (_equal("High", "up_limit") | _equal("Low", "down_limit"))
    return df.withColumns({"tradable_base": base, "is_one_price_limit": one_price}).withColumn(
        "current_tradable", F.col("tradable_base") & ~F.col("is_one_price_limit"))


# All session windows below run over descending minutes. Looking ahead then
# means looking at rows already passed, which running frames do in one step
# per row, and the whole chain needs a single sort.

def _session():
    return Window.partitionBy(*SESSION).orderBy(F.col("MinuteIndex").desc())


def _ahead(column: str, offset: int) -> Column:
    """Value of the bar whose minute is exactly ``offset`` later."""
    return F.last(column).over(_session().rangeBetween(-offset, -offset))


def _locked(limit: str) -> Column:
    day = _session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.bool_and(_equal("High", limit) & _equal("Low", limit)).over(day)


def _simple_return() -> Column:
    return S.ratio(F.col("Close"), F.lead("Close").over(_session())) - 1


def _trailing_std(column: str, window: int, min_count: int) -> Column:
    frame = _session().rowsBetween(0, window - 1)
    return F.when(F.count(column).over(frame) >= min_count, F.stddev_samp(column).over(frame))


def _next_tradable(trade: Column) -> Column:
    """``trade`` of the next tradable bar, the current one included."""
    passed = _session().rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(F.col("current_tradable"), trade), ignorenulls=True).over(passed)


def _own_trade() -> list[Column]:
    return [F.col("MinuteIndex").alias("minute"), F.col("Open").cast("double").alias("open"), F.col("vwap").alias("vwap")]


def next_trade(df: DataFrame) -> DataFrame:
    """Minute, open and VWAP of the next tradable bar."""
    return df.withColumn("_next", _next_tradable(F.struct(*_own_trade()))).withColumns({
        "next_trade_minute": F.col("_next.minute"), "next_trade_open": F.col("_next.open"),
        "next_trade_vwap": F.col("_next.vwap")}).drop("_next")


def entry_and_exit(df: DataFrame, delay: int, holding: int, more: Sequence[int] = ()) -> DataFrame:
    """Execution of a signal at each bar: entry at the next tradable bar
    ``delay`` minutes on, exit at the one ``holding`` minutes after the entry.

    Seen from the entry bar the exit lies at a fixed offset, so each tradable
    bar carries its own exit along and the signal bar finds both through one
    keyed frame. No lookup join is needed. ``_next`` is the struct of the next
    tradable bar. With ``more`` holdings their exits follow from the same entry,
    as the array ``exits`` of (minute, open, vwap), all NULL without an entry.
    """
    rows = df.withColumns({"_exit": _ahead("_next", holding), **{f"_exit{i}": _ahead("_next", h) for i, h in enumerate(more)}})
    others = [F.array(*[f"_exit{i}" for i in range(len(more))]).alias("exits")] if more else []
    rows = rows.withColumn("_trip", _next_tradable(F.struct(*_own_trade(), F.col("_exit").alias("exit"), *others)))
    rows = rows.withColumn("_entry", _ahead("_trip", delay))
    return rows.withColumns({
        "entry_schedule_minute": F.col("MinuteIndex") + delay,
        "entry_exec_minute": F.col("_entry.minute"), "entry_open": F.col("_entry.open"), "entry_vwap": F.col("_entry.vwap"),
        "exit_schedule_minute": F.col("_entry.minute") + holding,
        "exit_exec_minute": F.col("_entry.exit.minute"),
        "exit_open": F.col("_entry.exit.open"), "exit_vwap": F.col("_entry.exit.vwap"),
        **({"exits": F.col("_entry.exits")} if more else {}),
    }).drop("_exit", "_trip", "_entry", *[f"_exit{i}" for i in range(len(more))])


def market_state(
    bars: DataFrame, daily: DataFrame, st_days: DataFrame | None = None, cfg: MarketSettings = MarketSettings(),
    more_holdings: Sequence[int] = (),
) -> DataFrame:
    """Bars with limits, trailing ADV, flags, sigma, and entry and exit trades.

    ADV is added to the daily table itself. The bars are shuffled once, on
    (code, Date), for the joins and every window after them. ``more_holdings``
    add ``exits``, see :func:`entry_and_exit`.
    """
    side = with_trailing_adv(daily, cfg.adv_days).select("code", "Date", "up_limit", "down_limit", "adv_amount")
    out = attach_daily(bars, side)
    if st_days is None:
        out = out.withColumn("is_st", F.lit(False))
    else:
        flagged = st_days.select(F.col("code").alias("StockCode"), "Date", F.lit(True).alias("is_st"))
        out = out.join(flagged, list(SESSION), "left").withColumn("is_st", F.coalesce("is_st", F.lit(False)))
    out = tradable_flags(out.withColumns({"vwap": S.vwap(), "time": S.minute_time("MinuteIndex")}))
    # Each withColumns is one window operator with several frames.
    out = out.withColumns({
        "is_limit_up_all_day": _locked("up_limit"), "is_limit_down_all_day": _locked("down_limit"),
        "_ret": _simple_return(), "_next": _next_tradable(F.struct(*_own_trade()))})
    out = out.withColumn("sigma_intraday", _trailing_std("_ret", cfg.sigma_window, cfg.sigma_min_count))
    out = entry_and_exit(out, cfg.entry_delay, cfg.holding, more_holdings)
    return out.withColumns({
        "next_trade_minute": F.col("_next.minute"), "next_trade_open": F.col("_next.open"),
        "next_trade_vwap": F.col("_next.vwap")}).drop("_ret", "_next")


LEG_COLUMNS = [
    f"{leg}_{c}" for leg in ("entry", "exit") for c in ("schedule_minute", "exec_minute", "open", "vwap")]


def universe(state: DataFrame, *more: str | Column) -> DataFrame:
    """The signal-time columns of a market state, keyed by (date, time, code), and ``more`` of its columns."""
    return state.select(
        F.col("StockCode").cast("int").alias("code"), S.short_date("Date").alias("date"), "time",
        F.col("MinuteIndex").alias("base_minute"),
        F.col("Open").alias("signal_open"), F.col("Close").alias("signal_close"), F.col("Vol").alias("signal_vol"),
        F.col("Amount").alias("signal_amount"), "adv_amount", "current_tradable", "sigma_intraday", "up_limit",
        "down_limit", "is_limit_up_all_day", "is_limit_down_all_day", *LEG_COLUMNS, *more)


def next_trade_table(state: DataFrame) -> DataFrame:
    """The execution lookup: next tradable bar at or after each minute."""
    return state.select(
        F.col("StockCode").cast("int").alias("code"), S.short_date("Date").alias("date"),
        F.col("MinuteIndex").alias("schedule_minute"), "next_trade_minute", "next_trade_open", "next_trade_vwap")


def next_trade_lookup(df: DataFrame, table: DataFrame, leg: str) -> DataFrame:
    """Attach ``leg``_exec_minute/open/vwap at ``leg``_schedule_minute, for
    schedules that do not follow the fixed delay and holding of a state."""
    side = table.select(
        "code", "date", F.col("schedule_minute").alias(f"{leg}_schedule_minute"),
        F.col("next_trade_minute").alias(f"{leg}_exec_minute"),
        F.col("next_trade_open").alias(f"{leg}_open"), F.col("next_trade_vwap").alias(f"{leg}_vwap"))
    keys = ["code", "date", f"{leg}_schedule_minute"]
    return df.join(unique_rows(side, keys), keys, "left")


def allowed_times(rows: DataFrame, pred: DataFrame) -> DataFrame:
    """Rows on the dates and at the times the score table covers.

    The score table is read once, for its (date, time) pairs.
    """
    stamps = stored(pred.select("date", "time").distinct())
    return (rows.join(stamps.select("time").distinct(), "time", "left_semi")
            .join(stamps.select("date").distinct(), "date", "left_semi"))


def signal_left_join(rows: DataFrame, pred: DataFrame) -> DataFrame:
    """Scores onto the universe; rows without one stay and are flagged.

    A (date, time, code) that repeats among the scores fails the job.
    """
    keys = ["date", "time", "code"]
    return rows.join(unique_rows(pred.select(*keys, "prediction"), keys), keys, "left").withColumn(
        "prediction_available", S.is_finite("prediction"))


def scored_universe(state: DataFrame, pred: DataFrame, *more: str | Column) -> DataFrame:
    """``universe`` at the times the scores cover, with the scores of :func:`signal_left_join`.

    The wide rows of a state lie by session, and there they stay: the narrow
    scores are brought to them, and a row finds its score among the few of its
    session. The time is therefore matched by two bounds and not as a key of
    the join. Short dates are days of the 2000s.
    """
    rows = allowed_times(universe(state, F.col("Date").alias("_day"), *more), pred)
    keys = ["date", "time", "code"]
    side = pred.select(*keys, "prediction", S.full_date("date").alias("_day")).repartition("code", "_day")
    side = unique_rows(side, [*keys, "_day"])
    same = (F.col("l.code") == F.col("r.code")) & (F.col("l._day") == F.col("r._day"))
    for key in ("date", "time"):
        same = same & F.col(f"l.{key}").between(F.col(f"r.{key}"), F.col(f"r.{key}"))
    found = rows.alias("l").join(side.alias("r"), same, "left").select("l.*", "r.prediction").drop("_day")
    return found.withColumn("prediction_available", S.is_finite("prediction"))


def fillable_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"fillable_{p}": F.col(f"entry_{p}").isNotNull() & F.col(f"exit_{p}").isNotNull() for p in ("open", "vwap")})


def limit_touch_flags(df: DataFrame) -> DataFrame:
    """Whether each leg's price touches a limit; a missing price or limit does not."""
    return df.withColumns({
        f"{leg}_{p}_is_{side}_limit": S.falsy(
            F.col(f"{leg}_{p}") >= F.col("up_limit") if side == "up" else F.col(f"{leg}_{p}") <= F.col("down_limit"))
        for leg in ("entry", "exit") for p in ("open", "vwap") for side in ("up", "down")})


def execution_returns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"ret_{p}_exec_10": S.ratio(F.col(f"exit_{p}"), F.col(f"entry_{p}")) - 1 for p in ("open", "vwap")})


def execution_features(pred: DataFrame, state: DataFrame, cfg: MarketSettings = MarketSettings()) -> DataFrame:
    """Scores joined to entry and exit executions: the fixed feature columns."""
    rows = scored_universe(state, pred).withColumn("minute_slot", S.minute_slot("base_minute", cfg.slot_mod))
    return limit_touch_flags(fillable_flags(execution_returns(rows))).select(*EXECUTION_COLUMNS)
