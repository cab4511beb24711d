"""Bar features, forward labels and normalisation.

A (StockCode, Date) group is one session: its key (StockCode, Date,
MinuteIndex) is unique, so a group never exceeds the session length and plain
windows are bounded. All of them share one exchange on (StockCode, Date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S
from ..functions.ranks import add_value_ranks
from ..settings import FeatureSettings

SESSION = ("StockCode", "Date")
PRICES = ("Open", "Close", "High", "Low")


def session_window(order: str = "MinuteIndex"):
    return Window.partitionBy(*SESSION).orderBy(order)


# --- filters --------------------------------------------------------------

def valid_bars(df: DataFrame) -> DataFrame:
    """Finite OHLCV, positive prices, non-negative volume and amount."""
    ok = F.lit(True)
    for c in PRICES:
        ok = ok & S.is_finite(c) & (F.col(c) > 0)
    for c in ("Vol", "Amount"):
        ok = ok & S.is_finite(c) & (F.col(c) >= 0)
    return df.where(ok)


def keep_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & S.is_finite(c)
    return df.where(ok)


def finite_pairs(df: DataFrame, x: str = "prediction", y: str = "target") -> DataFrame:
    return keep_finite(df, [x, y])


def drop_horizon_tail(df: DataFrame, horizon: int, last_index: int = 239) -> DataFrame:
    return df.where(F.col("MinuteIndex") <= last_index - horizon)


def drop_zero_indicators(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not c.endswith("_is_zero")]


# --- row windows ----------------------------------------------------------

def at_minute(column: str | Column, offset: int) -> Column:
    """Value of the bar whose MinuteIndex is exactly ``offset`` later; NULL if
    that minute is absent. A RANGE frame of one key: no self-join, no extra
    shuffle, and gaps cannot shift the lookup."""
    return F.last(S.col(column)).over(session_window().rangeBetween(offset, offset))


def forward_value(df: DataFrame, column: str, horizon: int, name: str) -> DataFrame:
    return df.withColumn(name, at_minute(column, horizon))


def row_change(column: str, k: int) -> Column:
    """x[t] - x[t-k rows] inside the session."""
    return F.col(column) - F.lag(column, k).over(session_window())


def rolling_std(column: str, window: int, min_count: int, ddof: int) -> Column:
    frame = session_window().rowsBetween(-(window - 1), 0)
    std = F.stddev_pop(column) if ddof == 0 else F.stddev_samp(column)
    return F.when(F.count(column).over(frame) >= min_count, std.over(frame))


def rolling_mean(column: str, window: int, min_count: int = 1) -> Column:
    frame = session_window().rowsBetween(-(window - 1), 0)
    return F.when(F.count(column).over(frame) >= min_count, F.avg(column).over(frame))


def forward_vol(df: DataFrame, horizon: int, name: str = "volatility_label", min_count: int = 2) -> DataFrame:
    """Deviation (ddof 0) of the next ``horizon`` one-row log returns.

    NULL unless the session still has horizon - 1 rows after the current one.
    """
    log_close = F.when(S.is_finite("Close") & (F.col("Close") > 0), F.ln("Close"))
    ahead = session_window().rowsBetween(1, horizon)
    return (df.withColumn("_lc", log_close)
            .withColumn("_r", row_change("_lc", 1))
            .withColumn("_rows", F.count("*").over(session_window().rowsBetween(1, horizon - 1 if horizon > 1 else 1)))
            .withColumn(name, F.when((F.col("_rows") >= horizon - 1) & (F.count("_r").over(ahead) >= min_count),
                                     F.stddev_pop("_r").over(ahead)))
            .drop("_lc", "_r", "_rows"))


def next_valid(column: str | Column) -> Column:
    """Next non-NULL value from the current row on."""
    return F.first(S.col(column), ignorenulls=True).over(
        session_window().rowsBetween(0, Window.unboundedFollowing))


def contiguous_runs(df: DataFrame) -> DataFrame:
    """Add run_id (first minute of the gap-free run) and run_len (its length so far)."""
    island = F.col("MinuteIndex") - F.row_number().over(session_window())
    inside = Window.partitionBy(*SESSION, "_island").orderBy("MinuteIndex")
    return (df.withColumn("_island", island)
            .withColumn("run_id", F.min("MinuteIndex").over(inside))
            .withColumn("run_len", F.row_number().over(inside))
            .drop("_island"))


def position_in_session(df: DataFrame, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(session_window()) - 1)


# --- composite features ---------------------------------------------------

def bar_features(df: DataFrame, cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Return, shape, activity and clock features of valid bars."""
    out = valid_bars(df).withColumn("log_close", F.ln("Close"))
    vol, mv, ma = f"vol_{cfg.vol_window}m", f"log_vol_{cfg.mean_window}m_mean", f"log_amount_{cfg.mean_window}m_mean"
    first = {f"ret_{k}m": row_change("log_close", k) for k in cfg.return_lags}
    first |= {
        "_r1": row_change("log_close", 1),
        "hl": F.ln(F.col("High") / F.col("Low")),
        "oc": F.ln(F.col("Close") / F.col("Open")),
        "log_vol": F.ln(F.col("Vol") + 1.0),
        "log_amount": F.ln(F.col("Amount") + 1.0),
        "minute_norm": S.minute_norm("MinuteIndex"),
        "session_minute_norm": S.session_minute_norm("MinuteIndex"),
    }
    if cfg.include_session_id:
        first["session_id"] = S.session_id("MinuteIndex")
    out = out.withColumns(first).withColumns({
        vol: rolling_std("_r1", cfg.vol_window, cfg.vol_min_count, ddof=0),
        mv: rolling_mean("log_vol", cfg.mean_window),
        ma: rolling_mean("log_amount", cfg.mean_window),
    }).drop("_r1")
    shaped = {}
    if cfg.signed_log_returns:
        shaped |= {c: S.signed_log1p(c) for c in cfg.return_names}
    if cfg.squash_scale is not None:
        shaped |= {c: S.squash(c, cfg.squash_scale) for c in ("hl", "oc", vol)}
    if shaped:
        out = out.withColumns(shaped)
    if cfg.zero_sources:
        out = out.withColumns({f"{c}_is_zero": S.is_zero(c) for c in cfg.zero_sources})
    return out


def forward_label(df: DataFrame, horizon: int = 10, entry_lag: int = 1, name: str = "label_ret") -> DataFrame:
    """log_close[t + horizon] - log_close[t + entry_lag], both by minute key."""
    if not 0 <= entry_lag < horizon:
        raise ValueError(f"entry lag {entry_lag} must lie in [0, {horizon})")
    if "log_close" not in df.columns:
        df = df.withColumn("log_close", F.when(S.is_finite("Close") & (F.col("Close") > 0), F.ln("Close")))
    return df.withColumn(name, at_minute("log_close", horizon) - at_minute("log_close", entry_lag))


def with_short_keys(df: DataFrame) -> DataFrame:
    """Put the evaluation keys date (yymmdd), time (hhmmss) and code on bars.

    Column names ignore case, so date takes the place of Date.
    """
    return df.withColumns({
        "date": S.short_date("Date"), "time": S.minute_time("MinuteIndex"), "code": F.col("StockCode").cast("int"),
    })


def training_table(df: DataFrame, cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Features and label of every bar that has all of them."""
    labelled = forward_label(bar_features(df, cfg), cfg.horizon, cfg.entry_lag)
    kept = keep_finite(drop_horizon_tail(labelled, cfg.horizon, cfg.last_index), [*cfg.feature_names, "label_ret"])
    return kept.select("StockCode", "Date", "MinuteIndex", *cfg.feature_names, "label_ret")


def inference_table(df: DataFrame, cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Features of every bar, labelled or not; the target stays NULL."""
    kept = keep_finite(bar_features(df, cfg), cfg.feature_names)
    return kept.select("StockCode", "Date", "MinuteIndex", *cfg.feature_names,
                       F.lit(None).cast("double").alias("target"))


def cross_section_gaussianize(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("Date", "MinuteIndex"),
    lo: float = 1e-3, hi: float = 1 - 1e-3, plan: str | None = None,
) -> DataFrame:
    """Normal scores of average-tie percentile ranks, as ``<column>_cs``."""
    out = df
    for c in columns:
        out = add_value_ranks(out, keys, c, {"pct": "_pct"}, plan)
        out = out.withColumn(f"{c}_cs", S.inverse_normal(S.clip("_pct", lo, hi))).drop("_pct")
    return out


# --- normalisation --------------------------------------------------------

def zscore_table(df: DataFrame, columns: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """One row per field: pooled mean and deviation (ddof 0) of finite values.

    A single pass over all columns; excluded fields get (0, 1).
    """
    aggs = []
    for i, c in enumerate(columns):
        v = S.clean(c)
        aggs += [F.avg(v).alias(f"_m{i}"), F.stddev_pop(v).alias(f"_s{i}")]
    fields = [
        F.struct(F.lit(c).alias("field"),
                 (F.lit(0.0) if c in exclude else F.col(f"_m{i}")).alias("mean"),
                 (F.lit(1.0) if c in exclude else F.col(f"_s{i}")).alias("std"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*fields)))


def fit_zscore(
    df: DataFrame, columns: Sequence[str], exclude: Sequence[str] = (), scope: str = "train",
) -> dict[str, tuple[float, float]]:
    """Parameters on the driver: two numbers per field. Only a training scope
    may be fitted, so that no later split leaks into the scale."""
    if scope != "train":
        raise ValueError(f"normalisation may only be fitted on the train split, not {scope!r}")
    params = {r["field"]: (r["mean"], r["std"]) for r in zscore_table(df, columns, exclude).collect()}
    bad = [c for c, (m, s) in params.items() if m is None or s is None or not s > 0]
    if bad:
        raise ValueError(f"no positive deviation for {bad}")
    return params


def apply_zscore(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: S.zscore(c, m, s) for c, (m, s) in params.items()})


def invert_zscore(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: S.unzscore(c, m, s) for c, (m, s) in params.items()})


# --- scores and variants of the label -------------------------------------

BASELINE_SPECS = {
    "ret_1m": {"ret_1m": 1.0},
    "ret_5m": {"ret_5m": 1.0},
    "ret_10m": {"ret_10m": 1.0},
    "ret_combo": {"ret_1m": 1.0, "ret_5m": 0.5, "ret_10m": 0.25},
}


def linear_score(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(float(w)) * F.col(name).cast("double")
    return out


def lagged_returns(df: DataFrame, lags: Sequence[int], horizon: int) -> DataFrame:
    """Past returns and targets under three timing conventions.

    ``ret_k_current`` ends at the current close, ``ret_k_previous`` at the
    previous one. Target A enters at this close, B at the next minute's close,
    C is A, to be used with the previous-bar returns.
    """
    out = df.withColumn("log_close", F.ln("Close"))
    w = session_window()
    cols = {}
    for k in lags:
        cols[f"ret_{k}m_current"] = row_change("log_close", k)
        cols[f"ret_{k}m_previous"] = F.lag("log_close", 1).over(w) - F.lag("log_close", k + 1).over(w)
    out = out.withColumns(cols)
    ahead = at_minute("log_close", horizon)
    out = out.withColumns({
        "target_A": ahead - F.col("log_close"),
        "target_B": ahead - at_minute("log_close", 1),
    })
    return out.withColumn("target_C", F.col("target_A"))


def sequence_windows(df: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """The trailing ``length`` x features tensor of every row whose gap-free
    run is long enough; a frame never holds more than ``length`` rows."""
    runs = contiguous_runs(df)
    frame = Window.partitionBy(*SESSION, "run_id").orderBy("MinuteIndex").rowsBetween(-(length - 1), 0)
    step = F.array(*[F.col(c).cast("float") for c in columns])
    return (runs.withColumn("window", F.collect_list(step).over(frame))
            .where(F.col("run_len") >= length))


def valid_windows(df: DataFrame, length: int) -> DataFrame:
    """Rows that end a gap-free run of at least ``length`` minutes."""
    return contiguous_runs(df).where(F.col("run_len") >= length)
