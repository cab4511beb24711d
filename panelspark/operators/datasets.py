"""Splits, folds, sampling, shuffling and scoring of panel tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalar as S
from ..functions.ranks import WINDOW, add_positions
from .features import SESSION
from .windows import score_blocks, window_blocks


def _numbered_dates(dates: DataFrame, descending: bool = False) -> DataFrame:
    """Ordinal of each date. The calendar is a few thousand rows at most."""
    order = F.col("date").desc() if descending else F.col("date").asc()
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return dates.select("date").distinct().withColumn("_i", F.row_number().over(w) - 1)


def split_by_counts(dates: DataFrame, train: int, val: int, test: int, check: bool = True) -> DataFrame:
    """(date, split): the first ``train`` dates, then ``val``, then ``test``."""
    need = train + val + test
    if check and dates.select("date").distinct().count() < need:
        raise ValueError(f"{need} dates needed")
    i = F.col("_i")
    split = F.when(i < train, "train").when(i < train + val, "val").otherwise("test")
    return _numbered_dates(dates).where(i < need).select("date", split.alias("split"))


def split_by_ranges(dates: DataFrame, train_end: int, val_end: int, check: bool = True) -> DataFrame:
    """(date, split) by calendar bounds, each inclusive."""
    if not train_end < val_end:
        raise ValueError("train_end must precede val_end")
    d = F.col("date")
    split = F.when(d <= train_end, "train").when(d <= val_end, "val").otherwise("test")
    out = dates.select("date").distinct().select("date", split.alias("split"))
    if check and out.select("split").distinct().count() < 3:
        raise ValueError("a split is empty")
    return out


def split_tail_holdout(dates: DataFrame, val: int, test: int, min_train: int = 1, check: bool = True) -> DataFrame:
    """(date, split): the last ``test`` dates, ``val`` before them, the rest train."""
    if check and dates.select("date").distinct().count() < min_train + val + test:
        raise ValueError("too few dates left for training")
    i = F.col("_i")
    split = F.when(i < test, "test").when(i < test + val, "val").otherwise("train")
    return _numbered_dates(dates, descending=True).select("date", split.alias("split"))


def rolling_folds(dates: DataFrame, train: int, val: int, test: int, step: int) -> DataFrame:
    """(fold, date, split) of overlapping windows rolled by ``step`` dates."""
    if step <= 0:
        raise ValueError("step must be positive")
    total = train + val + test
    counted = _numbered_dates(dates).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    last_fold = F.floor((F.col("_n") - total) / step)
    first = F.greatest(F.ceil((F.col("_i") - total + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("_i") / step), last_fold)
    folds = (counted.where((F.col("_n") >= total) & (first <= last))
             .withColumn("fold", F.explode(F.sequence(first, last))))
    place = F.col("_i") - F.col("fold") * step
    split = F.when(place < train, "train").when(place < train + val, "val").otherwise("test")
    return folds.select(F.col("fold").cast("int").alias("fold"), "date", split.alias("split"))


def attach_split(df: DataFrame, splits: DataFrame, date: str = "Date") -> DataFrame:
    """Rows of the split calendar, tagged; the calendar side is tiny."""
    return df.join(splits.withColumnRenamed("date", date), date)


# --- sampling -------------------------------------------------------------

def sample_per_group(df: DataFrame, keys: Sequence[str], k: int, seed: int, unique: Sequence[str], plan: str | None = None) -> DataFrame:
    """k rows per group without replacement, the same ones for the same seed.

    The draw orders rows by a seeded hash of their unique key.
    """
    if k <= 0:
        return df
    drawn = df.withColumn("_h", S.seeded_hash(seed, *unique))
    return add_positions(drawn, keys, ["_h", *unique], rn="_rn", plan=plan).where(F.col("_rn") <= k).drop("_h", "_rn")


def bounded_sample(df: DataFrame, n: int, seed: int, unique: Sequence[str]) -> DataFrame:
    """Uniform sample of n rows: top-n by seeded hash, n rows per task."""
    return df.withColumn("_h", S.seeded_hash(seed, *unique)).orderBy("_h", *unique).limit(n).drop("_h")


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int, plan: str | None = None) -> DataFrame:
    """Every stride-th row in ``order`` so that about n rows remain."""
    numbered = add_positions(df, [], list(order), rn="_rn", n="_n", plan=plan)
    stride = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    return numbered.where((F.col("_rn") - 1) % stride == 0).drop("_rn", "_n")


def top_by(df: DataFrame, metric: str, n: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(metric).desc(), *ties).limit(n)


def universe_first_n(df: DataFrame, n: int) -> DataFrame:
    """Rows of the n smallest codes of each date.

    The distinct (Date, StockCode) pairs are ranked, not the rows.
    """
    pairs = df.select("Date", "StockCode").distinct()
    chosen = add_positions(pairs, ["Date"], ["StockCode"], rn="_rn").where(F.col("_rn") <= n).drop("_rn")
    return df.join(chosen, ["Date", "StockCode"], "left_semi")


# --- shuffling ------------------------------------------------------------

def epoch_shuffle(df: DataFrame, unique: Sequence[str], seed: int, epoch: int, world: int = 1) -> DataFrame:
    """Add each row's sort key in one epoch's order and the shard it goes to.

    Both come from a seeded hash of the row's unique key: another epoch gives
    another order, and no row moves until somebody sorts or filters by it.
    """
    key = S.seeded_hash(f"{seed}-{epoch}", *unique)
    shard = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % world
    return df.withColumn("epoch_key", key).withColumn("shard", shard.cast("int"))


# --- complete runs and label perturbation ----------------------------------

def code_day_runs(df: DataFrame, run_rows: int, need: int) -> DataFrame:
    """The first ``need`` complete (code, day) runs, numbered from 0.

    Only the run keys are ordered, and only the first ``need`` of them.
    """
    complete = (df.groupBy("Date", "StockCode").agg(F.count("*").alias("_rows"))
                .where(F.col("_rows") == run_rows).orderBy("Date", "StockCode").limit(need))
    # At most ``need`` rows are left here, so one task may number them.
    numbered = add_positions(complete.drop("_rows"), [], ["Date", "StockCode"], rn="run", plan=WINDOW)
    return numbered.withColumn("run", (F.col("run") - 1).cast("int"))


def take_runs(df: DataFrame, runs: DataFrame, train: int, val: int) -> DataFrame:
    """Rows of the chosen runs, split by run number."""
    split = F.when(F.col("run") < train, "train").when(F.col("run") < train + val, "val").otherwise("test")
    return df.join(runs, ["Date", "StockCode"]).withColumn("split", split)


def shuffle_labels(df: DataFrame, label: str, order: Sequence[str], seed: int, plan: str | None = None) -> DataFrame:
    """Deal the labels out again in a seeded random order: the i-th row in
    ``order`` gets the label of the i-th row in hash order."""
    rows = add_positions(df.drop(label), [], list(order), rn="_rn", plan=plan)
    hashed = df.select(label, *order).withColumn("_h", S.seeded_hash(seed, *order))
    dealt = add_positions(hashed, [], ["_h", *order], rn="_rn", plan=plan).select("_rn", label)
    return rows.join(dealt, "_rn").drop("_rn")


def shift_labels_one_run(df: DataFrame, label: str) -> DataFrame:
    """Give each (code, day) run the labels of the run before it, minute by
    minute; the first run receives those of the last."""
    runs = df.select("Date", "StockCode").distinct()
    numbered = add_positions(runs, [], ["Date", "StockCode"], rn="_run", n="_runs")
    tagged = df.join(numbered, ["Date", "StockCode"])
    inside = Window.partitionBy(*SESSION).orderBy("MinuteIndex")
    tagged = tagged.withColumn("_pos", F.row_number().over(inside))
    donors = tagged.select(
        (F.col("_run") % F.col("_runs") + 1).alias("_run"), "_pos", F.col(label).alias("_given"))
    return (tagged.join(donors, ["_run", "_pos"], "left")
            .withColumn(label, F.col("_given")).drop("_given", "_run", "_runs", "_pos"))


# --- scoring --------------------------------------------------------------

def batch_score(
    df: DataFrame, score: Callable, keys: Sequence[str] = ("date", "time", "code"),
    label_scale: tuple[float, float] | None = None, columns: Sequence[str] | None = None, length: int = 1,
) -> DataFrame:
    """Apply a user model to Arrow batches and emit a prediction table.

    ``score`` maps a batch of feature rows to one number per row; with
    ``label_scale`` = (mean, std) the output is brought back to label units.
    With ``length`` over 1 the model reads windows: ``score`` maps an array of
    windows x length x ``columns`` to one number per window, and rows that end no
    gap-free window get no prediction.
    """
    if length > 1:
        if not columns:
            raise ValueError("a model of windows needs the columns it reads")
        return score_blocks(window_blocks(df, columns, length, keys), score, length, label_scale)
    kept = list(keys)
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[kept].copy()
            out["prediction"] = score(batch).astype("float64").to_numpy()
            yield out

    scored = df.mapInPandas(run, f"{fields}, prediction double")
    if label_scale is not None:
        scored = scored.withColumn("prediction", S.unzscore("prediction", *label_scale))
    return scored
