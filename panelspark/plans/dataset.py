"""Bars to a normalised, split feature table."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators import datasets as D, features as P
from ..settings import FeatureSettings
from ..sources.files import file_versions
from ..sources.writers import contract_hash, reuse_or_build


def split_training_rows(bars: DataFrame, splits: DataFrame, cfg: FeatureSettings) -> DataFrame:
    """Feature and label rows tagged with their split.

    The split calendar joins the bars first, so dates outside it are never
    turned into features.
    """
    wanted = D.attach_split(bars, splits)
    table = P.training_table(wanted.drop("split"), cfg)
    return D.attach_split(table, splits)


def normalised_splits(
    rows: DataFrame, cfg: FeatureSettings, exclude: tuple[str, ...] = (), label: str = "label_ret",
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """z-scored features and label, fitted on the train split only."""
    train = rows.where(F.col("split") == "train")
    excluded = [*exclude, *[c for c in cfg.feature_names if c.endswith("_is_zero")]]
    params = P.fit_zscore(train, [*cfg.feature_names, label], excluded, scope="train")
    return P.apply_zscore(rows, params), params


def build_dataset(
    bars: DataFrame, splits: DataFrame, out: str, cfg: FeatureSettings = FeatureSettings(),
    sample_per_minute: int = 0, seed: int = 0, extra_contract: dict[str, Any] | None = None, bars_id: str | None = None,
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Write (or reuse) the raw split table, then return it normalised.

    The contract covers the features, the sample, every (date, split) and the
    bars: their files with sizes and times of change, or ``bars_id`` (a version)
    where given. A table built under another contract is refused.

    The features are stored before fitting, so the fit and every later reader
    scan Parquet instead of recomputing the windows.
    """
    calendar = sorted((r["date"], r["split"]) for r in splits.select("date", "split").collect())  # one row per date
    contract = {
        "features": asdict(cfg), "sample": sample_per_minute, "seed": seed, "splits": contract_hash({"dates": calendar}),
        "bars": bars_id or contract_hash({"files": file_versions(bars.sparkSession, bars.inputFiles())}), **(extra_contract or {})}

    def build() -> DataFrame:
        rows = split_training_rows(bars, splits, cfg)
        return D.sample_per_group(rows, ["Date", "MinuteIndex"], sample_per_minute, seed, ["StockCode", "Date", "MinuteIndex"])

    return normalised_splits(reuse_or_build(bars.sparkSession, out, contract, build), cfg)
