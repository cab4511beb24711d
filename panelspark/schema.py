"""Table contracts of the panel: schemas and the checks that enforce them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

KEYS = ("date", "time", "code")
BAR_KEYS = ("StockCode", "Date", "MinuteIndex")


_TYPES = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _schema(fields: str) -> T.StructType:
    """Schema from "name TYPE" pairs; needs no running session."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The columns of each table, by name and in order.
BARS = _schema(
    "StockCode INT, DateTime TIMESTAMP_NTZ, Date INT, MinuteIndex INT, Open DOUBLE, Close DOUBLE, "
    "High DOUBLE, Low DOUBLE, Vol DOUBLE, Amount DOUBLE"
)
DAILY = _schema("ts_code STRING, up_limit DOUBLE, down_limit DOUBLE, amount DOUBLE")
SYMBOLS = _schema("ts_code STRING, symbol STRING")
NAME_HISTORY = _schema("ts_code STRING, name STRING, start_date INT, end_date INT")
INFERENCE = _schema("prediction DOUBLE, code INT, date INT, time INT")
PREDICTIONS = _schema("row_id BIGINT, prediction FLOAT, target FLOAT, code BIGINT, date BIGINT, time BIGINT")
POSITIONS = _schema(
    "date INT, time INT, minute_slot INT, slot_bar_id INT, code INT, prediction DOUBLE, "
    "prediction_available BOOLEAN, current_tradable BOOLEAN, simple_return DOUBLE, sigma_intraday DOUBLE, "
    "adv_amount DOUBLE, fillable BOOLEAN, spread_bps DOUBLE, side INT, target_weight DOUBLE"
)
BAR_LEDGER_COLUMNS = (
    "minute_slot", "slot_bar_id", "date", "time", "gross_return", "planned_turnover", "turnover",
    "spread_cost", "impact_coeff", "planned_name_count", "filled_name_count", "fill_ratio",
    "long_exposure", "short_exposure", "executed_gross_exposure", "cash_buffer",
)
EXECUTION_COLUMNS = (
    "date", "time", "code", "minute_slot", "base_minute", "prediction", "prediction_available",
    "signal_open", "signal_close", "signal_vol", "signal_amount", "adv_amount", "current_tradable",
    "sigma_intraday", "up_limit", "down_limit", "is_limit_up_all_day", "is_limit_down_all_day",
    "entry_schedule_minute", "entry_exec_minute", "entry_open", "entry_vwap",
    "exit_schedule_minute", "exit_exec_minute", "exit_open", "exit_vwap",
    "ret_open_exec_10", "ret_vwap_exec_10", "fillable_open", "fillable_vwap",
    "entry_open_is_up_limit", "entry_open_is_down_limit", "exit_open_is_up_limit", "exit_open_is_down_limit",
    "entry_vwap_is_up_limit", "entry_vwap_is_down_limit", "exit_vwap_is_up_limit", "exit_vwap_is_down_limit",
)


class ContractError(ValueError):
    """A table or artifact does not satisfy its contract."""


def require_columns(df: DataFrame, columns: Sequence[str] | T.StructType, exact: bool = False) -> DataFrame:
    """Return ``df`` unchanged when it carries ``columns``; raise otherwise.

    ``exact`` also demands the same order and nothing else.
    """
    wanted = columns.fieldNames() if isinstance(columns, T.StructType) else list(columns)
    missing = [name for name in wanted if name not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    if exact and df.columns != wanted:
        raise ContractError(f"columns must be exactly {wanted}, got {df.columns}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` for the lookup side of a many-to-one join: repeated keys fail the job.

    The check is part of the plan. It groups by the join keys, so the join
    finds its rows already in place and nothing is read twice.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    text = F.concat_ws(", ", F.lit("duplicate key"), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(text))
    return grouped.select(*keys, row.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when ``keys`` repeat (the "m:1" check on a lookup side)."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ContractError(f"duplicate key {found[0].asDict()}")
    return df
