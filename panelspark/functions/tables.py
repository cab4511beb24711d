"""User models and metrics as table functions of SQL, over whole sessions.

``register_session_function`` makes a Python function callable from SQL:

    SELECT * FROM my_function(TABLE(bars))

The table function itself asks for what the function needs, so that a caller
cannot get it wrong: only the named columns are sent (the scan reads no more),
rows are partitioned by the keys of a session and ordered within it, and the
output columns and their types follow from the input's. The function sees a
session at a time, which its meaning bounds, as columns in order; it never sees
a part of one.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

#: Key columns and order of a session of bars.
SESSION_KEYS, SESSION_ORDER = ("StockCode", "Date"), ("MinuteIndex",)


def _fields(table: AnalyzeArgument, names: Sequence[str]) -> list[T.StructField]:
    """Fields of an input table by name, upper and lower case alike; an unknown name is an error."""
    if not isinstance(table.dataType, T.StructType) or not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    have = {f.name.lower(): f for f in table.dataType.fields}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    return [have[n.lower()] for n in names]


def register_session_function(
    spark: SparkSession, name: str, function: Callable[[Mapping[str, list]], Mapping[str, Sequence]], reads: Sequence[str],
    returns: Mapping[str, str], per_row: bool = True, keys: Sequence[str] = SESSION_KEYS, order: Sequence[str] = SESSION_ORDER,
) -> None:
    """Make ``function`` callable from SQL as ``name(TABLE(...))``.

    ``function`` gets the columns ``reads`` of one session, in ``order``, as
    {column: list} and gives {output: values}. ``per_row``: a value for each
    row, returned beside the keys and the order; else one value a session,
    beside the keys. ``returns`` names the outputs and their SQL types. NULL
    keys are sessions of their own; an empty table gives an empty one; numbers
    may come as numpy arrays.
    """
    keys, order, reads, outputs = list(keys), list(order), list(reads), dict(returns)
    shown = keys + order if per_row else keys
    clash = {n.lower() for n in shown} & {n.lower() for n in outputs}
    if clash or len({n.lower() for n in outputs}) < len(outputs):
        raise ValueError(f"output names must differ from each other and from {shown}")
    kinds = T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in outputs.items()))
    sent = list(dict.fromkeys(keys + order + reads))

    class SessionFunction:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            by_name = dict(zip(sent, _fields(table, sent), strict=True))
            schema = T.StructType([T.StructField(n, by_name[n].dataType) for n in shown] + kinds.fields)
            return AnalyzeResult(
                schema=schema, partitionBy=[PartitioningColumn(n) for n in keys], orderBy=[OrderingColumn(n) for n in order],
                select=[SelectedColumn(n) for n in sent])

        def __init__(self):
            self.rows = []

        def eval(self, row):
            self.rows.append(row)  # a row is one step; the columns are made once a session

        def terminate(self):
            if not self.rows:
                return
            session = dict(zip(sent, map(list, zip(*self.rows, strict=True)), strict=False))
            found = function({n: session[n] for n in reads})
            if set(found) != set(outputs):
                raise ValueError(f"{name} gave {sorted(found)} and not {sorted(outputs)}")
            plain = [getattr(found[n], "tolist", lambda v=found[n]: v)() for n in outputs]
            if not per_row:
                yield tuple(session[n][0] for n in keys) + tuple(plain)
                return
            size = len(self.rows)
            if any(len(values) != size for values in plain):
                raise ValueError(f"{name} must give a value for each of the {size} rows")
            yield from zip(*[session[n] for n in shown], *plain, strict=True)

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
    spark.udtf.register(name, F.udtf(SessionFunction))


def register_session_metrics(
    spark: SparkSession, name: str, metrics: Mapping[str, Callable[[Mapping[str, list]], float | None]], reads: Sequence[str],
    keys: Sequence[str] = SESSION_KEYS, order: Sequence[str] = SESSION_ORDER,
) -> None:
    """Several named metrics as one table function: a row a session, a double column a metric; columns are read once."""
    named = dict(metrics)

    def all_of(session):
        return {n: metric(session) for n, metric in named.items()}

    register_session_function(spark, name, all_of, reads, dict.fromkeys(named, "double"), False, keys, order)
