"""Windows of consecutive minutes as tensors, kept as blocks instead of copies.

A window model reads, for every bar, the ``length`` bars that end with it. Laid
out a window a row, a table grows ``length`` times. Here each gap-free run of a
session is cut into blocks of ``BLOCK`` windows: a block stores its rows once,
after ``length - 1`` lead-in rows (the halo), and its windows are strided views
of that one array. Stored size is 1 + (length - 1) / BLOCK of the rows at most,
less than 1 for the many runs that end before a block is full.

Runs come out of the session windows in order, so blocks are cut from the stream
of Arrow batches: no further exchange, no list collected per row, and memory of
one block however long a session is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from .features import SESSION, contiguous_runs

#: Windows of a block.
BLOCK = 512


def window_blocks(
    df: DataFrame, columns: Sequence[str], length: int, keys: Sequence[str] = ("date", "time", "code"), block: int = BLOCK,
) -> DataFrame:
    """Blocks of windows: ``ends`` (the ``keys`` of each window's last row, in order) and ``steps``, the rows'
    ``columns`` as floats, row after row, of which window i covers rows i to i + length - 1.

    Rows that end no window of ``length`` gap-free minutes are only steps. Keys may
    be any columns, labels among them; missing values become NaN.
    """
    if length < 1 or block < 1:
        raise ValueError("length and block must be positive")
    kept, width = list(keys), len(columns)
    end = F.struct(*[F.col(k) for k in kept])
    rows = contiguous_runs(df).sortWithinPartitions(*SESSION, "MinuteIndex").select(
        F.col("run_len").cast("long").alias("_place"), end.alias("_end"),
        *[F.col(c).cast("float").alias(f"_{i}") for i, c in enumerate(columns)])
    end_type = rows.schema["_end"].dataType.simpleString()

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        steps, ends = np.empty((0, width), np.float32), None  # the open run

        def made(stop: int):
            """A block of the first ``stop`` rows of the open run."""
            last = ends.slice(length - 1, stop - length + 1)
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(last)], pa.int32()), last),
                 pa.ListArray.from_arrays(pa.array([0, stop * width], pa.int32()), pa.array(steps[:stop].reshape(-1)))], ["ends", "steps"])

        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float32) for c in batch.columns[2:]], 1)
            cuts = [0, *(np.flatnonzero(place == 1)), len(place)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part = batch.column(1).slice(start, stop - start)
                if place[start] == 1:  # a new run; the one before has ended
                    if len(steps) >= length:
                        yield made(len(steps))
                    steps, ends = values[start:stop], pa.concat_arrays([part])
                else:
                    steps, ends = np.concatenate([steps, values[start:stop]]), pa.concat_arrays([ends, part])
                full = block + length - 1
                while len(steps) > full:
                    yield made(full)
                    steps, ends = steps[block:], ends.slice(block)
        if len(steps) >= length:
            yield made(len(steps))

    return rows.mapInArrow(cut, f"ends array<{end_type}>, steps array<float>")


def score_blocks(
    blocks: DataFrame, score: Callable, length: int, label_scale: tuple[float, float] | None = None,
) -> DataFrame:
    """One row for each window of :func:`window_blocks`: its keys and ``prediction``.

    ``score`` maps an array of windows x length x columns, a view that is not to be
    written to, to one number a window; with ``label_scale`` = (mean, std) the
    output is brought back to label units.
    """
    keys = blocks.schema["ends"].dataType.elementType
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ends, steps = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                own = ends[i].values
                rows = len(own) + length - 1
                table = steps[i].values.to_numpy(zero_copy_only=False).reshape(rows, -1)
                views = np.lib.stride_tricks.sliding_window_view(table, length, axis=0).swapaxes(1, 2)
                found = np.asarray(score(views), np.float64)
                yield pa.RecordBatch.from_arrays([*own.flatten(), pa.array(found)], names=[*(f.name for f in own.type), "prediction"])

    scored = blocks.select("ends", "steps").mapInArrow(run, f"{fields}, prediction double")
    if label_scale is not None:
        scored = scored.withColumn("prediction", S.unzscore("prediction", *label_scale))
    return scored
