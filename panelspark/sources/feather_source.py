"""Feather (Arrow IPC) files as a Spark data source, read by ranges of record batches.

``spark.dataSource.register(FeatherSource)`` once, then
``spark.read.format("panel_feather").load(folder)``. Options: ``path``, a file or a
folder of ``*.feather`` files on a file system that Arrow reaches, and ``batches``,
the record batches of a partition. Schema and partitions come from the footers,
which hold no data. A schema given to the reader prunes: only its columns are
decoded. ``write_feather`` writes such files from tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SUFFIX = ".feather"
BATCHES = 16


def _located(path: str):
    """(file system, path) of Arrow for a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, place = _located(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [info.path]
    found = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else []
    names = sorted(f.path for f in found if f.path.endswith(SUFFIX))
    if not names:
        raise FileNotFoundError(path)
    return names


class BatchRange(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "panel_feather"

    def schema(self) -> StructType:
        import pyarrow.ipc as ipc
        from pyspark.sql.pandas.types import from_arrow_schema

        path = self.options["path"]
        system, _ = _located(path)
        with system.open_input_file(_files(path)[0]) as file:
            return from_arrow_schema(ipc.open_file(file).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeatherReader(schema, self.options["path"], int(self.options.get("batches", BATCHES)))


class FeatherReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, batches: int):
        self.schema, self.path, self.batches = schema, path, batches

    def partitions(self) -> list[InputPartition]:
        import pyarrow.ipc as ipc

        system, _ = _located(self.path)
        ranges = []
        for name in _files(self.path):
            with system.open_input_file(name) as file:
                count = ipc.open_file(file).num_record_batches
            ranges += [BatchRange(name, i, min(i + self.batches, count)) for i in range(0, count, self.batches)]
        return ranges

    def read(self, partition: BatchRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.ipc as ipc
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        system, _ = _located(self.path)
        with system.open_input_file(partition.file) as file:
            names = ipc.open_file(file).schema.names
            missing = [f.name for f in wanted if f.name not in names]
            if missing:
                raise ValueError(f"{partition.file} has no columns {missing}")
            fields = sorted(names.index(f.name) for f in wanted)
            reader = ipc.open_file(file, options=ipc.IpcReadOptions(included_fields=fields))
            for i in range(partition.start, partition.stop):
                part = reader.get_batch(i)
                yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in wanted], schema=wanted)


def write_feather(df: DataFrame, path: str) -> DataFrame:
    """Write a file for each partition of ``df``, a record batch for each Arrow batch; one row (file, rows) for each.

    A task that runs again writes the same name; a file appears under it only when it is whole.
    """
    schema = df.schema

    def write(batches):
        import pyarrow as pa
        import pyarrow.ipc as ipc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        system, place = _located(path)
        system.create_dir(place, recursive=True)
        task = TaskContext.get()
        name, wanted, rows = f"{place.rstrip('/')}/part-{task.partitionId():05d}{SUFFIX}", to_arrow_schema(schema), 0
        open_name = f"{name}.{task.taskAttemptId()}"
        with system.open_output_stream(open_name) as sink, ipc.new_file(sink, wanted) as writer:
            for batch in batches:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, wanted)], schema=wanted))
                rows += batch.num_rows
        system.move(open_name, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": [rows]})

    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return df.mapInArrow(write, "file string, rows bigint")
