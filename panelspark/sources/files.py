"""Small files and listings on whatever file system a path names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) of Hadoop for ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Names of the files of a folder that end in ``suffix``, sorted."""
    p, fs = hadoop_path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = hadoop_path(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = hadoop_path(spark, path)
    reader = spark.sparkContext._jvm.java.util.Scanner(fs.open(p), "UTF-8").useDelimiter("\\A")
    text = reader.next() if reader.hasNext() else ""
    reader.close()
    return text


def file_versions(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of files, by path. Each folder is listed once."""
    wanted = set(files)
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in wanted}):
        p, fs = hadoop_path(spark, folder)
        names = {f.rsplit("/", 1)[1]: f for f in wanted if f.rsplit("/", 1)[0] == folder}
        for status in fs.listStatus(p):
            name = status.getPath().toUri().getRawPath().rsplit("/", 1)[1]
            if name in names:
                found.append((names[name], int(status.getLen()), int(status.getModificationTime())))
    return sorted(found)
