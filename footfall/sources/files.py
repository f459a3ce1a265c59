"""Existence, size, renaming and removal of paths on whatever file system they name."""

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop_path = _path(spark, path)
    return system.exists(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    system, hadoop_path = _path(spark, path)
    system.delete(hadoop_path, True)


def remove_file_named(spark: SparkSession, uri: str) -> None:
    """Remove a file that Spark names by its URI, in which a space is %20."""
    jvm = spark.sparkContext._jvm
    remove(spark, jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString())


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder within one file system; its new parent is made if need be."""
    system, path = _path(spark, source)
    _, new_path = _path(spark, target)
    system.mkdirs(new_path.getParent())
    if not system.rename(path, new_path):
        raise OSError(f"cannot move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    system, hadoop_path = _path(spark, path)
    stream = system.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in the place of one that is there."""
    system, hadoop_path = _path(spark, path)
    stream = system.create(hadoop_path, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    system, hadoop_path = _path(spark, path)
    if not system.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(hadoop_path))


def literal(path: str) -> str:
    """A path as a reader that takes patterns takes it literally."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def file_groups(spark: SparkSession, paths: str | list[str], most_bytes: int) -> list[tuple[list[str], int]]:
    """Files, folders or glob patterns as (paths, bytes) in groups of about `most_bytes`.

    A folder that is larger is cut into what it holds; only such folders are listed. A single file is never
    cut, Spark splits it over tasks.
    """
    groups: list[tuple[list[str], int]] = []
    for path in [paths] if isinstance(paths, str) else paths:
        system, hadoop_path = _path(spark, path)
        for found in system.globStatus(hadoop_path) or []:
            for name, size in _pieces(system, found, most_bytes):
                if groups and groups[-1][1] + size <= most_bytes:
                    groups[-1] = ([*groups[-1][0], name], groups[-1][1] + size)
                else:
                    groups.append(([name], size))
    return groups


def _pieces(system, found, most_bytes: int) -> Iterator[tuple[str, int]]:
    """A file or folder, or what is in a folder that is too large, as names a reader takes literally."""
    path, size = found.getPath(), system.getContentSummary(found.getPath()).getLength()
    if not found.isDirectory() or size <= most_bytes:
        yield literal(path.toString()), size
        return
    for inside in sorted(system.listStatus(path), key=lambda status: status.getPath().getName()):
        # Spark leaves such names out when it lists a folder.
        if not inside.getPath().getName().startswith(("_", ".")):
            yield from _pieces(system, inside, most_bytes)


def planned_bytes(frame: DataFrame) -> int:
    """Size of the files behind a frame that does no more than read them, from the listing it was planned with."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def total_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder."""
    system, hadoop_path = _path(spark, path)
    return system.getContentSummary(hadoop_path).getLength()
