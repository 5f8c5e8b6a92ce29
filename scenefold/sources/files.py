"""Ranged reads of binary files inside tasks.

A reader plans byte ranges from a header of a few kilobytes; tasks then open
the file through Arrow's file systems (local, HDFS, S3, ...) and decode only
their own range, so one large file is read by many tasks.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ImportFormatError


def open_file(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = arrow_fs.FileSystem.from_uri(path)
    else:
        system, inner = arrow_fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def file_size(path: str) -> int:
    with open_file(path) as handle:
        return handle.size()


def read_range(path: str, offset: int, length: int) -> bytes:
    with open_file(path) as handle:
        payload = handle.read_at(length, offset)
    if len(payload) != length:
        raise ImportFormatError(f"{path} ends inside a record")
    return payload


COMMITTED = "_commits/current.json"


def committed(folder: str) -> dict | None:
    """What the last commit of a folder of ``sinks.committed`` says, or None without one."""
    system, inner = arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)
    if system.get_file_info(f"{inner}/{COMMITTED}").type == arrow_fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{inner}/{COMMITTED}") as handle:
        return json.loads(handle.read().decode())


def committed_chunks(folder: str) -> list[dict]:
    """Index rows (chunk, name, hash, rows, bytes) of a committed folder in chunk order."""
    rows = []
    for part in (committed(folder) or {"parts": []})["parts"]:
        with open_file(f"{folder}/{part}") as handle:
            rows += [json.loads(line) for line in handle.read().decode().splitlines()]
    return sorted(rows, key=lambda r: r["chunk"])


def chunk_path(folder: str, row: dict) -> str:
    """Where a chunk of an index row is: a whole path, or one inside the folder."""
    return row["name"] if row["name"].startswith("/") or "://" in row["name"] else f"{folder}/{row['name']}"


def list_files(path: str, pattern: str = "*") -> list[str]:
    """The files of a path: itself, what was committed to it, or what matches in its folder, in order."""
    head, _, last = path.rstrip("/").rpartition("/")
    system, inner = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)
    kind = system.get_file_info(inner).type
    if kind == arrow_fs.FileType.File:
        return [path]
    if kind == arrow_fs.FileType.Directory:
        if committed(path) is not None:
            return [chunk_path(path, row) for row in committed_chunks(path)]
        head, last = path.rstrip("/"), pattern
    elif not any(c in last for c in "*?["):
        return []
    folder = inner if kind == arrow_fs.FileType.Directory else inner.rstrip("/").rpartition("/")[0]
    listed = system.get_file_info(arrow_fs.FileSelector(folder))
    names = sorted(i.base_name for i in listed if i.type == arrow_fs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [f"{head}/{n}" for n in names if fnmatch.fnmatch(n, last)]


def decode_ranges(ranges: DataFrame, decode: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``decode(payload, row)`` to each ``path, offset, length`` row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield decode(read_range(row.path, int(row.offset), int(row.length)), row)

    return ranges.mapInPandas(run, schema)


def record_ranges(spark: SparkSession, path: str, start: int, stride: int, records: int, per_range: int) -> DataFrame:
    """Ranges of at most ``per_range`` fixed-size records; planned by Spark, not listed on the driver."""
    parts = max(1, -(-records // per_range))
    first = F.col("id") * per_range
    count = F.least(F.lit(records) - first, F.lit(per_range))
    return spark.range(parts, numPartitions=min(parts, 100_000)).select(
        F.lit(path).alias("path"), (F.lit(start) + first * stride).cast("long").alias("offset"),
        (count * stride).cast("long").alias("length"), first.cast("long").alias("first"), count.cast("long").alias("count"),
    ).filter("count > 0")
