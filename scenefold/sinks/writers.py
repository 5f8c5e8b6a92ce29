"""Atomic file writes from tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, functions as F


def _system(path: str):
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def write_atomic(path: str, payload: bytes, replace: bool = True) -> None:
    """Write next to the target, then rename: a retried or doubled task leaves one whole file."""
    system, inner = _system(path)
    if not replace and system.get_file_info(inner).type != arrow_fs.FileType.NotFound:
        return
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(payload)
    system.move(part, inner)


def exists(path: str) -> bool:
    system, inner = _system(path)
    return system.get_file_info(inner).type != arrow_fs.FileType.NotFound


def write_files(files: DataFrame, folder: str, name: str = "name", payload: str = "payload", replace: bool = True) -> None:
    """Write one file per row; tasks write their own rows, the driver sees none of them."""

    def run(rows):
        for row in rows:
            write_atomic(f"{folder}/{row[name]}", bytes(row[payload]), replace)

    files.select(name, payload).foreachPartition(run)


def content_named(chunks: DataFrame, prefix: str, suffix: str, payload: str = "payload") -> DataFrame:
    """Name each payload by its SHA-256."""
    return chunks.withColumn("hash", F.sha2(payload, 256)).withColumn("name", F.concat(F.lit(prefix), F.col("hash"), F.lit(suffix)))
