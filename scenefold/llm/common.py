"""Scratch tables and Arrow batch helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space of the line and word rules: space, \t, \n, \v, \f, \r.
WHITE = " \t\n\x0b\f\r"
#: Texts are handed to numpy in slices of about this many bytes.
SLICE_BYTES = 4 << 20
#: Partitions that the size of an input can ask for, and the bound from which a size counts as unknown.
MOST_PARTITIONS, UNKNOWN_BYTES = 4096, 1 << 58


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder; nothing is created yet."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back from there.

    The reader's plan starts at the files, so a lost executor repeats a read and
    not the work behind it, and later jobs prune columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, share: int) -> int:
    """Partitions of about ``share`` bytes of ``df`` by the planner's bound of its size.

    At least the session's shuffle partitions, which is also the answer where the
    planner knows no bound (rows from memory) or an immense one (joins multiply theirs).
    """
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return least
    try:
        size = int(plan.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:
        # Such bounds have thousands of digits, which Python refuses to parse.
        return least
    return max(least, min(MOST_PARTITIONS, size // share)) if size < UNKNOWN_BYTES else least


def with_workers(df: DataFrame) -> DataFrame:
    """Make this package importable in the Python workers of ``df``'s session."""
    ship_package(df.sparkSession)
    return df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``limit`` bytes; one long text is a slice of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
