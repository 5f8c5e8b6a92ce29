"""PLY point clouds."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ImportFormatError
from ..functions import vectors as V
from ..operators.common import attach
from ..operators.ordering import global_index
from ..operators.surface import bounds
from .files import decode_ranges, file_size, open_file, record_ranges

HEADER_BYTES = 65_536
ROWS_PER_RANGE = 500_000

# PLY scalar names as little-endian numpy types. Fixed values.
SCALARS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2",
    "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4",
    "double": "<f8", "float64": "<f8",
}
# Alternative property names per output column. Fixed values.
ALIASES = {
    "x": ("x",), "y": ("y",), "z": ("z",), "nx": ("nx", "normal_x"), "ny": ("ny", "normal_y"), "nz": ("nz", "normal_z"),
    "r": ("red", "r"), "g": ("green", "g"), "b": ("blue", "b"),
}
SCHEMA = "idx long, x double, y double, z double, nx double, ny double, nz double, r short, g short, b short"


def read_header(path: str) -> tuple[str, int, list[tuple[str, str]], int]:
    """Format, vertex count, vertex properties and payload offset."""
    with open_file(path) as handle:
        head = handle.read(HEADER_BYTES)
    if not re.match(rb"ply\r?\n", head):
        raise ImportFormatError("missing ply magic")
    end = re.search(rb"end_header\r?\n", head)
    if end is None:
        raise ImportFormatError("missing end_header")
    kind, count, inside, properties = None, None, False, []
    for line in head[: end.start()].decode("utf-8").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            if inside:
                count = int(words[2])
            elif count is None:
                raise ImportFormatError("the vertex element has to come first")
        elif words[:1] == ["property"] and inside:
            if words[1] not in SCALARS:
                raise ImportFormatError(f"unsupported vertex property type {words[1]!r}")
            properties.append((words[2], SCALARS[words[1]]))
    if count is None or not {"x", "y", "z"} <= {name for name, _ in properties}:
        raise ImportFormatError("missing vertex positions")
    return kind, count, properties, end.end()


def _source_of(properties: list[tuple[str, str]]) -> dict[str, str | None]:
    names = {name for name, _ in properties}
    return {out: next((n for n in options if n in names), None) for out, options in ALIASES.items()}


def scan_ply(spark: SparkSession, path: str) -> DataFrame:
    """Raw vertices numbered by ``idx``; missing normals are 0 and missing colours 255."""
    kind, count, properties, offset = read_header(path)
    source = _source_of(properties)
    if kind == "ascii":
        return _scan_ascii(spark, path, count, properties, source)
    if kind != "binary_little_endian":
        raise ImportFormatError(f"unsupported PLY format {kind!r}")
    record = np.dtype(properties)
    if file_size(path) - offset < count * record.itemsize:
        raise ImportFormatError("truncated vertex payload")

    def decode(payload: bytes, row) -> pd.DataFrame:
        rows = np.frombuffer(payload, dtype=record)
        out = {"idx": np.arange(row.first, row.first + len(rows))}
        for name in ("x", "y", "z", "nx", "ny", "nz"):
            out[name] = rows[source[name]].astype(float) if source[name] else np.zeros(len(rows))
        for name in "rgb":
            out[name] = rows[source[name]].astype(np.int16) if source[name] else np.full(len(rows), 255, np.int16)
        return pd.DataFrame(out)

    return decode_ranges(record_ranges(spark, path, offset, record.itemsize, count, ROWS_PER_RANGE), decode, SCHEMA)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their number.

    The order of lines is the split offset and then the position in the split;
    both are known to the scan, so no task has to read the whole file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seen"), "value")
    return global_index(lines, ["_file", "_start", "_seen"], "line").select("line", "value")


def _scan_ascii(spark, path, count, properties, source) -> DataFrame:
    lines = numbered_lines(spark, path)
    end = lines.filter("trim(value) = 'end_header'").agg(F.min("line")).first()[0]
    words = F.split(F.trim("value"), r"\s+")
    place = {name: i for i, (name, _) in enumerate(properties)}

    def pick(name: str, kind: str, missing: float):
        return (words.getItem(place[source[name]]).cast(kind) if source[name] else F.lit(missing).cast(kind)).alias(name)

    body = lines.filter((F.col("line") > end) & (F.col("line") <= end + count))
    return body.select(
        (F.col("line") - end - 1).alias("idx"), *[pick(n, "double", 0.0) for n in ("x", "y", "z", "nx", "ny", "nz")],
        *[pick(n, "short", 255) for n in "rgb"])


def import_points(spark: SparkSession, path: str) -> DataFrame:
    """Surfels of a multi-view stereo cloud: finite rows, unit normals, a scene-relative radius."""
    raw = scan_ply(spark, path).filter(V.all_finite(F.col("x"), F.col("y"), F.col("z")))
    unit = V.normalize(V.vec("nx", "ny", "nz"))
    extent = bounds(raw).select(F.greatest(F.col("diagonal") / 4096, F.lit(1e-5)).alias("radius"))
    named = raw.withColumns({
        name: F.coalesce(component, F.lit(0.0)) for name, component in zip(("nx", "ny", "nz"), unit)
    })
    return attach(named, extent).select(
        "idx", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", F.lit(1.0).alias("confidence"), "radius",
        F.lit(-1).alias("first_observing_frame"), F.lit(1).cast("long").alias("contributors"))


def sample_positions(spark: SparkSession, path: str, maximum: int) -> DataFrame:
    """Every k-th vertex, with the smallest k that stays within ``maximum``."""
    count = read_header(path)[1]
    stride = max(1, -(-count // maximum))
    return scan_ply(spark, path).filter(F.col("idx") % stride == 0)
