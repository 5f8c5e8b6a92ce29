"""Recorded model outputs and expected results of the streaming geometry.

``VPS1`` holds the input windows, ``VPO1``/``CPS1`` expected clouds and
``MVO1`` raw multi-view outputs. All are little-endian; every view is read by
its own task.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import ImportFormatError
from ..schemas import PIXELS, VIEWS
from .files import decode_ranges, file_size, open_file, read_range, record_ranges


def window_lengths(frames: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, length) of every scheduled window."""
    step, out, start = size - overlap, [], 0
    while True:
        out.append((start, min(size, frames - start)))
        if start + size >= frames:
            return out
        start += step


def _read(handle, layout: str):
    size = struct.calcsize("<" + layout)
    data = handle.read(size)
    if len(data) != size:
        raise ImportFormatError("truncated recording")
    return struct.unpack("<" + layout, data)


def read_input_header(path: str) -> dict:
    """Header of a VPS1 file (versions 2 and 3) and the place of every view.

    ``path`` may be a comma-separated list: the header and one part for each window or each view.
    """
    files = path.split(",")
    with open_file(files[0]) as handle:
        if handle.read(4) != b"VPS1":
            raise ImportFormatError("not a VPS1 recording")
        version, frames, height, width, size, overlap, percentile, point_size, minimum = _read(handle, "IIIIIIdfI")
        if version not in (2, 3):
            raise ImportFormatError(f"unsupported version {version}")
        branches = _read(handle, "I")[0] if version == 3 else 0
        windows = _read(handle, "I")[0]
        offset = handle.tell()
    plane = width * height
    schedule = window_lengths(frames, size, overlap) if frames and 0 <= overlap < size and size >= 2 else []
    if plane == 0 or branches & ~3 or len(schedule) != windows or not 0 <= percentile <= 100 or not point_size > 0:
        raise ImportFormatError("invalid VPS1 header")
    total = sum(length for _, length in schedule)
    if len(files) not in (1, 1 + windows, 1 + total):
        raise ImportFormatError("a recording in parts has one part for each window or each view")
    view_bytes, views = 4 * 21 + 11 * plane, []
    by_view = len(files) == 1 + total
    for index, (start, length) in enumerate(schedule):
        where = files[1 + (len(views) if by_view else index)] if len(files) > 1 else files[0]
        offset = offset if len(files) == 1 else 0
        with open_file(where) as handle:
            if handle.read_at(4, offset) != struct.pack("<I", length):
                raise ImportFormatError("a window does not follow the schedule")
            # The part of a view holds nothing else; the first of a window has the window's length before it.
            first = [(where, offset + 4 + view_bytes * i, view_bytes, index, start + i) for i in range(1 if by_view else length)]
            offset += 4 + view_bytes * len(first)
            if (len(files) > 1 or index == windows - 1) and handle.size() != offset:
                raise ImportFormatError("unexpected recording length")
        views += first
        for i in range(len(first), length):
            views.append((files[1 + len(views)], 0, view_bytes, index, start + i))
            if file_size(views[-1][0]) != view_bytes:
                raise ImportFormatError("unexpected recording length")
    return {"frames": frames, "height": height, "width": width, "size": size, "overlap": overlap, "percentile": percentile,
            "point_size": point_size, "minimum_overlap": minimum, "icp": bool(branches & 1), "loops": bool(branches & 2), "views": views}


def scan_input(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """Header, ``views`` and ``pixels`` of a VPS1 recording."""
    header = read_input_header(path)
    height, width = header["height"], header["width"]
    plane = height * width
    ranges = spark.createDataFrame(header["views"], "path string, offset long, length long, window_index int, frame_index int")
    ranges = ranges.repartition(len(header["views"]))

    def numbers(payload: bytes):
        values = np.frombuffer(payload, "<f4", 21 + 2 * plane)
        if not np.isfinite(values).all():
            raise ImportFormatError("recordings hold finite values only")
        return values.astype(float)

    def view(payload: bytes, row) -> pd.DataFrame:
        values = numbers(payload)
        return pd.DataFrame({"window_index": [row.window_index], "frame_index": [row.frame_index], "w2c": [values[9:21].tolist()], "k": [values[:9].tolist()]})

    def pixels(payload: bytes, row) -> pd.DataFrame:
        values, at = numbers(payload), np.arange(plane)
        rgb = np.frombuffer(payload, np.uint8, 3 * plane, 4 * (21 + 2 * plane)).reshape(-1, 3).astype(np.int16)
        return pd.DataFrame({
            "window_index": row.window_index, "frame_index": row.frame_index, "px": at % width, "py": at // width,
            "depth": values[21:21 + plane], "confidence": values[21 + plane:], "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    return header, decode_ranges(ranges, view, VIEWS), decode_ranges(ranges, pixels, PIXELS)


ROWS_PER_RANGE = 500_000
_CLOUD = "ordinal long, x double, y double, z double, r short, g short, b short, radius double"


def _cloud(spark: SparkSession, path: str, start: int, points: int) -> DataFrame:
    """Expected points: three columnar arrays, each task reading its slice of all three."""
    rgb_start, radius_start = start + 12 * points, start + 15 * points

    def decode(payload: bytes, row) -> pd.DataFrame:
        xyz = np.frombuffer(payload, "<f4").reshape(-1, 3).astype(float)
        first, count = int(row.first), int(row.count)
        rgb = np.frombuffer(read_range(path, rgb_start + 3 * first, 3 * count), "u1").reshape(-1, 3).astype(np.int16)
        radius = np.frombuffer(read_range(path, radius_start + 4 * first, 4 * count), "<f4").astype(float)
        return pd.DataFrame({"ordinal": np.arange(first, first + count), **{n: xyz[:, i] for i, n in enumerate("xyz")},
                             **{n: rgb[:, i] for i, n in enumerate("rgb")}, "radius": radius})

    return decode_ranges(record_ranges(spark, path, start, 12, points, ROWS_PER_RANGE), decode, _CLOUD)


def _small(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """A table with one row per frame or window of the capture."""
    return spark.createDataFrame(pd.DataFrame(columns))


def scan_expected_cloud(spark: SparkSession, path: str) -> dict:
    """VPO1 or CPS1: header numbers plus ``points``, ``frame_counts``, ``cameras`` and (VPO1) ``windows``."""
    with open_file(path) as handle:
        magic = handle.read(4)
        take = lambda kind, n: np.frombuffer(handle.read(n * np.dtype(kind).itemsize), kind)
        skip = lambda n: handle.seek(handle.tell() + n)
        if magic == b"VPO1":
            version, frames, height, width, points, windows, warnings, loops, scale = _read(handle, "IIIIIIiif")
            poses, header = frames, {"frames": frames, "height": height, "width": width, "warnings": warnings, "loops": loops, "scale": scale}
            if height * width == 0:
                raise ImportFormatError("invalid header")
        elif magic == b"CPS1":
            version, frames, points, poses = _read(handle, "IIII")
            windows, header = 0, {"frames": frames}
        else:
            raise ImportFormatError("not a VPO1 or CPS1 recording")
        if version != 1 or frames == 0 or poses > frames:
            raise ImportFormatError("invalid header")
        counts = take("<i4", frames) if magic == b"CPS1" else None
        if counts is not None and ((counts < 0).any() or counts.sum() != points):
            raise ImportFormatError("point counts do not add up")
        header["points"] = _cloud(spark, path, handle.tell(), points)
        skip(19 * points)
        if counts is None:
            counts = take("<i4", frames)
            place, middle = take("<f4", 3 * windows).reshape(-1, 3).astype(float), take("<i4", windows)
            if windows:
                header["windows"] = _small(spark, window_index=np.arange(windows), x=place[:, 0], y=place[:, 1], z=place[:, 2], mid_frame=middle)
        centre, facing = (take("<f4", 3 * poses).astype(float) for _ in range(2))
        if handle.tell() != handle.size() or len(facing) != 3 * poses:
            raise ImportFormatError("unexpected recording length")
    header["frame_counts"] = _small(spark, frame_index=np.arange(frames), points=counts.astype(np.int64))
    if poses:
        c, f = centre.reshape(-1, 3), facing.reshape(-1, 3)
        header["cameras"] = _small(spark, frame_index=np.arange(poses), x=c[:, 0], y=c[:, 1], z=c[:, 2], fx=f[:, 0], fy=f[:, 1], fz=f[:, 2])
    return header


def cloud_header(path: str) -> tuple[int, int]:
    """Where the points of a VPO1 or CPS1 recording begin, and how many there are."""
    with open_file(path) as handle:
        magic = handle.read(4)
        if magic == b"VPO1":
            version, frames, height, width, points, *_ = _read(handle, "IIIIIIiif")
            good = height * width > 0
        elif magic == b"CPS1":
            version, frames, points, poses = _read(handle, "IIII")
            handle.seek(handle.tell() + 4 * frames)
            good = poses <= frames
        else:
            raise ImportFormatError("not a VPO1 or CPS1 recording")
        if version != 1 or frames == 0 or not good or handle.size() < handle.tell() + 19 * points:
            raise ImportFormatError("invalid header")
        return handle.tell(), points


def multiview_header(path: str) -> dict:
    """Header of a MVO1 file and the place of every view."""
    with open_file(path) as handle:
        if handle.read(4) != b"MVO1":
            raise ImportFormatError("not a MVO1 recording")
        version, frames, size, overlap, windows = _read(handle, "IIIII")
        schedule = window_lengths(frames, size, overlap) if frames and size >= 2 and 0 <= overlap < size else []
        if version != 1 or not windows or len(schedule) != windows:
            raise ImportFormatError("invalid MVO1 header")
        views, shape = [], None
        for index, (start, length) in enumerate(schedule):
            first, count, height, width = _read(handle, "IIII")
            if (first, count) != (start, length) or height * width == 0 or shape not in (None, (height, width)):
                raise ImportFormatError("a window does not follow the schedule")
            shape, here = (height, width), handle.tell()
            each = 4 * (2 * height * width + 21)
            views += [(path, here + each * i, each, index, start + i) for i in range(count)]
            handle.seek(here + each * count)
        if handle.tell() != handle.size():
            raise ImportFormatError("unexpected recording length")
    return {"frames": frames, "size": size, "overlap": overlap, "height": shape[0], "width": shape[1], "views": views}


def scan_multiview(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """MVO1: header and one row per view with its arrays."""
    header = multiview_header(path)
    views = header.pop("views")
    plane = header["height"] * header["width"]
    ranges = spark.createDataFrame(views, "path string, offset long, length long, window_index int, frame_index int").repartition(len(views))

    def decode(payload: bytes, row) -> pd.DataFrame:
        v = np.frombuffer(payload, "<f4").astype(float)
        return pd.DataFrame({"window_index": [row.window_index], "frame_index": [row.frame_index], "depth": [v[:plane].tolist()],
                             "confidence": [v[plane:2 * plane].tolist()], "w2c": [v[2 * plane:2 * plane + 12].tolist()], "k": [v[2 * plane + 12:].tolist()]})

    schema = "window_index int, frame_index int, depth array<double>, confidence array<double>, w2c array<double>, k array<double>"
    return header, decode_ranges(ranges, decode, schema)
