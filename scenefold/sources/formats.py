"""The binary evidence formats as Spark data sources.

``register(spark)`` makes them known; then ``spark.read.format("scene_ply").load(path)``
and so on. A path is a file, a folder or a pattern of one folder; a folder written by
``sinks.committed`` lists only what was committed.

* A reader plans spans (byte ranges of a file, or views of a recording) from headers.
  Tasks open the file and read their own span.
* Spans that cannot match are never opened: an option named like a key column, such as
  ``frame_index=3,7``, ``window_index=0..4`` or ``file_name=a.bin``, keeps those rows only.
* With the option ``push_filters=true`` filters on these columns are pushed down as well
  (``spark.sql.python.filterPushdown.enabled`` has to be set). It is off by default: Spark
  4.1 keeps the pushed filters with the relation, so a DataFrame that was read with a
  filter and then without one would give the filtered rows again. Use it for a scan that
  is read once. Spark applies every pushed filter again.
* ``.schema("x double, y double")`` asks for some columns only; the others are not decoded.
* Values stay in Arrow arrays from the file to Spark; there is no Python object per pixel.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import ImportFormatError
from .files import file_size, list_files, open_file, read_range

ROWS_PER_SPAN = 500_000


@dataclass
class Span(InputPartition):
    """A part of a file; ``known`` has the constant columns and the ranges of others, (low, high) included."""

    path: str
    offset: int
    length: int
    first: int = 0
    count: int = 0
    known: dict = field(default_factory=dict)
    extra: tuple = ()


def _may_match(bounds: tuple, test: Filter) -> bool:
    low, high = bounds if isinstance(bounds, tuple) else (bounds, bounds)
    if isinstance(test, In):
        return any(low <= v <= high for v in test.value if v is not None)
    if test.value is None:
        return True
    if isinstance(test, (EqualTo, EqualNullSafe)):
        return low <= test.value <= high
    if isinstance(test, GreaterThan):
        return high > test.value
    if isinstance(test, GreaterThanOrEqual):
        return high >= test.value
    if isinstance(test, LessThan):
        return low < test.value
    return low <= test.value


def _choice(text: str) -> tuple:
    """``low..high`` or a list of values as (low, high, values)."""
    number = lambda v: int(v) if re.fullmatch(r"-?\d+", v.strip()) else v.strip()
    if ".." in text and re.fullmatch(r"\s*-?\d+\.\.-?\d+\s*", text):
        low, high = (int(v) for v in text.split(".."))
        return low, high, None
    values = frozenset(number(v) for v in text.split(","))
    return min(values), max(values), values


def _overlaps(bounds: object, choice: tuple) -> bool:
    low, high, values = choice
    first, last = bounds if isinstance(bounds, tuple) else (bounds, bounds)
    if values is not None:
        return any(first <= v <= last for v in values)
    return first <= high and last >= low


_PUSHED = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)


class SpanReader(DataSourceReader):
    """Reads the spans of ``plan(path)`` by ``decode(span, wanted)``, which gives a column by name."""

    def __init__(self, source: "SceneSource", schema: StructType) -> None:
        self.source, self.schema, self.paths = source, schema, source.files()
        self.tests: list[Filter] = []
        self.kept = {k: _choice(source.options[k]) for k in source.keys if k in source.options}

    def partitions(self) -> Sequence[InputPartition]:
        spans = []
        for path in self.paths:
            for span in self.source.plan(path, self.source.rows_seen):
                pushed = all(_may_match(span.known[t.attribute[0]], t) for t in self.tests if t.attribute[0] in span.known)
                if pushed and all(_overlaps(span.known[k], choice) for k, choice in self.kept.items() if k in span.known):
                    spans.append(span)
        return spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        for columns in self.source.decode(span, set(shape.names) | set(self.kept)):
            arrays = []
            for f in shape:
                if f.name not in columns:
                    raise ImportFormatError(f"{span.path} has no column {f.name!r}")
                value = columns[f.name]
                arrays.append(value if isinstance(value, pa.Array) else pa.array(np.ascontiguousarray(value)).cast(f.type))
            batch = pa.RecordBatch.from_arrays(arrays, schema=shape)
            for k, (low, high, values) in self.kept.items():
                # A span may hold rows before and after the wanted range.
                if isinstance(span.known.get(k), tuple):
                    held = np.asarray(columns[k])
                    mask = (held >= low) & (held <= high) if values is None else np.isin(held, list(values))
                    batch = batch.filter(pa.array(mask))
                    columns = {n: np.asarray(c)[mask] if n in self.kept else c for n, c in columns.items()}
            yield batch


class PushingReader(SpanReader):
    """Takes filters from Spark as well."""

    def pushFilters(self, filters: list[Filter]):
        for test in filters:
            if isinstance(test, _PUSHED) and len(test.attribute) == 1 and test.attribute[0] in self.source.keys:
                self.tests.append(test)
            yield test


class SceneSource(DataSource):
    """A format: ``plan`` lists spans, ``decode`` reads one, ``keys`` are the columns filters prune by."""

    keys: tuple[str, ...] = ()
    pattern = "*"
    columns = ""
    rows_seen = 0

    def files(self) -> list[str]:
        if "path" not in self.options:
            raise ImportFormatError("load() needs a path")
        found = list_files(self.options["path"], self.options.get("pattern", self.pattern))
        if not found:
            raise ImportFormatError(f"{self.options['path']} holds no {self.name()} file")
        return found

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> SpanReader:
        return (PushingReader if self.options.get("push_filters", "false").lower() == "true" else SpanReader)(self, schema)

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        raise NotImplementedError

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        raise NotImplementedError


def record_spans(path: str, start: int, stride: int, records: int, seen: int, per_span: int = ROWS_PER_SPAN, key: str = "idx", extra: tuple = ()) -> Iterator[Span]:
    for first in range(0, records, per_span):
        count = min(per_span, records - first)
        known = {key: (seen + first, seen + first + count - 1)}
        yield Span(path, start + first * stride, count * stride, seen + first, count, known, extra)


# --- point clouds ---------------------------------------------------------

class PlySource(SceneSource):
    """Binary PLY. Columns are ``ply.SCHEMA``, or with ``raw=true`` the properties of the first file.

    ``stride=k`` keeps every k-th vertex. ``idx`` runs on over the files of a folder.
    """

    keys, pattern = ("idx",), "*.ply"

    @classmethod
    def name(cls) -> str:
        return "scene_ply"

    def _raw(self) -> bool:
        return self.options.get("raw", "false").lower() == "true"

    def schema(self) -> str:
        from .ply import SCHEMA, read_header

        if not self._raw():
            return SCHEMA
        kinds = {"i1": "tinyint", "u1": "smallint", "<i2": "smallint", "<u2": "int", "<i4": "int", "<u4": "bigint", "<f4": "float", "<f8": "double"}
        return "idx bigint, " + ", ".join(f"`{name}` {kinds[kind]}" for name, kind in read_header(self.files()[0])[2])

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        from .ply import read_header

        kind, count, properties, offset = read_header(path)
        if kind != "binary_little_endian":
            raise ImportFormatError(f"{path} is {kind}; ply.scan_ply reads text")
        size = np.dtype(properties).itemsize
        if file_size(path) - offset < count * size:
            raise ImportFormatError("truncated vertex payload")
        self.rows_seen = seen + count
        yield from record_spans(path, offset, size, count, seen, extra=tuple(properties))

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        from .ply import _source_of

        rows = np.frombuffer(read_range(span.path, span.offset, span.length), np.dtype(list(span.extra)))
        numbers = np.arange(span.first, span.first + span.count)
        stride = int(self.options.get("stride", "1"))
        if stride > 1:
            kept = numbers % stride == 0
            rows, numbers = rows[kept], numbers[kept]
        out = {"idx": numbers}
        if self._raw():
            out |= {n: rows[n] for n, _ in span.extra if n in wanted}
        else:
            source = _source_of(list(span.extra))
            for name in wanted & set("x y z nx ny nz".split()):
                out[name] = rows[source[name]].astype(float) if source[name] else np.zeros(len(rows))
            for name in wanted & set("rgb"):
                out[name] = rows[source[name]].astype(np.int16) if source[name] else np.full(len(rows), 255, np.int16)
        yield out


class SurfelSource(SceneSource):
    """VSPT surfel chunks; ``idx`` runs on over the chunks in their order."""

    keys, pattern = ("idx",), "*.bin"
    columns = "idx long, x float, y float, z float, nx float, ny float, nz float, r short, g short, b short, confidence float, radius float, contributors long"

    @classmethod
    def name(cls) -> str:
        return "scene_surfels"

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        from ..sinks.clouds import SURFEL, SURFEL_MAGIC, SURFEL_VERSION

        with open_file(path) as handle:
            head, size = handle.read(12), handle.size()
        version, stride, count = np.frombuffer(head[4:6] + head[6:8], "<u2").tolist() + [int.from_bytes(head[8:12], "little")] if len(head) == 12 else (0, 0, 0)
        if head[:4] != SURFEL_MAGIC or version != SURFEL_VERSION or stride != SURFEL.itemsize or size != 12 + stride * count:
            raise ImportFormatError(f"{path} is not a surfel chunk")
        self.rows_seen = seen + count
        yield from record_spans(path, 12, stride, count, seen)

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        from ..sinks.clouds import SURFEL

        rows = np.frombuffer(read_range(span.path, span.offset, span.length), SURFEL)
        out = {"idx": np.arange(span.first, span.first + span.count), "confidence": rows["conf"], "radius": rows["radius"], "contributors": rows["contributors"]}
        for block, names in (("p", "x y z"), ("n", "nx ny nz"), ("c", "r g b")):
            out |= {n: rows[block][:, i] for i, n in enumerate(names.split()) if n in wanted}
        yield out


class SplatSource(SceneSource):
    """32-byte splat rows; ``idx`` runs on over the parts."""

    keys, pattern = ("idx",), "*.splat"
    columns = "idx long, x float, y float, z float, sx float, sy float, sz float, r short, g short, b short, a short, q0 short, q1 short, q2 short, q3 short"

    @classmethod
    def name(cls) -> str:
        return "scene_splats"

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        from ..sinks.clouds import SPLAT

        count, rest = divmod(file_size(path), SPLAT.itemsize)
        if rest:
            raise ImportFormatError(f"{path} ends inside a splat")
        self.rows_seen = seen + count
        yield from record_spans(path, 0, SPLAT.itemsize, count, seen)

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        from ..sinks.clouds import SPLAT

        rows = np.frombuffer(read_range(span.path, span.offset, span.length), SPLAT)
        out = {"idx": np.arange(span.first, span.first + span.count)}
        for block, names in (("p", "x y z"), ("s", "sx sy sz"), ("c", "r g b a"), ("q", "q0 q1 q2 q3")):
            out |= {n: rows[block][:, i] for i, n in enumerate(names.split()) if n in wanted}
        yield out


# --- rasters --------------------------------------------------------------

def _pixels(first: int, count: int, width: int) -> dict:
    at = np.arange(first, first + count)
    return {"px": (at % width).astype(np.int32), "py": (at // width).astype(np.int32)}


def _text(value: str, rows: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(rows, np.int32)), pa.array([value])).cast(pa.string())


class DenseArraySource(SceneSource):
    """Dense stereo arrays, ``width&height&channels&`` and float32 values: a row per pixel of channel 0."""

    keys, columns = ("file_name", "py"), "file_name string, px int, py int, depth double"

    @classmethod
    def name(cls) -> str:
        return "scene_dense_array"

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        with open_file(path) as handle:
            head = re.match(rb"(\d+)&(\d+)&(\d+)&", handle.read(128))
            size = handle.size()
        if head is None:
            raise ImportFormatError(f"{path} has no three-field header")
        w, h, c = (int(v) for v in head.groups())
        if min(w, h, c) <= 0 or size - head.end() != 4 * w * h * c:
            raise ImportFormatError(f"{path} does not hold {w}x{h}x{c} values")
        name = path.rsplit("/", 1)[-1]
        per_span = max(1, ROWS_PER_SPAN // w)
        for row in range(0, h, per_span):
            rows = min(per_span, h - row)
            yield Span(path, head.end() + 4 * row * w * c, 4 * rows * w * c, row * w, rows * w, {"file_name": name, "py": (row, row + rows - 1)}, (w, c))

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        width, channels = span.extra
        out = _pixels(span.first, span.count, width)
        if "depth" in wanted:
            out["depth"] = np.frombuffer(read_range(span.path, span.offset, span.length), "<f4")[::channels].astype(float)
        if "file_name" in wanted:
            out["file_name"] = _text(span.known["file_name"], span.count)
        yield out


class PredictionBatchSource(SceneSource):
    """NPZ prediction batches: a row per pixel. A frame that the filters exclude is not decoded.

    An archive's arrays are read one by one, so columns that are not asked for are not unpacked.
    """

    keys, pattern = ("batch", "frame_index", "slot"), "*.npz"
    columns = "batch string, slot int, frame_index int, px int, py int, depth double, confidence double, r short, g short, b short"

    @classmethod
    def name(cls) -> str:
        return "scene_prediction_batch"

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        with open_file(path) as handle, np.load(io.BytesIO(handle.read())) as data:
            needed = {"depth", "conf", "rgb", "intrinsics", "extrinsics", "frame_indices"}
            if not needed <= set(data.files):
                raise ImportFormatError(f"{path} lacks {sorted(needed - set(data.files))}")
            index = data["frame_indices"].astype(int).tolist()
        for slot, frame in enumerate(index):
            yield Span(path, 0, 0, 0, len(index), {"batch": path.rsplit("/", 1)[-1], "slot": slot, "frame_index": frame})

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        slot = span.known["slot"]
        with open_file(span.path) as handle, np.load(io.BytesIO(handle.read())) as data:
            depth = data["depth"]
            if depth.ndim != 3 or len(depth) != span.count:
                raise ImportFormatError(f"{span.path} has inconsistent shapes")
            _, height, width = depth.shape
            plane = height * width
            out = _pixels(0, plane, width) | {"slot": np.full(plane, slot, np.int32), "frame_index": np.full(plane, span.known["frame_index"], np.int32)}
            out["depth"] = depth[slot].ravel().astype(float)
            if "confidence" in wanted:
                conf = data["conf"]
                if conf.shape != depth.shape:
                    raise ImportFormatError(f"{span.path} has inconsistent shapes")
                out["confidence"] = conf[slot].ravel().astype(float)
            if wanted & set("rgb"):
                rgb = data["rgb"]
                if rgb.shape != (*depth.shape, 3):
                    raise ImportFormatError(f"{span.path} has inconsistent shapes")
                out |= {n: rgb[slot, :, :, i].ravel().astype(np.int16) for i, n in enumerate("rgb")}
        if "batch" in wanted:
            out["batch"] = _text(span.known["batch"], plane)
        yield out


class SemanticMaskSource(SceneSource):
    """Semantic masks: a row per mask pixel; every frame is a span of its own."""

    keys, columns = ("frame_index",), "frame_index int, x int, y int, class_code tinyint, confidence double"

    @classmethod
    def name(cls) -> str:
        return "scene_semantic_mask"

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        from .rasters import mask_header

        indices, width, height, start = mask_header(path)
        plane = width * height
        for i, frame in enumerate(indices):
            yield Span(path, start + i * plane, plane, 0, plane, {"frame_index": int(frame)}, (width, start + (len(indices) + i) * plane))

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        width, sure = span.extra
        at = _pixels(0, span.count, width)
        out = {"frame_index": np.full(span.count, span.known["frame_index"], np.int32), "x": at["px"], "y": at["py"]}
        codes = np.frombuffer(read_range(span.path, span.offset, span.length), np.uint8)
        if codes.max(initial=0) > 6:
            raise ImportFormatError("unknown class code")
        out["class_code"] = codes.astype(np.int8)
        if "confidence" in wanted:
            out["confidence"] = np.frombuffer(read_range(span.path, sure, span.count), np.uint8) / 255.0
        yield out


# --- recordings -----------------------------------------------------------

class RecordingSource(SceneSource):
    """VPS1 recordings: a row per pixel, or with ``table=views`` per view. A path may hold parts in name order.

    Spans are views, so filters on ``window_index`` and ``frame_index`` skip whole views.
    """

    keys = ("window_index", "frame_index")

    @classmethod
    def name(cls) -> str:
        return "scene_recording"

    def schema(self) -> str:
        from ..schemas import PIXELS, VIEWS

        return VIEWS if self.options.get("table") == "views" else PIXELS

    def files(self) -> list[str]:
        found = super().files()
        return [",".join(found)] if found[0].rsplit("/", 1)[-1].startswith("part-") else found

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        from .recordings import read_input_header

        header = read_input_header(path)
        for where, offset, length, window, frame in header["views"]:
            yield Span(where, offset, length, 0, header["height"] * header["width"], {"window_index": window, "frame_index": frame}, (header["width"],))

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        payload = read_range(span.path, span.offset, span.length)
        values = np.frombuffer(payload, "<f4", 21 + 2 * span.count)
        if not np.isfinite(values).all():
            raise ImportFormatError("recordings hold finite values only")
        views = self.options.get("table") == "views"
        rows = 1 if views else span.count
        out = {n: np.full(rows, span.known[n], np.int32) for n in self.keys}
        if views:
            out |= {"k": pa.array([values[:9].astype(float)], pa.list_(pa.float64())), "w2c": pa.array([values[9:21].astype(float)], pa.list_(pa.float64()))}
        else:
            rgb = np.frombuffer(payload, np.uint8, 3 * rows, 4 * (21 + 2 * rows)).reshape(-1, 3)
            out |= _pixels(0, rows, span.extra[0]) | {"depth": values[21 : 21 + rows].astype(float), "confidence": values[21 + rows :].astype(float)}
            out |= {n: rgb[:, i].astype(np.int16) for i, n in enumerate("rgb")}
        yield out


class ExpectedCloudSource(SceneSource):
    """Points of VPO1 and CPS1 recordings: three columnar blocks, each span reads its slice of those it needs."""

    keys, columns = ("ordinal",), "ordinal long, x double, y double, z double, r short, g short, b short, radius double"

    @classmethod
    def name(cls) -> str:
        return "scene_expected_cloud"

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        from .recordings import cloud_header

        start, points = cloud_header(path)
        self.rows_seen = seen + points
        yield from record_spans(path, start, 12, points, 0, key="ordinal", extra=(start, points))

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        start, points = span.extra
        out = {"ordinal": np.arange(span.first, span.first + span.count)}
        if wanted & set("xyz"):
            xyz = np.frombuffer(read_range(span.path, span.offset, span.length), "<f4").reshape(-1, 3)
            out |= {n: xyz[:, i].astype(float) for i, n in enumerate("xyz")}
        if wanted & set("rgb"):
            rgb = np.frombuffer(read_range(span.path, start + 12 * points + 3 * span.first, 3 * span.count), np.uint8).reshape(-1, 3)
            out |= {n: rgb[:, i].astype(np.int16) for i, n in enumerate("rgb")}
        if "radius" in wanted:
            out["radius"] = np.frombuffer(read_range(span.path, start + 15 * points + 4 * span.first, 4 * span.count), "<f4").astype(float)
        yield out


class MultiviewSource(SceneSource):
    """MVO1 raw outputs: a row per pixel of each view."""

    keys, columns = ("window_index", "frame_index"), "window_index int, frame_index int, px int, py int, depth double, confidence double"

    @classmethod
    def name(cls) -> str:
        return "scene_multiview"

    def plan(self, path: str, seen: int) -> Iterator[Span]:
        from .recordings import multiview_header

        header = multiview_header(path)
        plane = header["height"] * header["width"]
        for where, offset, length, window, frame in header["views"]:
            yield Span(where, offset, length, 0, plane, {"window_index": window, "frame_index": frame}, (header["width"],))

    def decode(self, span: Span, wanted: set[str]) -> Iterator[dict]:
        values = np.frombuffer(read_range(span.path, span.offset, 8 * span.count), "<f4")
        out = {n: np.full(span.count, span.known[n], np.int32) for n in self.keys}
        yield out | _pixels(0, span.count, span.extra[0]) | {"depth": values[: span.count].astype(float), "confidence": values[span.count :].astype(float)}


SOURCES: tuple[type[SceneSource], ...] = (
    PlySource, SurfelSource, SplatSource, DenseArraySource, PredictionBatchSource, SemanticMaskSource, RecordingSource, ExpectedCloudSource, MultiviewSource,
)


def register(spark: SparkSession) -> SparkSession:
    """Make all formats known to the session, once."""
    from ..session import ship_package
    from ..sinks.committed import SINKS

    if not getattr(spark, "_scene_formats", False):
        ship_package(spark)
        sinks: dict[str, Callable] = {sink.name(): sink for sink in SINKS}
        for source in SOURCES:
            spark.dataSource.register(sinks.pop(source.name(), source))
        for sink in sinks.values():
            spark.dataSource.register(sink)
        spark._scene_formats = True
    return spark
