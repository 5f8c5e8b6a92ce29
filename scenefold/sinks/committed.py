"""Files of bounded size written by tasks and published by one commit.

``df.write.format("scene_...").mode("overwrite").save(folder)``: rows come sorted, each
task cuts its own into chunks and writes a file for each, one at a time. What it wrote
(chunk, name, hash, rows, bytes) goes to an index part of its own; the driver only gets
the name of that part and its sums. The commit writes ``_commits/current.json`` by a
rename, and readers list nothing else. A failed job deletes its folder; files of a
failed or repeated attempt are in no index.

A chunk is the rows with one value of ``chunk_key`` or, without that, the next ``rows``
rows. Files are made of units (all rows of a view, say), so that a task holds one unit.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import ExportError
from ..sources.files import COMMITTED, committed
from ..sources.formats import PlySource, RecordingSource, SplatSource, SurfelSource
from ..sources.recordings import window_lengths
from .clouds import PLY_RECORD, SPLAT, SURFEL, SURFEL_MAGIC, SURFEL_VERSION, glb_tile
from .writers import _system, write_atomic


@dataclass
class Part(WriterCommitMessage):
    """One task's index part."""

    name: str
    chunks: int
    rows: int


def _units(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in ``keys``; without keys, every ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = 0
        while at < batch.num_rows:
            if keys:
                rest = [batch.column(batch.schema.get_field_index(k)).slice(at) for k in keys]
                key = tuple(r[0].as_py() for r in rest)
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                same = np.logical_and.reduce([r.to_numpy(zero_copy_only=False) == v for r, v in zip(rest, key, strict=True)])
                take = len(same) if same.all() else int(np.argmin(same))
                last = key
            else:
                if size >= limit:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                take = min(batch.num_rows - at, limit - size)
            held.append(batch.slice(at, take))
            size += take
            at += take
    if held:
        yield pa.Table.from_batches(held)


def _block(rows: pa.Table, names: str) -> np.ndarray:
    return np.stack([rows.column(n).to_numpy() for n in names.split()], axis=1)


class ChunkWriter(DataSourceArrowWriter):
    """Writes the units of a sink's rows into one file per chunk."""

    def __init__(self, sink: ChunkSink, schema: StructType, overwrite: bool) -> None:
        self.sink, self.overwrite = sink, overwrite
        self.folder, self.id = sink.options["path"].rstrip("/"), uuid.uuid4().hex
        # Chunks named by their hash may go to a folder that writes share; others are in a folder of this write.
        self.shared = sink.options.get("chunks")
        self.data = self.shared or f"{self.folder}/data-{self.id}"
        missing = [c for c in sink.needed if c not in schema.names]
        if missing:
            raise ExportError(f"{sink.name()} needs the columns {missing}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        sink, context = self.sink, TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        system, inner = _system(self.data)
        system.create_dir(inner, recursive=True)
        lines: list[dict] = []
        out = digest = None
        units = rows = size = 0
        now = None

        def close() -> None:
            nonlocal out, rows, size
            for piece in sink.close(now, units):
                put(piece)
            out.close()
            place = now if now is not None else task << 32 | len(lines)
            name = sink.file_name(place, digest.hexdigest())
            system.move(part, f"{inner}/{name}")
            lines.append({"chunk": place, "name": f"{self.data if self.shared else self.data.rsplit('/', 1)[-1]}/{name}", "hash": digest.hexdigest(), "rows": rows, "bytes": size})
            out, rows, size = None, 0, 0

        def put(piece: bytes) -> None:
            nonlocal size
            out.write(piece)
            digest.update(piece)
            size += len(piece)

        key = sink.chunk_key
        try:
            for unit in _units(iterator, [*([key] if key else []), *sink.unit_keys], sink.limit()):
                chunk = unit.column(key)[0].as_py() if key else None
                if out is not None and (key is None or chunk != now):
                    close()
                if out is None:
                    now, units, digest = chunk, 0, hashlib.sha256()
                    part = f"{inner}/{uuid.uuid4().hex}.part"
                    out = system.open_output_stream(part)
                    put(sink.open(unit))
                put(sink.pack(unit, units))
                units += 1
                rows += unit.num_rows
            if out is not None:
                close()
        finally:
            if out is not None:
                out.close()
                system.delete_file(part)
        name = f"_index/{self.id}/part-{task:05d}-{attempt}.json"
        write_atomic(f"{self.folder}/{name}", "".join(json.dumps(x) + "\n" for x in lines).encode())
        return Part(name, len(lines), sum(x["rows"] for x in lines))

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        before = None if self.overwrite else committed(self.folder)
        document = {
            "parts": [*(before["parts"] if before else []), *(m.name for m in parts)],
            "chunks": sum(m.chunks for m in parts) + (before["chunks"] if before else 0),
            "rows": sum(m.rows for m in parts) + (before["rows"] if before else 0),
        }
        self.sink.committing(self.folder, document)
        write_atomic(f"{self.folder}/{COMMITTED}", json.dumps(document).encode())

    def abort(self, messages: list[Part | None]) -> None:
        for path in [f"{self.folder}/_index/{self.id}"] + ([] if self.shared else [self.data]):
            system, folder = _system(path)
            if system.get_file_info(folder).type == arrow_fs.FileType.Directory:
                system.delete_dir(folder)


class ChunkSink(DataSource):
    """What the files of a format look like."""

    chunk_key: str | None = None
    unit_keys: tuple[str, ...] = ()
    needed: tuple[str, ...] = ()
    suffix = ".bin"

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        self.chunk_key = self.options.get("chunk_key", self.chunk_key)
        return ChunkWriter(self, schema, overwrite)

    def limit(self) -> int:
        return int(self.options.get("rows", "50000"))

    def file_name(self, chunk: int, digest: str) -> str:
        if self.options.get("named") == "hash":
            return f"{self.options.get('prefix', '')}{digest}{self.suffix}"
        return f"part-{chunk:012d}{self.suffix}"

    def open(self, unit: pa.Table) -> bytes:
        return b""

    def pack(self, unit: pa.Table, before: int) -> bytes:
        raise NotImplementedError

    def close(self, chunk: int | None, units: int) -> Iterator[bytes]:
        yield b""

    def committing(self, folder: str, document: dict) -> None:
        """Last checks, and files that need the sums, before the commit."""


def _packed(record: np.dtype, rows: int, **columns) -> bytes:
    out = np.zeros(rows, dtype=record)
    for name, value in columns.items():
        out[name] = value
    return out.tobytes()


class SurfelSink(ChunkSink, SurfelSource):
    needed = tuple("x y z nx ny nz r g b confidence radius contributors".split())

    def pack(self, unit: pa.Table, before: int) -> bytes:
        get = lambda n: unit.column(n).to_numpy()
        body = _packed(SURFEL, unit.num_rows, p=_block(unit, "x y z"), n=_block(unit, "nx ny nz"), c=_block(unit, "r g b"), conf=get("confidence"),
                       radius=get("radius"), contributors=get("contributors"))
        return SURFEL_MAGIC + struct.pack("<HHI", SURFEL_VERSION, SURFEL.itemsize, unit.num_rows) + body


class PlySink(ChunkSink, PlySource):
    """Whole binary PLY files, one per chunk."""

    needed, suffix = tuple("x y z nx ny nz r g b".split()), ".ply"

    def pack(self, unit: pa.Table, before: int) -> bytes:
        names = [("float", n) for n in ("x", "y", "z", "nx", "ny", "nz")] + [("uchar", n) for n in ("red", "green", "blue")]
        header = ["ply", "format binary_little_endian 1.0", f"element vertex {unit.num_rows}", *[f"property {k} {n}" for k, n in names], "end_header"]
        return ("\n".join(header) + "\n").encode() + _packed(PLY_RECORD, unit.num_rows, p=_block(unit, "x y z"), n=_block(unit, "nx ny nz"), c=_block(unit, "r g b"))


class SplatSink(ChunkSink, SplatSource):
    """Splat rows from ``clouds.splat_columns``."""

    needed, suffix = tuple("x y z sx sy sz r g b a q0 q1 q2 q3".split()), ".splat"

    def pack(self, unit: pa.Table, before: int) -> bytes:
        return _packed(SPLAT, unit.num_rows, p=_block(unit, "x y z"), s=_block(unit, "sx sy sz"), c=_block(unit, "r g b a"), q=_block(unit, "q0 q1 q2 q3"))


class GlbSink(ChunkSink):
    """GLB 2.0 point tiles."""

    needed, suffix = tuple("x y z nx ny nz r g b".split()), ".glb"

    @classmethod
    def name(cls) -> str:
        return "scene_glb"

    def pack(self, unit: pa.Table, before: int) -> bytes:
        return glb_tile(_block(unit, "x y z"), _block(unit, "nx ny nz"), _block(unit, "r g b"))


class RecordingSink(ChunkSink, RecordingSource):
    """A VPS1 recording as parts: rows sorted by view, py, px, one file per view.

    ``view`` is the place of a view in the recording, see ``recordings.view_rows``; the
    first row of a view has its ``k`` and ``w2c``. Options are the numbers of the header.
    Put end to end in order, ``part-...`` files are the recording.
    """

    chunk_key, suffix = "view", ""
    unit_keys = ("view",)
    needed = tuple("view window_index frame_index px py depth confidence r g b k w2c".split())

    def _numbers(self) -> dict:
        whole = {n: int(self.options[n]) for n in ("frames", "height", "width", "size", "overlap", "minimum_overlap")}
        return whole | {n: float(self.options[n]) for n in ("percentile", "point_size")} | {n: self.options.get(n, "false").lower() == "true" for n in ("icp", "loops")}

    def file_name(self, chunk: int, digest: str) -> str:
        return f"part-{chunk + 1:05d}"

    def _views(self, window: int) -> tuple[int, int]:
        h = self._numbers()
        schedule = window_lengths(h["frames"], h["size"], h["overlap"])
        if not 0 <= window < len(schedule):
            raise ExportError(f"window {window} is not in the schedule")
        return schedule[window]

    def open(self, unit: pa.Table) -> bytes:
        start, count = self._views(unit.column("window_index")[0].as_py())
        return struct.pack("<I", count) if unit.column("frame_index")[0].as_py() == start else b""

    def pack(self, unit: pa.Table, before: int) -> bytes:
        h = self._numbers()
        window, frame, view = (unit.column(n)[0].as_py() for n in ("window_index", "frame_index", "view"))
        start, count = self._views(window)
        if not start <= frame < start + count or view != frame + window * h["overlap"]:
            raise ExportError("the views do not follow the window schedule")
        at = unit.column("py").to_numpy().astype(np.int64) * h["width"] + unit.column("px").to_numpy()
        if len(at) != h["height"] * h["width"] or (at != np.arange(len(at))).any():
            raise ExportError("a view needs each pixel of its raster once")
        numbers = [np.array(unit.column("k")[0].as_py()), np.array(unit.column("w2c")[0].as_py()), unit.column("depth").to_numpy(), unit.column("confidence").to_numpy()]
        return np.concatenate(numbers).astype("<f4").tobytes() + _block(unit, "r g b").astype(np.uint8).tobytes()

    def committing(self, folder: str, document: dict) -> None:
        h = self._numbers()
        schedule = window_lengths(h["frames"], h["size"], h["overlap"])
        if document["chunks"] != sum(count for _, count in schedule):
            raise ExportError("the views do not follow the window schedule")
        head = b"VPS1" + struct.pack("<IIIIIIdfI", 3, h["frames"], h["height"], h["width"], h["size"], h["overlap"], h["percentile"], h["point_size"], h["minimum_overlap"])
        head += struct.pack("<II", int(h["icp"]) | int(h["loops"]) << 1, len(schedule))
        name = f"_head-{uuid.uuid4().hex}/part-00000"
        write_atomic(f"{folder}/{name}", head)
        line = {"chunk": -1, "name": name, "hash": hashlib.sha256(head).hexdigest(), "rows": 0, "bytes": len(head)}
        index = f"_index/{uuid.uuid4().hex}.json"
        write_atomic(f"{folder}/{index}", (json.dumps(line) + "\n").encode())
        document["parts"] = [index, *document["parts"]]


class WindowSink(ChunkSink):
    """Measured windows as JSON documents, streamed view by view.

    Rows: window_index, start, stop, frame_index, ``camera`` and ``point`` (JSON texts; a
    view without points has one row with a null), sorted by window, frame and pixel.
    A part of a window also has ``first_view``, the place of its first view in the window,
    and ``continued``, whether an earlier part began that view.
    """

    chunk_key, unit_keys, suffix = "window_index", ("frame_index",), ".json"
    needed = ("window_index", "start", "stop", "frame_index", "camera", "point")

    @classmethod
    def name(cls) -> str:
        return "scene_windows"

    def open(self, unit: pa.Table) -> bytes:
        first = {n: unit.column(n)[0].as_py() for n in unit.column_names if n in (*self.needed[:3], "first_view", "continued")}
        window = {"index": first["window_index"], "start": first["start"], "end": first["stop"]}
        if first.get("first_view") is not None:
            window |= {"first_view": first["first_view"], "continued": first["continued"]}
        return json.dumps({"window": window})[:-1].encode() + b',"views":['

    def pack(self, unit: pa.Table, before: int) -> bytes:
        head = f'{{"frame_index":{unit.column("frame_index")[0].as_py()},"camera":{unit.column("camera")[0].as_py()},"points":['
        return (b"," if before else b"") + head.encode() + _joined(unit.column("point")) + b"]}"

    def close(self, chunk: int | None, units: int) -> Iterator[bytes]:
        yield b"]}"


class PointSink(ChunkSink):
    """Fused points as JSON documents of a bounded number of points each; rows are ``chunk`` and ``point``."""

    chunk_key, suffix = "chunk", ".json"
    needed = ("chunk", "point")

    @classmethod
    def name(cls) -> str:
        return "scene_points"

    def pack(self, unit: pa.Table, before: int) -> bytes:
        return b'{"points":[' + _joined(unit.column("point")) + b"]}"


class ReplaySink(ChunkSink):
    """VRPL payloads, one per frame; rows are sorted by frame, py, px and seen by the camera ``k``."""

    chunk_key, suffix = "frame_index", ".vrpl"
    needed = ("frame_index", "x", "y", "z", "r", "g", "b", "k")

    @classmethod
    def name(cls) -> str:
        return "scene_replay"

    def pack(self, unit: pa.Table, before: int) -> bytes:
        from .clouds import REPLAY_RECORD

        k = unit.column("k")[0].as_py()
        head = b"VRPL" + struct.pack("<HHI4f", 2, 0, unit.num_rows, k[0], k[4], k[2], k[5])
        return head + _packed(REPLAY_RECORD, unit.num_rows, p=_block(unit, "x y z"), c=_block(unit, "r g b"))


def _joined(texts: pa.ChunkedArray) -> bytes:
    whole = texts.drop_null().combine_chunks()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.cast(pa.string())), ",")[0].as_py().encode()


SINKS: tuple[type[ChunkSink], ...] = (SurfelSink, PlySink, SplatSink, GlbSink, RecordingSink, WindowSink, PointSink, ReplaySink)


def save(rows: DataFrame, kind: str, folder: str, by: str, order: list[str], finish: Callable[[DataFrame], DataFrame] | None = None, **options) -> dict:
    """Deal rows to tasks by ``by``, sort them there and write; the commit document is returned.

    A task holds whole values of ``by``, so chunks do not depend on the partitioning.
    ``finish`` makes wide columns, such as texts, only when the rows are dealt and sorted.
    """
    from ..sources.formats import register

    register(rows.sparkSession)
    sorted_rows = rows.repartition(by).sortWithinPartitions(by, *order)
    if finish is not None:
        sorted_rows = finish(sorted_rows)
    sorted_rows.write.format(kind).options(**{k: str(v) for k, v in options.items()}).mode("overwrite").save(folder)
    return committed(folder)
