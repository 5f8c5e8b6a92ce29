"""Point cloud exports.

Order and chunks come from ``chunk_numbers``; one task packs one chunk of a
bounded number of rows. Nothing is gathered in one place: a cloud larger than
one chunk is written as consecutive part files, to be concatenated in name
order where the format is a plain sequence, or used as tiles where it is not.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import ExportError
from ..functions import cameras as C
from ..functions import vectors as V
from ..operators.ordering import chunk_numbers
from ..session import settle
from .writers import content_named, write_atomic, write_files

CHUNK_ROWS = 50_000
# Raster rows of a block of a replay payload.
REPLAY_ROWS = 2_048
SURFEL_MAGIC, SURFEL_VERSION = b"VSPT", 1
# Record layouts. Fixed values.
SURFEL = np.dtype([("p", "<f4", 3), ("n", "<f4", 3), ("c", "u1", 3), ("pad", "u1"), ("conf", "<f4"), ("radius", "<f4"), ("contributors", "<u4")])
SPLAT = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])
PLY_RECORD = np.dtype([("p", "<f4", 3), ("n", "<f4", 3), ("c", "u1", 3)])
REPLAY_RECORD = np.dtype([("p", "<f4", 3), ("c", "u1", 3)])
_PAYLOAD = "chunk long, rows long, payload binary"


def _block(rows: pd.DataFrame, names) -> np.ndarray:
    return rows[list(names)].to_numpy()


def _packed(rows: pd.DataFrame, record: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(rows), dtype=record)
    for name, value in columns.items():
        out[name] = value
    return out


def _per_chunk(points: DataFrame, order: list[str], rows: int, pack) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "rows": [len(pdf)], "payload": [pack(pdf)]})

    return chunk_numbers(points, order, rows).groupBy("chunk").applyInPandas(run, _PAYLOAD)


def surfel_chunks(points: DataFrame, order: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """VSPT chunks: 12-byte header and 40-byte rows."""

    def pack(pdf: pd.DataFrame) -> bytes:
        body = _packed(pdf, SURFEL, p=_block(pdf, "xyz"), n=_block(pdf, ("nx", "ny", "nz")), c=_block(pdf, "rgb"), conf=pdf["confidence"],
                       radius=pdf["radius"], contributors=pdf["contributors"])
        return SURFEL_MAGIC + struct.pack("<HHI", SURFEL_VERSION, SURFEL.itemsize, len(pdf)) + body.tobytes()

    return content_named(_per_chunk(points, order, rows, pack), "points-", ".bin")


def read_surfels(payload: bytes) -> pd.DataFrame:
    version, stride, count = struct.unpack_from("<HHI", payload, 4)
    if payload[:4] != SURFEL_MAGIC or version != SURFEL_VERSION or stride != SURFEL.itemsize or len(payload) != 12 + stride * count:
        raise ExportError("not a surfel chunk")
    rows = np.frombuffer(payload, SURFEL, count, 12)
    flat = {a: rows["p"][:, i] for i, a in enumerate("xyz")} | {n: rows["n"][:, i] for i, n in enumerate(("nx", "ny", "nz"))}
    flat |= {c: rows["c"][:, i] for i, c in enumerate("rgb")}
    return pd.DataFrame({**flat, "confidence": rows["conf"], "radius": rows["radius"], "contributors": rows["contributors"].astype(np.int64)})


def write_ply_text(points: DataFrame, order: list[str], folder: str, rows: int = 1_000_000) -> int:
    """ASCII PLY as ``part-000000000.ply`` (header) and ordered body parts; returns the vertex count."""
    names = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "confidence", "radius", "contributors"]
    line = F.concat_ws(" ", *[F.col(c).cast("float") if c in names[:6] + ["confidence", "radius"] else F.col(c) for c in names])
    lines = settle(chunk_numbers(points, order, rows).select("chunk", "ordinal", line.alias("line")))
    total = lines.count()
    kinds = dict.fromkeys(names, "float") | dict.fromkeys("rgb", "uchar") | {"contributors": "uint"}
    labels = {"r": "red", "g": "green", "b": "blue"}
    header = ["ply", "format ascii 1.0", f"element vertex {total}", *[f"property {kinds[n]} {labels.get(n, n)}" for n in names], "end_header"]
    write_atomic(f"{folder}/part-000000000.ply", ("\n".join(header) + "\n").encode())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = "\n".join(pdf.sort_values("ordinal")["line"]) + "\n"
        return pd.DataFrame({"name": [f"part-{int(pdf['chunk'].iloc[0]) + 1:09d}.ply"], "payload": [text.encode()]})

    write_files(lines.groupBy("chunk").applyInPandas(run, "name string, payload binary"), folder)
    return total


def write_ply_binary(points: DataFrame, order: list[str], folder: str, rows: int = 1_000_000) -> int:
    """Binary little-endian PLY (positions, normals, colours) as a header part and body parts."""
    pack = lambda pdf: _packed(pdf, PLY_RECORD, p=_block(pdf, "xyz"), n=_block(pdf, ("nx", "ny", "nz")), c=_block(pdf, "rgb")).tobytes()
    chunks = settle(_per_chunk(points, order, rows, pack))
    total = chunks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    names = [("float", n) for n in ("x", "y", "z", "nx", "ny", "nz")] + [("uchar", n) for n in ("red", "green", "blue")]
    header = ["ply", "format binary_little_endian 1.0", f"element vertex {total}", *[f"property {k} {n}" for k, n in names], "end_header"]
    write_atomic(f"{folder}/part-000000000.ply", ("\n".join(header) + "\n").encode())
    write_files(chunks.withColumn("name", F.format_string("part-%09d.ply", F.col("chunk") + 1)), folder)
    return total


def glb_tile(xyz: np.ndarray, normals: np.ndarray, rgb: np.ndarray) -> bytes:
    """One GLB 2.0 file of a point primitive: little-endian chunks, JSON padded with spaces, data with zeros."""
    attributes = {"POSITION": (xyz.astype("<f4"), 5126), "NORMAL": (normals.astype("<f4"), 5126), "COLOR_0": (rgb.astype("u1"), 5121)}
    data, views, accessors = bytearray(), [], []
    for values, kind in attributes.values():
        accessors.append({"bufferView": len(views), "componentType": kind, "count": len(values), "type": "VEC3"})
        views.append({"buffer": 0, "byteOffset": len(data), "byteLength": values.nbytes, "target": 34962})
        data += values.tobytes()
        data += bytes(-len(data) % 4)
    position = attributes["POSITION"][0]
    accessors[0] |= {"min": [float(v) for v in position.min(axis=0)], "max": [float(v) for v in position.max(axis=0)]}
    accessors[2]["normalized"] = True
    primitive = {"attributes": {name: i for i, name in enumerate(attributes)}, "mode": 0}
    text = json.dumps({
        "asset": {"version": "2.0", "generator": "scenefold"}, "buffers": [{"byteLength": len(data)}], "bufferViews": views,
        "accessors": accessors, "meshes": [{"primitives": [primitive]}], "nodes": [{"mesh": 0}], "scenes": [{"nodes": [0]}], "scene": 0,
    }).encode()
    text += b" " * (-len(text) % 4)
    size = 28 + len(text) + len(data)
    if size >> 32:
        raise ExportError("a GLB file has to stay below 4 GiB")
    return b"".join((struct.pack("<4sII", b"glTF", 2, size), struct.pack("<I4s", len(text), b"JSON"), text, struct.pack("<I4s", len(data), b"BIN\0"), bytes(data)))


def write_glb(points: DataFrame, order: list[str], folder: str, rows: int = 1_000_000) -> dict:
    """GLB 2.0 point tiles of at most ``rows`` points; returns the commit."""
    from .committed import save

    return save(chunk_numbers(points, order, rows), "scene_glb", folder, "chunk", ["ordinal"], chunk_key="chunk")


def splat_columns(points: DataFrame) -> DataFrame:
    """The splat fields of surfels: a flat disc of the radius, colour with confidence, rotation of the normal in bytes."""
    quaternion = C.quaternion_from_normal(V.vec("nx", "ny", "nz"))
    inside = lambda v, low: F.least(F.greatest(v, F.lit(low)), F.lit(1.0))
    disc = F.greatest(F.col("radius"), F.lit(1e-6))
    return points.withColumns({
        "sx": disc, "sy": disc, "sz": disc * 0.1, "a": F.round(inside(F.col("confidence"), 0.0) * 255.0),
        **{f"q{i}": F.round((inside(q, -1.0) * 0.5 + 0.5) * 255.0) for i, q in enumerate(quaternion)}})


def write_splats(points: DataFrame, order: list[str], folder: str, rows: int = 1_000_000) -> dict:
    """Ordered parts of 32-byte splat rows; put end to end they are one file. Returns the commit."""
    from .committed import save

    # Only what the file needs is numbered and dealt, and its wide fields are made behind the last shuffle.
    fields = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "confidence", "radius"]
    numbered = chunk_numbers(points.select(*fields, *[c for c in order if c not in fields]), order, rows)
    return save(numbered.select("chunk", "ordinal", *fields), "scene_splats", folder, "chunk", ["ordinal"], splat_columns, chunk_key="chunk")


def write_surfels(points: DataFrame, order: list[str], folder: str, rows: int = CHUNK_ROWS, **options) -> dict:
    """VSPT chunks of ``rows`` surfels in order; returns the commit."""
    from .committed import save

    return save(chunk_numbers(points, order, rows), "scene_surfels", folder, "chunk", ["ordinal"], chunk_key="chunk", **options)


def camera_rows(views: DataFrame, poses: DataFrame) -> DataFrame:
    """Views with the pose of their window; windows without a pose are left out."""
    return views.join(poses.select("window_index", F.struct("scale", "rotation", "translation").alias("local_to_world")), "window_index").select(
        "window_index", "frame_index", F.col("w2c").alias("world_to_camera"), F.col("k").alias("intrinsics"), "local_to_world")


def write_cameras(views: DataFrame, poses: DataFrame, folder: str) -> None:
    camera_rows(views, poses).write.mode("errorifexists").json(folder)


def replay_payloads(points: DataFrame, views: DataFrame) -> DataFrame:
    """VRPL payload of each owned frame: camera-space points in front of it.

    Tasks pack blocks of REPLAY_ROWS raster rows; a frame puts the packed blocks of its
    one payload together. Cameras meet blocks, not pixels.
    """
    joined = points.join(views.select("window_index", "frame_index", "w2c"), ["window_index", "frame_index"])
    p = C.world_to_camera("w2c", V.vec("x", "y", "z"))
    seen = joined.withColumns(dict(zip(("_x", "_y", "_z"), p))).filter(V.all_finite(F.col("_x"), F.col("_y")) & V.positive(F.col("_z")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["py", "px"])
        body = _packed(pdf, REPLAY_RECORD, p=_block(pdf, ("_x", "_y", "_z")), c=_block(pdf, "rgb"))
        return pd.DataFrame({**{n: [int(pdf[n].iloc[0])] for n in ("frame_index", "block", "window_index")}, "rows": [len(pdf)], "body": [body.tobytes()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        k = pdf["k"].iloc[0]
        head = b"VRPL" + struct.pack("<HHI4f", 2, 0, int(pdf["rows"].sum()), k[0], k[4], k[2], k[5])
        return pd.DataFrame({"frame_index": [int(pdf["frame_index"].iloc[0])], "payload": [b"".join([head, *pdf["body"]])]})

    block = F.floor(F.col("py") / REPLAY_ROWS).alias("block")
    blocks = seen.select("frame_index", block, "window_index", "px", "py", "_x", "_y", "_z", "r", "g", "b").groupBy("frame_index", "block").applyInPandas(
        pack, "frame_index int, block long, window_index int, rows long, body binary")
    whole = blocks.join(views.select("window_index", "frame_index", "k"), ["window_index", "frame_index"])
    return whole.select("frame_index", "block", "rows", "body", "k").groupBy("frame_index").applyInPandas(join, "frame_index int, payload binary")
