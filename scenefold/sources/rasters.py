"""Frame images, depth arrays, prediction batches and semantic masks."""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ImportFormatError, VideoError
from ..functions import types as K
from ..operators.ordering import adjacent
from ..schemas import DEPTH_BATCH
from .files import decode_ranges, open_file, read_range

LUMA = np.array([0.2126, 0.7152, 0.0722])
THUMBNAIL = (32, 24)
_PPM = K.struct(width=K.LONG, height=K.LONG, rgb=K.BINARY)
_SIGNATURE = K.struct(luma=K.DOUBLES, sharpness=K.DOUBLE)


def parse_ppm(payload: bytes) -> tuple[int, int, bytes]:
    match = re.match(rb"P6(?:\s+#[^\n]*\n|\s)\s*(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)(?:\r\n|\s)", payload)
    if match is None:
        raise ImportFormatError("not a binary RGB PPM")
    width, height, depth = (int(value) for value in match.groups())
    pixels = payload[match.end():]
    if depth != 255 or width == 0 or height == 0 or len(pixels) != 3 * width * height:
        raise ImportFormatError("PPM must hold exactly width x height RGB24 pixels")
    return width, height, pixels


@F.pandas_udf(_PPM)
def decode_ppm(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_ppm(payload) for payload in content], columns=["width", "height", "rgb"])


@F.pandas_udf(_SIGNATURE)
def frame_signature(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """32x24 nearest luma samples and their mean change to the right and downwards."""
    columns, rows = THUMBNAIL
    out = []
    for payload, w, h in zip(rgb, width, height):
        image = np.frombuffer(payload, dtype=np.uint8).reshape(h, w, 3)
        picked = image[np.arange(rows) * h // rows][:, np.arange(columns) * w // columns]
        luma = picked @ LUMA / 255.0
        steps = np.abs(np.diff(luma, axis=1)).sum() + np.abs(np.diff(luma, axis=0)).sum()
        out.append((luma.ravel().tolist(), steps / ((columns - 1) * rows + columns * (rows - 1))))
    return pd.DataFrame(out, columns=["luma", "sharpness"])


def novelty(a, b):
    """Mean absolute difference of two signatures, 0 for unequal lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, total / F.greatest(F.size(a), F.lit(1))).otherwise(0.0)


@F.pandas_udf(K.DOUBLE)
def frame_delta(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean luma change over all pixels of two equally sized frames."""
    out = []
    for left, right in zip(a, b):
        if left is None or right is None or len(left) != len(right):
            out.append(None)
            continue
        x, y = (np.frombuffer(v, dtype=np.uint8).reshape(-1, 3) @ LUMA / 255.0 for v in (left, right))
        out.append(float(np.abs(x - y).mean()))
    return pd.Series(out, dtype=float)


def scan_ppm(spark: SparkSession, folder: str, maximum: int = 1800) -> DataFrame:
    """Frames of a decode cache in file-name order; all of one size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ppm").load(folder)
    frames = files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.sha2("content", 256).alias("sha256"),
        decode_ppm("content").alias("_image")).select("file_name", "sha256", "_image.*")
    shape = frames.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("width", "height").alias("sizes")).first()
    if not 1 <= shape["n"] <= maximum or shape["sizes"] != 1:
        raise VideoError(f"a cache holds 1 to {maximum} frames of one size, found {shape['n']} of {shape['sizes']} sizes")
    # At most `maximum` names: this small list gives every frame its position.
    names = sorted(row["file_name"] for row in frames.select("file_name").collect())
    order = spark.createDataFrame(list(enumerate(names)), "ordinal long, file_name string")
    return frames.join(F.broadcast(order), "file_name")


def selection_indices(spark: SparkSession, manifest: str | None, frames: int, fps: float) -> DataFrame:
    """Source index of every cached frame: the manifest's list, or the identity without one."""
    if manifest is None:
        return spark.range(frames).select(F.col("id").alias("ordinal"), F.col("id").alias("source_index"))
    read = spark.read.option("multiLine", True).json(manifest)
    row = read.select(F.size("selected_indices").alias("n"), "frames_per_second").first()
    if row["n"] != frames or row["frames_per_second"] != fps:
        raise VideoError("the selection manifest belongs to another decode")
    listed = read.select(F.posexplode("selected_indices").alias("ordinal", "source_index"))
    broken = adjacent(listed, [], "ordinal", {"_p": lambda w: F.lag("source_index").over(w)}).filter("source_index <= _p")
    if broken.limit(1).count():
        raise VideoError("selected indices must increase")
    return listed


_ARRAY = "width int, height int, channels int, depth array<float>"


def scan_dense_arrays(spark: SparkSession, pattern: str) -> DataFrame:
    """Dense stereo arrays: ``width&height&channels&`` and float32 values, one row per file."""
    def decode(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                head = re.match(rb"(\d+)&(\d+)&(\d+)&", bytes(content[:128]))
                if head is None:
                    raise ImportFormatError(f"{path} has no three-field header")
                w, h, c = (int(v) for v in head.groups())
                values = np.frombuffer(content, dtype="<f4", offset=head.end())
                if min(w, h, c) <= 0 or values.size != w * h * c:
                    raise ImportFormatError(f"{path} does not hold {w}x{h}x{c} values")
                yield pd.DataFrame({"path": [path], "width": [w], "height": [h], "channels": [c], "depth": [values.tolist()]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(decode, f"path string, {_ARRAY}")


def array_pixels(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pixel of the first channel."""
    cells = arrays.select(*keys, "width", "channels", F.posexplode("depth").alias("_i", "depth"))
    pixel = F.floor(F.col("_i") / F.col("channels"))
    return cells.filter(F.col("_i") % F.col("channels") == 0).select(
        *keys, (pixel % F.col("width")).cast("int").alias("px"), F.floor(pixel / F.col("width")).cast("int").alias("py"),
        F.col("depth").cast("double").alias("depth"))


def scan_prediction_batches(spark: SparkSession, pattern: str) -> DataFrame:
    """NPZ batches, one row per frame (a batch holds at most a few dozen frames)."""
    needed = ("depth", "conf", "rgb", "intrinsics", "extrinsics", "frame_indices")

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content)) as data:
                    missing = [name for name in needed if name not in data]
                    if missing:
                        raise ImportFormatError(f"{path} lacks {missing}")
                    depth, conf, rgb, k, w2c, index = (data[name] for name in needed)
                n = depth.shape[0] if depth.ndim == 3 else -1
                shapes = (conf.shape, rgb.shape, k.shape, w2c.shape, index.shape)
                if n < 0 or shapes != (depth.shape, (*depth.shape, 3), (n, 3, 3), (n, 4, 4), (n,)):
                    raise ImportFormatError(f"{path} has inconsistent shapes")
                for slot in range(n):
                    yield pd.DataFrame({
                        "batch": [path.rsplit("/", 1)[-1]], "slot": [slot], "frame_index": [int(index[slot])],
                        "height": [depth.shape[1]], "width": [depth.shape[2]], "depth": [depth[slot].ravel().astype("f4").tolist()],
                        "conf": [conf[slot].ravel().astype("f4").tolist()], "rgb": [rgb[slot].astype("u1").tobytes()],
                        "k": [k[slot].ravel().astype("f4").tolist()], "w2c": [w2c[slot].ravel().astype("f4").tolist()]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(decode, DEPTH_BATCH)


def batch_pixels(batches: DataFrame) -> DataFrame:
    """Pixels of prediction batches as ``batch, slot, frame_index, px, py, depth, confidence``."""
    both = batches.select("batch", "slot", "frame_index", "width", F.posexplode(F.arrays_zip("depth", "conf")).alias("_i", "_v"))
    return both.select(
        "batch", "slot", "frame_index", (F.col("_i") % F.col("width")).cast("int").alias("px"),
        F.floor(F.col("_i") / F.col("width")).cast("int").alias("py"), F.col("_v.depth").cast("double").alias("depth"),
        F.col("_v.conf").cast("double").alias("confidence"))


SEMANTIC_MAGIC = b"VSEM1"


def mask_header(path: str) -> tuple[np.ndarray, int, int, int]:
    """Frame numbers, width, height and the place of the first class plane."""
    with open_file(path) as handle:
        head = handle.read(17)
        if head[:5] != SEMANTIC_MAGIC or len(head) < 17:
            raise ImportFormatError("missing mask header")
        frames, width, height = (int(v) for v in np.frombuffer(head, "<u4", 3, 5))
        indices = np.frombuffer(handle.read(4 * frames), "<u4").astype(int)
        plane, classes = width * height, 17 + 4 * frames
        if plane == 0 or handle.size() != classes + 2 * frames * plane:
            raise ImportFormatError("unexpected mask length")
    if len(indices) != frames or (np.diff(indices) <= 0).any():
        raise ImportFormatError("mask frames must increase")
    return indices, width, height, classes


def scan_semantic_masks(spark: SparkSession, path: str) -> DataFrame:
    """Class and confidence of every mask pixel; every frame is its own read."""
    indices, width, height, classes = mask_header(path)
    frames, plane = len(indices), width * height
    half = frames * plane
    ranges = spark.createDataFrame(
        [(path, int(classes + i * plane), int(plane), int(f)) for i, f in enumerate(indices)],
        "path string, offset long, length long, frame_index int")

    def decode(payload: bytes, row) -> pd.DataFrame:
        codes = np.frombuffer(payload, np.uint8)
        if codes.max(initial=0) > 6:
            raise ImportFormatError("unknown class code")
        sure = np.frombuffer(read_range(row.path, int(row.offset) + half, plane), np.uint8)
        at = np.arange(plane)
        return pd.DataFrame({"frame_index": row.frame_index, "x": at % width, "y": at // width, "class_code": codes.astype("i1"), "confidence": sure / 255.0})

    return decode_ranges(ranges.repartition(max(1, frames)), decode, "frame_index int, x int, y int, class_code tinyint, confidence double")


def probe_video(metadata: str) -> dict:
    """Duration and size from the JSON of a probe run outside Spark; portrait is refused."""
    data = json.loads(metadata)
    stream = data["streams"][0]
    duration, width, height = float(data["format"]["duration"]), int(stream["width"]), int(stream["height"])
    if not (np.isfinite(duration) and duration > 0):
        raise VideoError("the video has no positive duration")
    if width < height:
        raise VideoError("portrait video is not supported")
    return {"duration_seconds": duration, "width": width, "height": height}
