"""Image exports: PPM caches, depth previews and BMP thumbnails."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.types import BINARY
from ..operators.depth import coloured_depth
from ..operators.ordering import global_index
from ..operators.surface import first_owner
from ..schemas import tag
from ..sources.rasters import parse_ppm
from .writers import write_atomic, write_files


@F.pandas_udf(BINARY)
def encode_ppm(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([b"P6\n%d %d\n255\n" % (w, h) + bytes(pixels) for pixels, w, h in zip(rgb, width, height)])


@F.pandas_udf(BINARY)
def ppm_to_bmp(content: pd.Series) -> pd.Series:
    """24-bit bottom-up BMP with rows padded to four bytes."""
    out = []
    for payload in content:
        width, height, pixels = parse_ppm(payload)
        image = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)[::-1, :, ::-1]
        padding = -(3 * width) % 4
        body = np.pad(image.reshape(height, 3 * width), ((0, 0), (0, padding))).tobytes()
        head = struct.pack("<2sI4xI", b"BM", 54 + len(body), 54) + struct.pack("<IIIHHII16x", 40, width, height, 1, 24, 0, len(body))
        out.append(head + body)
    return pd.Series(out)


def selected_cache(frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Selected frames renumbered from 1 as ``frame-000001.ppm`` files."""
    kept = frames.join(keyframes.select("ordinal"), "ordinal", "left_semi")
    numbered = global_index(kept.withColumnRenamed("ordinal", "source_index"), ["source_index"], "selected")
    return numbered.withColumn("name", F.format_string("frame-%06d.ppm", F.col("selected") + 1)).withColumn(
        "payload", encode_ppm("rgb", "width", "height"))


def write_selected_cache(frames: DataFrame, keyframes: DataFrame, folder: str, fps: float) -> None:
    """Cache files and the manifest of their source indices.

    A cache holds at most 1,800 frames; its index list is the only thing that
    reaches the driver.
    """
    selected = selected_cache(frames, keyframes)
    write_files(selected, folder)
    indices = [row[0] for row in selected.select("source_index").orderBy("source_index").collect()]
    document = {"schema": tag("decode-selection"), "frames_per_second": fps, "selected_indices": indices}
    write_atomic(f"{folder}/selection.json", json.dumps(document).encode())


def depth_previews(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Coloured depth of the owned view of every frame as PPM with its hash."""
    owned = first_owner(pixels, window="batch")
    coloured = coloured_depth(owned, ["frame_index"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width, 3), np.uint8)
        image[pdf["py"].to_numpy(), pdf["px"].to_numpy()] = pdf[["r", "g", "b"]].to_numpy()
        payload = b"P6\n%d %d\n255\n" % (width, height) + image.tobytes()
        return pd.DataFrame({"frame_index": [int(pdf["frame_index"].iloc[0])], "payload": [payload]})

    files = coloured.select(F.col("frame_index").cast("long").alias("frame_index"), "px", "py", "r", "g", "b").groupBy("frame_index").applyInPandas(
        pack, "frame_index long, payload binary")
    return files.withColumn("sha256", F.sha2("payload", 256)).withColumn("name", F.format_string("depth_%06d.ppm", "frame_index"))


def thumbnails(frames: DataFrame, allowed: DataFrame) -> DataFrame:
    """BMP of the frames a product lists."""
    return frames.join(allowed.select("frame_index"), "frame_index", "left_semi").withColumn("bmp", ppm_to_bmp("content"))
