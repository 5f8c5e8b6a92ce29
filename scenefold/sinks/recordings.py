"""Recordings of measured windows, the inverse of ``sources.recordings.scan_input``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.files import chunk_path, committed_chunks
from .committed import save


def view_rows(pixels: DataFrame, overlap: int) -> DataFrame:
    """Rows for the sink: the place of their view in the recording, its camera on the first pixel only.

    Cameras are wider than pixels; with one a view, neither the sort nor a batch carries them.
    Other pixels have empty arrays, as Arrow lists are slow to fill with many nulls.
    """
    first, none = (F.col("px") == 0) & (F.col("py") == 0), F.array().cast("array<double>")
    return pixels.withColumns({
        "view": F.col("frame_index").cast("long") + F.col("window_index") * overlap,
        **{c: F.when(first, F.col(c)).otherwise(none) for c in ("k", "w2c")}})


def write_recording(pixels: DataFrame, folder: str, **header) -> None:
    """Write pixels that carry the ``k`` and ``w2c`` of their view; a task holds one view."""
    save(view_rows(pixels, int(header["overlap"])), "scene_recording", folder, "view", ["py", "px"], **header)


def write_input_parts(views: DataFrame, pixels: DataFrame, header: dict, folder: str) -> list[str]:
    """Write a version 3 recording as parts: a header, then one part for each view.

    The returned parts, put end to end, are the recording. ``views`` and ``pixels``
    have the columns of ``scan_input``, ``header`` its numbers; every scheduled view
    must hold one row for each pixel. A task holds one view; nothing is listed unless
    all windows are whole.
    """
    joined = pixels.join(views.select("window_index", "frame_index", "k", "w2c"), ["window_index", "frame_index"])
    write_recording(joined, folder, **{k: v for k, v in header.items() if k != "views"})
    return [chunk_path(folder, row) for row in committed_chunks(folder)]
