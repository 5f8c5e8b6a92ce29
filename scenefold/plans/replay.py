"""Recorded windows replayed through the fusion and compared with the expected cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import reports, surface
from ..operators.ordering import global_index
from ..sources import recordings
from .fusion import FusedScene, fuse_scene


def measured_windows(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """Header, views and points of a recording; points carry the recorded radius."""
    header, views, pixels = recordings.scan_input(spark, path)
    kept = surface.at_least_window_percentile(pixels, header["percentile"])
    points = surface.backproject_exact(kept, views)
    k = views.select("window_index", "frame_index", F.least(F.col("k").getItem(0), F.col("k").getItem(4)).alias("_f"))
    measured = points.join(k, ["window_index", "frame_index"]).withColumn("radius", header["point_size"] * F.col("depth") / F.col("_f"))
    zero = [F.lit(0.0).alias(n) for n in ("nx", "ny", "nz")]
    return header, views, measured.select("window_index", "frame_index", "px", "py", "x", "y", "z", *zero, "r", "g", "b", "confidence", "radius")


def replay(spark: SparkSession, path: str, surface_mode: str = "tsdf") -> FusedScene:
    header, views, points = measured_windows(spark, path)
    return fuse_scene(points, views, ["py", "px"], "relative", surface_mode, header["loops"])


def compare(points: DataFrame, expected: DataFrame, order: list[str]) -> DataFrame:
    """Difference statistics of two clouds in their output order."""
    numbered = global_index(points.select("x", "y", "z", "r", "g", "b", "radius", *[c for c in order if c not in "xyz"]), order)
    return reports.difference_stats(numbered, expected, ["ordinal"], ["x", "y", "z", "radius"], ["r", "g", "b"])
