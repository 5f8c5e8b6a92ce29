"""Whole reconstructions whose motion is known: windows that saw one world in frames of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import fusion
from ..settings import SeamGate
from . import bindings as B
from .registry import near, query, sql_near as R

_POSES = f"""
WITH {B.POINTS_SQL},
w AS (SELECT DISTINCT unnest(CASE WHEN frame_index % 9 < 3 AND frame_index >= 9 THEN [frame_index // 9, frame_index // 9 - 1] ELSE [frame_index // 9] END) AS w FROM pts)
SELECT CAST(w AS INTEGER) AS window_index, {R('1 + w * 0.01::DOUBLE', 5)} AS scale, {R('cos(w * 0.1::DOUBLE)', 5)} AS r00, {R('sin(w * 0.1::DOUBLE)', 5)} AS r10,
       {R('w * 0.5::DOUBLE', 4)} AS t0, {R('w * -0.25::DOUBLE', 4)} AS t1, 0.0::DOUBLE AS t2 FROM w"""


def _capture(spark, folder):
    """Points of 120 frames in 14 windows; frames of an overlap are in both, and no pixel is repeated.

    Window w sees the world through the inverse of scale 1 + w/100, a turn of w/10 and a shift.
    """
    points = B.points(spark, folder)
    frame = F.col("frame_index")
    own = F.floor(frame / 9).cast("int")
    both = F.when((frame % 9 < 3) & (frame >= 9), F.array(own, own - 1)).otherwise(F.array(own))
    seen = points.groupBy("frame_index", F.floor(F.col("l_orderkey") / 120).alias("px"), F.col("l_linenumber").alias("py")).agg(
        *[F.min(c).alias(c) for c in ("x", "y", "z", "r", "g", "b", "confidence", "radius")])
    members = seen.withColumn("window_index", F.explode(both))
    w = F.col("window_index")
    c, s, k = F.cos(w * 0.1), F.sin(w * 0.1), 1 + w * 0.01
    dx, dy = F.col("x") - w * 0.5, F.col("y") + w * 0.25
    local = members.select(
        "window_index", "frame_index", "px", "py", ((c * dx + s * dy) / k).alias("x"), ((c * dy - s * dx) / k).alias("y"), (F.col("z") / k).alias("z"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), "r", "g", "b", "confidence", (F.col("radius") / k).alias("radius"))
    views = local.select("window_index", "frame_index").distinct().withColumns({"w2c": B.turning_camera(F.col("frame_index")), "k": F.array(*[F.lit(1.0)] * 9)})
    return local, views


def _poses(scene):
    at = lambda name, i, digits: near(F.get(F.col(name), F.lit(i)), digits)
    return scene.poses.select("window_index", near("scale", 5).alias("scale"), at("rotation", 0, 5).alias("r00"), at("rotation", 3, 5).alias("r10"),
                              *[at("translation", i, 4).alias(f"t{i}") for i in range(3)])


_GATE = SeamGate(maximum_normalized_rms=1.0)


@query("fused_scene_poses", _POSES)
def fused_scene_poses(spark, folder):
    """Seams by the robust fit, chained: every window comes back to where it was."""
    points, views = _capture(spark, folder)
    return _poses(fusion.fuse_scene(points, views, ["px", "py"], "product", "voxel", gate=_GATE))


@query("fused_scene_relative", _POSES)
def fused_scene_relative(spark, folder):
    """The same by the relative profile, which keeps each window's more confident points and fits by Huber weights."""
    points, views = _capture(spark, folder)
    return _poses(fusion.fuse_scene(points, views, ["px", "py"], "relative", "voxel", gate=_GATE))


@query("fused_scene_cells", f"""
WITH {B.POINTS_SQL},
seen AS (SELECT frame_index, l_orderkey // 120 AS px, l_linenumber AS py, min(x) AS x, min(y) AS y, min(z) AS z, min(confidence) AS confidence, min(radius) AS radius FROM pts GROUP BY 1, 2, 3),
edge AS (SELECT 2 * list_sort(list(radius))[count(*) // 2 + 1] AS voxel FROM seen),
cells AS (SELECT CAST(round(x / voxel) AS BIGINT) AS kx, CAST(round(y / voxel) AS BIGINT) AS ky, CAST(round(z / voxel) AS BIGINT) AS kz, * FROM seen, edge)
SELECT kx, ky, kz, min(frame_index) AS first_observing_frame, count(*) AS contributors, {R('sum(confidence * x) / sum(confidence)', 5)} AS x FROM cells GROUP BY 1, 2, 3""")
def fused_scene_cells(spark, folder):
    """Windows placed by the fused scene give the voxels of the world they saw, each frame once."""
    points, views = _capture(spark, folder)
    fused = fusion.fuse_scene(points, views, ["px", "py"], "product", "voxel", gate=_GATE).points
    return fused.select("kx", "ky", "kz", "first_observing_frame", "contributors", near("x", 5).alias("x"))
