"""Round trips: whole tables written in a format by tasks, committed, and read back as a data source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import ordering
from ..session import ensure_checkpoint_dir
from ..sinks import bundle as out_bundle
from ..sinks import clouds
from ..sinks.committed import save
from ..sinks.recordings import write_recording
from ..sources import bundle as in_bundle
from . import bindings as B
from .registry import near, query, sql_near as R

ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "x", "y", "z", "confidence"]
_NUMBERED = f"WITH {B.POINTS_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS i FROM pts)"
_F = lambda *names: ", ".join(f"CAST({n} AS FLOAT)::DOUBLE AS {n}" for n in names)


def folder_for(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _doubles(df: DataFrame, *names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


@query("ply_round_trip", f"""{_NUMBERED}
SELECT i AS idx, {_F('x', 'y', 'z', 'nx', 'ny', 'nz')}, r::SMALLINT AS r, g::SMALLINT AS g, b::SMALLINT AS b FROM numbered""")
def ply_round_trip(spark, folder):
    target = folder_for(spark, "ply")
    numbered = ordering.chunk_numbers(B.points(spark, folder), ORDER, 10_000)
    save(numbered, "scene_ply", target, "chunk", ["ordinal"], chunk_key="chunk")
    return spark.read.format("scene_ply").load(target)


@query("surfel_round_trip", f"""{_NUMBERED}
SELECT i AS idx, {_F('x', 'y', 'z', 'confidence', 'radius')}, r::SMALLINT AS r, frame_index::BIGINT AS contributors FROM numbered""")
def surfel_round_trip(spark, folder):
    target = folder_for(spark, "surfels")
    clouds.write_surfels(B.points(spark, folder).withColumn("contributors", F.col("frame_index")), ORDER, target, 10_000)
    back = spark.read.format("scene_surfels").load(target)
    return back.select("idx", *_doubles(back, "x", "y", "z", "confidence", "radius"), "r", "contributors")


@query("splat_round_trip", f"""{_NUMBERED}
SELECT i AS idx, {_F('x', 'y', 'z')}, CAST(radius AS FLOAT)::DOUBLE AS sx, CAST(radius * 0.1::DOUBLE AS FLOAT)::DOUBLE AS sz,
       round(least(greatest(confidence, 0), 1) * 255)::SMALLINT AS a FROM numbered""")
def splat_round_trip(spark, folder):
    target = folder_for(spark, "splats")
    clouds.write_splats(B.points(spark, folder), ORDER, target, 10_000)
    back = spark.read.format("scene_splats").load(target)
    return back.select("idx", *_doubles(back, "x", "y", "z", "sx", "sz"), "a")


@query("point_chunk_round_trip", f"""{_NUMBERED}
SELECT i // 5000 AS chunk, CAST(i % 5000 AS INTEGER) AS position, x, y, z, nx, confidence, radius, frame_index AS first_observing_frame, 2::BIGINT AS contributors FROM numbered""")
def point_chunk_round_trip(spark, folder):
    target = folder_for(spark, "scene")
    out_bundle.create_bundle(target, {"source": "lineitem"})
    points = B.points(spark, folder).withColumns({"first_observing_frame": F.col("frame_index"), "contributors": F.lit(2).cast("long")})
    out_bundle.write_point_chunks(points, ORDER, target, 5000)
    back = in_bundle.scan_point_chunks(spark, target)
    return back.select("chunk", "position", "x", "y", "z", "nx", "confidence", "radius", "first_observing_frame", "contributors")


@query("window_chunk_round_trip", f"""WITH {B.POINTS_SQL}
SELECT window_index, frame_index, px, py, x, y, z, confidence, radius FROM pts""")
def window_chunk_round_trip(spark, folder):
    target = folder_for(spark, "scene")
    out_bundle.create_bundle(target, {"source": "lineitem"})
    views = B.views(spark, folder)
    schedule = views.groupBy("window_index").agg(F.min("frame_index").alias("start"), (F.max("frame_index") + 1).alias("stop"))
    out_bundle.write_windows(views, B.points(spark, folder), target, schedule)
    _, points = in_bundle.scan_windows(spark, target)
    return points.select("window_index", "frame_index", "px", "py", "x", "y", "z", "confidence", "radius")


_RASTER = f"""
WITH {B.RASTER_SQL},
grid AS (SELECT f.range AS frame_index, x.range AS px, y.range AS py FROM range(120) f, range(8) x, raster, range(raster.h) y),
measured AS (
  SELECT l_orderkey % 120 AS frame_index, l_linenumber AS px, l_suppkey AS py, 1 + min(l_quantity) / 10 AS depth,
         max(1 - l_tax / 1.03::DOUBLE) AS confidence, min((l_partkey % 4) * 64) AS r
  FROM lineitem GROUP BY 1, 2, 3),
full_raster AS (
  SELECT grid.*, CAST(coalesce(depth, 1) AS FLOAT)::DOUBLE AS depth, CAST(coalesce(confidence, 0) AS FLOAT)::DOUBLE AS confidence, coalesce(r, 0) AS r
  FROM grid LEFT JOIN measured USING (frame_index, px, py)),
members AS (SELECT w.range AS window_index, full_raster.* FROM full_raster, range(13) w WHERE frame_index >= 9 * w.range AND frame_index < 9 * w.range + 12)
"""


@query("recording_round_trip", f"""{_RASTER}
SELECT CAST(window_index AS INTEGER) AS window_index, CAST(frame_index AS INTEGER) AS frame_index, count(*) AS pixels,
       {R('sum(depth)', 4)} AS depth, {R('sum(confidence)', 4)} AS confidence, sum(r)::BIGINT AS r FROM members GROUP BY 1, 2""")
def recording_round_trip(spark, folder):
    """A capture of 120 whole rasters as a VPS1 recording of 13 windows."""
    target = folder_for(spark, "recording")
    width, height = B.raster(spark, folder)
    frame = F.col("frame_index")
    measured = B.points(spark, folder).groupBy("frame_index", "px", "py").agg(
        (1 + F.min("l_quantity") / 10).alias("depth"), F.max("confidence").alias("confidence"), F.min("r").alias("r"))
    grid = spark.range(120).select(F.col("id").cast("int").alias("frame_index"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("py"))
    grid = grid.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    whole = grid.join(measured, ["frame_index", "px", "py"], "left").fillna({"depth": 1.0, "confidence": 0.0, "r": 0})
    whole = whole.withColumns({"g": F.lit(0), "b": F.lit(0)})
    members = ordering.window_members(whole.withColumn("ordinal", frame.cast("long")), ordinal="ordinal")
    members = members.withColumn("window_index", F.col("window_index").cast("int"))
    calibration = F.array(*[F.lit(v) for v in (500.0, 0.0, 3.5, 0.0, 500.0, 50.0, 0.0, 0.0, 1.0)])
    rows = members.select("window_index", "frame_index", "px", "py", "depth", "confidence", "r", "g", "b",
                          calibration.alias("k"), B.turning_camera(frame).alias("w2c"))
    write_recording(rows, target, frames=120, height=height, width=width, size=12, overlap=3, percentile=0.0, point_size=1.0, minimum_overlap=3)
    back = spark.read.format("scene_recording").load(target)
    return back.groupBy("window_index", "frame_index").agg(
        F.count(F.lit(1)).alias("pixels"), near(F.sum("depth"), 4).alias("depth"), near(F.sum("confidence"), 4).alias("confidence"),
        F.sum("r").alias("r"))
