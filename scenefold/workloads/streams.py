"""Queries that run the streaming operators over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir, file_bytes
from ..streaming import increments, sequences
from . import bindings as B
from .registry import ORACLES, near, query, sql_near as R
from . import sequences as batch


# A table arrives in four batches; their files hold about this many bytes each.
BATCHES, FILE_BYTES = 4, 64 << 20


def _shared_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _deal(rows: DataFrame, target: str, table: DataFrame | None = None) -> int:
    """Write ``rows`` in no order as the files of four batches; how many of them make a batch.

    Their number follows the planner's size of ``table`` that the rows come from, so that no task reads a share of the whole.
    """
    files = max(1, -(-file_bytes(rows if table is None else table) // (BATCHES * FILE_BYTES)))
    rows.repartition(BATCHES * files).write.parquet(target)
    return files


@query("voxel_fusion_stream", f"""
WITH {B.POINTS_SQL},
cells AS (SELECT CAST(round(x / 0.25::DOUBLE) AS BIGINT) AS kx, CAST(round(y / 0.25::DOUBLE) AS BIGINT) AS ky, CAST(round(z / 0.25::DOUBLE) AS BIGINT) AS kz, * FROM pts)
SELECT kx, ky, kz, {R('sum(confidence * x) / sum(confidence)', 9)} AS x, {R('avg(confidence)')} AS confidence, min(frame_index) AS first_observing_frame, count(*) AS contributors
FROM cells GROUP BY kx, ky, kz""")
def voxel_fusion_stream(spark, folder):
    target = _shared_folder(spark)
    items = B.table(spark, folder, "lineitem")
    files = _deal(items, f"{target}/arrivals")
    points = B.as_points(increments.arriving(spark, f"{target}/arrivals", items.schema, "*.parquet", files_per_trigger=files))
    increments.run_to_table(increments.voxel_stream(points, 0.25), f"{target}/table", f"{target}/state")
    fused = increments.latest(spark, f"{target}/table", ["kx", "ky", "kz"])
    return fused.select("kx", "ky", "kz", near("x", 9).alias("x"), near(F.col("confidence")).alias("confidence"), "first_observing_frame", "contributors")


def _arrivals(spark, folder):
    """Frames of all captures in four batches in no order, then the end of each capture."""
    target = _shared_folder(spark)
    luma = F.col("luma")
    frames = B.frames(spark, folder).select("capture", "frame_index", F.array(luma).alias("signature"), luma.alias("sharpness"), F.lit(False).alias("closed"))
    files = _deal(frames, f"{target}/arrivals", B.table(spark, folder, "events"))
    captures = spark.read.schema(frames.schema).parquet(f"{target}/arrivals").select("capture").distinct()
    ends = captures.select("capture", *[F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in ("frame_index", "signature", "sharpness")], F.lit(True).alias("closed"))
    ends.coalesce(files).write.mode("append").parquet(f"{target}/arrivals")
    return target, increments.arriving(spark, f"{target}/arrivals", frames.schema, "*.parquet", files_per_trigger=files)


@query("window_schedule_stream", ORACLES["window_schedule"])
def window_schedule_stream(spark, folder):
    target, frames = _arrivals(spark, folder)
    increments.run_to_table(sequences.window_stream(frames, "capture", "frame_index"), f"{target}/table", f"{target}/state", "append")
    return spark.read.parquet(f"{target}/table").select("capture", "window_index", "start", "stop")


@query("keyframe_stream", ORACLES["keyframe_select"])
def keyframe_stream(spark, folder):
    target, frames = _arrivals(spark, folder)
    chosen = sequences.keyframe_stream(frames, "capture", 8.0, "frame_index", batch._KEY)
    increments.run_to_table(chosen, f"{target}/table", f"{target}/state", "append")
    return spark.read.parquet(f"{target}/table").select("capture", "frame_index")
