"""Incremental fusion over arriving evidence.

The fused cells are sums, minima and counts, so a streaming aggregation holds
the same state a batch run computes, and a restart continues from the stream
checkpoint instead of refusing or repeating finished windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import surface
from ..settings import TsdfSettings


def arriving(spark: SparkSession, folder: str, schema: StructType, pattern: str, files_per_trigger: int = 100) -> DataFrame:
    """Evidence files of a folder as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def voxel_stream(points: DataFrame, voxel: float) -> DataFrame:
    """Surfels per voxel as a running aggregate; ``points`` may be a stream."""
    edge = points.sparkSession.createDataFrame([(float(voxel),)], "voxel double")
    return surface.fuse_voxels(points, edge)


def tsdf_stream(points: DataFrame, voxel: float, settings: TsdfSettings = TsdfSettings()) -> DataFrame:
    """Running TSDF cell sums of oriented points; extract with ``zero_crossing``."""
    return surface.tsdf_cells(surface.splat(points, voxel, settings))


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> None:
    """Process everything that has arrived; each batch adds the rows it changed.

    The checkpoint makes a second run continue where the first stopped. A batch
    has a folder of its own, ``batch=<number>``: a repeated batch replaces only
    that, and a reader never meets an empty table. ``latest`` gives the present state.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(store).start())
    query.awaitTermination()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest row of each key in a table of ``run_to_table``."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"]).drop("batch")


def distinct_windows(views: DataFrame, delay: str, time: str = "ts") -> DataFrame:
    """Each (window, frame) once, however often it is delivered within ``delay``."""
    timed = views.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(["window_index", "frame_index"])
