"""How the driver tables are read as spatial evidence.

The tables have no depth maps, so each logical table is a projection or an
aggregate of whole driver tables. The SQL text next to a binding is the same
projection for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import global_index
from ..session import ship_package

# Pixel columns are line numbers, pixel rows are suppliers: the raster is as high as they reach.
RASTER_WIDTH = 8
RASTER_SQL = "raster AS (SELECT CAST(max(l_suppkey) AS INTEGER) + 1 AS h FROM lineitem)"


def raster(spark: SparkSession, folder: str) -> tuple[int, int]:
    top = table(spark, folder, "lineitem").agg(F.max("l_suppkey")).first()[0]
    return RASTER_WIDTH, int(top or 0) + 1



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{folder}/{name}.parquet")


# --- points of overlapping windows (lineitem) ---------------------------

# The odd divisors keep cell means away from decimal rounding ties.
# A frame in the overlap of two 12/3 windows has its rows split between them.
POINTS_SQL = """
pts AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity,
         CAST(l_orderkey % 120 AS INTEGER) AS frame_index,
         CAST((l_orderkey % 120) // 9 AS INTEGER)
           - (CASE WHEN (l_orderkey % 120) % 9 < 3 AND l_orderkey % 120 >= 9 AND l_partkey % 2 = 0 THEN 1 ELSE 0 END) AS window_index,
         l_linenumber AS px, CAST(l_suppkey AS INTEGER) AS py,
         l_extendedprice / 9973 AS x, l_quantity / 9.7::DOUBLE AS y, l_discount / 0.103::DOUBLE AS z,
         l_discount - 0.05::DOUBLE AS nx, l_tax - 0.04::DOUBLE AS ny, 0.1::DOUBLE AS nz,
         (l_partkey % 4) * 64 AS r, (l_suppkey % 4) * 64 AS g, (l_linenumber % 4) * 64 AS b,
         1 - l_tax / 1.03::DOUBLE AS confidence, 0.05::DOUBLE + l_tax / 1.03::DOUBLE AS radius
  FROM lineitem)"""


def points(spark: SparkSession, folder: str) -> DataFrame:
    return as_points(table(spark, folder, "lineitem"))


def as_points(items: DataFrame) -> DataFrame:
    frame = F.col("l_orderkey") % 120
    shared = (frame % 9 < 3) & (frame >= 9) & (F.col("l_partkey") % 2 == 0)
    return items.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", frame.cast("int").alias("frame_index"),
        (F.floor(frame / 9).cast("int") - F.when(shared, 1).otherwise(0)).alias("window_index"),
        F.col("l_linenumber").alias("px"), F.col("l_suppkey").cast("int").alias("py"),
        (F.col("l_extendedprice") / 9973).alias("x"), (F.col("l_quantity") / 9.7).alias("y"), (F.col("l_discount") / 0.103).alias("z"),
        (F.col("l_discount") - 0.05).alias("nx"), (F.col("l_tax") - 0.04).alias("ny"), F.lit(0.1).alias("nz"),
        ((F.col("l_partkey") % 4) * 64).alias("r"), ((F.col("l_suppkey") % 4) * 64).alias("g"), ((F.col("l_linenumber") % 4) * 64).alias("b"),
        (1 - F.col("l_tax") / 1.03).alias("confidence"), (0.05 + F.col("l_tax") / 1.03).alias("radius"),
    )


# --- one depth value per pixel (lineitem) --------------------------------

PIXELS_SQL = POINTS_SQL + """,
pixels AS (
  SELECT window_index, frame_index, px, py, 1 + min(l_quantity) / 10 AS depth, max(confidence) AS confidence,
         min(r) AS r, min(g) AS g, min(b) AS b, 1 + max(l_quantity) / 10 AS reference
  FROM pts GROUP BY window_index, frame_index, px, py)"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    return points(spark, folder).groupBy("window_index", "frame_index", "px", "py").agg(
        (1 + F.min("l_quantity") / 10).alias("depth"), F.max("confidence").alias("confidence"),
        *[F.min(c).alias(c) for c in "rgb"], (1 + F.max("l_quantity") / 10).alias("reference"))


# A camera turning around the y axis while moving along x, one per frame.
VIEWS_SQL = """
views AS (
  SELECT window_index, frame_index, cos(frame_index * 0.05::DOUBLE) AS c, sin(frame_index * 0.05::DOUBLE) AS s, frame_index * 0.1::DOUBLE AS t
  FROM (SELECT DISTINCT window_index, frame_index FROM pts) v)"""


def turning_camera(frame):
    c, s, zero, one = F.cos(frame * 0.05), F.sin(frame * 0.05), F.lit(0.0), F.lit(1.0)
    return F.array(c, zero, s, frame * 0.1, zero, one, zero, zero, -s, zero, c, zero)


def views(spark: SparkSession, folder: str) -> DataFrame:
    k = F.array(*[F.lit(v) for v in (500.0, 0.0, 3.5, 0.0, 500.0, 50.0, 0.0, 0.0, 1.0)])
    return points(spark, folder).select("window_index", "frame_index").distinct().withColumns(
        {"w2c": turning_camera(F.col("frame_index")), "k": k})


# --- unordered clouds (embeddings) ---------------------------------------

CLOUD_SQL = """
cloud AS (
  SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
         embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w
  FROM embeddings)"""


def cloud(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda i: F.col("embedding").getItem(i).cast("double")
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", *[at(i).alias(n) for i, n in enumerate(("x", "y", "z", "u", "v", "w"))])


# --- captures of frames (events) -----------------------------------------

# Each user records one capture.
FRAMES_SQL = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
frames AS (
  SELECT user_id AS capture, seq AS frame_index, event_id, ts, event_type,
         value / 500 AS luma, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 1000 AS timestamp_millis
  FROM numbered)"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    numbered = global_index(table(spark, folder, "events").drop("props"), ["ts", "event_id"], "seq", keys=["user_id"])
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return numbered.select(
        F.col("user_id").alias("capture"), F.col("seq").alias("frame_index"),
        "event_id", "ts", "event_type", (F.col("value") / 500).alias("luma"), F.floor(micros / 1000).alias("timestamp_millis"))


# --- sparse tracks (lineitem) --------------------------------------------

TRACKS_SQL = """
observations AS (
  SELECT DISTINCT l_partkey AS point_id, CAST(l_orderkey % 120 AS INTEGER) AS frame_index FROM lineitem)"""


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("point_id"), (F.col("l_orderkey") % 120).cast("int").alias("frame_index")).distinct()


# Log ratios of a track against a measured depth, per frame.
EVIDENCE_SQL = """
evidence AS (
  SELECT CAST(l_orderkey % 120 AS INTEGER) AS frame_index, CAST(l_linenumber AS BIGINT) AS window_index, l_partkey AS point_id,
         ln(l_extendedprice / (2000 * l_quantity)) AS log_ratio
  FROM lineitem)"""


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 120).cast("int").alias("frame_index"), F.col("l_linenumber").cast("long").alias("window_index"),
        F.col("l_partkey").alias("point_id"), F.log(F.col("l_extendedprice") / (2000 * F.col("l_quantity"))).alias("log_ratio"))
