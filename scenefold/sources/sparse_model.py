"""COLMAP text models as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import PoseError
from ..functions import cameras as C
from ..functions import vectors as V
from ..operators.common import attach, first_by
from ..operators.ordering import adjacent, global_index
from .ply import numbered_lines


def _word(index) -> Column:
    """A word of the line, NULL past its end: a pushed-down filter may see any line."""
    return F.get("w", F.lit(index) if isinstance(index, int) else index)


def _refuse(bad: DataFrame, reason: str) -> None:
    row = bad.limit(1).collect()
    if row:
        raise PoseError(f"{reason}: {row[0]}")


def scan_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``camera_id, model, width, height, f, cx, cy, k``; only one radial coefficient is supported."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter("trim(value) <> '' and not value like '#%'").select(words.alias("w"))
    _refuse(lines.filter("size(w) <> 8 or get(w, 1) <> 'SIMPLE_RADIAL'"), "unsupported camera")
    cameras = lines.select(
        _word(0).try_cast("long").alias("camera_id"), _word(1).alias("model"), _word(2).try_cast("int").alias("width"),
        _word(3).try_cast("int").alias("height"), *[_word(i).try_cast("double").alias(n) for i, n in enumerate(("f", "cx", "cy", "k"), 4)])
    good = V.all_finite(*[F.col(n) for n in ("f", "cx", "cy", "k")]) & (F.col("width") > 0) & (F.col("height") > 0) & F.col("camera_id").isNotNull()
    _refuse(cameras.filter(~F.coalesce(good, F.lit(False))), "bad camera")
    _refuse(cameras.groupBy("camera_id").count().filter("count > 1"), "repeated camera")
    return cameras


def _image_lines(spark: SparkSession, path: str) -> DataFrame:
    """Header and observation line of each image, paired by line number.

    Comments and leading blanks do not count; after that every second line is
    the observation line of the one before, even when it is empty.
    """
    lines = numbered_lines(spark, path).filter("not value like '#%'")
    start = lines.filter("trim(value) <> ''").agg(F.min("line").alias("_start"))
    body = attach(lines, start).filter("line >= _start").drop("_start")
    placed = global_index(body, ["line"], "_i")
    heads = placed.filter("_i % 2 = 0").select((F.col("_i") / 2).cast("long").alias("image_no"), F.col("value").alias("head"))
    tails = placed.filter("_i % 2 = 1").select(F.floor(F.col("_i") / 2).cast("long").alias("image_no"), F.col("value").alias("tail"))
    return heads.filter("trim(head) <> ''").join(tails, "image_no", "left")


def scan_images(spark: SparkSession, path: str, rasters: DataFrame | None = None) -> DataFrame:
    """``image_no, image_id, camera_id, name, w2c, tail`` and, with rasters, ``frame_index``."""
    words = F.split(F.trim("head"), r"\s+")
    lines = _image_lines(spark, path).withColumn("w", words)
    _refuse(lines.filter("size(w) < 10"), "short image line")
    number = lambda i: _word(i).try_cast("double")
    pose = C.quaternion_to_w2c(*[number(i) for i in range(1, 5)], tuple(number(i) for i in range(5, 8)))
    images = lines.select(
        "image_no", _word(0).try_cast("long").alias("image_id"), _word(8).try_cast("long").alias("camera_id"),
        F.array_join(F.slice("w", 10, F.size("w")), " ").alias("name"), pose.alias("w2c"), "tail")
    _refuse(images.filter(~F.forall("w2c", V.finite)), "bad pose")
    if rasters is None:
        return images
    joined = images.join(rasters.select("frame_index", F.col("file_name").alias("name")), "name", "left")
    _refuse(joined.filter("frame_index is null").select("name"), "image without raster")
    _refuse(joined.groupBy("frame_index").count().filter("count > 1"), "repeated raster")
    return joined


def image_observations(images: DataFrame) -> DataFrame:
    """``image_id, slot, u, v, point_id`` from the observation lines; -1 marks no point."""
    words = F.filter(F.split(F.trim(F.coalesce("tail", F.lit(""))), r"\s+"), lambda w: w != "")
    carried = [c for c in ("image_id", "frame_index") if c in images.columns]
    listed = images.select(*carried, words.alias("w"))
    _refuse(listed.filter("size(w) % 3 <> 0").select("image_id"), "broken observations")
    count = (F.size("w") / 3).cast("int")
    slots = listed.filter("size(w) > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), count - 1)))
    at = lambda i, kind: _word(F.col("slot") * 3 + i).try_cast(kind)
    return slots.select(*carried, "slot", at(0, "double").alias("u"), at(1, "double").alias("v"), at(2, "long").alias("point_id"))


def scan_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tracks ``point_id, x, y, z, r, g, b, reprojection_error_px`` and their elements ``point_id, image_id, slot``."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter("trim(value) <> '' and not value like '#%'").select(words.alias("w"))
    _refuse(lines.filter("size(w) < 8 or size(w) % 2 <> 0"), "broken point line")
    number = lambda i: _word(i).try_cast("double")
    point = _word(0).try_cast("long").alias("point_id")
    tracks = lines.select(point, number(1).alias("x"), number(2).alias("y"), number(3).alias("z"),
                          *[_word(i).try_cast("short").alias(n) for i, n in enumerate("rgb", 4)], number(7).alias("reprojection_error_px"))
    pairs = (F.size("w") - 8) / 2
    elements = lines.filter("size(w) > 8").withColumn("_e", F.explode(F.sequence(F.lit(0), pairs.cast("int") - 1)))
    elements = elements.select(point, _word(8 + 2 * F.col("_e")).try_cast("long").alias("image_id"),
                               _word(9 + 2 * F.col("_e")).try_cast("int").alias("slot"))
    return tracks, elements


def global_model(spark: SparkSession, folder: str, rasters: DataFrame):
    """Cameras, registered frames, tracks and first observation per (track, frame)."""
    cameras = scan_cameras(spark, f"{folder}/cameras.txt")
    images = scan_images(spark, f"{folder}/images.txt", rasters)
    observed = image_observations(images).filter("point_id >= 0")
    first = first_by(observed.select("point_id", "frame_index", "slot", "u", "v"), ["point_id", "frame_index"], [F.col("slot")]).drop("slot")
    tracks = scan_points(spark, f"{folder}/points3D.txt")[0].join(first.select("point_id").distinct(), "point_id", "left_semi")
    if not tracks.limit(1).count():
        raise PoseError("the model has no observed track")
    poses = rasters.select("frame_index", "file_name").join(
        images.select("frame_index", "w2c", "camera_id"), "frame_index", "left").withColumn("registered", F.col("w2c").isNotNull())
    return cameras, poses, tracks, first.join(tracks, "point_id", "left_semi")


def misordered_names(images: DataFrame) -> DataFrame:
    """Neighbours in time whose file names sort the other way.

    Sequential matching reads images by name, so names have to follow time.
    ``images``: timestamp_millis, kind, file_name.
    """
    order = ["timestamp_millis", F.col("kind") != "selected", "file_name"]
    numbered = global_index(images, order)
    named = adjacent(numbered, [], "ordinal", {"_before": lambda w: F.lag("file_name").over(w)})
    return named.filter("_before >= file_name").drop("_before")
