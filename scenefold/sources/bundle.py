"""Scene bundles: one JSON manifest and content-addressed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import BundleError
from ..schemas import POSE_SOLUTION, RASTER_MANIFEST, tag_pattern
from .files import committed

_POINT = (
    "position:array<double>,normal:array<double>,color_srgb:array<short>,confidence:double,radius:double"
)
WINDOW = (
    "window struct<index:int,start:int,end:int,first_view:int,continued:boolean>, views array<struct<frame_index:int,"
    "camera:struct<intrinsics:array<double>,world_to_camera:array<double>>,"
    f"points:array<struct<{_POINT},source_pixel:array<int>>>>>"
)
FUSED = (
    "voxel_size double, points array<struct<"
    f"{_POINT},first_observing_frame:int,contributors:long>>, "
    "alignments array<struct<window_index:int,correspondence_count:long,inlier_count:long,rms_residual:double,"
    "normalized_rms_residual:double,transform:struct<scale:double,rotation:array<double>,translation:array<double>>>>, "
    "pose_graph struct<initial_cost:double,final_cost:double,iterations:int,loop_edges:long>, "
    "window_poses array<struct<window_index:int,local_to_world:struct<scale:double,rotation:array<double>,translation:array<double>>>>"
)
POINTS_CHUNK = f"points array<struct<{_POINT},first_observing_frame:int,contributors:long>>"


def open_manifest(spark: SparkSession, bundle: str) -> DataFrame:
    """The catalogue row of a bundle."""
    try:
        manifest = spark.read.option("multiLine", True).json(f"{bundle}/manifest.json")
        row = manifest.select("schema").first()
    except Exception as error:  # a missing path surfaces as an analysis error
        raise BundleError(f"{bundle} is not a scene bundle") from error
    if row is None or not spark.range(1).select(F.lit(row["schema"]).rlike(tag_pattern("scene"))).first()[0]:
        raise BundleError(f"{bundle} has an unsupported manifest")
    return manifest


def published(manifest: DataFrame, column: str, bundle: str | None = None) -> DataFrame:
    """Published chunks of a kind as ``chunk, hash``: the manifest's own list, then the rows of its indexes.

    Without ``bundle`` only the list is read.
    """
    spark = manifest.sparkSession
    rows = spark.createDataFrame([], "chunk long, hash string")
    if column in manifest.columns and dict(manifest.dtypes)[column] == "array<string>":
        rows = manifest.select(F.posexplode(column).alias("chunk", "hash"))
    if bundle is not None and "chunk_indexes" in manifest.columns and column in manifest.select("chunk_indexes.*").columns:
        parts = [f"{bundle}/{index}/{part}" for index in manifest.select(f"chunk_indexes.{column}").first()[0]
                 for part in (committed(f"{bundle}/{index}") or {"parts": []})["parts"]]
        if parts:
            rows = rows.unionByName(spark.read.schema("chunk long, hash string").json(parts))
    return rows


def require_published(manifest: DataFrame, column: str, hash_: str) -> None:
    if not published(manifest, column).filter(F.col("hash") == hash_).limit(1).count():
        raise BundleError(f"{hash_} is not published in {column}")


def _point_columns(source: str) -> list:
    at = lambda field, i: F.col(f"{source}.{field}").getItem(i)
    return [
        *[at("position", i).alias(a) for i, a in enumerate("xyz")], *[at("normal", i).alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
        *[at("color_srgb", i).alias(c) for i, c in enumerate("rgb")], F.col(f"{source}.confidence").alias("confidence"),
        F.col(f"{source}.radius").alias("radius"),
    ]


def scan_windows(spark: SparkSession, bundle: str) -> tuple[DataFrame, DataFrame]:
    """``views`` and ``measured_points`` of all published windows, whole or in parts.

    Chunk names sort by hash, not by time: ordered operators use ``window_index``.
    """
    hashes = published(open_manifest(spark, bundle), "measured_chunk_hashes", bundle)
    chunks = spark.read.schema(WINDOW).option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{bundle}/chunks").select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("hash"), "window", "views")
    views = chunks.join(hashes, "hash", "left_semi").filter("window is not null").select(
        F.col("window.index").alias("window_index"), F.coalesce("window.first_view", F.lit(0)).alias("_first"),
        F.coalesce("window.continued", F.lit(False)).alias("_continued"), F.posexplode("views").alias("_at", "v"))
    # A view that goes on in further parts counts once.
    views = views.withColumn("view_index", F.col("_first") + F.col("_at"))
    calibrated = views.filter(~F.col("_continued") | (F.col("_at") > 0)).select("window_index", "view_index", F.col("v.frame_index").alias("frame_index"),
                              F.col("v.camera.world_to_camera").alias("w2c"), F.col("v.camera.intrinsics").alias("k"))
    points = views.select("window_index", F.col("v.frame_index").alias("frame_index"), F.explode("v.points").alias("p")).select(
        "window_index", "frame_index", F.col("p.source_pixel").getItem(0).alias("px"), F.col("p.source_pixel").getItem(1).alias("py"), *_point_columns("p"))
    return calibrated, points


def scan_fused(spark: SparkSession, bundle: str, hash_: str) -> tuple[DataFrame, DataFrame]:
    """Fused chunk row and its surfels in stored order (``ordinal``)."""
    chunk = spark.read.schema(FUSED).option("multiLine", True).json(f"{bundle}/chunks/fused-{hash_}.json")
    points = chunk.select(F.posexplode("points").alias("ordinal", "p")).select(
        "ordinal", *_point_columns("p"), "p.first_observing_frame", "p.contributors")
    return chunk.drop("points"), points


def scan_point_chunks(spark: SparkSession, bundle: str) -> DataFrame:
    """Surfels of the ordered point chunks: ``chunk, position`` is their order."""
    hashes = published(open_manifest(spark, bundle), "fused_point_chunk_hashes", bundle)
    stored = spark.read.schema(POINTS_CHUNK).option("multiLine", True).option("pathGlobFilter", "points-*.json").json(f"{bundle}/chunks").select(
        F.regexp_extract("_metadata.file_name", r"^points-(.*)\.json$", 1).alias("hash"), "points")
    return stored.join(hashes, "hash").select("chunk", F.posexplode("points").alias("position", "p")).select(
        "chunk", "position", *_point_columns("p"), "p.first_observing_frame", "p.contributors")


def scan_raster_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    manifest = spark.read.schema(RASTER_MANIFEST).option("multiLine", True).json(path)
    return manifest.drop("frames"), manifest.select(F.explode("frames").alias("f")).select("f.*")


def scan_pose_solution(spark: SparkSession, bundle: str, hash_: str) -> dict[str, DataFrame]:
    """A published pose solution split into its tables."""
    require_published(open_manifest(spark, bundle), "pose_solution_hashes", hash_)
    return pose_tables(spark, f"{bundle}/chunks/pose-{hash_}.json")


def pose_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    document = spark.read.schema(POSE_SOLUTION).option("multiLine", True).json(path)
    frames = document.select(F.explode("frames").alias("f")).select(
        "f.frame_index", "f.image_name", "f.registered", F.col("f.world_to_camera").alias("w2c"))
    world = document.select("global_trajectory.*").filter("tracks is not null")
    links = world.select(F.explode("frame_camera_ids").alias("_k", "camera_id")).select(F.col("_k").cast("int").alias("frame_index"), "camera_id")
    models = world.select(F.explode("camera_models").alias("m")).select(
        "m.camera_id", "m.model", "m.width", "m.height", *[F.col("m.parameters").getItem(i).alias(n) for i, n in enumerate(("f", "cx", "cy", "k"))])
    tracks = world.select(F.explode("tracks").alias("t"))
    return {
        "document": document.select("schema", "provider", "raster_fingerprint", "coordinate_convention", "diagnostics"),
        "poses": frames.join(links, "frame_index", "left"), "models": models,
        "tracks": tracks.select("t.point_id", *[F.col("t.position").getItem(i).alias(a) for i, a in enumerate("xyz")], "t.reprojection_error_px"),
        "observations": tracks.select("t.point_id", F.posexplode("t.observations").alias("position", "o")).select(
            "point_id", "position", "o.frame_index", F.col("o.image_xy").getItem(0).alias("u"), F.col("o.image_xy").getItem(1).alias("v")),
    }


def bind_inputs(rasters: DataFrame, images: DataFrame, poses: DataFrame, models: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Registered frames with verified rasters and intrinsics scaled to the raster.

    ``images`` has ``file_name`` and the ``sha256`` of the stored bytes; a frame
    whose bytes differ from the manifest is reported, not skipped.
    """
    joined = rasters.join(images.select("file_name", F.col("sha256").alias("stored")), "file_name", "left")
    bad = joined.filter(~F.col("sha256").eqNullSafe(F.col("stored"))).limit(1).collect()
    if bad:
        raise BundleError(f"raster {bad[0]['file_name']} does not match its manifest hash")
    sx, sy = F.lit(size[0]) / F.col("width"), F.lit(size[1]) / F.col("height")
    centre = lambda value, factor: (value + 0.5) * factor - 0.5
    k = F.array(F.col("f") * sx, F.lit(0.0), centre(F.col("cx"), sx), F.lit(0.0), F.col("f") * sy, centre(F.col("cy"), sy), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return joined.join(poses.filter("registered").select("frame_index", "w2c", "camera_id"), "frame_index").join(models, "camera_id").select(
        "frame_index", "file_name", "timestamp_millis", "w2c", k.alias("k"))


def replay_owner(windows: DataFrame) -> DataFrame:
    """Frame to the lowest window holding it, with that window's chunk."""
    return windows.groupBy("frame_index").agg(F.min_by(F.struct("window_index", "hash"), "window_index").alias("_o")).select("frame_index", "_o.*")
