"""Imports of external evidence and the depth hybrids."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import PoseError
from ..functions import naming
from ..operators import depth, matching, ordering, planes, reports, surface
from ..operators.quantiles import percentiles
from ..schemas import tag
from ..session import settle
from ..settings import TRACK_FOLD, ArchitectureSettings, CalibrationSettings, TsdfSettings
from ..sources import ply, rasters, sparse_model
from ..sources.bundle import pose_tables


def raster_fingerprint(document: dict) -> str:
    """SHA-256 of the manifest without its tag and fingerprint, keys in order, no spaces."""
    body = {k: v for k, v in document.items() if k not in ("schema", "raster_fingerprint")}
    return hashlib.sha256(json.dumps({k: body[k] for k in sorted(body)}, separators=(",", ":")).encode()).hexdigest()


def record_rasters(spark: SparkSession, cache: str, selection: str | None, fps: float, probe: dict) -> dict:
    """Raster manifest of a decode cache (at most 1,800 frames, hence a driver document).

    ``probe``: source_sha256, duration_seconds, source_width, source_height, crop.
    """
    frames = settle(rasters.scan_ppm(spark, cache).select("ordinal", "file_name", "sha256", "width", "height"))
    source = rasters.selection_indices(spark, selection, frames.count(), fps)
    millis = F.round(F.col("source_index") / fps * 1000.0).cast("long")
    rows = frames.join(source, "ordinal").select(F.col("ordinal").alias("frame_index"), "file_name", "sha256", millis.alias("timestamp_millis"), "width", "height")
    listed = sorted(rows.collect(), key=lambda r: r.frame_index)
    document = {
        "schema": tag("raster"), **probe, "output_width": int(listed[0].width), "output_height": int(listed[0].height),
        "frames": [{"frame_index": int(r.frame_index), "file_name": r.file_name, "sha256": r.sha256, "timestamp_millis": r.timestamp_millis} for r in listed],
    }
    return document | {"raster_fingerprint": raster_fingerprint(document)}


def import_pose_solution(spark: SparkSession, path: str, frames: DataFrame, fingerprint: str) -> dict[str, DataFrame]:
    """Tables of an external pose solution after every check of its contract."""
    tables = pose_tables(spark, path)
    checks = [
        reports.document_violations(tables["document"], "pose-solution", fingerprint),
        reports.pose_violations(tables["poses"], frames, []),
        reports.track_violations(tables["tracks"], tables["observations"], tables["poses"].select("frame_index").distinct()),
    ]
    for check in checks:
        bad = check.limit(3).collect()
        if bad:
            raise PoseError(f"pose contract: {[row.asDict() for row in bad]}")
    return tables


def label_masks(scores: DataFrame) -> DataFrame:
    """Surface class of each pixel from per-label scores: the best label, its score in 1/255 steps."""
    best = scores.groupBy("frame_index", "x", "y").agg(F.max_by(F.struct("label", "score"), "score").alias("_b"))
    confidence = F.round(F.least(F.greatest(F.col("_b.score"), F.lit(0.0)), F.lit(1.0)) * 255) / 255
    return best.select("frame_index", "x", "y", naming.semantic_code(F.col("_b.label")).alias("class_code"), confidence.alias("confidence"))


def import_sparse_model(spark: SparkSession, folder: str, frames: DataFrame):
    """Cameras, poses, tracks and observations of a text model, validated."""
    cameras, poses, tracks, observations = sparse_model.global_model(spark, folder, frames)
    bad = reports.pose_violations(poses.select("frame_index", F.col("file_name").alias("image_name"), "registered", "w2c"), frames, []).limit(3).collect()
    if bad:
        raise PoseError(f"pose contract: {[row.asDict() for row in bad]}")
    return cameras, poses, tracks, observations


def import_stereo_cloud(spark: SparkSession, path: str) -> DataFrame:
    return ply.import_points(spark, path)


def fuse_imported_cloud(points: DataFrame, maximum: int | None = None, settings: TsdfSettings = TsdfSettings()) -> DataFrame:
    """An imported cloud as one zero-crossing layer; ``maximum`` asks for a stride sample."""
    sampled = points
    if maximum is not None:
        sampled = ordering.stride_sample(points, ["idx"], ordering.stride_for_cap(points.count(), maximum))
    return surface.fuse_tsdf(sampled.withColumnRenamed("first_observing_frame", "frame_index"), None, settings)


def extract_architecture(points: DataFrame, order: list[str], settings: ArchitectureSettings = ArchitectureSettings()):
    """Planes, plane surfels and their mesh."""
    found, cells = planes.extract_planes(points, order, settings)
    vertices, indices = planes.mesh_from_cells(cells, ["plane", "cu", "cv"])
    return found, cells, vertices, indices


def calibrate_predictions(evidence: DataFrame, pixels: DataFrame, pose: str, settings: CalibrationSettings = CalibrationSettings()):
    """Calibrate overlapping predictions, choose one per frame and decide.

    ``evidence``: batch_index, source_slot, frame_index, point_id, log_ratio.
    ``pixels``: batch, frame_index, px, py, depth, confidence.
    """
    keys = ["batch_index", "source_slot", "frame_index"]
    rows = settle(depth.calibrate_batches(evidence, keys, TRACK_FOLD, F.lit(pose), settings))
    canonical = depth.canonical_predictions(rows, [])
    scaled = pixels.join(rows.select(F.col("batch_index").alias("batch"), "frame_index", "scale"), ["batch", "frame_index"]).withColumn("depth", F.col("depth") * F.col("scale"))
    overlap = matching.overlap_differences(scaled)
    decision = reports.calibration_decision(canonical, overlap, settings.maximum_held_out_error, settings.minimum_frame_coverage, settings.maximum_overlap_p95)
    return canonical, decision


def emit_predictions(pixels: DataFrame, views: DataFrame, settings: CalibrationSettings = CalibrationSettings()) -> DataFrame:
    """First-owned points above the global confidence percentile."""
    confident = pixels.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    limit = percentiles(confident, [], "confidence", {"limit": settings.confidence_percentile / 100}).first()["limit"]
    owned = surface.first_owner(pixels)
    return surface.dense_points(owned, views, settings.stride, limit)


def stereo_hybrid(pixels: DataFrame, stereo: DataFrame, cameras: DataFrame, raster: tuple[int, int], cells: int = 0, minimum: int = 16) -> DataFrame:
    """Predicted depth replaced by the z-buffer of a stereo cloud where that was seen.

    ``pixels``: frame_index, px, py, depth, confidence. With ``cells`` the rest is
    scaled by the local ratio of both.
    """
    seen = depth.z_buffer_all(stereo, cameras, *raster)
    both = pixels.join(seen.select("frame_index", "px", "py", F.col("depth").alias("reference")), ["frame_index", "px", "py"], "left")
    if cells:
        tiled = depth.tile_ratio(both, ["frame_index"], *raster, cells, minimum)
        both = tiled.withColumn("depth", F.col("depth") * F.col("ratio")).drop("ratio", "tx", "ty")
    return depth.fill_from_reference(both, ["frame_index"])


def dense_stereo_hybrid(pixels: DataFrame, stereo: DataFrame, source: tuple[int, int], raster: tuple[int, int]) -> DataFrame:
    """Predicted depth replaced by resampled dense stereo depth."""
    resized = depth.resample_nearest(stereo, ["frame_index"], source, raster).filter("depth is not null")
    both = pixels.join(resized.select("frame_index", "px", "py", F.col("depth").alias("reference")), ["frame_index", "px", "py"], "left")
    return depth.fill_from_reference(both, ["frame_index"])


# Values an imported prediction manifest must hold. Fixed values.
HYBRID_POLICIES = ("mvs-zbuffer-where-observed-else-da3/v1", "mvs-zbuffer-plus-coarse-local-ratio/v1")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Accepted decision, well-formed hashes and a known pixel policy.

    ``manifest``: decision, raster_fingerprint, pose_solution_hash, ply_sha256, policy.
    """
    reasons = F.array_compact(F.array(
        F.when(~F.col("decision").eqNullSafe("accepted"), "decision"),
        *[F.when(~F.coalesce(naming.is_sha256(F.col(c)), F.lit(False)), c) for c in ("raster_fingerprint", "pose_solution_hash", "ply_sha256")],
        F.when(F.col("policy").isNotNull() & ~F.col("policy").isin(*HYBRID_POLICIES), "policy"),
    ))
    return manifest.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
