"""Quality as data: summaries, gates and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cameras as C
from ..functions import naming
from ..functions import vectors as V
from ..schemas import tag_pattern
from ..session import spread
from ..settings import GlobalFitSettings
from ..sources.rasters import frame_delta
from . import similarity
from .common import attach, equi
from .matching import camera_pairs
from .ordering import adjacent
from .quantiles import median, percentiles, upper_median


# --- scene summaries -----------------------------------------------------

def _finite_or_null(value: Column) -> Column:
    return F.when(V.finite(value), value)


def inlier_ratio() -> Column:
    counted = F.col("correspondence_count") > 0
    return F.when(counted, F.col("inlier_count") / F.when(counted, F.col("correspondence_count")))


def alignment_summary(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, least inlier ratio and greatest finite residual of the seams."""
    return alignments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sequential_alignment_count"),
        F.sum("correspondence_count").alias("correspondence_count"), F.sum("inlier_count").alias("inlier_count"),
        F.min(inlier_ratio()).alias("minimum_inlier_ratio"), F.max(_finite_or_null(F.col("rms_residual"))).alias("maximum_rms_residual"),
    )


def three_point_summary(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Minimum, upper median and maximum of the finite values, per output prefix."""
    out = None
    for name, value in values.items():
        finite = df.withColumn("_v", _finite_or_null(value)).filter("_v is not null")
        ends = finite.groupBy(*keys).agg(F.min("_v").alias(f"{name}_min"), F.max("_v").alias(f"{name}_max"))
        one = equi(ends, upper_median(finite, keys, "_v", f"{name}_median"), keys)
        out = one if out is None else (out.join(one, keys, "full_outer") if keys else attach(out, one))
    return out


def point_gate() -> Column:
    """A surfel that may be part of a valid world."""
    names = ("x", "y", "z", "nx", "ny", "nz")
    return F.coalesce(V.all_finite(*[F.col(c) for c in names]) & V.positive(F.col("radius")), F.lit(False))


def surface_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fused_points"), F.min(point_gate()).alias("finite_points"))


def scene_state(points: DataFrame, keys: list[str]) -> DataFrame:
    state = (
        F.when(F.col("fused_points").isNull() | (F.col("fused_points") == 0), "measured_only")
        .when(~F.col("finite_points"), "invalid_fused_geometry").otherwise("fused_relative_world")
    )
    return surface_summary(points, keys).withColumn("state", state)


def verify(evidence: DataFrame, profile: dict) -> DataFrame:
    """Violations of a quality profile.

    A missing inlier ratio violates its minimum; a missing residual does not
    violate its maximum.
    """
    v = []
    v.append(F.when(F.col("measured_windows") < profile["minimum_measured_windows"], "measured_windows"))
    v.append(F.when(F.col("fused_points") < profile["minimum_fused_points"], "fused_points"))
    v.append(F.when(~F.col("finite_points"), "finite_points"))
    ratio = F.coalesce(F.col("minimum_inlier_ratio") < profile["minimum_sequential_inlier_ratio"], F.lit(True))
    v.append(F.when(ratio, "minimum_inlier_ratio"))
    residual = F.coalesce(F.col("maximum_rms_residual") > profile["maximum_sequential_rms_residual"], F.lit(False))
    v.append(F.when(residual, "maximum_rms_residual"))
    v.append(F.when(F.lit(profile["require_loop_closure"]) & (F.col("loop_closures") == 0), "loop_closure"))
    return evidence.withColumn("violations", F.array_compact(F.array(*v))).withColumn("passed", F.size("violations") == 0)


def difference_stats(left: DataFrame, right: DataFrame, ordinal: list[str], values: list[str], exact: list[str]) -> DataFrame:
    """Mean and greatest absolute difference of two ordered tables, matched by position."""
    a = left.select(*ordinal, F.struct(*values, *exact).alias("a"))
    b = right.select(*ordinal, F.struct(*values, *exact).alias("b"))
    both = a.join(b, ordinal, "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = [
        F.count("a").alias("left_rows"), F.count("b").alias("right_rows"), F.sum(paired.cast("long")).alias("paired_rows"),
    ]
    for name in values:
        gap = F.when(paired, F.abs(F.col(f"a.{name}") - F.col(f"b.{name}")))
        out += [F.avg(gap).alias(f"{name}_mean_error"), F.max(gap).alias(f"{name}_max_error"),
                F.sum((gap != 0).cast("long")).alias(f"{name}_mismatches")]
    for name in exact:
        out.append(F.sum((paired & ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))).cast("long")).alias(f"{name}_mismatches"))
    return both.agg(*out)


# Two-sided 95 % Student t quantiles by degrees of freedom. Fixed values.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
       11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086,
       21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064, 25: 2.060, 26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045, 30: 2.042}


def trial_intervals(samples: DataFrame, arm: str, trial: str, value: str) -> DataFrame:
    """Mean of the trial medians with its 95 % interval."""
    medians = median(samples, [arm, trial], value, "_m")
    stats = medians.groupBy(arm).agg(F.count(F.lit(1)).alias("trials"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("_s"))
    table = F.create_map(*[F.lit(v) for pair in T95.items() for v in pair])
    critical = F.coalesce(F.try_element_at(table, (F.col("trials") - 1).cast("int")), F.lit(1.96))
    margin = F.coalesce(critical * F.col("_s") / F.sqrt("trials"), F.lit(0.0))
    return stats.select(arm, "trials", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def _advised(seen: DataFrame, keys: list[str], step: Column, mixed: Column) -> DataFrame:
    out = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("frame_count"), F.avg(step).alias("_mean"), F.max(mixed).alias("_mixed"))
    unusable = (F.col("frame_count") < 2) | (F.coalesce("_mixed", F.lit(0)) == 1)
    mean = F.col("mean_adjacent_luma_delta")
    state = F.when(mean < 0.002, "recapture").when(mean < 0.01, "review").otherwise("ready")
    return out.withColumn("mean_adjacent_luma_delta", F.when(unusable, 0.0).otherwise(F.col("_mean"))).withColumn(
        "disposition", state).drop("_mean", "_mixed")


def capture_quality(frames: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Mean change of ``luma`` between neighbouring frames and the advice that follows from it."""
    seen = adjacent(frames, keys, ordinal, {"_luma": lambda w: F.lag("luma").over(w)})
    return _advised(seen, keys, F.abs(F.col("luma") - F.col("_luma")), F.lit(0))


def frame_quality(frames: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The same over whole images; frames of different sizes call for a recapture.

    Images are large, so a window block holds only a few dozen of them.
    """
    seen = adjacent(frames, keys, ordinal, {
        "_rgb": lambda w: F.lag("rgb").over(w), "_w": lambda w: F.lag("width").over(w), "_h": lambda w: F.lag("height").over(w)}, block=32)
    mixed = ((F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h"))).cast("int")
    return _advised(seen, keys, frame_delta("_rgb", "rgb"), mixed)


# --- contracts -----------------------------------------------------------

def raster_violations(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of a raster manifest that break its rules.

    Indices are contiguous from zero, names unique and plain, hashes and sizes
    well-formed and timestamps strictly increasing.
    """
    ordered = adjacent(frames, keys, "frame_index", {
        "_index": lambda w: F.lag("frame_index").over(w), "_time": lambda w: F.lag("timestamp_millis").over(w)})
    repeated = frames.groupBy(*keys, "file_name").agg(F.count(F.lit(1)).alias("_names"))
    joined = ordered.join(repeated, [*keys, "file_name"])
    gap = F.when(F.col("_index").isNull(), F.col("frame_index") != 0).otherwise(F.col("frame_index") != F.col("_index") + 1)
    reasons = F.array_compact(F.array(
        F.when(gap, "index gap"), F.when(F.col("_names") > 1, "repeated name"),
        F.when(~F.coalesce(F.col("file_name").rlike(r"^[^/\\]+$"), F.lit(False)), "unsafe name"),
        F.when(~F.coalesce(naming.is_sha256(F.col("sha256")), F.lit(False)), "bad hash"),
        F.when(F.col("timestamp_millis") <= F.col("_time"), "time order"),
        F.when(F.col("timestamp_millis") < 0, "negative time"),
    ))
    return joined.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*keys, "frame_index", "file_name", "reasons")


# Coordinate convention required of each publishable provider. Fixed values.
POSE_CONVENTIONS = {
    "colmap": "COLMAP world; W2C row-major 3x4 f64",
    "droid-slam": "OpenCV world; W2C row-major 3x4 f64",
    "vggt": "OpenCV world; W2C row-major 3x4 f64",
    "hybrid-colmap-droid": "OpenCV world; W2C row-major 3x4 f64",
}


def pose_violations(solution: DataFrame, rasters: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a pose solution that break its contract.

    ``solution``: keys, frame_index, image_name, registered, w2c. ``rasters``:
    keys, frame_index, file_name.
    """
    repeated = solution.groupBy(*keys, "frame_index").agg(F.count(F.lit(1)).alias("_rows"))
    joined = solution.join(repeated, [*keys, "frame_index"]).join(
        rasters.select(*keys, "frame_index", F.col("file_name").alias("_name")), [*keys, "frame_index"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_rows") > 1, "repeated frame"), F.when(F.col("_name").isNull(), "unknown frame"),
        F.when(F.col("_name") != F.col("image_name"), "name differs"),
        F.when(F.col("registered") & ~F.coalesce(C.is_rigid("w2c"), F.lit(False)), "not rigid"),
        F.when(~F.col("registered") & F.col("w2c").isNotNull(), "pose on unregistered frame"),
    ))
    return joined.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*keys, "frame_index", "reasons")


def track_violations(tracks: DataFrame, observations: DataFrame, frames: DataFrame) -> DataFrame:
    """Sparse tracks with bad numbers, repeated frames or unknown frames.

    A task sees a bounded share of the observations, by frame for the frames that are known and
    then by track: the aggregate of distinct frames holds nearly a row for each of them.
    """
    known = spread(observations, "frame_index").join(frames.select("frame_index", F.lit(True).alias("_known")), "frame_index", "left")
    per_track = spread(known, "point_id", table=observations).groupBy("point_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("frame_index").alias("_d"),
        F.sum(F.col("_known").isNull().cast("int")).alias("_unknown"),
        F.min(V.all_finite(F.col("u"), F.col("v"))).alias("_finite"))
    joined = tracks.join(per_track, "point_id", "left")
    reasons = F.array_compact(F.array(
        F.when(~V.all_finite(F.col("x"), F.col("y"), F.col("z")), "position"),
        F.when(~F.coalesce(V.finite(F.col("reprojection_error_px")) & (F.col("reprojection_error_px") >= 0), F.lit(False)), "error"),
        F.when(F.col("_n").isNull(), "no observation"), F.when(F.col("_n") != F.col("_d"), "repeated frame"),
        F.when(F.col("_unknown") > 0, "unknown frame"), F.when(~F.col("_finite"), "image position"),
    ))
    return joined.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select("point_id", "reasons")


def document_violations(documents: DataFrame, document: str, raster: str | None = None) -> DataFrame:
    """Solutions with a wrong tag, convention, provider or raster fingerprint."""
    checks = [
        F.when(~F.coalesce(F.col("schema").rlike(tag_pattern(document)), F.lit(False)), "schema"),
    ]
    if "provider" in documents.columns:
        table = F.create_map(*[F.lit(v) for pair in POSE_CONVENTIONS.items() for v in pair])
        expected = F.try_element_at(table, F.col("provider.kind"))
        checks.append(F.when(expected.isNull(), "provider"))
        checks.append(F.when(~expected.eqNullSafe(F.col("coordinate_convention")), "convention"))
    if raster is not None:
        checks.append(F.when(F.col("raster_fingerprint") != raster, "raster"))
    return documents.withColumn("reasons", F.array_compact(F.array(*checks))).filter(F.size("reasons") > 0)


def checkpoint_violations(views: DataFrame, schedule: DataFrame, keys: list[str]) -> DataFrame:
    """Windows whose stored frames are not exactly the scheduled contiguous range."""
    stored = views.groupBy(*keys, "window_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("frame_index").alias("d"),
        F.min("frame_index").alias("low"), F.max("frame_index").alias("high"))
    joined = stored.join(schedule, [*keys, "window_index"], "left")
    good = (F.col("low") == F.col("start")) & (F.col("high") == F.col("stop") - 1) & (F.col("n") == F.col("d")) & (
        F.col("n") == F.col("stop") - F.col("start"))
    return joined.filter(~F.coalesce(good, F.lit(False))).select(*keys, "window_index", "low", "high", "n")


def semantic_violations(pixels: DataFrame) -> DataFrame:
    good = naming.semantic_name(F.col("class_code")).isNotNull() & V.finite(F.col("confidence")) & F.col("confidence").between(0, 1)
    return pixels.filter(~F.coalesce(good, F.lit(False)))


def frame_set_report(published: DataFrame, registered: DataFrame, keys: list[str], minimum: float = 0.85) -> DataFrame:
    """Published frames must be registered and cover enough of them."""
    p = published.select(*keys, "frame_index").distinct().withColumn("_p", F.lit(1))
    r = registered.select(*keys, "frame_index").distinct().withColumn("_r", F.lit(1))
    both = p.join(r, [*keys, "frame_index"], "full_outer")
    counts = both.groupBy(*keys).agg(
        F.count("_p").alias("published"), F.count("_r").alias("registered"),
        F.sum((F.col("_p").isNotNull() & F.col("_r").isNull()).cast("long")).alias("foreign"))
    return counts.withColumn("passed", (F.col("foreign") == 0) & (F.col("registered") > 0) & (
        F.col("published") >= minimum * F.col("registered")))


def global_window_fit(views: DataFrame, poses: DataFrame, settings: GlobalFitSettings = GlobalFitSettings()) -> DataFrame:
    """Similarity of each window to a global trajectory and its gate."""
    pairs = camera_pairs(views, poses, ["window_index"])
    fit = similarity.huber_fit(pairs, ["window_index"])
    centre = pairs.groupBy("window_index").agg(*[F.avg(c).alias(f"_{c}") for c in ("sx", "sy", "sz")])
    reach = pairs.join(centre, "window_index").groupBy("window_index").agg(
        F.sqrt(F.avg(V.squared_distance(V.vec("sx", "sy", "sz"), V.vec("_sx", "_sy", "_sz")))).alias("_extent"))
    joined = fit.join(reach, "window_index")
    normalized = F.col("rms_residual") / F.greatest(F.col("_extent") * F.abs("scale"), F.lit(1e-6))
    normalized = F.when(F.col("pairs") >= 3, normalized)
    passed = F.coalesce((F.col("pairs") >= settings.minimum_cameras) & (normalized <= settings.maximum_normalized_rms), F.lit(False))
    return joined.withColumn("normalized_rms", normalized).withColumn("passed", passed).drop("_extent")


def calibration_decision(canonical: DataFrame, overlap: DataFrame, maximum_error: float = 0.20, minimum_share: float = 0.85,
                         maximum_p95: float = 0.22) -> DataFrame:
    """One row: accepted share of frames, overlap p95 and the decision."""
    good = F.col("accepted") & (F.col("held_out_median_log_error") <= maximum_error)
    share = canonical.agg(F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("accepted_share"), F.count(F.lit(1)).alias("frames"))
    spread = percentiles(overlap, [], "difference", {"overlap_p95": 0.95})
    decision = (F.col("accepted_share") >= minimum_share) & (F.coalesce("overlap_p95", F.lit(0.0)) <= maximum_p95)
    return attach(share, spread).withColumn("decision", F.when(decision, "accepted").otherwise("rejected"))


# --- catalogue -----------------------------------------------------------

def resolve_product(products: DataFrame, keys: list[str], requested: Column, selected: Column) -> DataFrame:
    """Product to show: the requested one, else the geometric multi-view one, the first surfel one, the selected one.

    A requested product that does not exist resolves to nothing.
    """
    rank = (
        F.when(requested.isNotNull(), F.when(F.col("product_id") == requested, 0))
        .when(F.col("product_id") == "colmap-mvs-geometric", 1)
        .when(F.col("kind") == "surfel", 2).when(F.col("product_id") == selected, 3))
    ranked = products.withColumn("rank", rank).filter("rank is not null")
    return ranked.groupBy(*keys).agg(F.min_by(F.struct("product_id", "kind", "rank"), F.struct("rank", "product_id")).alias("_p")).select(*keys, "_p.*")


def recover_job(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Latest job, running ones marked interrupted, and the next free id."""
    latest = jobs.groupBy(*(keys or [])).agg(
        F.max_by("state", "job_id").alias("state"), F.max("job_id").alias("job_id"))
    return latest.withColumn("state", F.when(F.col("state").isin("running", "cancel_requested"), "interrupted").otherwise(F.col("state"))).withColumn(
        "next_job_id", F.col("job_id") + 1)


def new_documents(incoming: DataFrame, published: DataFrame, hash_column: str = "sha256") -> DataFrame:
    """Content not published yet, once per hash."""
    return incoming.dropDuplicates([hash_column]).join(published.select(hash_column).distinct(), hash_column, "left_anti")


def publish_once_conflicts(incoming: DataFrame, published: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Keys that already hold a different document; an equal one is no conflict."""
    old = published.select(*keys, F.col(fingerprint).alias("_old"))
    return incoming.join(old, keys).filter(~F.col(fingerprint).eqNullSafe(F.col("_old"))).drop("_old")
