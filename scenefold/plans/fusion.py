"""Whole-scene fusions composed from the operators.

Every stage is a distributed job; the only per-scene driver values are scalars
(voxel edge, median radius) and the only single-task step is the dense pose
graph of one capture.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..errors import FusionError, StitchError
from ..functions import cameras as C
from ..functions import vectors as V
from ..operators import depth, graph, matching, ordering, reports, similarity, surface
from ..operators.icp import icp_refine
from ..operators.quantiles import upper_median
from ..operators.spatial import nearest_within
from ..session import BROADCAST_ROWS, broadcast_if_small, has_at_most, settle
from ..settings import (
    FrameGlobalSettings, GlobalFitSettings, LoopSettings, RelativeLoopSettings, SeamGate, TsdfSettings, WindowSettings,
)

_SIM3 = ["scale", "rotation", "translation"]


@dataclass(frozen=True)
class FusedScene:
    alignments: DataFrame
    edges: DataFrame
    poses: DataFrame
    points: DataFrame


def plan(frame_count: int, spark, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Window schedule of a capture."""
    frames = spark.range(frame_count).withColumnRenamed("id", "ordinal")
    return ordering.window_schedule(frames, [], "ordinal", settings)


def align_windows(points: DataFrame, order: list[str], profile: str = "product", gate: SeamGate = SeamGate()) -> DataFrame:
    """Transform of every window to its predecessor, all seams in one job.

    A similarity fit commutes with moving the target by a similarity, so local
    seams followed by a prefix product give the chained poses; the seams need
    not wait for each other.
    """
    keyed = ["window_index"]
    seen = settle(points.select("window_index", "frame_index").distinct())
    seen = seen if has_at_most(seen, BROADCAST_ROWS) else None
    if profile == "product":
        fit = similarity.robust_fit(matching.shared_pixel_pairs(points, order, seen=seen), keyed)
        return similarity.require_seams(settle(fit), gate)
    fit = similarity.huber_fit(matching.shared_pixel_pairs(points, order, minimum_weight=1e-6, seen=seen), keyed)
    return settle(fit.withColumnRenamed("pairs", "correspondence_count"))


def sequential_poses(alignments: DataFrame, windows: DataFrame) -> DataFrame:
    """World poses by prefix product; a window without a seam is an error."""
    eye = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    first = windows.agg(F.min("window_index").alias("window_index"))
    missing = windows.join(F.broadcast(first), "window_index", "left_anti").join(alignments, "window_index", "left_anti").limit(1).collect()
    if missing:
        raise StitchError(f"window {missing[0]['window_index']} has no overlap with its predecessor")
    start = first.select("window_index", F.lit(1.0).alias("scale"), eye.alias("rotation"), F.array(*[F.lit(0.0)] * 3).alias("translation"))
    return settle(graph.chain_poses(start.unionByName(alignments.select("window_index", *_SIM3))))


def world_cameras(views: DataFrame, poses: DataFrame) -> DataFrame:
    """Camera centre and direction of every view in the world."""
    joined = views.join(poses, "window_index")
    s = C.sim3()
    centre = C.sim3_apply(s, C.camera_centre("w2c"))
    forward = V.rotate(s[1], C.camera_forward("w2c"))
    names = ("x", "y", "z", "fx", "fy", "fz")
    return joined.select("window_index", "frame_index", *[v.alias(n) for v, n in zip((*centre, *forward), names)]).filter(
        V.all_finite(*[F.col(n) for n in names]))


def _loop_pairs(points: DataFrame, proposals: DataFrame, poses: DataFrame):
    """Seeded source points of the later window and target points of the earlier one, per proposal."""
    pair = proposals.withColumn("pair", F.col("earlier") * 1_000_000 + F.col("later")).select("pair", "earlier", "later")
    at = lambda side, prefix: poses.select(F.col("window_index").alias(side), *[F.col(c).alias(f"{prefix}{c}") for c in _SIM3])
    seeds = pair.join(at("earlier", "e_"), "earlier").join(at("later", "l_"), "later")
    seeds = seeds.select("pair", "earlier", "later", *C.sim3_columns(C.sim3_compose(C.sim3_inverse(C.sim3("e_")), C.sim3("l_"))))
    sources = points.withColumnRenamed("window_index", "later").join(seeds, "later")
    targets = points.withColumnRenamed("window_index", "earlier").join(pair.select("pair", "earlier"), "earlier")
    return settle(seeds), settle(sources.withColumn("qid", F.monotonically_increasing_id())), settle(targets.withColumn("tid", F.monotonically_increasing_id()))


def _matched(sources: DataFrame, targets: DataFrame, matches: DataFrame) -> DataFrame:
    s = sources.select("pair", "qid", *[F.col(a).alias(f"s{a}") for a in "xyz"], F.col("confidence").alias("_sc"))
    t = targets.select("tid", *[F.col(a).alias(f"t{a}") for a in "xyz"], *[F.col(n).alias(f"t{n}") for n in ("nx", "ny", "nz")], F.col("confidence").alias("_tc"))
    return matches.select("qid", "tid").join(s, "qid").join(t, "tid").withColumn("w", F.greatest(F.least("_sc", "_tc"), F.lit(0.0)))


def discover_loops(points: DataFrame, views: DataFrame, poses: DataFrame, profile: str = "product",
                   loops: LoopSettings = LoopSettings(), relative: RelativeLoopSettings = RelativeLoopSettings(), refine_icp: bool = False) -> DataFrame:
    """Accepted revisit edges between windows that are not neighbours."""
    cameras = world_cameras(views, poses)
    if profile == "product":
        radius = upper_median(points.filter(V.positive(F.col("radius"))), [], "radius", "r").first()["r"]
        proposals = matching.camera_path_revisits(cameras, loops.minimum_window_gap, radius * loops.centre_distance_radii, loops.minimum_forward_cosine)
        distance, information = radius * loops.match_distance_radii, loops.information
    else:
        proposals = matching.camera_path_revisits(cameras, relative.minimum_window_gap, relative.maximum_centre_distance, relative.minimum_forward_cosine)
        distance, information = relative.match_distance, relative.information
    proposals = settle(proposals)
    empty = poses.sparkSession.createDataFrame([], "src int, dst int, scale double, rotation array<double>, translation array<double>, information double, loop_closure boolean")
    if not proposals.limit(1).count():
        return empty
    seeds, sources, targets = _loop_pairs(points, proposals, poses)
    seeded = V.columns(sources, C.sim3_apply(C.sim3(), V.vec("x", "y", "z")), ("x", "y", "z"))
    if profile == "product":
        matches = matching.one_to_one_nearest(seeded, targets, distance, ["pair"])
        fit = similarity.robust_fit(_matched(sources, targets, matches), ["pair"])
        good = similarity.loop_gate(fit, loops.minimum_correspondences, loops.minimum_inlier_ratio, radius * loops.maximum_rms_radii)
    else:
        matches = nearest_within(seeded, targets, distance, "first_in_cell_order", by=["pair"])
        found = _matched(sources, targets, matches)
        enough = found.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= relative.minimum_pairs)
        good = similarity.huber_fit(found.join(enough, "pair", "left_semi"), ["pair"])
        if refine_icp:
            refined = icp_refine(sources, targets, good.select("pair", *_SIM3))
            good = refined.select("pair", *_SIM3)
    return good.join(seeds.select("pair", "earlier", "later"), "pair").select(
        F.col("earlier").cast("int").alias("src"), F.col("later").cast("int").alias("dst"), *_SIM3, F.lit(information).alias("information"), F.lit(True).alias("loop_closure"))


def fuse_scene(points: DataFrame, views: DataFrame, order: list[str], profile: str = "product", surface_mode: str = "voxel",
               close_loops: bool = False, tsdf: TsdfSettings = TsdfSettings(), gate: SeamGate = SeamGate(),
               loops: LoopSettings = LoopSettings(), relative: RelativeLoopSettings = RelativeLoopSettings()) -> FusedScene:
    """Measured windows to one surface: seams, chain, loops, graph, ownership, fusion."""
    points = settle(points)
    if not points.limit(1).count():
        raise FusionError("no measured points")
    if profile == "relative":
        points = settle(surface.at_least_window_percentile(points))
    windows = points.select("window_index").distinct()
    alignments = align_windows(points, order, profile, gate)
    poses = sequential_poses(alignments, windows)
    edges = graph.relative_edges(poses)
    if close_loops:
        found = settle(discover_loops(points, views, poses, profile, loops, relative))
        if found.limit(1).count():
            edges = settle(edges.unionByName(found))
            solved = graph.optimise_pose_graph(poses.withColumn("graph", F.lit(0)), edges.withColumn("graph", F.lit(0)), "graph")
            poses = settle(solved.select("window_index", *_SIM3))
    world = surface.first_owner(surface.transform_points(points, broadcast_if_small(poses)))
    if surface_mode == "voxel":
        return FusedScene(alignments, edges, poses, surface.fuse_voxels(world))
    cameras = surface.first_owner(world_cameras(views, poses)).select("x", "y", "z")
    return FusedScene(alignments, edges, poses, surface.fuse_tsdf(world, cameras, tsdf))


def fuse_with_global_pose(points: DataFrame, views: DataFrame, solution: DataFrame, settings: GlobalFitSettings = GlobalFitSettings(),
                          tsdf: TsdfSettings = TsdfSettings()) -> FusedScene:
    """Windows placed by a global trajectory; every window has to fit."""
    fits = settle(reports.global_window_fit(views, solution, settings))
    bad = points.select("window_index").distinct().join(fits.filter("passed"), "window_index", "left_anti").limit(3).collect()
    if bad:
        raise FusionError(f"windows without a good global fit: {[r['window_index'] for r in bad]}")
    poses = fits.select("window_index", *_SIM3)
    world = surface.first_owner(surface.transform_points(points, poses))
    cameras = surface.first_owner(world_cameras(views, poses)).select("x", "y", "z")
    return FusedScene(fits, graph.relative_edges(poses), poses, surface.fuse_tsdf(world, cameras, tsdf))


def fuse_frames_globally(points: DataFrame, views: DataFrame, solution: dict[str, DataFrame], raster: tuple[int, int],
                         settings: FrameGlobalSettings = FrameGlobalSettings(), surface_mode: str = "tsdf", check_neighbours: bool = True,
                         tsdf: TsdfSettings = TsdfSettings()) -> tuple[DataFrame, DataFrame]:
    """Per-frame scales from sparse tracks, then one surface in the global frame.

    ``solution`` has the tables of ``pose_tables``. Returns (reports, surfels).
    All points are fused; a hash sample is drawn only where ``maximum_observations``
    asks for one, before the neighbour check, which joins rasters.
    """
    evidence = settle(matching.track_scale_evidence(
        solution["observations"], solution["tracks"], solution["poses"], solution["models"], points, views, raster, settings.maximum_track_error_px))
    candidates = depth.frame_scale_reports(evidence, ["window_index", "frame_index"], settings)
    canonical = depth.canonical_views(candidates, [], settings)
    every = views.groupBy("frame_index").agg(F.min("window_index").alias("_first"))
    canonical = every.join(canonical, "frame_index", "left").withColumn("window_index", F.coalesce("window_index", "_first")).drop("_first")
    numbered = ordering.global_index(canonical, ["frame_index"])
    held = evidence.filter(F.pmod("point_id", F.lit(5)) == 0).join(canonical.select("frame_index", "window_index"), ["frame_index", "window_index"], "left_semi")
    smoothed = settle(depth.smooth_scales(numbered, held, [], "ordinal", settings))
    coverage = depth.frame_coverage(smoothed, [], settings).first()
    if not coverage["passed"]:
        raise FusionError(f"only {coverage['fused_frames']} of {coverage['total_frames']} frames are supported")
    accepted = smoothed.filter(depth.is_accepted(settings)).select("window_index", "frame_index", F.col("scale"))
    models = solution["models"].select("camera_id", "f", "cx", "cy", F.col("k").alias("radial"), "width", "height")
    cameras = solution["poses"].filter("registered").join(models, "camera_id").select(
        "frame_index", F.col("w2c").alias("global_w2c"), "f", "cx", "cy", "radial", "width", "height")
    joined = points.join(accepted, ["window_index", "frame_index"]).join(views.select("window_index", "frame_index", "w2c", "k"), ["window_index", "frame_index"]).join(cameras, "frame_index")
    sampled = joined
    if settings.maximum_observations is not None:
        sampled = surface.hash_sample(joined, joined.count(), settings.maximum_observations)
    rebased = settle(depth.rebase_points(sampled, raster).withColumn("pid", F.monotonically_increasing_id()))
    if check_neighbours:
        local = C.camera_depth("w2c", V.vec("x", "y", "z"))
        pixels = joined.select("frame_index", "px", "py", (local * F.col("scale")).alias("depth"))
        lens = cameras.select("frame_index", F.col("global_w2c").alias("w2c"), "f", "cx", "cy", F.col("radial").alias("k"), "width", "height")
        rebased = settle(matching.agreeing_neighbours(rebased.drop("w2c", "k", "f", "cx", "cy", "width", "height"), lens, pixels, raster,
                                                      settings.neighbour_radius, settings.neighbour_minimum, settings.neighbour_log_error))
    if surface_mode != "tsdf":
        return smoothed, rebased
    centres = V.columns(cameras.join(accepted, "frame_index", "left_semi"), C.camera_centre("global_w2c"), ("x", "y", "z")).select("x", "y", "z")
    return smoothed, surface.fuse_tsdf(rebased, centres, tsdf)


def inspect_scene(scene: FusedScene, voxel: float) -> dict[str, DataFrame]:
    """Report tables of a fused scene."""
    cells = ordering.global_index(surface.occupied_cells(scene.points, voxel), surface.KEY, "node")
    return {
        "alignments": reports.alignment_summary(scene.alignments, []), "state": reports.scene_state(scene.points, []),
        "topology": graph.topology(graph.components(cells, graph.cell_edges(cells))),
    }
