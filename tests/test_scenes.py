"""Whole-scene jobs on a synthetic room."""

import numpy as np
import pandas as pd
import pytest

from scenefold.functions import linalg
from scenefold.operators import matching, surface
from scenefold.plans import fusion
from scenefold.settings import LoopSettings, SeamGate, TsdfSettings


@pytest.fixture(scope="module")
def walk(spark):
    """Five windows of a walk through a wavy floor, each in its own scaled frame."""
    rng = np.random.default_rng(9)
    rows, views = [], []
    for window, start in enumerate((0, 2, 4, 6, 8)):
        rotation = linalg.so3_exp(rng.normal(size=3) * 0.2) if window else np.eye(3)
        scale = 1.0 + 0.1 * window
        shift = rng.normal(size=3) if window else np.zeros(3)
        back = lambda p: rotation.T @ ((p - shift) / scale)
        for frame in range(start, start + 4):
            centre = np.array([np.cos(frame * 0.6) * 0.3, np.sin(frame * 0.6) * 0.3, 1.0])
            pose = np.eye(4)
            pose[:3, :3] = rotation
            pose[:3, 3] = -rotation @ back(centre)
            views.append((window, frame, pose[:3].ravel().tolist(), [50.0, 0.0, 8.0, 0.0, 50.0, 8.0, 0.0, 0.0, 1.0]))
            for px in range(8):
                for py in range(8):
                    x, y = centre[0] + (px - 4) * 0.1, centre[1] + (py - 4) * 0.1
                    p = back(np.array([x, y, 0.1 * np.sin(3 * x) * np.cos(3 * y)]))
                    n = rotation.T @ np.array([0.0, 0.0, 1.0])
                    rows.append((window, frame, px, py, *p, *n, 100, 100, 100, 1.0, 0.05 / scale))
    names = ["window_index", "frame_index", "px", "py", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "confidence", "radius"]
    points = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    return points, spark.createDataFrame(views, "window_index int, frame_index int, w2c array<double>, k array<double>")


@pytest.mark.parametrize("profile", ["product", "relative"])
def test_windows_come_back_to_one_world(spark, walk, profile):
    points, views = walk
    scene = fusion.fuse_scene(points, views, ["py", "px"], profile, "voxel", gate=SeamGate(maximum_normalized_rms=1.0))
    poses = {r.window_index: r for r in scene.poses.collect()}
    for window in range(5):
        assert poses[window].scale == pytest.approx(1.0 + 0.1 * window, rel=2e-3)
    fused = scene.points.toPandas()
    assert np.abs(fused.z - 0.1 * np.sin(3 * fused.x) * np.cos(3 * fused.y)).max() < 0.03
    assert fused.contributors.sum() == 12 * 64


def shuffles(df):
    """Shuffles by key in the plan, with joins that are broadcast by hint only."""
    spark, name = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(name, before)


def test_seams_shuffle_the_frames_that_windows_share(spark, walk, monkeypatch):
    points, _ = walk
    asked, keep = [], matching.latest_by
    monkeypatch.setattr(matching, "latest_by", lambda rows, *more: (asked.append(rows), keep(rows, *more))[1])
    fits = fusion.align_windows(points, ["py", "px"], "product", SeamGate(maximum_normalized_rms=1.0)).collect()
    assert sorted(f.window_index for f in fits) == [1, 2, 3, 4] and all(f.correspondence_count == 2 * 64 for f in fits)
    # Each window but the last shares two of its four frames with the next.
    assert asked[0].count() == 4 * 2 * 64
    # The source once and the target once, also where a pixel is found twice.
    assert shuffles(matching.shared_pixel_pairs(points, ["py", "px"])) == 2


def test_the_percentile_of_a_window_does_not_shuffle_its_pixels(spark, walk):
    points, _ = walk
    kept = surface.at_least_window_percentile(points.withColumn("confidence", ((points.px * 8 + points.py) % 20).cast("double")))
    assert shuffles(kept) == 0
    # 256 pixels of a window: the values 0 to 3 sixteen times, the others twelve times.
    values = sorted((px * 8 + py) % 20 for px in range(8) for py in range(8)) * 4
    assert kept.filter("window_index = 0").count() == sum(v >= np.percentile(values, 55) for v in values)


def test_loop_closure_adds_an_edge(spark, walk):
    points, views = walk
    loops = LoopSettings(minimum_correspondences=20, centre_distance_radii=20.0, minimum_inlier_ratio=0.3, maximum_rms_radii=5.0)
    scene = fusion.fuse_scene(points, views, ["py", "px"], "product", "voxel", close_loops=True, loops=loops)
    edges = scene.edges.collect()
    assert sum(not e.loop_closure for e in edges) == 4 and any(e.loop_closure for e in edges)
    assert scene.poses.count() == 5


def test_global_pose_places_windows(spark, walk):
    points, views = walk
    rows = [(f, [1.0, 0.0, 0.0, float(-np.cos(f * 0.6) * 0.3), 0.0, 1.0, 0.0, float(-np.sin(f * 0.6) * 0.3), 0.0, 0.0, 1.0, -1.0], True) for f in range(12)]
    solution = spark.createDataFrame(rows, "frame_index int, w2c array<double>, registered boolean")
    from scenefold.operators import reports
    from scenefold.settings import GlobalFitSettings

    fits = reports.global_window_fit(views, solution, GlobalFitSettings(minimum_cameras=4)).collect()
    assert len(fits) == 5 and all(f.passed and f.pairs == 4 for f in fits)
    scene = fusion.fuse_with_global_pose(points, views, solution, GlobalFitSettings(minimum_cameras=4), TsdfSettings(voxel_size=0.1))
    assert scene.points.count() > 20


def test_report_tables(spark, walk):
    points, views = walk
    scene = fusion.fuse_scene(points, views, ["py", "px"], "product", "voxel")
    tables = fusion.inspect_scene(scene, 0.2)
    assert tables["alignments"].first().sequential_alignment_count == 4
    assert tables["state"].first().state == "fused_relative_world"
    assert tables["topology"].first().components >= 1


def test_frames_fused_by_sparse_tracks(spark):
    """Predicted depth is half of the truth; tracks restore the scale of every frame."""
    from scenefold.plans.fusion import fuse_frames_globally
    from scenefold.settings import FrameGlobalSettings

    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    k = [16.0, 0.0, 7.5, 0.0, 16.0, 7.5, 0.0, 0.0, 1.0]
    rows, observations, tracks, point = [], [], [], 0
    for frame in range(4):
        for px in range(16):
            for py in range(16):
                rows.append((0, frame, px, py, (px - 7.5) / 16, (py - 7.5) / 16, 1.0, 0.0, 0.0, -1.0, 9, 9, 9, 1.0, 0.03))
                if px % 3 == 0 and py % 3 == 0:
                    tracks.append((point, (px - 7.5) / 8 - 0.01 * frame, (py - 7.5) / 8, 2.0, 0.1))
                    observations.append((point, frame, float(px), float(py)))
                    point += 1
    names = ["window_index", "frame_index", "px", "py", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "confidence", "radius"]
    points = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    views = spark.createDataFrame([(0, f, eye, k) for f in range(4)], "window_index int, frame_index int, w2c array<double>, k array<double>")
    shifted = lambda f: eye[:3] + [0.01 * f] + eye[4:]
    solution = {
        "observations": spark.createDataFrame(observations, "point_id long, frame_index int, u double, v double"),
        "tracks": spark.createDataFrame(tracks, "point_id long, x double, y double, z double, reprojection_error_px double"),
        "poses": spark.createDataFrame([(f, shifted(f), 1, True) for f in range(4)], "frame_index int, w2c array<double>, camera_id long, registered boolean"),
        "models": spark.createDataFrame([(1, 16, 16, 16.0, 7.5, 7.5, 0.0)], "camera_id long, width int, height int, f double, cx double, cy double, k double"),
    }
    reports_, cloud = fuse_frames_globally(points, views, solution, (16, 16), FrameGlobalSettings(), surface_mode="raw")
    assert all(r.scale == pytest.approx(2.0) for r in reports_.collect())
    rows = cloud.toPandas()
    assert len(rows) > 500 and np.allclose(rows.z, 2.0)
