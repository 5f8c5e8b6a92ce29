"""Back-projection, cameras and similarities against hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenefold.functions import cameras as C
from scenefold.functions import linalg
from scenefold.functions import vectors as V
from scenefold.operators import depth, surface
from scenefold.schemas import PIXELS, VIEWS
from scenefold.settings import BackprojectionSettings

EYE = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
# Focal length 4, optical axis through the middle of a raster three pixels wide and high.
K = [4.0, 0.0, 1.0, 0.0, 4.0, 1.0, 0.0, 0.0, 1.0]


def scene(spark, depths, width, k=K, w2c=EYE, confidence=None):
    confidence = confidence or [1.0] * len(depths)
    rows = [(0, 0, i % width, i // width, float(d), float(c), 7 * i % 256, 11 * i % 256, 13 * i % 256)
            for i, (d, c) in enumerate(zip(depths, confidence))]
    view = [(0, 0, [float(v) for v in w2c], [float(v) for v in k])]
    return spark.createDataFrame(rows, PIXELS), spark.createDataFrame(view, VIEWS)


def ordered(points):
    return points.orderBy("py", "px").collect()


def test_backprojection_of_a_small_raster(spark):
    points = ordered(surface.backproject(*scene(spark, [8, 8, 16, 4, 12, 4], 3)))
    # x = (px - 1) z / 4 and y = (py - 1) z / 4.
    assert [(p.x, p.y, p.z) for p in points] == [(-2, -2, 8), (0, -2, 8), (4, -4, 16), (-1, 0, 4), (0, 0, 12), (1, 0, 4)]
    assert (points[5].r, points[5].g, points[5].b) == (35, 55, 65)
    assert [p.radius for p in points[:3]] == [2.0, 2.0, 4.0]


def test_stencil_normal_faces_the_camera(spark):
    # A wall at one depth is seen along the axis; a wall that recedes to the right turns to the left.
    flat = ordered(surface.backproject(*scene(spark, [5] * 9, 3)))[0]
    assert (flat.nx, flat.ny, flat.nz) == (0.0, 0.0, -1.0)
    slanted = ordered(surface.backproject(*scene(spark, [4, 5, 6] * 3, 3)))[0]
    assert slanted.nx > 0 > slanted.nz and slanted.nx ** 2 + slanted.ny ** 2 + slanted.nz ** 2 == pytest.approx(1.0)


def test_pose_is_inverted(spark):
    # The camera looks along world -x: its rows are the world axes (0, 0, 1), (0, 1, 0), (-1, 0, 0).
    w2c = [0, 0, 1, 5, 0, 1, 0, 6, -1, 0, 0, 7]
    point = ordered(surface.backproject(*scene(spark, [20], 1, w2c=w2c)))[0]
    # Camera point (-5, -5, 20), less the translation (-10, -11, 13), by the transposed rotation.
    assert (point.x, point.y, point.z) == (-13.0, -11.0, -10.0)


def test_only_finite_confident_evidence_stays(spark):
    pixels, views = scene(spark, [3, math.inf, 0, 3, 3, math.nan], 3, confidence=[0.7, 0.9, 0.9, 0.2, math.nan, 0.9])
    points = ordered(surface.backproject(pixels, views, BackprojectionSettings(minimum_confidence=0.7)))
    assert [(p.px, p.py) for p in points] == [(0, 0)]


def test_exact_inverse_backprojection(spark):
    k = [4.0, 0.0, 3.0, 0.0, 8.0, 2.0, 0.0, 0.0, 1.0]
    pixels, views = scene(spark, [8] * 20, 5, k=k, w2c=[1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3])
    point = surface.backproject_exact(pixels, views).filter("px = 4 and py = 1").first()
    # Camera point (2, -1, 8), less the translation.
    assert (point.x, point.y, point.z) == (1.0, -3.0, 5.0)


def test_stride_keeps_full_raster_neighbours(spark):
    depths = [6] * 25
    depths[1 + 5 * 2] = 7
    points = ordered(surface.backproject(*scene(spark, depths, 5), BackprojectionSettings(stride=2)))
    assert [(p.px, p.py) for p in points] == [(x, y) for y in (0, 2, 4) for x in (0, 2, 4)]
    # The neighbour at (1, 2) is off the stride grid but still bends the normal of (0, 2).
    assert [abs(points[i].nx) > 1e-6 for i in (0, 1, 3, 4)] == [False, False, True, False]


def test_camera_centre_and_direction(spark):
    row = spark.createDataFrame([([1.0, 0.0, 0.0, -2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 1.0, -4.0],)], "w2c array<double>").select(
        *[c.alias(n) for c, n in zip((*C.camera_centre("w2c"), *C.camera_forward("w2c")), "abcdef")]).first()
    assert tuple(row) == (2.0, -3.0, 4.0, 0.0, 0.0, 1.0)


def test_similarity_inverse_and_composition(spark):
    r = linalg.so3_exp(np.array([0.2, -0.4, 0.7]))
    row = (2.5, r.ravel().tolist(), [1.0, -2.0, 3.0])
    frame = spark.createDataFrame([row], "scale double, rotation array<double>, translation array<double>")
    both = C.sim3_compose(C.sim3_inverse(C.sim3()), C.sim3())
    moved = C.sim3_apply(both, V.vec(0.3, 0.4, 0.5))
    assert np.allclose(list(frame.select(*[m.alias(n) for m, n in zip(moved, "xyz")]).first()), [0.3, 0.4, 0.5], atol=1e-12)
    assert np.allclose(linalg.so3_log(r), [0.2, -0.4, 0.7], atol=1e-12)
    bad = spark.createDataFrame([(0.0, *row[1:])], frame.schema).select(C.sim3_inverse(C.sim3())[0].alias("s")).first()
    assert bad.s is None


def test_image_to_raster_pixel(spark):
    frame = spark.createDataFrame([(811.107142857, 541.107142857)], "u double, v double")
    big, small = (F.lit(1620), F.lit(1080)), (F.lit(504), F.lit(336))
    assert tuple(frame.select(*[c.alias(n) for c, n in zip(C.image_to_raster_pixel(F.col("u"), F.col("v"), big, small), "xy")]).first()) == (252, 168)
    uneven = C.image_to_raster_pixel(F.col("u"), F.col("v"), (F.lit(1620), F.lit(1081)), small)[0]
    assert frame.select(uneven.alias("x")).first().x is None


def test_projection_undoes_undistortion(spark):
    lens = tuple(F.lit(v) for v in (40.0, 31.5, 23.5, 0.02))
    frame = C.undistort(spark.createDataFrame([(20.0, 30.0)], "u double, v double"), F.col("u"), F.col("v"), lens, ("x", "y"))
    size = (F.lit(64), F.lit(48))
    back = C.project(frame.withColumn("z", F.lit(1.0)), V.vec("x", "y", "z"), lens, size, size, ("pu", "pv", "depth")).first()
    assert np.allclose([back.pu, back.pv], [20.0, 30.0], atol=1e-6)


def test_colour_round_trip(spark):
    rows = spark.range(256).select("id", C.linear_to_srgb(C.srgb_to_linear(F.col("id"))).alias("v")).collect()
    assert all(r.id == r.v for r in rows)


def test_quaternion_of_special_normals(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], "x double, y double, z double")
    q = rows.select(*[c.alias(n) for c, n in zip(C.quaternion_from_normal(V.vec("x", "y", "z")), "abcd")]).collect()
    assert tuple(q[0]) == (0, 0, 0, 1) and tuple(q[1]) == (1, 0, 0, 0) and tuple(q[2]) == (0, 0, 0, 1)
    assert np.allclose(tuple(q[3]), (0, math.sqrt(0.5), 0, math.sqrt(0.5)))


def test_centre_crop_of_a_wide_image(spark):
    crop = spark.range(1).select(C.centre_crop(F.lit(1920), F.lit(1080), 504, 336).alias("c")).first().c
    assert (crop.x, crop.y, crop.width, crop.height) == (150, 0, 1620, 1080)


def test_bounded_voxel_and_degenerate_scene(spark):
    points = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], "x double, y double, z double")
    from scenefold.settings import TsdfSettings

    assert surface.tsdf_voxel(points, TsdfSettings()) == pytest.approx(0.004)
    assert surface.tsdf_voxel(points.limit(1), TsdfSettings()) == 0.03


def test_rebase_at_unit_scale_returns_the_point(spark):
    row = (0, 0, 3, 2, 0.1, -0.2, 2.0, 0.0, 0.0, -1.0, 0.01, 1.0, EYE, K)
    frame = spark.createDataFrame([tuple([float(v) for v in x] if isinstance(x, list) else x for x in row)],
                                  "window_index int, frame_index int, px int, py int, x double, y double, z double, nx double, ny double, nz double, "
                                  "radius double, confidence double, w2c array<double>, k array<double>")
    extra = {n: F.lit(v) for n, v in (("f", 4.0), ("cx", 1.0), ("cy", 1.0), ("radial", 0.0), ("scale", 1.0))}
    moved = depth.rebase_points(frame.withColumns({**extra, "width": F.lit(8), "height": F.lit(8), "global_w2c": F.col("w2c")}), (8, 8)).first()
    assert (moved.x, moved.y, moved.z) == (1.0, 0.5, 2.0)
    assert moved.radius == pytest.approx(0.01)
