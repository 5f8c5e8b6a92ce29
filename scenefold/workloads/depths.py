"""Queries over cameras, depth rasters and sparse tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cameras as C
from ..functions import hashing
from ..functions import vectors as V
from ..operators import depth, matching
from ..operators.ordering import global_index
from ..operators.quantiles import median, percentiles
from ..settings import CalibrationSettings, FrameGlobalSettings
from . import bindings as B
from .registry import near, query, sql_near as R

# --- cameras -------------------------------------------------------------


@query("camera_centres", f"""
WITH {B.POINTS_SQL}, {B.VIEWS_SQL}
SELECT window_index, frame_index, {R('-(c * t)')} AS x, {R('0.0::DOUBLE')} AS y, {R('-(s * t)')} AS z, {R('-s')} AS fx, {R('c')} AS fz FROM views""")
def camera_centres(spark, folder):
    views = B.views(spark, folder)
    x, y, z = C.camera_centre("w2c")
    forward = C.camera_forward("w2c")
    return views.select("window_index", "frame_index", near(x).alias("x"), near(y).alias("y"), near(z).alias("z"),
                        near(forward[0]).alias("fx"), near(forward[2]).alias("fz"))


# Points seen by a radial camera: f = 40, centre (31.5, 23.5), k = 0.01, image 64x48, raster 32x24.
_PROJECTED = f"""
WITH {B.POINTS_SQL},
cam AS (
  SELECT l_orderkey, l_partkey, px, py, cos(frame_index * 0.05::DOUBLE) * x + sin(frame_index * 0.05::DOUBLE) * z + frame_index * 0.1::DOUBLE AS cx, y AS cy,
         -sin(frame_index * 0.05::DOUBLE) * x + cos(frame_index * 0.05::DOUBLE) * z AS cz FROM pts),
img AS (SELECT *, cx / cz AS ix, cy / cz AS iy, 1 + 0.01::DOUBLE * ((cx / cz) * (cx / cz) + (cy / cz) * (cy / cz)) AS k FROM cam WHERE cz > 0),
ras AS (SELECT *, (40 * ix * k + 31.5::DOUBLE + 0.5) * 32 / 64 - 0.5 AS u, (40 * iy * k + 23.5::DOUBLE + 0.5) * 24 / 48 - 0.5 AS v FROM img)"""


def _lens():
    return tuple(F.lit(v) for v in (40.0, 31.5, 23.5, 0.01))


@query("project_to_raster", _PROJECTED + f"""
SELECT px, py, count(*) AS points, {R('sum(u)', 3)} AS u, {R('sum(v)', 3)} AS v, {R('min(cz)')} AS nearest FROM ras WHERE u >= 0 AND v >= 0 AND u < 31 AND v < 23 GROUP BY px, py""")
def project_to_raster(spark, folder):
    points = B.points(spark, folder).withColumn("w2c", B.turning_camera(F.col("frame_index")))
    seen = V.columns(points, C.world_to_camera("w2c", V.vec("x", "y", "z")), ("_x", "_y", "_z"))
    placed = C.project(seen, V.vec("_x", "_y", "_z"), _lens(), (F.lit(64), F.lit(48)), (F.lit(32), F.lit(24)), ("u", "v", "depth"))
    return placed.groupBy("px", "py").agg(F.count(F.lit(1)).alias("points"), near(F.sum("u"), 3).alias("u"), near(F.sum("v"), 3).alias("v"), near(F.min("depth")).alias("nearest"))


def _fixed_point(rounds: int) -> str:
    """Undistortion steps as a chain of SQL tables."""
    text = "s0 AS (SELECT *, (u - 31.5::DOUBLE) / 40 AS xd, (v - 23.5::DOUBLE) / 40 AS yd, (u - 31.5::DOUBLE) / 40 AS x, (v - 23.5::DOUBLE) / 40 AS y FROM src)"
    for i in range(rounds):
        text += f", s{i + 1} AS (SELECT * EXCLUDE (x, y), xd / (1 + 0.01::DOUBLE * (x * x + y * y)) AS x, yd / (1 + 0.01::DOUBLE * (x * x + y * y)) AS y FROM s{i})"
    return text


@query("undistorted_rays", f"""
WITH src AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_quantity + 0.5::DOUBLE AS u, l_extendedprice / 2500 AS v FROM lineitem), {_fixed_point(8)}
SELECT l_partkey, count(*) AS rays, {R('sum(x)')} AS x, {R('sum(y)')} AS y FROM s8 GROUP BY l_partkey""")
def undistorted_rays(spark, folder):
    items = B.table(spark, folder, "lineitem")
    rays = C.undistort(items, F.col("l_quantity") + 0.5, F.col("l_extendedprice") / 2500, _lens(), ("x", "y"))
    return rays.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("rays"), near(F.sum("x")).alias("x"), near(F.sum("y")).alias("y"))


@query("image_to_raster", """
WITH p AS (SELECT l_suppkey, round((l_extendedprice / 65 + 0.5) * 504 / 1620 - 0.5) AS x, round((l_quantity * 22 + 0.5) * 336 / 1080 - 0.5) AS y FROM lineitem)
SELECT l_suppkey, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py, count(*) AS n FROM p WHERE x >= 0 AND y >= 0 AND x < 504 AND y < 336 GROUP BY ALL""")
def image_to_raster(spark, folder):
    px, py = C.image_to_raster_pixel(F.col("l_extendedprice") / 65, F.col("l_quantity") * 22, (F.lit(1620), F.lit(1080)), (F.lit(504), F.lit(336)))
    placed = B.table(spark, folder, "lineitem").select("l_suppkey", px.alias("px"), py.alias("py")).filter("px is not null")
    return placed.groupBy("l_suppkey", "px", "py").agg(F.count(F.lit(1)).alias("n"))


@query("rebased_points", f"""
WITH {B.PIXELS_SQL}, src AS (SELECT *, (px + 0.5::DOUBLE) * 64 / 8 - 0.5 AS u, (py + 0.5::DOUBLE) * 512 / 64 - 0.5 AS v, 1 + window_index * 0.05::DOUBLE AS scale FROM pixels), {_fixed_point(8)},
m AS (SELECT *, cos(frame_index * 0.05::DOUBLE) AS c, sin(frame_index * 0.05::DOUBLE) AS s, depth * scale AS d FROM s8),
w AS (SELECT *, x * d - frame_index * 0.1::DOUBLE AS dx, y * d AS dy, d AS dz FROM m)
SELECT window_index, frame_index, px, py, {R('c * dx - s * dz')} AS x, {R('dy')} AS y, {R('s * dx + c * dz')} AS z, {R('depth / 500 * 500 / depth * d / 40')} AS radius, {R('-s')} AS nx, {R('c')} AS nz FROM w""")
def rebased_points(spark, folder):
    """Measured camera-space points (identity view) moved to the turning global camera."""
    identity = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)])
    k = F.array(*[F.lit(v) for v in (500.0, 0.0, 3.5, 0.0, 500.0, 50.0, 0.0, 0.0, 1.0)])
    pixels = B.pixels(spark, folder).select(
        "window_index", "frame_index", "px", "py", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("depth").alias("z"), F.lit(0.0).alias("nx"),
        F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), (F.col("depth") / 500).alias("radius"), "confidence", identity.alias("w2c"), k.alias("k"),
        B.turning_camera(F.col("frame_index")).alias("global_w2c"), F.lit(40.0).alias("f"), F.lit(31.5).alias("cx"), F.lit(23.5).alias("cy"),
        F.lit(0.01).alias("radial"), F.lit(64).alias("width"), F.lit(512).alias("height"), (1 + F.col("window_index") * 0.05).alias("scale"))
    moved = depth.rebase_points(pixels, (8, 64))
    return moved.select("window_index", "frame_index", "px", "py", *[near(c).alias(c) for c in ("x", "y", "z", "radius", "nx", "nz")])


# --- scale evidence ------------------------------------------------------

_SCALES = f"""
WITH {B.EVIDENCE_SQL},
cnt AS (SELECT frame_index, window_index, count(*) FILTER (point_id % 5 <> 0) AS scale_samples, count(*) FILTER (point_id % 5 = 0) AS held_out_samples,
          median(log_ratio) FILTER (point_id % 5 <> 0) AS raw FROM evidence GROUP BY ALL),
s AS (SELECT * EXCLUDE (raw), CASE WHEN scale_samples >= 12 AND held_out_samples > 0 THEN raw END AS log_scale FROM cnt),
h AS (SELECT frame_index, window_index, median(abs(log_ratio - log_scale)) AS err FROM evidence JOIN s USING (frame_index, window_index) WHERE point_id % 5 = 0 AND log_scale IS NOT NULL GROUP BY ALL),
rep AS (SELECT s.*, h.err FROM s LEFT JOIN h USING (frame_index, window_index))
"""
# The synthetic ratios spread far wider than real depth, so the gate is wider too.
_WIDE = FrameGlobalSettings(maximum_held_out_error=0.5)


def _reports(spark, folder):
    return depth.frame_scale_reports(B.evidence(spark, folder), ["frame_index", "window_index"], _WIDE)


@query("frame_scale_holdout", _SCALES + f"""
SELECT frame_index, window_index, scale_samples, held_out_samples, {R('log_scale')} AS log_scale, {R('err')} AS held_out_error FROM rep""")
def frame_scale_holdout(spark, folder):
    return _reports(spark, folder).select("frame_index", "window_index", "scale_samples", "held_out_samples", near("log_scale").alias("log_scale"),
                                          near("held_out_median_log_error").alias("held_out_error"))


_CANON = _SCALES + """,
canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY coalesce(err <= 0.5::DOUBLE, false) DESC, coalesce(round(err, 9), 'inf'::DOUBLE), scale_samples DESC, window_index) AS rn FROM rep) WHERE rn = 1)
"""


def _canonical(spark, folder):
    # Equal medians may differ in the last bit between engines; ranking ignores that bit.
    reports = _reports(spark, folder)
    rounded = reports.withColumn("held_out_median_log_error", F.round("held_out_median_log_error", 9))
    return depth.canonical_views(rounded, [], _WIDE)


@query("canonical_view_rank", _CANON + f"""
SELECT frame_index, window_index, scale_samples, {R('err')} AS held_out_error FROM canon""")
def canonical_view_rank(spark, folder):
    return _canonical(spark, folder).select("frame_index", "window_index", "scale_samples", near("held_out_median_log_error").alias("held_out_error"))


@query("canonical_predictions", """
WITH r AS (SELECT o_custkey AS frame_index, o_totalprice AS train, o_orderkey AS batch_index FROM orders)
SELECT frame_index, batch_index FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY floor(train / 100000), batch_index) AS rn FROM r) WHERE rn = 1""")
def canonical_predictions(spark, folder):
    rows = B.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("frame_index"), F.floor(F.col("o_totalprice") / 100000).alias("train_median_log_error"), F.lit(1).alias("scale_samples"),
        F.col("o_orderkey").alias("batch_index"), F.lit(0).alias("source_slot")).withColumn("train_median_log_error", F.col("train_median_log_error").cast("double"))
    return depth.canonical_predictions(rows, []).select("frame_index", "batch_index")


@query("temporal_smoothing", _CANON + f""",
ord AS (SELECT *, row_number() OVER (ORDER BY frame_index) AS pos, coalesce(err <= 0.5::DOUBLE, false) AS ok FROM canon),
grp AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS run FROM ord),
sm AS (
  SELECT a.frame_index, a.window_index, CASE WHEN count(*) > 1 THEN median(b.log_scale) END AS smoothed FROM grp a JOIN grp b
    ON b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND abs(b.frame_index - a.frame_index) <= 2 AND b.ok AND a.ok AND a.run = b.run GROUP BY ALL),
er AS (SELECT sm.frame_index, median(abs(log_ratio - smoothed)) AS e2 FROM sm JOIN evidence USING (frame_index, window_index) WHERE point_id % 5 = 0 GROUP BY ALL)
SELECT grp.frame_index, {R('CASE WHEN e2 <= 0.5::DOUBLE THEN smoothed ELSE log_scale END')} AS log_scale, {R('CASE WHEN e2 <= 0.5::DOUBLE THEN e2 ELSE err END')} AS held_out_error
FROM grp LEFT JOIN sm USING (frame_index) LEFT JOIN er USING (frame_index)""")
def temporal_smoothing(spark, folder):
    # Reports are one row per frame of a capture; their position is their frame order.
    ordered = global_index(_canonical(spark, folder), ["frame_index"])
    owners = ordered.select("frame_index", "window_index")
    held = B.evidence(spark, folder).filter(hashing.modulo_hold_out(F.col("point_id"))).join(owners, ["frame_index", "window_index"], "left_semi")
    smoothed = depth.smooth_scales(ordered, held, [], "ordinal", _WIDE)
    return smoothed.select("frame_index", near("log_scale").alias("log_scale"), near("held_out_median_log_error").alias("held_out_error"))


@query("frame_coverage", _CANON + """
SELECT CAST(count(*) FILTER (coalesce(err <= 0.5::DOUBLE, false)) AS BIGINT) AS fused_frames, count(*) AS total_frames,
       count(*) > 0 AND count(*) FILTER (coalesce(err <= 0.5::DOUBLE, false)) >= 0.85 * count(*) AS passed FROM canon""")
def frame_coverage(spark, folder):
    return depth.frame_coverage(_canonical(spark, folder), [], _WIDE)


@query("keyed_hold_out", """
WITH p AS (SELECT l_suppkey, l_partkey, sha256('train:' || l_suppkey || ':' || l_partkey) AS h FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))
SELECT l_suppkey, count(*) AS points, CAST(count(*) FILTER (('0x' || substr(h, 1, 16))::UBIGINT % 5 = 0) AS BIGINT) AS held_out FROM p GROUP BY l_suppkey""")
def keyed_hold_out(spark, folder):
    pairs = B.table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    held = hashing.keyed_hold_out("train", F.col("l_suppkey"), F.col("l_partkey"))
    return pairs.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("points"), F.sum(held.cast("long")).alias("held_out"))


@query("batch_calibration", f"""
WITH {B.EVIDENCE_SQL},
m AS (SELECT *, ('0x' || substr(sha256('fold:' || frame_index || ':' || point_id), 1, 16))::UBIGINT % 5 = 0 AS held FROM evidence),
c AS (SELECT frame_index, window_index, count(*) FILTER (NOT held) AS train, count(*) FILTER (held) AS held_out, median(log_ratio) FILTER (NOT held) AS raw FROM m GROUP BY ALL),
s AS (SELECT * EXCLUDE (raw), CASE WHEN train >= 1 AND held_out > 0 THEN raw END AS log_scale FROM c),
e AS (SELECT frame_index, window_index, median(abs(log_ratio - log_scale)) FILTER (NOT held) AS train_error, median(abs(log_ratio - log_scale)) FILTER (held) AS held_error FROM m JOIN s USING (frame_index, window_index) GROUP BY ALL)
SELECT frame_index, window_index, train, held_out, {R('log_scale')} AS log_scale, {R('train_error')} AS train_error, {R('held_error')} AS held_error,
       coalesce(train >= 12 AND held_out >= 6 AND held_error IS NOT NULL, false) AS accepted FROM s LEFT JOIN e USING (frame_index, window_index)""")
def batch_calibration(spark, folder):
    out = depth.calibrate_batches(B.evidence(spark, folder), ["frame_index", "window_index"], "fold", F.col("frame_index"), CalibrationSettings())
    return out.select("frame_index", "window_index", F.col("scale_samples").alias("train"), F.col("held_out_samples").alias("held_out"), near("log_scale").alias("log_scale"),
                      near("train_median_log_error").alias("train_error"), near("held_out_median_log_error").alias("held_error"), "accepted")


@query("track_scale_evidence", f"""
WITH {B.PIXELS_SQL}, {B.RASTER_SQL},
trk AS (SELECT p_partkey AS point_id, p_size AS gx, p_retailprice / 500 AS gz, p_size * 0.1::DOUBLE AS err FROM part),
obs AS (SELECT DISTINCT l_partkey AS point_id, CAST(l_orderkey % 120 AS INTEGER) AS frame_index, (l_linenumber + 0.5::DOUBLE) * 4 - 0.5 AS u, (CAST(l_suppkey AS INTEGER) + 0.5::DOUBLE) * 4 - 0.5 AS v FROM lineitem),
pl AS (SELECT obs.*, CAST(round((u + 0.5) * 8 / 32 - 0.5) AS INTEGER) AS px, CAST(round((v + 0.5) * h / (4 * h) - 0.5) AS INTEGER) AS py, h,
        -sin(frame_index * 0.05::DOUBLE) * gx + cos(frame_index * 0.05::DOUBLE) * gz AS sparse FROM raster, obs JOIN trk USING (point_id) WHERE err <= 2.5)
SELECT window_index, frame_index, count(*) AS pairs, {R('sum(ln(sparse / depth))', 4)} AS log_ratio FROM pl JOIN pixels USING (frame_index, px, py)
WHERE sparse > 0 AND px >= 0 AND px < 8 AND py >= 0 AND py < h GROUP BY ALL""")
def track_scale_evidence(spark, folder):
    identity = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)])
    items, raster = B.table(spark, folder, "lineitem"), B.raster(spark, folder)
    centre = lambda c: (F.col(c).cast("int") + 0.5) * 4 - 0.5
    observations = items.select(F.col("l_partkey").alias("point_id"), (F.col("l_orderkey") % 120).cast("int").alias("frame_index"),
                                centre("l_linenumber").alias("u"), centre("l_suppkey").alias("v")).distinct()
    tracks = B.table(spark, folder, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"),
                                                   (F.col("p_retailprice") / 500).alias("z"), (F.col("p_size") * 0.1).alias("reprojection_error_px"))
    frames = B.views(spark, folder).select("frame_index", "w2c").distinct()
    poses = items.select((F.col("l_orderkey") % 120).cast("int").alias("frame_index")).distinct().select(
        "frame_index", B.turning_camera(F.col("frame_index")).alias("w2c"), F.lit(1).alias("camera_id"), F.lit(True).alias("registered"))
    models = frames.select(F.lit(1).alias("camera_id"), F.lit(32).alias("width"), F.lit(4 * raster[1]).alias("height")).distinct()
    pixels = B.pixels(spark, folder)
    points = pixels.select("window_index", "frame_index", "px", "py", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("depth").alias("z"))
    views = pixels.select("window_index", "frame_index").distinct().withColumn("w2c", identity)
    found = matching.track_scale_evidence(observations, tracks, poses, models, points, views, raster)
    return found.groupBy("window_index", "frame_index").agg(F.count(F.lit(1)).alias("pairs"), near(F.sum("log_ratio"), 4).alias("log_ratio"))


# --- visibility ----------------------------------------------------------

@query("zbuffer", """
SELECT l_linenumber AS px, CAST(l_suppkey AS INTEGER) AS py, min(l_extendedprice) AS depth, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS pid FROM lineitem GROUP BY ALL""")
def zbuffer(spark, folder):
    samples = B.table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("px"), F.col("l_suppkey").cast("int").alias("py"), F.col("l_extendedprice").alias("depth"), F.col("l_orderkey").alias("pid"))
    return depth.nearest_per_pixel(samples, [])


@query("projected_zbuffer", f"""
WITH {B.POINTS_SQL},
c AS (SELECT l_orderkey, cos(frame_index * 0.05::DOUBLE) * x + sin(frame_index * 0.05::DOUBLE) * z + frame_index * 0.1::DOUBLE AS cx, y AS cy,
        -sin(frame_index * 0.05::DOUBLE) * x + cos(frame_index * 0.05::DOUBLE) * z AS cz, frame_index FROM pts),
p AS (SELECT *, CAST(round_even(10 * cx / cz + 20, 0) AS INTEGER) AS px, CAST(round_even(10 * cy / cz + 15, 0) AS INTEGER) AS py FROM c WHERE cz > 0 AND abs(10 * cx / cz) < 1e6 AND abs(10 * cy / cz) < 1e6)
SELECT frame_index, px, py, {R('min(cz)')} AS depth FROM p WHERE px BETWEEN 0 AND 39 AND py BETWEEN 0 AND 29 GROUP BY ALL""")
def projected_zbuffer(spark, folder):
    points = B.points(spark, folder).withColumnRenamed("l_orderkey", "pid").withColumnRenamed("frame_index", "f")
    cameras = points.select("f").distinct().select(
        "f", F.col("f").alias("frame_index"), F.lit(10.0).alias("fx"), F.lit(10.0).alias("fy"), F.lit(20.0).alias("cx"), F.lit(15.0).alias("cy"),
        B.turning_camera(F.col("f")).alias("w2c"))
    seen = depth.z_buffer(points.select("f", "pid", "x", "y", "z"), cameras, ["f"], 40, 30)
    return seen.select("frame_index", "px", "py", near("depth").alias("depth"))


@query("stereo_zbuffer", f"""
WITH {B.CLOUD_SQL}, cams AS (SELECT DISTINCT label AS frame_index FROM cloud),
p AS (SELECT frame_index, vec_id AS pid, z + 40.0::DOUBLE + frame_index AS depth, CAST(round_even(500 * x / (z + 40.0::DOUBLE + frame_index) + 20, 0) AS INTEGER) AS px,
        CAST(round_even(500 * y / (z + 40.0::DOUBLE + frame_index) + 15, 0) AS INTEGER) AS py FROM cloud, cams WHERE z + 40.0::DOUBLE + frame_index > 0)
SELECT frame_index, px, py, {R('min(depth)')} AS depth, arg_min(pid, (depth, pid)) AS pid FROM p WHERE px BETWEEN 0 AND 39 AND py BETWEEN 0 AND 29 GROUP BY ALL""")
def stereo_zbuffer(spark, folder):
    cloud = B.cloud(spark, folder)
    pose = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)], F.lit(40.0) + F.col("frame_index"))
    cameras = cloud.select(F.col("label").alias("frame_index")).distinct().select(
        "frame_index", *[F.lit(v).alias(n) for n, v in (("fx", 500.0), ("fy", 500.0), ("cx", 20.0), ("cy", 15.0))], pose.alias("w2c"))
    return depth.z_buffer_all(cloud.withColumnRenamed("vec_id", "pid"), cameras, 40, 30).withColumn("depth", near("depth"))


@query("tile_local_ratio", f"""
WITH {B.PIXELS_SQL},
t AS (SELECT *, px // 3 AS tx, py // 25 AS ty, reference / depth AS ratio FROM pixels),
m AS (SELECT window_index, tx, ty, median(ratio) AS ratio, count(*) AS n FROM t WHERE ratio BETWEEN 0.5 AND 2 GROUP BY ALL HAVING count(*) >= 16)
SELECT t.window_index, t.tx::BIGINT AS tx, t.ty::BIGINT AS ty, count(*) AS pixels, {R('max(coalesce(m.ratio, 1))')} AS ratio FROM t LEFT JOIN m ON t.window_index = m.window_index AND t.tx = m.tx AND t.ty = m.ty GROUP BY ALL""")
def tile_local_ratio(spark, folder):
    tiled = depth.tile_ratio(B.pixels(spark, folder), ["window_index"], 9, 75, 3, 16)
    return tiled.groupBy("window_index", "tx", "ty").agg(F.count(F.lit(1)).alias("pixels"), near(F.max("ratio")).alias("ratio"))


@query("reference_fill", f"""
WITH {B.PIXELS_SQL}, fl AS (SELECT frame_index, quantile_cont(confidence, 0.75) AS fl FROM pixels GROUP BY frame_index)
SELECT frame_index, count(*) AS pixels, {R('sum(reference)', 4)} AS depth, {R('sum(greatest(confidence, fl))', 4)} AS confidence FROM pixels JOIN fl USING (frame_index) GROUP BY frame_index""")
def reference_fill(spark, folder):
    filled = depth.fill_from_reference(B.pixels(spark, folder), ["frame_index"])
    return filled.groupBy("frame_index").agg(F.count(F.lit(1)).alias("pixels"), near(F.sum("depth"), 4).alias("depth"), near(F.sum("confidence"), 4).alias("confidence"))


@query("nearest_resample", """
WITH src AS (SELECT l_partkey, l_linenumber - 1 AS px, min(l_quantity) AS depth FROM lineitem GROUP BY ALL),
grid AS (SELECT unnest(range(0, 12)) AS tx),
map AS (SELECT tx, CAST(least(greatest(round_even((tx + 0.5) * 7 / 12 - 0.5, 0), 0), 6) AS INTEGER) AS px FROM grid)
SELECT l_partkey, CAST(tx AS INTEGER) AS px, depth FROM src JOIN map USING (px)""")
def nearest_resample(spark, folder):
    source = B.table(spark, folder, "lineitem").groupBy("l_partkey", (F.col("l_linenumber") - 1).alias("px")).agg(F.min("l_quantity").alias("depth"))
    resized = depth.resample_nearest(source.withColumn("py", F.lit(0)), ["l_partkey"], (7, 1), (12, 1))
    return resized.select("l_partkey", "px", "depth")


@query("raster_bilinear", f"""
WITH {B.PIXELS_SQL}, px1 AS (SELECT frame_index, px, py, min(depth) AS depth FROM pixels GROUP BY ALL),
q AS (SELECT DISTINCT frame_index, px + 0.25::DOUBLE AS u, py + 0.5::DOUBLE AS v, px AS x0, py AS y0 FROM px1)
SELECT q.frame_index, x0 AS px, y0 AS py, {R('(a.depth * 0.75 + b.depth * 0.25) * 0.5 + (c.depth * 0.75 + d.depth * 0.25) * 0.5')} AS sample
FROM q JOIN px1 a ON a.frame_index = q.frame_index AND a.px = x0 AND a.py = y0 JOIN px1 b ON b.frame_index = q.frame_index AND b.px = x0 + 1 AND b.py = y0
JOIN px1 c ON c.frame_index = q.frame_index AND c.px = x0 AND c.py = y0 + 1 JOIN px1 d ON d.frame_index = q.frame_index AND d.px = x0 + 1 AND d.py = y0 + 1""")
def raster_bilinear(spark, folder):
    pixels = B.pixels(spark, folder).groupBy("frame_index", "px", "py").agg(F.min("depth").alias("depth"))
    queries = pixels.select("frame_index", F.col("px").alias("qx"), F.col("py").alias("qy"), (F.col("px") + 0.25).alias("u"), (F.col("py") + 0.5).alias("v"))
    sampled = matching.bilinear(queries, pixels, ["frame_index"], ["frame_index", "qx", "qy"], "depth")
    return sampled.select("frame_index", F.col("qx").alias("px"), F.col("qy").alias("py"), near("sample").alias("sample"))


@query("neighbour_agreement", f"""
WITH {B.PIXELS_SQL}, {B.RASTER_SQL}, px1 AS (SELECT frame_index, px, py, avg(depth) AS depth FROM pixels GROUP BY ALL),
n AS (SELECT row_number() OVER () AS pid, frame_index, x, y, z FROM pts),
o AS (SELECT n.*, frame_index + d AS other FROM n, (VALUES (-2), (-1), (1), (2)) t(d)),
cam AS (SELECT o.pid, o.frame_index, other, cos(other * 0.05::DOUBLE) * x + sin(other * 0.05::DOUBLE) * z + other * 0.1::DOUBLE AS cx, y AS cy, -sin(other * 0.05::DOUBLE) * x + cos(other * 0.05::DOUBLE) * z AS cz
  FROM o JOIN (SELECT DISTINCT frame_index AS other FROM pts) f USING (other)),
uv AS (SELECT *, (4 * (cx / cz) + 3.5::DOUBLE + 0.5) * 8 / 8 - 0.5 AS u, (4 * (cy / cz) + (h - 1) / 2.0::DOUBLE + 0.5) * h / h - 0.5 AS v FROM cam, raster WHERE cz > 0),
ins AS (SELECT *, CAST(floor(u) AS INTEGER) AS x0, CAST(floor(v) AS INTEGER) AS y0 FROM uv WHERE u >= 0 AND v >= 0 AND u < 7 AND v < h - 1),
smp AS (SELECT i.pid, i.frame_index, i.cz, (a.depth * (1 - (u - x0)) + b.depth * (u - x0)) * (1 - (v - y0)) + (c.depth * (1 - (u - x0)) + d.depth * (u - x0)) * (v - y0) AS s
  FROM ins i JOIN px1 a ON a.frame_index = other AND a.px = x0 AND a.py = y0 JOIN px1 b ON b.frame_index = other AND b.px = x0 + 1 AND b.py = y0
  JOIN px1 c ON c.frame_index = other AND c.px = x0 AND c.py = y0 + 1 JOIN px1 d ON d.frame_index = other AND d.px = x0 + 1 AND d.py = y0 + 1)
SELECT frame_index, count(DISTINCT pid) AS points FROM smp WHERE abs(ln(cz) - ln(s)) <= 0.5::DOUBLE GROUP BY frame_index""")
def neighbour_agreement(spark, folder):
    points, raster = B.points(spark, folder).withColumn("pid", F.monotonically_increasing_id()), B.raster(spark, folder)
    cameras = points.select("frame_index").distinct().select(
        "frame_index", B.turning_camera(F.col("frame_index")).alias("w2c"), *[F.lit(v).alias(n) for n, v in (("f", 4.0), ("cx", 3.5), ("cy", (raster[1] - 1) / 2), ("k", 0.0))],
        F.lit(raster[0]).alias("width"), F.lit(raster[1]).alias("height"))
    pixels = B.pixels(spark, folder).groupBy("frame_index", "px", "py").agg(F.avg("depth").alias("depth"))
    kept = matching.agreeing_neighbours(points, cameras, pixels, raster, maximum_log_error=0.5)
    return kept.groupBy("frame_index").agg(F.count(F.lit(1)).alias("points"))


# --- summaries -----------------------------------------------------------

@query("depth_summary", f"""
SELECT l_suppkey, count(*) FILTER (l_extendedprice - 30000 > 0) AS valid_pixels, count(*) AS pixels, {R('median(l_extendedprice - 30000) FILTER (l_extendedprice - 30000 > 0)', 4)} AS depth_median,
       {R('quantile_cont(l_extendedprice - 30000, 0.95) FILTER (l_extendedprice - 30000 > 0)', 4)} AS depth_p95, {R('count(*) FILTER (l_extendedprice - 30000 > 0) / count(*)')} AS coverage
FROM lineitem GROUP BY l_suppkey""")
def depth_summary(spark, folder):
    items = B.table(spark, folder, "lineitem").select("l_suppkey", (F.col("l_extendedprice") - 30000).alias("depth"))
    out = depth.depth_summary(items, ["l_suppkey"])
    return out.withColumns({"depth_median": near("depth_median", 4), "depth_p95": near("depth_p95", 4), "coverage": near("coverage")})


@query("track_depth_report", f"""
WITH s AS (SELECT l_suppkey, l_extendedprice AS expected, CASE WHEN l_discount > 0.02 THEN 2000 * l_quantity END AS measured FROM lineitem),
e AS (SELECT *, abs(ln(measured / expected)) AS e FROM s)
SELECT l_suppkey, count(*) AS observations, count(e) AS covered_observations, {R('median(e)')} AS median_error, {R('quantile_cont(e, 0.95)')} AS p95_error, {R('count(e) / count(*)')} AS coverage FROM e GROUP BY l_suppkey""")
def track_depth_report(spark, folder):
    measured = F.when(F.col("l_discount") > 0.02, 2000 * F.col("l_quantity"))
    samples = B.table(spark, folder, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("expected"), measured.alias("measured"))
    out = depth.track_depth_report(samples, ["l_suppkey"])
    return out.select("l_suppkey", "observations", "covered_observations", near("median_abs_log_depth_error").alias("median_error"),
                      near("p95_abs_log_depth_error").alias("p95_error"), near("coverage").alias("coverage"))


@query("global_ratio_report", f"""
WITH r AS (SELECT CAST(l_orderkey % 120 AS INTEGER) AS frame_index, l_extendedprice / (2000 * l_quantity) AS ratio FROM lineitem), g AS (SELECT median(ratio) AS g FROM r),
e AS (SELECT frame_index, ratio, abs(ln(ratio / g)) AS e FROM r, g)
SELECT frame_index, count(*) AS track_samples, {R('median(ratio)')} AS median_ratio, {R('median(e)')} AS median_error, {R('quantile_cont(e, 0.95)')} AS p95_error FROM e GROUP BY frame_index""")
def global_ratio_report(spark, folder):
    ratios = B.table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 120).cast("int").alias("frame_index"), (F.col("l_extendedprice") / (2000 * F.col("l_quantity"))).alias("ratio"))
    return depth.global_ratio_report(ratios).select("frame_index", "track_samples", near("median_ratio").alias("median_ratio"),
                                                    near("median_abs_log_error").alias("median_error"), near("p95_abs_log_error").alias("p95_error"))


@query("local_minimum_depth", f"""
WITH {B.PIXELS_SQL}, px1 AS (SELECT frame_index, px, py, min(depth) AS depth FROM pixels GROUP BY ALL)
SELECT a.frame_index, a.px AS u, a.py AS v, min(b.depth) AS measured FROM px1 a JOIN px1 b ON a.frame_index = b.frame_index AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 GROUP BY ALL""")
def local_minimum_depth(spark, folder):
    raster = B.pixels(spark, folder).groupBy("frame_index", "px", "py").agg(F.min("depth").alias("depth"))
    samples = raster.select("frame_index", F.col("px").alias("u"), F.col("py").alias("v"))
    return depth.local_minimum_depth(samples, raster, ["frame_index"])


@query("overlap_differences", f"""
WITH px1 AS (SELECT CAST(l_orderkey % 120 AS INTEGER) AS frame_index, l_linenumber AS px, l_suppkey AS py, l_partkey % 16 AS batch, max(l_quantity) AS depth FROM lineitem GROUP BY ALL),
base AS (SELECT frame_index, min(batch) AS b0 FROM px1 GROUP BY frame_index)
SELECT p.frame_index, p.batch, count(*) AS pixels, {R('median(abs(q.depth - p.depth) / greatest(q.depth, p.depth))')} AS median_difference
FROM px1 p JOIN base USING (frame_index) JOIN px1 q ON q.frame_index = p.frame_index AND q.px = p.px AND q.py = p.py AND q.batch = b0 WHERE p.batch > b0 GROUP BY ALL""")
def overlap_differences(spark, folder):
    pixels = B.table(spark, folder, "lineitem").groupBy(
        (F.col("l_orderkey") % 120).cast("int").alias("frame_index"), F.col("l_linenumber").alias("px"), F.col("l_suppkey").alias("py"),
        (F.col("l_partkey") % 16).alias("batch")).agg(F.max("l_quantity").alias("depth"))
    found = matching.overlap_differences(pixels, first_two=False)
    keys = ["frame_index", "batch"]
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"))
    return counts.join(median(found, keys, "difference", "median_difference"), keys).withColumn("median_difference", near("median_difference"))


@query("coloured_depth", f"""
WITH i AS (SELECT l_suppkey, 1 / l_quantity AS inv FROM lineitem), e AS (SELECT l_suppkey, quantile_cont(inv, 0.02) AS lo, quantile_cont(inv, 0.98) AS hi FROM i GROUP BY l_suppkey),
t AS (SELECT l_suppkey, least(greatest((inv - lo) / greatest(hi - lo, 1e-8), 0), 1) * 4 AS p FROM i JOIN e USING (l_suppkey)),
l AS (SELECT l_suppkey, p, least(floor(p), 3)::INTEGER AS b FROM t)
SELECT l_suppkey, {R('sum(([0.10,0.00,0.05,0.98,0.86]::DOUBLE[])[b + 1] * (1 - (p - b)) + ([0.10,0.00,0.05,0.98,0.86]::DOUBLE[])[b + 2] * (p - b))', 2)} AS red FROM l GROUP BY l_suppkey""")
def coloured_depth(spark, folder):
    pixels = B.table(spark, folder, "lineitem").select("l_suppkey", F.col("l_quantity").alias("depth"))
    inverse = pixels.withColumn("inv", 1 / F.col("depth"))
    ends = percentiles(inverse, ["l_suppkey"], "inv", {"lo": 0.02, "hi": 0.98})
    share = (F.col("inv") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8))
    return inverse.join(ends, "l_suppkey").groupBy("l_suppkey").agg(near(F.sum(C.depth_blend(share)[0]), 2).alias("red"))


@query("depth_preview_pixels")
def depth_preview_pixels(spark, folder):
    return depth.coloured_depth(B.pixels(spark, folder), ["frame_index"]).select("frame_index", "px", "py", "r", "g", "b")


@query("linear_light", f"""
WITH c AS (SELECT l_suppkey, (l_partkey % 256) / 255.0::DOUBLE AS v FROM lineitem),
lin AS (SELECT l_suppkey, avg(CASE WHEN v <= 0.04045::DOUBLE THEN v / 12.92::DOUBLE ELSE pow((v + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS m FROM c GROUP BY l_suppkey)
SELECT l_suppkey, {R('m')} AS linear, CAST(round(255 * CASE WHEN m <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * m ELSE 1.055::DOUBLE * pow(m, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) AS SMALLINT) AS srgb FROM lin""")
def linear_light(spark, folder):
    mean = B.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.avg(C.srgb_to_linear(F.col("l_partkey") % 256)).alias("m"))
    return mean.select("l_suppkey", near("m").alias("linear"), C.linear_to_srgb(F.col("m")).alias("srgb"))


@query("normal_quaternions", f"""
WITH {B.CLOUD_SQL}, u AS (SELECT vec_id, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM cloud)
SELECT vec_id, {R('-y / sqrt(2 * (1 + z))')} AS qx, {R('x / sqrt(2 * (1 + z))')} AS qy, {R('(1 + z) / sqrt(2 * (1 + z))')} AS qw FROM u""")
def normal_quaternions(spark, folder):
    qx, qy, _, qw = C.quaternion_from_normal(V.vec("x", "y", "z"))
    return B.cloud(spark, folder).select("vec_id", near(qx).alias("qx"), near(qy).alias("qy"), near(qw).alias("qw"))


@query("centre_crops", """
WITH s AS (SELECT p_partkey, CAST(600 + p_size * 37 AS INTEGER) AS w, CAST(400 + p_partkey % 300 AS INTEGER) AS h FROM part),
c AS (SELECT *, CASE WHEN w * 336 > h * 504 THEN h * 504 // 336 ELSE w END AS cw, CASE WHEN w * 336 > h * 504 THEN h ELSE w * 336 // 504 END AS ch FROM s)
SELECT p_partkey, cw AS width, ch AS height, (w - cw) // 2 AS x, (h - ch) // 2 AS y FROM c""")
def centre_crops(spark, folder):
    part = B.table(spark, folder, "part").select(
        "p_partkey", (600 + F.col("p_size") * 37).cast("int").alias("w"), (400 + F.col("p_partkey") % 300).cast("int").alias("h"))
    return part.select("p_partkey", C.centre_crop(F.col("w"), F.col("h"), 504, 336).alias("c")).select("p_partkey", "c.width", "c.height", "c.x", "c.y")


_FRUSTUM_SRC = f"""
WITH {B.POINTS_SQL}, {B.VIEWS_SQL},
src AS (SELECT window_index, frame_index, c, s, i AS corner, 64.0::DOUBLE * cx AS u, 48.0::DOUBLE * cy AS v FROM views, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) k(i, cx, cy)), """


@query("frustum_corners", _FRUSTUM_SRC + _fixed_point(8) + f"""
SELECT window_index, frame_index, corner, {R('(c * x - s) / sqrt(x * x + y * y + 1)')} AS dx, {R('y / sqrt(x * x + y * y + 1)')} AS dy, {R('(s * x + c) / sqrt(x * x + y * y + 1)')} AS dz,
       {R('2 * atan(48 / 80.0::DOUBLE)')} AS vertical_fov FROM s8""")
def frustum_corners(spark, folder):
    corners = C.frustum(B.views(spark, folder), "w2c", _lens(), F.lit(64.0), F.lit(48.0))
    return corners.select("window_index", "frame_index", "corner", *[near(c).alias(c) for c in ("dx", "dy", "dz", "vertical_fov")])
