"""Queries over ordered frames, pose chains and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import graph, matching, ordering, reports
from ..session import settle
from ..settings import KeyframeSettings
from . import bindings as B
from .registry import near, query, sql_near as R

_WINDOWS = f"""
WITH {B.FRAMES_SQL},
n AS (SELECT capture, count(*) AS frames FROM frames GROUP BY capture),
w AS (SELECT capture, frames, unnest(range(0, frames, 9)) AS start FROM n),
kept AS (SELECT capture, start // 9 AS window_index, start, least(start + 12, frames) AS stop FROM w WHERE start = 0 OR start - 9 + 12 < frames)
"""


@query("window_schedule", _WINDOWS + "SELECT capture, window_index, start, stop FROM kept")
def window_schedule(spark, folder):
    return ordering.window_schedule(B.frames(spark, folder).select("capture", "frame_index"), ["capture"], "frame_index")


@query("window_members", _WINDOWS + "SELECT capture, window_index, unnest(range(start, stop)) AS frame_index FROM kept")
def window_members(spark, folder):
    members = ordering.window_members(B.frames(spark, folder).select("capture", "frame_index"), ["capture"], "frame_index")
    return members.select("capture", "window_index", "frame_index")


@query("batch_schedule", f"""
WITH {B.FRAMES_SQL},
n AS (SELECT capture, count(*) AS frames FROM frames GROUP BY capture),
w AS (SELECT capture, frames, unnest(range(0, frames, 12)) AS start FROM n),
k AS (SELECT capture, start // 12 AS window_index, start, least(start + 16, frames) AS stop FROM w WHERE start = 0 OR start - 12 + 16 < frames),
f AS (SELECT capture, window_index, CASE WHEN stop - start < 3 THEN greatest(stop - 16, 0) ELSE start END AS start, stop FROM k),
l AS (SELECT *, lag(start) OVER (PARTITION BY capture ORDER BY window_index) AS ps, lag(stop) OVER (PARTITION BY capture ORDER BY window_index) AS pe FROM f)
SELECT capture, window_index, start, stop FROM l WHERE ps IS NULL OR NOT (ps = start AND pe = stop)""")
def batch_schedule(spark, folder):
    return ordering.batch_schedule(B.frames(spark, folder).select("capture", "frame_index"), ["capture"], "frame_index")


# Keyframes: event values stand in for luma, their change for novelty.
_KEY = KeyframeSettings(minimum_novelty=0.1, minimum_sharpness=0.02)


def _novelty(a, b):
    return F.abs(a - b)


@query("keyframe_select", f"""
WITH RECURSIVE {B.FRAMES_SQL},
n AS (SELECT capture, count(*) AS frames FROM frames GROUP BY capture),
cand AS (
  SELECT a.capture, a.frame_index AS i, b.frame_index AS j, b.luma * abs(a.luma - b.luma) AS score
  FROM frames a JOIN n ON n.capture = a.capture JOIN frames b ON b.capture = a.capture AND b.frame_index BETWEEN a.frame_index + 4 AND a.frame_index + 5
  WHERE b.luma >= 0.02::DOUBLE AND abs(a.luma - b.luma) >= 0.1::DOUBLE),
best AS (SELECT capture, i, arg_max(j, (score, -j)) AS j FROM cand GROUP BY capture, i),
nxt AS (
  SELECT f.capture, f.frame_index AS i, CASE WHEN least(f.frame_index + 4, frames - 1) < frames - 1 THEN coalesce(best.j, least(f.frame_index + 5, frames - 1)) END AS j, frames
  FROM frames f JOIN n USING (capture) LEFT JOIN best ON best.capture = f.capture AND best.i = f.frame_index),
path(capture, i) AS (SELECT capture, 0::BIGINT FROM n UNION ALL SELECT p.capture, nxt.j FROM path p JOIN nxt ON nxt.capture = p.capture AND nxt.i = p.i WHERE nxt.j IS NOT NULL)
SELECT capture, i AS frame_index FROM path UNION SELECT capture, frames - 1 FROM n UNION SELECT capture, frame_index FROM frames JOIN n USING (capture) WHERE frames <= 2""")
def keyframe_select(spark, folder):
    frames = B.frames(spark, folder).select("capture", "frame_index", F.col("luma").alias("signature"), F.col("luma").alias("sharpness"))
    return ordering.keyframes(frames, ["capture"], 8.0, _novelty, _KEY, ordinal="frame_index")


@query("capture_quality", f"""
WITH {B.FRAMES_SQL}, d AS (SELECT capture, abs(luma - lag(luma) OVER (PARTITION BY capture ORDER BY frame_index)) AS d FROM frames),
m AS (SELECT capture, count(*) AS frame_count, CASE WHEN count(*) < 2 THEN 0 ELSE avg(d) END AS mean FROM d GROUP BY capture)
SELECT capture, frame_count, {R('mean')} AS mean_adjacent_luma_delta, CASE WHEN mean < 0.002 THEN 'recapture' WHEN mean < 0.01 THEN 'review' ELSE 'ready' END AS disposition FROM m""")
def capture_quality(spark, folder):
    out = reports.capture_quality(B.frames(spark, folder).select("capture", "frame_index", "luma"), ["capture"], "frame_index")
    return out.withColumn("mean_adjacent_luma_delta", near("mean_adjacent_luma_delta"))


@query("monotonic_violations", """
WITH o AS (SELECT conv_id, turn, length(text) AS v, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, CAST(v AS INTEGER) AS length FROM o WHERE v <= p""")
def monotonic_violations(spark, folder):
    turns = B.table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("length"))
    return ordering.monotonic_violations(turns, ["conv_id"], "turn", "length")


@query("uniform_rate", """
WITH f AS (SELECT conv_id, turn, CASE WHEN turn < 3 THEN turn * 125 ELSE turn * 125 + (conv_id % 3) * 7 * turn END AS ms FROM conversations),
g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM f),
s AS (SELECT conv_id, count(*) AS frames, min(gap) FILTER (turn = 1) AS step, coalesce(min(gap) > 0, true) AS increasing FROM g GROUP BY conv_id),
b AS (SELECT g.conv_id, min(turn) FILTER (gap <> step) AS broken FROM g JOIN s USING (conv_id) GROUP BY g.conv_id)
SELECT conv_id, frames, step, increasing, coalesce(broken, frames) AS uniform_frames, CASE WHEN step > 0 AND coalesce(broken, frames) >= frames - 1 THEN 1000.0::DOUBLE / step END AS frames_per_second
FROM s JOIN b USING (conv_id)""")
def uniform_rate(spark, folder):
    turn = F.col("turn")
    millis = F.when(turn < 3, turn * 125).otherwise(turn * 125 + (F.col("conv_id") % 3) * 7 * turn)
    frames = B.table(spark, folder, "conversations").select("conv_id", "turn", millis.alias("timestamp_millis"))
    return ordering.uniform_rate(frames, ["conv_id"], "turn")


@query("bridge_schedule", f"""
WITH {B.FRAMES_SQL},
g AS (SELECT capture, frame_index, timestamp_millis // 3600000 AS t, lead(timestamp_millis // 3600000) OVER (PARTITION BY capture ORDER BY frame_index) AS nxt FROM frames),
s AS (SELECT *, unnest(range(1, 1 + ((nxt - t) * 250 - 1) // 1000)) AS k FROM g WHERE nxt IS NOT NULL AND ((nxt - t) * 250 - 1) // 1000 >= 1)
SELECT capture, frame_index, t + k * 4 AS bridge_millis FROM s WHERE t + k * 4 < nxt""")
def bridge_schedule(spark, folder):
    frames = B.frames(spark, folder).select("capture", "frame_index", F.floor(F.col("timestamp_millis") / 3600000).alias("timestamp_millis"))
    return ordering.bridge_schedule(frames, ["capture"], "frame_index", 250).select("capture", "frame_index", "bridge_millis")


@query("bridge_names", """
SELECT o_orderkey, 'frame' || o_custkey || '~bridge-' || lpad(CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), 12, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.png' AS name FROM orders""")
def bridge_names(spark, folder):
    orders = B.table(spark, folder, "orders")
    image = F.concat(F.lit("frame"), F.col("o_custkey"), F.lit(".png"))
    return orders.select("o_orderkey", naming.bridge_name(image, F.rint("o_totalprice").cast("long"), F.col("o_orderkey")).alias("name"))


# --- graphs --------------------------------------------------------------

@query("covisibility_pairs", f"""
WITH {B.TRACKS_SQL}
SELECT a.frame_index AS frame_a, b.frame_index AS frame_b, count(*) AS shared_tracks FROM observations a JOIN observations b ON a.point_id = b.point_id AND a.frame_index < b.frame_index GROUP BY ALL""")
def covisibility_pairs(spark, folder):
    return matching.covisible_frames(B.observations(spark, folder))


@query("covisibility_batches")
def covisibility_batches(spark, folder):
    observations = B.observations(spark, folder).withColumn("scene", F.lit(0))
    frames = observations.select("scene", "frame_index").distinct().withColumns(
        {"fx": F.sin(F.col("frame_index") * 0.05), "fy": F.lit(0.0), "fz": F.cos(F.col("frame_index") * 0.05)})
    return graph.covisibility_batches(frames, matching.covisible_frames(observations, ["scene"]), "scene", minimum_direction=0.5)


_CAMERAS = f"""
WITH {B.FRAMES_SQL},
cams AS (SELECT capture, frame_index // 9 AS window_index, luma * 10 AS x, (event_id % 7) * 0.5::DOUBLE AS y, 0.0::DOUBLE AS z, cos(luma * 3) AS fx, sin(luma * 3) AS fy FROM frames)
"""


@query("revisit_pairs", _CAMERAS + f"""
, m AS (SELECT a.capture, a.window_index AS earlier, b.window_index AS later, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.fx * b.fx + a.fy * b.fy AS c
  FROM cams a JOIN cams b ON a.capture = b.capture AND b.window_index >= a.window_index + 3)
SELECT capture, earlier, later, {R('min(d)')} AS nearest_centre_distance, {R('max(c)')} AS best_forward_cosine FROM m GROUP BY ALL HAVING bool_or(d <= 0.4::DOUBLE AND c >= 0.5::DOUBLE)""")
def revisit_pairs(spark, folder):
    frames = B.frames(spark, folder)
    cameras = frames.select(
        "capture", F.floor(F.col("frame_index") / 9).alias("window_index"), (F.col("luma") * 10).alias("x"), ((F.col("event_id") % 7) * 0.5).alias("y"),
        F.lit(0.0).alias("z"), F.cos(F.col("luma") * 3).alias("fx"), F.sin(F.col("luma") * 3).alias("fy"), F.lit(0.0).alias("fz"))
    found = matching.camera_path_revisits(cameras, 3, 0.4, 0.5, ["capture"])
    return found.withColumns({c: near(c) for c in ("nearest_centre_distance", "best_forward_cosine")})


# Steps between consecutive windows of a capture: mean luma sets length and turn.
_STEPS = f"""
WITH RECURSIVE {B.FRAMES_SQL},
st AS (SELECT capture, CAST(frame_index // 9 AS INTEGER) AS w, avg(luma) AS m FROM frames GROUP BY ALL),
pose(capture, w, scale, angle, x, y) AS (
  SELECT capture, 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM st WHERE w = 0
  UNION ALL
  SELECT p.capture, st.w, p.scale * (0.99::DOUBLE + 0.02::DOUBLE * m), p.angle + 0.1::DOUBLE * m,
         p.x + p.scale * (cos(p.angle) * m - sin(p.angle) * 0.5::DOUBLE), p.y + p.scale * (sin(p.angle) * m + cos(p.angle) * 0.5::DOUBLE)
  FROM pose p JOIN st ON st.capture = p.capture AND st.w = p.w + 1)
"""


def _steps(spark, folder):
    means = B.frames(spark, folder).groupBy("capture", F.floor(F.col("frame_index") / 9).cast("int").alias("window_index")).agg(F.avg("luma").alias("m"))
    first = F.col("window_index") == 0
    m = F.when(first, F.lit(0.0)).otherwise(F.col("m"))
    c, s, zero = F.cos(0.1 * m), F.sin(0.1 * m), F.lit(0.0)
    return means.select(
        "capture", "window_index", F.when(first, 1.0).otherwise(0.99 + 0.02 * m).alias("scale"),
        F.array(c, -s, zero, s, c, zero, zero, zero, F.lit(1.0)).alias("rotation"),
        F.array(m, F.when(first, 0.0).otherwise(0.5), zero).alias("translation"))


@query("pose_chain", _STEPS + f"""
SELECT capture, w AS window_index, {R('scale')} AS scale, {R('cos(angle)')} AS cos_angle, {R('x')} AS x, {R('y')} AS y FROM pose""")
def pose_chain(spark, folder):
    poses = graph.chain_poses(_steps(spark, folder), ["capture"])
    at = lambda c, i: near(F.col(c).getItem(i))
    return poses.select("capture", "window_index", near("scale").alias("scale"), at("rotation", 0).alias("cos_angle"), at("translation", 0).alias("x"), at("translation", 1).alias("y"))


@query("pose_graph")
def pose_graph(spark, folder):
    """Chained poses plus a loop edge from the first to the last window of each capture."""
    poses = settle(graph.chain_poses(_steps(spark, folder), ["capture"]))
    edges = graph.relative_edges(poses, ["capture"])
    last = poses.groupBy("capture").agg(F.max("window_index").alias("dst")).filter("dst >= 3")
    loops = poses.join(last, "capture").filter("window_index = dst").select(
        "capture", F.lit(0).alias("src"), "dst", F.lit(1.0).alias("scale"), "rotation", F.transform("translation", lambda v: v * 0.9).alias("translation"),
        F.lit(5.0).alias("information"), F.lit(True).alias("loop_closure"))
    return graph.optimise_pose_graph(poses, edges.unionByName(loops), "capture")


@query("diagnostic_links", f"""
WITH {B.FRAMES_SQL},
a AS (SELECT capture, CAST(frame_index // 9 AS INTEGER) AS w, min(luma) AS x FROM frames GROUP BY ALL)
SELECT p.capture, 'seam' AS kind, p.w AS src, q.w AS dst, p.x, q.x AS to_x FROM a p JOIN a q ON q.capture = p.capture AND q.w = p.w + 1
UNION ALL SELECT p.capture, 'loop', 0, q.w, p.x, q.x FROM a p JOIN a q ON q.capture = p.capture AND p.w = 0 AND q.w >= 3""")
def diagnostic_links(spark, folder):
    anchors = B.frames(spark, folder).groupBy("capture", F.floor(F.col("frame_index") / 9).cast("int").alias("window_index")).agg(F.min("luma").alias("x"))
    nodes = anchors.select("capture", "window_index", "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    edges = nodes.filter("window_index >= 3").select("capture", F.lit(0).alias("src"), F.col("window_index").alias("dst"), F.lit(True).alias("loop_closure"))
    return matching.diagnostic_links(nodes, edges, ["capture"]).select("capture", "kind", "src", "dst", "x", "to_x")


# --- providers -----------------------------------------------------------

@query("provider_fallback_merge", """
WITH a AS (SELECT n_nationkey * 2 AS frame_index, min(c_acctbal) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
b AS (SELECT s_nationkey * 3 AS frame_index, min(s_acctbal) AS v FROM supplier GROUP BY s_nationkey)
SELECT coalesce(a.frame_index, b.frame_index) AS frame_index, coalesce(a.v, b.v) AS v, CASE WHEN a.frame_index IS NOT NULL THEN 'primary' ELSE 'secondary' END AS provider
FROM a FULL JOIN b ON a.frame_index = b.frame_index""")
def provider_fallback_merge(spark, folder):
    nation = B.table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    primary = B.table(spark, folder, "customer").join(nation, "c_nationkey").groupBy((F.col("c_nationkey") * 2).alias("frame_index")).agg(F.min("c_acctbal").alias("v"))
    secondary = B.table(spark, folder, "supplier").groupBy((F.col("s_nationkey") * 3).alias("frame_index")).agg(F.min("s_acctbal").alias("v"))
    return matching.fallback_merge(primary, secondary, ["frame_index"], ["v"])


@query("keep_first_union", """
WITH a AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
c AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b)""")
def keep_first_union(spark, folder):
    orders = B.table(spark, folder, "orders")
    chunk = lambda status: orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("v"))
    return matching.keep_first_union([chunk(s) for s in "FOP"], ["k"])


@query("text_model_filter", """
WITH im AS (SELECT o_orderkey AS image_id, o_custkey % 50 AS camera_id, o_orderstatus AS s FROM orders), kept AS (SELECT * FROM im WHERE s <> 'F'),
ob AS (SELECT l_orderkey AS image_id, l_linenumber AS slot, min(l_partkey) AS point_id FROM lineitem GROUP BY ALL),
tr AS (SELECT DISTINCT l_partkey AS point_id, l_orderkey AS image_id, l_linenumber AS slot FROM lineitem WHERE l_discount < 0.07)
SELECT ob.image_id, ob.slot, CASE WHEN tr.point_id IS NULL THEN -1 ELSE ob.point_id END AS point_id FROM ob JOIN kept USING (image_id) LEFT JOIN tr ON tr.image_id = ob.image_id AND tr.slot = ob.slot AND tr.point_id = ob.point_id""")
def text_model_filter(spark, folder):
    images = B.table(spark, folder, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 50).alias("camera_id"), "o_orderstatus")
    items = B.table(spark, folder, "lineitem")
    slot = [F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("slot")]
    observations = items.groupBy(*slot).agg(F.min("l_partkey").alias("point_id"))
    tracks = items.filter("l_discount < 0.07D").select(F.col("l_partkey").alias("point_id"), *slot).distinct()
    cameras = images.select("camera_id").distinct()
    _, kept, _, _ = matching.filter_text_model(images, observations, tracks, cameras, F.col("o_orderstatus") != "F")
    return kept.select("image_id", "slot", "point_id")


@query("camera_pairs", f"""
WITH {B.POINTS_SQL}, {B.VIEWS_SQL}
SELECT window_index, frame_index, {R('-(c * t)')} AS sx, {R('-(s * t)')} AS sz, {R('-(2 * c * t)')} AS tx FROM views WHERE frame_index % 10 <> 0""")
def camera_pairs(spark, folder):
    views = B.views(spark, folder)
    doubled = F.transform(B.turning_camera(F.col("frame_index")), lambda v, i: F.when(i % 4 == 3, v * 2).otherwise(v))
    poses = views.select("frame_index").distinct().select("frame_index", doubled.alias("w2c"), (F.col("frame_index") % 10 != 0).alias("registered"))
    return matching.camera_pairs(views, poses, ["window_index"]).select("window_index", "frame_index", *[near(c).alias(c) for c in ("sx", "sz", "tx")])


@query("global_window_fit")
def global_window_fit(spark, folder):
    views = B.views(spark, folder)
    doubled = F.transform(B.turning_camera(F.col("frame_index")), lambda v, i: F.when(i % 4 == 3, v * 2).otherwise(v))
    poses = views.select("frame_index").distinct().select("frame_index", doubled.alias("w2c"), F.lit(True).alias("registered"))
    return reports.global_window_fit(views, poses)


@query("known_global_fit", f"""
WITH {B.POINTS_SQL}, {B.VIEWS_SQL}
SELECT window_index, 2.0::DOUBLE AS scale, 1.0::DOUBLE AS r00, 1.0::DOUBLE AS r22, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t2, count(*) AS pairs, count(*) >= 6 AS passed
FROM views GROUP BY window_index""")
def known_global_fit(spark, folder):
    """A trajectory of twice the size: every window's fit is known."""
    fits = global_window_fit(spark, folder)
    at = lambda name, i: near(F.get(F.col(name), F.lit(i)))
    return fits.select("window_index", near("scale").alias("scale"), at("rotation", 0).alias("r00"), at("rotation", 8).alias("r22"),
                       at("translation", 0).alias("t0"), at("translation", 2).alias("t2"), F.col("pairs").cast("long").alias("pairs"), "passed")
