"""Queries over reports, gates, catalogues and content addressing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import matching, reports, similarity
from ..operators.ordering import window_members, window_schedule
from . import bindings as B
from .registry import near, query, sql_near as R


def _joined(violations, column="reasons"):
    return violations.withColumn(column, F.concat_ws("; ", column))


# Orders stand in for seam alignments: one alignment per order of a customer.
_ALIGN = """
WITH al AS (SELECT o_custkey AS scene, o_orderkey AS window_index, o_orderkey % 120 AS correspondence_count, (o_orderkey % 120) * (60 + o_orderkey % 41) // 100 AS inlier_count,
  CASE WHEN o_orderstatus = 'P' THEN 'nan'::DOUBLE ELSE o_totalprice / 99991 END AS rms_residual, o_totalprice / 249989 AS scale FROM orders)
"""


def _alignments(spark, folder):
    key = F.col("o_orderkey")
    count = key % 120
    return B.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("scene"), key.alias("window_index"), count.alias("correspondence_count"),
        F.floor(count * (60 + key % 41) / 100).alias("inlier_count"),
        F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 99991).alias("rms_residual"),
        (F.col("o_totalprice") / 249989).alias("scale"))


_SUMMARY = """
, sm AS (SELECT scene, count(*) AS sequential_alignment_count, CAST(sum(correspondence_count) AS BIGINT) AS correspondence_count, CAST(sum(inlier_count) AS BIGINT) AS inlier_count,
  min(CASE WHEN correspondence_count > 0 THEN inlier_count / correspondence_count END) AS minimum_inlier_ratio, max(CASE WHEN NOT isnan(rms_residual) THEN rms_residual END) AS maximum_rms_residual FROM al GROUP BY scene)
"""


@query("alignment_summary", _ALIGN + _SUMMARY + f"""
SELECT scene, sequential_alignment_count, correspondence_count, inlier_count, {R('minimum_inlier_ratio')} AS minimum_inlier_ratio, {R('maximum_rms_residual')} AS maximum_rms_residual FROM sm""")
def alignment_summary(spark, folder):
    out = reports.alignment_summary(_alignments(spark, folder), ["scene"])
    return out.withColumns({c: near(c) for c in ("minimum_inlier_ratio", "maximum_rms_residual")})


@query("scene_report", _ALIGN + f""",
v AS (SELECT scene, scale AS v FROM al WHERE NOT isnan(scale)), r AS (SELECT scene, rms_residual AS v FROM al WHERE NOT isnan(rms_residual)),
a AS (SELECT scene, min(v) AS lo, list_sort(list(v))[count(*) // 2 + 1] AS mid, max(v) AS hi FROM v GROUP BY scene),
b AS (SELECT scene, min(v) AS lo, list_sort(list(v))[count(*) // 2 + 1] AS mid, max(v) AS hi FROM r GROUP BY scene)
SELECT scene, {R('a.lo')} AS scale_min, {R('a.mid')} AS scale_median, {R('a.hi')} AS scale_max, {R('b.lo')} AS rms_min, {R('b.mid')} AS rms_median, {R('b.hi')} AS rms_max FROM a FULL JOIN b USING (scene)""")
def scene_report(spark, folder):
    out = reports.three_point_summary(_alignments(spark, folder), ["scene"], {"scale": F.col("scale"), "rms": F.col("rms_residual")})
    return out.select("scene", *[near(c).alias(c) for c in out.columns if c != "scene"])


_PROFILE = {"minimum_measured_windows": 8, "minimum_fused_points": 500, "minimum_sequential_inlier_ratio": 0.6,
            "maximum_sequential_rms_residual": 4.5, "require_loop_closure": True}


@query("verify_gates", _ALIGN + _SUMMARY + """
SELECT scene, array_to_string(list_filter([CASE WHEN sequential_alignment_count < 8 THEN 'measured_windows' END, CASE WHEN correspondence_count < 500 THEN 'fused_points' END,
  CASE WHEN coalesce(minimum_inlier_ratio < 0.6::DOUBLE, true) THEN 'minimum_inlier_ratio' END, CASE WHEN coalesce(maximum_rms_residual > 4.5::DOUBLE, false) THEN 'maximum_rms_residual' END,
  CASE WHEN scene % 3 = 0 THEN 'loop_closure' END], lambda x: x IS NOT NULL), '; ') AS violations FROM sm""")
def verify_gates(spark, folder):
    evidence = reports.alignment_summary(_alignments(spark, folder), ["scene"]).select(
        "scene", F.col("sequential_alignment_count").alias("measured_windows"), F.col("correspondence_count").alias("fused_points"),
        F.lit(True).alias("finite_points"), "minimum_inlier_ratio", "maximum_rms_residual", (F.col("scene") % 3).alias("loop_closures"))
    return _joined(reports.verify(evidence, _PROFILE), "violations").select("scene", "violations")


@query("seam_gate", _ALIGN + """
SELECT window_index FROM al WHERE correspondence_count < 50 OR inlier_count / correspondence_count < 0.6::DOUBLE OR isnan(rms_residual) OR rms_residual > 1 OR scale < 1e-3 OR scale > 1e3""")
def seam_gate(spark, folder):
    alignments = _alignments(spark, folder).filter("correspondence_count > 0").withColumn("normalized_rms_residual", F.col("rms_residual"))
    empty = _alignments(spark, folder).filter("correspondence_count = 0").select("window_index")
    return similarity.seam_violations(alignments).select("window_index").unionByName(empty)


@query("loop_gate", _ALIGN + f"""
SELECT window_index, 1.0::DOUBLE AS scale FROM al WHERE correspondence_count >= 50 AND inlier_count / correspondence_count >= 0.7::DOUBLE AND NOT isnan(rms_residual) AND rms_residual <= 2""")
def loop_gate(spark, folder):
    alignments = _alignments(spark, folder).filter("correspondence_count > 0")
    return similarity.loop_gate(alignments, 50, 0.7, 2.0).select("window_index", "scale")


@query("surface_summary", f"""
WITH {B.POINTS_SQL} SELECT window_index, count(*) AS fused_points, bool_and(radius > 0.06::DOUBLE) AS finite_points,
  CASE WHEN bool_and(radius > 0.06::DOUBLE) THEN 'fused_relative_world' ELSE 'invalid_fused_geometry' END AS state FROM pts GROUP BY window_index""")
def surface_summary(spark, folder):
    points = B.points(spark, folder).withColumn("radius", F.col("radius") - 0.06)
    return reports.scene_state(points, ["window_index"])


@query("diff_stats", f"""
WITH d AS (SELECT o_totalprice - CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS g, o_orderstatus <> CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS m FROM orders)
SELECT count(*) AS left_rows, count(*) AS right_rows, count(*) AS paired_rows, {R('avg(abs(g))')} AS price_mean_error, max(abs(g)) AS price_max_error,
       count(*) FILTER (g <> 0) AS price_mismatches, count(*) FILTER (m) AS status_mismatches FROM d""")
def diff_stats(spark, folder):
    orders = B.table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    shifted = orders.withColumns({"price": F.col("price") + F.when(F.col("o_orderkey") % 100 == 0, 1).otherwise(0),
                                  "status": F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("status"))})
    out = reports.difference_stats(orders, shifted, ["o_orderkey"], ["price"], ["status"])
    return out.withColumn("price_mean_error", near("price_mean_error"))


@query("trial_intervals", f"""
WITH m AS (SELECT o_orderpriority AS arm, o_custkey % 12 AS trial, median(o_totalprice / 1.037::DOUBLE) AS m FROM orders GROUP BY ALL)
SELECT arm, count(*) AS trials, {R('avg(m)', 3)} AS mean, {R('avg(m) - 2.201::DOUBLE * stddev_samp(m) / sqrt(count(*))', 3)} AS low, {R('avg(m) + 2.201::DOUBLE * stddev_samp(m) / sqrt(count(*))', 3)} AS high FROM m GROUP BY arm""")
def trial_intervals(spark, folder):
    samples = B.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 12).alias("trial"), (F.col("o_totalprice") / 1.037).alias("o_totalprice"))
    out = reports.trial_intervals(samples, "arm", "trial", "o_totalprice")
    return out.withColumns({c: near(c, 3) for c in ("mean", "low", "high")})


# --- catalogue and content -----------------------------------------------

@query("content_address_dedup", """
SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def content_address_dedup(spark, folder):
    hashed = B.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("new_documents", """
WITH p AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id)) SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT h FROM p)""")
def new_documents(spark, folder):
    hashed = B.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    published = hashed.join(B.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return reports.new_documents(hashed, published).select("sha256")


@query("publish_once_gate", """
SELECT d.doc_id, sha256(d.text) AS fingerprint FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0""")
def publish_once_gate(spark, folder):
    incoming = B.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    published = incoming.join(B.table(spark, folder, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 0, F.sha2(F.concat("fingerprint", F.lit("!")), 256)).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return reports.publish_once_conflicts(incoming, published, ["doc_id"], "fingerprint")


@query("frameset_subset", """
WITH p AS (SELECT quality AS k, doc_id AS f FROM labels WHERE toxic = 0), r AS (SELECT quality AS k, doc_id AS f FROM labels)
SELECT r.k, count(p.f) AS published, count(*) AS registered, 0::BIGINT AS "foreign", count(p.f) >= 0.85::DOUBLE * count(*) AS passed FROM r LEFT JOIN p ON p.k = r.k AND p.f = r.f GROUP BY r.k""")
def frameset_subset(spark, folder):
    labels = B.table(spark, folder, "labels").select(F.col("quality").alias("k"), F.col("doc_id").alias("frame_index"), "toxic")
    return reports.frame_set_report(labels.filter("toxic = 0"), labels, ["k"])


@query("frame_intersection", "SELECT c_nationkey AS frame_index FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def frame_intersection(spark, folder):
    return B.table(spark, folder, "customer").select(F.col("c_nationkey").alias("frame_index")).intersect(B.table(spark, folder, "supplier").select("s_nationkey"))


@query("frame_union", "SELECT c_nationkey * 2 AS frame_index FROM customer UNION SELECT s_nationkey * 3 FROM supplier")
def frame_union(spark, folder):
    frames = B.table(spark, folder, "customer").select((F.col("c_nationkey") * 2).alias("frame_index"))
    return frames.union(B.table(spark, folder, "supplier").select(F.col("s_nationkey") * 3)).distinct()


@query("latest_job", """
SELECT o_custkey AS queue, max(o_orderkey) AS job_id, CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'O' THEN 'interrupted' ELSE arg_max(o_orderstatus, o_orderkey) END AS state, max(o_orderkey) + 1 AS next_job_id FROM orders GROUP BY o_custkey""")
def latest_job(spark, folder):
    jobs = B.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("state"))
    return reports.recover_job(jobs, ["queue"]).select("queue", "job_id", "state", "next_job_id")


@query("product_resolution", """
WITH p AS (SELECT o_custkey AS scene, CASE WHEN o_orderkey % 97 = 0 THEN 'colmap-mvs-geometric' ELSE 'p-' || o_orderkey END AS id, CASE WHEN o_orderstatus = 'F' THEN 'surfel' ELSE 'tsdf' END AS kind, 'p-' || (o_custkey * 7) AS sel FROM orders),
r AS (SELECT *, CASE WHEN id = 'colmap-mvs-geometric' THEN 1 WHEN kind = 'surfel' THEN 2 WHEN id = sel THEN 3 END AS rank FROM p)
SELECT scene, arg_min(id, (rank, id)) AS product_id, CAST(min(rank) AS INTEGER) AS rank FROM r WHERE rank IS NOT NULL GROUP BY scene""")
def product_resolution(spark, folder):
    key = F.col("o_orderkey")
    products = B.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("scene"), F.when(key % 97 == 0, "colmap-mvs-geometric").otherwise(F.concat(F.lit("p-"), key)).alias("product_id"),
        F.when(F.col("o_orderstatus") == "F", "surfel").otherwise("tsdf").alias("kind"))
    selected = F.concat(F.lit("p-"), F.col("scene") * 7)
    return reports.resolve_product(products, ["scene"], F.lit(None).cast("string"), selected).select("scene", "product_id", "rank")


@query("identifier_checks", """
SELECT c_custkey, regexp_matches(replace(c_name, '#', '-'), '^[A-Za-z0-9-]+$') AS product_ok, regexp_matches(c_name, '^[A-Za-z0-9-]+$') AS raw_ok, regexp_matches(sha256(c_name), '^[0-9a-f]{64}$') AS hash_ok,
       CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '-') END AS requested FROM customer""")
def identifier_checks(spark, folder):
    name = F.col("c_name")
    query_ = F.concat(F.lit("a=1&product="), F.when(F.col("c_custkey") % 2 == 0, F.replace(name, F.lit("#"), F.lit("-"))).otherwise(name))
    return B.table(spark, folder, "customer").select(
        "c_custkey", naming.is_product_id(F.replace(name, F.lit("#"), F.lit("-"))).alias("product_ok"), naming.is_product_id(name).alias("raw_ok"),
        naming.is_sha256(F.sha2(name, 256)).alias("hash_ok"), naming.product_in_query(query_).alias("requested"))


@query("log_tails", "SELECT doc_id, right(text, 2000) AS tail FROM documents")
def log_tails(spark, folder):
    return B.table(spark, folder, "documents").select("doc_id", naming.log_tail(F.col("text")).alias("tail"))


@query("semantic_lookup", """
WITH m AS (SELECT s_suppkey % 120 AS frame_index, s_nationkey % 8 AS x, CAST(s_suppkey AS INTEGER) AS y, s_nationkey % 7 AS code FROM supplier)
SELECT CAST(l_orderkey % 120 AS INTEGER) AS frame_index, l_linenumber AS px, CAST(l_suppkey AS INTEGER) AS py, count(*) AS points, max(code IN (1, 2, 3)) AS surface, max(code IN (4, 5)) AS opening
FROM lineitem LEFT JOIN m ON m.frame_index = l_orderkey % 120 AND m.x = l_linenumber AND m.y = l_suppkey GROUP BY ALL""")
def semantic_lookup(spark, folder):
    mask = B.table(spark, folder, "supplier").select(
        (F.col("s_suppkey") % 120).cast("int").alias("frame_index"), (F.col("s_nationkey") % 8).alias("x"), F.col("s_suppkey").cast("int").alias("y"),
        (F.col("s_nationkey") % 7).cast("tinyint").alias("class_code"))
    points = B.points(spark, folder).select("frame_index", "px", "py")
    found = matching.semantic_lookup(points, mask)
    return found.groupBy("frame_index", "px", "py").agg(
        F.count(F.lit(1)).alias("points"), F.max(naming.supports_surface(F.col("class_code"))).alias("surface"), F.max(naming.is_opening(F.col("class_code"))).alias("opening"))


@query("semantic_violations", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber > 6 OR 20 * l_discount > 1.5 GROUP BY ALL""")
def semantic_violations(spark, folder):
    pixels = B.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("class_code"), (20 * F.col("l_discount") - 0.5).alias("confidence"))
    bad = pixels.withColumn("confidence", F.greatest("confidence", F.lit(0.0)))
    return reports.semantic_violations(bad).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("raster_violations", f"""
WITH {B.FRAMES_SQL},
f AS (SELECT capture, frame_index, 'f' || (event_id % 400) AS file_name, timestamp_millis // 86400000 AS ms FROM frames),
o AS (SELECT *, lag(ms) OVER (PARTITION BY capture ORDER BY frame_index) AS pm, count(*) OVER (PARTITION BY capture, file_name) AS c FROM f)
SELECT capture, frame_index, array_to_string(list_filter([CASE WHEN c > 1 THEN 'repeated name' END, CASE WHEN ms <= pm THEN 'time order' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM o WHERE c > 1 OR ms <= pm""")
def raster_violations(spark, folder):
    frames = B.frames(spark, folder).select(
        "capture", "frame_index", F.concat(F.lit("f"), F.col("event_id") % 400).alias("file_name"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"),
        F.floor(F.col("timestamp_millis") / 86400000).alias("timestamp_millis"))
    return _joined(reports.raster_violations(frames, ["capture"])).select("capture", "frame_index", "reasons")


@query("pose_violations", f"""
WITH {B.POINTS_SQL}, f AS (SELECT DISTINCT frame_index FROM pts)
SELECT frame_index, array_to_string(list_filter([CASE WHEN frame_index % 11 = 0 THEN 'unknown frame' END, CASE WHEN frame_index % 11 <> 0 AND frame_index % 7 = 0 THEN 'name differs' END,
  CASE WHEN frame_index % 5 = 0 THEN 'not rigid' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM f WHERE frame_index % 11 = 0 OR frame_index % 7 = 0 OR frame_index % 5 = 0""")
def pose_violations(spark, folder):
    frame = F.col("frame_index")
    frames = B.points(spark, folder).select("frame_index").distinct()
    bent = F.transform(B.turning_camera(frame), lambda v, i: F.when((frame % 5 == 0) & (i == 5), v * 1.1).otherwise(v))
    name = F.concat(F.lit("f"), frame)
    solution = frames.select("frame_index", F.when(frame % 7 == 0, "other").otherwise(name).alias("image_name"), F.lit(True).alias("registered"), bent.alias("w2c"))
    rasters = frames.filter(frame % 11 != 0).select("frame_index", name.alias("file_name"))
    return _joined(reports.pose_violations(solution, rasters, []))


@query("track_violations", """
WITH o AS (SELECT l_partkey AS point_id, count(*) AS n, count(DISTINCT l_orderkey) AS d FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS point_id, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'no observation' END, CASE WHEN n <> d THEN 'repeated frame' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM part LEFT JOIN o ON o.point_id = p_partkey WHERE n IS NULL OR n <> d""")
def track_violations(spark, folder):
    tracks = B.table(spark, folder, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_retailprice").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"),
                                                   F.lit(0.5).alias("reprojection_error_px"))
    observations = B.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_orderkey").alias("frame_index"),
                                                             F.col("l_quantity").alias("u"), F.col("l_tax").alias("v"))
    frames = observations.select("frame_index").distinct()
    return _joined(reports.track_violations(tracks, observations, frames))


@query("checkpoint_violations", f"""
WITH {B.FRAMES_SQL},
n AS (SELECT capture, count(*) AS frames FROM frames GROUP BY capture),
w AS (SELECT capture, frames, unnest(range(0, frames, 9)) AS start FROM n),
k AS (SELECT capture, start // 9 AS window_index, start, least(start + 12, frames) AS stop FROM w WHERE start = 0 OR start - 9 + 12 < frames),
m AS (SELECT capture, window_index, start, stop, unnest(range(start, stop)) AS frame_index FROM k),
s AS (SELECT m.capture, window_index, start, stop, count(*) AS n, min(frame_index) AS low, max(frame_index) AS high FROM m JOIN frames USING (capture, frame_index) WHERE event_type <> 'error' GROUP BY ALL)
SELECT capture, window_index, n FROM s WHERE n <> stop - start""")
def checkpoint_violations(spark, folder):
    frames = B.frames(spark, folder).select("capture", "frame_index", "event_type")
    stored = window_members(frames, ["capture"], "frame_index").filter("event_type <> 'error'")
    return reports.checkpoint_violations(stored, window_schedule(frames, ["capture"], "frame_index"), ["capture"]).select("capture", "window_index", "n")
