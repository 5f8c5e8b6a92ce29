"""Joins, solvers, samples and graphs against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenefold.errors import PoseError, PoseGraphError, ScheduleError, StitchError
from scenefold.functions import hashing, linalg
from scenefold.operators import depth, graph, icp, matching, ordering, planes, quantiles, reports, similarity, spatial, surface
from scenefold.settings import ArchitectureSettings, FrameGlobalSettings, KeyframeSettings, PreviewSettings, TsdfSettings, WindowSettings

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
SIM3 = "scale double, rotation array<double>, translation array<double>"


def cloud(spark, xyz, key):
    return spark.createDataFrame(pd.DataFrame({key: range(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))


@pytest.fixture(scope="module")
def clumped():
    """Two clouds with a dense clump and a run of equal positions."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(260, 3)), rng.normal(size=(120, 3))
    a[:90] = a[0] + rng.normal(size=(90, 3)) * 0.01
    a[90:140] = a[90]
    b[:30] = a[0] + rng.normal(size=(30, 3)) * 0.01
    return a, b


@pytest.mark.parametrize("leaf", [256, 24])
def test_nearest_and_moments_match_all_pairs(spark, clumped, leaf):
    """Small leaves force the descent that crowded cells take."""
    a, b = clumped
    queries, targets = cloud(spark, b, "qid"), cloud(spark, a, "tid")
    d2 = ((b[:, None] - a[None]) ** 2).sum(-1)
    found = {r.qid: r.tid for r in spatial.nearest_within(queries, targets, 0.4, leaf_rows=leaf).collect()}
    assert found == {i: int(d2[i].argmin()) for i in range(len(b)) if d2[i].min() <= 0.16}
    moments = {r.qid: r for r in spatial.radius_moments(queries, targets, 0.4, leaf_rows=leaf).collect()}
    for i, row in enumerate(d2):
        inside = a[row <= 0.16] - b[i]
        if len(inside) == 0:
            assert i not in moments
            continue
        assert moments[i].n == len(inside)
        assert moments[i].s_x == pytest.approx(inside[:, 0].sum(), abs=1e-9)
        assert moments[i].s_yz == pytest.approx((inside[:, 1] * inside[:, 2]).sum(), abs=1e-9)


@pytest.mark.parametrize("tie", ["lowest_id", "first_in_cell_order", "last_in_cell_order"])
def test_nearest_lays_blocks_together_and_writes_no_pairs(spark, monkeypatch, tie):
    """Every query has hundreds of targets in reach, many at one distance; ids repeat or are missing."""
    rng = np.random.default_rng(17)
    a, b = rng.integers(-4, 5, (500, 4)) * 0.05, rng.integers(-4, 5, (400, 4)) * 0.05
    group = lambda rows: (rows[:, 3] > 0).astype(int)
    listed = lambda rows: [(int(g), i, *map(float, p[:3])) for i, (g, p) in enumerate(zip(group(rows), rows))]
    odd = [(0, 9000, float("nan"), 0.0, 0.0), (1, 9001, None, 0.0, 0.0), (None, 9002, 0.0, 0.0, 0.0)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"g int, {name} long, x double, y double, z double")
    asked, offered = listed(b), listed(a)
    asked += [(1, 5, 0.012, 0.0, 0.0), (0, None, 0.013, 0.0, 0.0), (0, 700, 5.0, 0.0, 0.0)]
    written, settle = [], spatial.settle
    monkeypatch.setattr(spatial, "settle", lambda df: written.append(settle(df)) or written[-1])
    for name, value in (("QUERY_ROWS", 32), ("TASK_ROWS", 150), ("TREE_ROWS", 64)):
        monkeypatch.setattr(spatial, name, value, raising=False)
    rows = spatial.nearest_within(frame(asked + odd, "qid"), frame(offered + odd, "tid"), 0.3, tie, by=["g"], leaf_rows=16).collect()
    sign = -1 if tie == "last_in_cell_order" else 1
    cells = lambda p: () if tie == "lowest_id" else tuple(sign * math.floor(v / 0.3) for v in p)
    expected = {}
    for g, qid, *q in asked:
        for other, tid, *p in offered:
            d2 = (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])
            if g == other and d2 <= 0.3 * 0.3:
                expected[qid] = min(expected.get(qid, (9.0,)), (d2, cells(p), sign * tid))
    assert {r.qid: (r.d2, r.tid) for r in rows} == {k: (d2, sign * tid) for k, (d2, _, tid) in expected.items()}
    assert len(rows) == len(expected) and sum(df.count() for df in written) <= 2 * (len(asked) + len(offered))


def test_moments_of_a_clump_write_blocks_and_not_pairs(spark, monkeypatch):
    """Where each point has hundreds of neighbours, what is written grows with the points."""
    rng = np.random.default_rng(13)
    xyz, group = rng.normal(size=(300, 3)) * 0.2, np.arange(300) % 2
    points = spark.createDataFrame(pd.DataFrame({"g": group, "qid": range(300), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    written, settle = [], spatial.settle

    def counted(df):
        out = settle(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(spatial, "settle", counted)
    found = {r.qid: r for r in spatial.radius_moments(points, points.drop("qid"), 0.3, ["g"], leaf_rows=1).collect()}
    assert max(written) <= 300
    for i in range(300):
        d = xyz[group == group[i]] - xyz[i]
        inside = d[(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) <= 0.3 * 0.3]
        assert found[i].n == len(inside)
        assert found[i].s_x == pytest.approx(inside[:, 0].sum(), abs=1e-9)
        assert found[i].s_xz == pytest.approx((inside[:, 0] * inside[:, 2]).sum(), abs=1e-9)


@pytest.mark.parametrize("held", [10**6, 3])
def test_nearest_without_a_radius(spark, clumped, held):
    a, b = clumped
    found = {r.qid: r.tid for r in spatial.nearest(cloud(spark, b, "qid"), cloud(spark, a, "tid"), held=held).collect()}
    assert found == {i: int(((a - p) ** 2).sum(-1).argmin()) for i, p in enumerate(b)}


def test_gaps_that_make_no_band_keep_every_candidate(spark):
    from scenefold.settings import KeyframeSettings

    frames = spark.range(9).select(F.col("id").alias("ordinal"), F.lit(0).alias("c"))
    for fps, settings in ((float("nan"), KeyframeSettings()), (0.0, KeyframeSettings()), (30.0, KeyframeSettings(minimum_gap_seconds=2.0, maximum_gap_seconds=1.0))):
        assert ordering.keyframes(frames, ["c"], fps, None, settings).count() == 9


def test_one_to_one_matching_is_the_greedy_result(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((40, 3)), rng.random((50, 3))
    found = {r.qid: r.tid for r in matching.one_to_one_nearest(cloud(spark, a, "qid"), cloud(spark, b, "tid"), 0.3).collect()}
    used, expected = set(), {}
    for i, p in enumerate(a):
        options = [(d, j) for j, d in enumerate(np.linalg.norm(b - p, axis=1)) if d <= 0.3 and j not in used]
        if options:
            expected[i] = min(options)[1]
            used.add(expected[i])
    assert found == expected


def test_one_to_one_matching_of_a_clump_takes_few_nearest_joins(spark, monkeypatch):
    """Sources at one place all want the same targets: a round serves many of them, not one."""
    rng = np.random.default_rng(5)
    a, b, calls, join = np.zeros((60, 3)), rng.random((70, 3)) * 0.2, [], matching.nearest_within
    monkeypatch.setattr(matching, "nearest_within", lambda *args, **more: calls.append(1) or join(*args, **more))
    found = {r.qid: r.tid for r in matching.one_to_one_nearest(cloud(spark, a, "qid"), cloud(spark, b, "tid"), 0.5).collect()}
    assert found == dict(enumerate(np.argsort((b**2).sum(1), kind="stable")[:60].tolist())) and len(calls) <= 3


def test_one_to_one_matching_in_batches_and_blocks_with_short_lists(spark, monkeypatch):
    for name, value in (("BLOCK_SOURCES", 7), ("LISTED", 2), ("LIST_ROWS", 1), ("SMALL_BATCH", 30), ("FLAT_PAIRS", 0)):
        monkeypatch.setattr(matching, name, value)
    rng = np.random.default_rng(7)
    a, b = rng.random((60, 3)) * 0.4, rng.random((60, 3)) * 0.4
    found = {r.qid: r.tid for r in matching.one_to_one_nearest(cloud(spark, a, "qid"), cloud(spark, b, "tid"), 0.3).collect()}
    used, expected = set(), {}
    for i, p in enumerate(a):
        options = [(d, j) for j, d in enumerate(np.linalg.norm(b - p, axis=1)) if d <= 0.3 and j not in used]
        if options:
            expected[i] = min(options)[1]
            used.add(expected[i])
    assert found == expected


@pytest.mark.parametrize("flat", [1 << 62, 0])
def test_one_to_one_matching_follows_displaced_sources_in_their_task(spark, monkeypatch, flat):
    """Blocks in one another's way need few rounds; ids are wide, equal distances and odd rows are there."""
    rng, wide = np.random.default_rng(19), (1 << 53) + 1
    place = lambda n: rng.integers(-6, 7, (n, 3)) * 0.03 + rng.choice([0.0, 0.001], (n, 3))
    a, b = place(400), place(420)
    asked = [(g, wide + 2 * i + g, *map(float, p)) for g in (0, 1) for i, p in enumerate(a[200 * g:200 * g + 200])]
    offered = [(g, wide + 2 * i + g, *map(float, p)) for g in (0, 1) for i, p in enumerate(b[210 * g:210 * g + 210])]
    odd = [(0, 9000, float("nan"), 0.0, 0.0), (1, 9001, None, 0.0, 0.0), (None, 9002, 0.0, 0.0, 0.0)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"g int, {name} long, x double, y double, z double")
    for name, value in (("BLOCK_SOURCES", 25), ("LISTED", 2), ("LIST_ROWS", 1), ("SMALL_BATCH", 150), ("FLAT_PAIRS", flat),
                        ("HELD_TARGETS", 1000), ("REGION_TARGETS", 30), ("FIRST_LISTED", 3), ("TASK_ROWS", 100), ("LEAF_ROWS", 16)):
        monkeypatch.setattr(matching, name, value, raising=False)
    calls, settle = [], matching.settle
    monkeypatch.setattr(matching, "settle", lambda df: calls.append(1) or settle(df))
    rows = matching.one_to_one_nearest(frame(asked + odd, "qid"), frame(offered + odd, "tid"), 0.1, ["g"]).collect()
    used, expected = set(), {}
    for g, qid, *q in sorted(asked, key=lambda row: row[1]):
        d2 = lambda p: (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])
        options = [(d2(p), *(math.floor(v / 0.1) for v in p), tid) for other, tid, *p in offered if other == g and tid not in used and d2(p) <= 0.1 * 0.1]
        if options:
            expected[qid] = (min(options)[-1], min(options)[0])
            used.add(expected[qid][0])
    assert {r.qid: (r.tid, r.d2) for r in rows} == expected and len(rows) == len(expected) < len(asked)
    assert len(calls) <= 50


@pytest.mark.parametrize("small", [0, 1 << 62])
def test_quantiles_of_infinite_and_missing_values(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL_BYTES", small)
    inf, nan = float("inf"), float("nan")
    data = [("a", v) for v in (1.0, 2.0, 3.0, inf)] + [("b", v) for v in (nan, 1.0, -inf)] + [("c", inf), ("c", None), ("d", 1.7e308), ("d", -1.7e308), ("d", 0.0)]
    frame = spark.createDataFrame(data, "k string, v double")
    upper = {r.k: r.m for r in quantiles.upper_median(frame, ["k"], "v", "m").collect()}
    assert upper == {"a": 3.0, "b": 1.0, "c": inf, "d": 0.0}
    most = {r.k: r.m for r in quantiles.percentiles(frame, ["k"], "v", {"m": 1.0}).collect()}
    assert most["a"] == most["c"] == inf and most["b"] != most["b"] and most["d"] == 1.7e308


@pytest.mark.parametrize("small", [0, 1 << 62])
def test_quantiles_of_random_groups(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL_BYTES", small)
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"k": rng.integers(0, 3, 400), "v": np.round(rng.exponential(size=400) ** 4, 2)})
    frame = spark.createDataFrame(data)
    got = quantiles.percentiles(frame, ["k"], "v", {"a": 0.55, "b": 0.95}).orderBy("k").toPandas()
    upper = quantiles.upper_median(frame, ["k"], "v", "m").orderBy("k").toPandas()
    for k, part in data.groupby("k"):
        assert got.a[k] == pytest.approx(np.percentile(part.v, 55))
        assert got.b[k] == pytest.approx(np.percentile(part.v, 95))
        assert upper.m[k] == sorted(part.v)[len(part) // 2]


@pytest.mark.parametrize("small", [0, 1 << 62])
def test_statistics_of_several_measures_and_null_keys(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL_BYTES", small)
    data = [(None, 1.0, -5.0), (None, 3.0, None), ("a", None, -1e-300), ("a", None, -0.0), ("a", None, 5e-324), ("b", None, None)]
    frame = spark.createDataFrame(data, "k string, v double, w double")
    wanted = {"v50": ("v", 0.5), "w50": ("w", 0.5), "w0": ("w", 0.0), "top": (F.col("v") * 2, None)}
    rows = {r.k: tuple(r)[1:] for r in quantiles.statistics(frame, ["k"], wanted).collect()}
    assert rows == {None: (2.0, -5.0, -5.0, 6.0), "a": (None, 0.0, -1e-300, None), "b": (None, None, None, None)}
    assert quantiles.statistics(frame.limit(0), [], wanted).collect()[0][:] == (None,) * 4


def test_buckets_never_fall(spark):
    rng = np.random.default_rng(9)
    values = np.r_[rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), 0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0)]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", quantiles.bucket_of(F.col("v")).alias("b")).orderBy("v").toPandas()
    assert (np.diff(frame.b) >= 0).all()


def test_percentile_examples(spark):
    frame = spark.createDataFrame([(float(v),) for v in (9, 1, 5, 3)], "v double")
    row = quantiles.percentiles(frame, [], "v", {"a": 0.0, "b": 1.0, "c": 0.5}).first()
    assert (row.a, row.b, row.c) == (1.0, 9.0, 4.0)


def test_global_index_counts_every_row_once(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    indexed = ordering.global_index(frame, ["v"]).collect()
    assert all(r.ordinal == r.v for r in indexed)
    keyed = ordering.global_index(frame, ["v"], keys=["k"]).toPandas()
    for _, part in keyed.groupby("k"):
        assert sorted(part.ordinal) == list(range(len(part)))
        assert (part.sort_values("v").ordinal.to_numpy() == np.arange(len(part))).all()


@pytest.mark.parametrize("count,expected", [
    (60, [(0, 12), (9, 21), (18, 30), (27, 39), (36, 48), (45, 57), (54, 60)]), (5, [(0, 5)]), (12, [(0, 12)]), (13, [(0, 12), (9, 13)])])
def test_window_schedule(spark, count, expected):
    frames = spark.range(count).withColumnRenamed("id", "ordinal")
    rows = ordering.window_schedule(frames).orderBy("start").collect()
    assert [(r.start, r.stop) for r in rows] == expected
    members = ordering.window_members(frames).groupBy("window_index").count().orderBy("window_index").collect()
    assert [r["count"] for r in members] == [b - a for a, b in expected]


def test_window_schedule_of_120_frames_and_bad_overlap(spark):
    frames = spark.range(120).withColumnRenamed("id", "ordinal")
    rows = ordering.window_schedule(frames).orderBy("start").collect()
    assert len(rows) == 13 and (rows[-1].start, rows[-1].stop) == (108, 120)
    with pytest.raises(ScheduleError):
        ordering.window_schedule(frames, settings=WindowSettings(12, 12))


def sequences(spark, *items):
    rows = [(s, i, [float(v) for v in np.atleast_1d(v)], float(q)) for s, (values, sharp) in enumerate(items) for i, (v, q) in enumerate(zip(values, sharp))]
    return spark.createDataFrame(rows, "s long, ordinal long, signature array<double>, sharpness double")


def test_keyframes_follow_the_greedy_path_across_blocks(spark):
    from scenefold.sources.rasters import novelty

    rng = np.random.default_rng(5)
    items = [(rng.random(n), rng.random(n) * 0.05) for n in (1, 2, 3, 120)]
    settings = KeyframeSettings()
    got = ordering.keyframes(sequences(spark, *items), ["s"], 8.0, novelty, settings, block=16).toPandas()
    for s, (luma, sharp) in enumerate(items):
        n, picked = len(luma), [0]
        while n > 2:
            p = picked[-1]
            low, high = min(p + 4, n - 1), min(p + 5, n - 1)
            if low >= n - 1:
                break
            scores = [(sharp[i] * abs(luma[p] - luma[i]), -i) for i in range(low, high + 1) if sharp[i] >= 0.012 and abs(luma[p] - luma[i]) >= 0.015]
            picked.append(-max(scores)[1] if scores else high)
        expected = sorted({*picked, n - 1}) if n > 2 else list(range(n))
        assert sorted(got[got.s == s].ordinal) == expected


def test_bridge_and_extraction_schedules(spark):
    def frames(*millis):
        return spark.createDataFrame(list(enumerate(millis)), "ordinal long, timestamp_millis long")

    bridges = ordering.bridge_schedule(frames(0, 1200, 3000), [], "ordinal", 2.0).orderBy("bridge_millis").collect()
    assert [r.bridge_millis for r in bridges] == [500, 1000, 1700, 2200, 2700]
    assert ordering.bridge_schedule(frames(100, 400), [], "ordinal", 2.0).count() == 0
    rate = lambda *m: ordering.uniform_rate(frames(*m), [], "ordinal").first()
    steady = rate(0, 125, 250, 375, 490)
    assert (steady.frames_per_second, steady.uniform_frames) == (8.0, 4)
    assert rate(0, 500, 1125, 1500, 2125).frames_per_second is None
    assert rate(0, 500, 500).increasing is False


# --- fits ----------------------------------------------------------------

def pairs(spark, rows):
    return spark.createDataFrame([(k, *map(float, s), *map(float, t), 1.0) for k, s, t in rows], "seam int, sx double, sy double, sz double, tx double, ty double, tz double, w double")


AXES = [((0, 0, 0), (5, -3, 1)), ((1, 0, 0), (5, -1, 1)), ((0, 1, 0), (3, -3, 1)), ((0, 0, 1), (5, -3, 3))]


def test_similarity_of_known_points_and_a_line(spark):
    rows = [(1, s, t) for s, t in AXES] + [(2, (i, 0, 0), (i, 0, 0)) for i in range(6)]
    fits = {r.seam: r for r in similarity.fit_similarity(pairs(spark, rows), ["seam"]).collect()}
    assert fits[1].scale == pytest.approx(2, abs=1e-9)
    moved = fits[1].scale * np.array(fits[1].rotation).reshape(3, 3) @ [1, 0, 0] + fits[1].translation
    assert np.allclose(moved, [5, -1, 1])
    assert fits[2].scale is None
    with pytest.raises(StitchError):
        similarity.require_seams(similarity.robust_fit(pairs(spark, rows), ["seam"]))


def test_robust_and_huber_fits_resist_outliers(spark):
    rng = np.random.default_rng(6)
    source = rng.normal(size=(80, 3))
    target = 1.5 * source + [1, 2, 3]
    target[:6] += rng.normal(size=(6, 3)) * 5
    rows = [(0, s, t) for s, t in zip(source, target)]
    fit = similarity.robust_fit(pairs(spark, rows), ["seam"]).first()
    assert fit.scale == pytest.approx(1.5, abs=1e-6) and fit.inlier_count == 74
    huber = similarity.huber_fit(pairs(spark, rows), ["seam"]).first()
    assert huber.scale == pytest.approx(1.5, abs=0.05)
    provider = similarity.provider_fit(pairs(spark, rows), ["seam"]).first()
    assert provider.scale == pytest.approx(1.5, abs=1e-6)


def test_similarity_fit_follows_a_moved_target(spark):
    rows = [(0, s, t) for s, t in AXES] + [(1, s, tuple(3 * v + 1 for v in t)) for s, t in AXES]
    fits = {r.seam: r for r in similarity.fit_similarity(pairs(spark, rows), ["seam"]).collect()}
    assert fits[1].scale == pytest.approx(3 * fits[0].scale)


def test_icp_on_a_shifted_plane(spark):
    grid = [(i * 0.02, j * 0.02) for i in range(11) for j in range(11)]
    sources = [(0, k, x / 1.7, y / 1.7, 0.03 / 1.7) for k, (x, y) in enumerate(grid)] + [(1, 1000 + k, k * 0.01, 0.0, 1.0) for k in range(19)]
    targets = [(0, k, x, y, 0.0) for k, (x, y) in enumerate(grid)] + [(1, 1000 + k, k * 0.01, 0.0, 0.0) for k in range(19)]
    start = [(0, 1.7, EYE, [0.0] * 3), (1, 1.0, EYE, [0.0] * 3)]
    rows = icp.icp_refine(spark.createDataFrame(sources, "pair int, qid long, x double, y double, z double"),
                          spark.createDataFrame(targets, "pair int, tid long, x double, y double, z double"),
                          spark.createDataFrame(start, f"pair int, {SIM3}")).collect()
    assert [r.pair for r in rows] == [0]
    fit = rows[0]
    assert fit.scale == pytest.approx(1.7, abs=1e-6) and fit.translation[2] == pytest.approx(-0.03, abs=2e-4)
    assert fit.correspondences >= 20 and fit.rms_after < fit.rms_before / 100


def _brute_icp(sources, targets, reach, normal_radius, rounds=30):
    """Point-to-plane refinement over all pairs, ties to the last cell and id."""
    far = lambda a, b: sum((b[None, :, i] - a[:, None, i]) ** 2 for i in range(3))
    normals = np.full((len(targets), 3), np.nan)
    for k, row in enumerate(far(targets, targets) <= normal_radius**2):
        if row.sum() >= 3:
            normals[k] = np.linalg.eigh(np.cov(targets[row].T))[1][:, 0]
    order = np.lexsort((np.arange(len(targets)), *np.floor(targets / reach).T[::-1]))[::-1]
    t, normals = targets[order], normals[order]
    turn, shift, rms, step, before = np.eye(3), np.zeros(3), None, None, None
    for done in range(rounds + 1):
        p = sources @ turn.T + shift
        d2 = far(p, t)
        to = d2.argmin(axis=1)
        hit = (d2[np.arange(len(p)), to] <= reach**2) & ~np.isnan(normals[to, 0])
        p, n = p[hit], normals[to[hit]]
        r = ((p - t[to[hit]]) * n).sum(axis=1)
        now = np.sqrt((r * r).mean())
        before = now if before is None else before
        if done and (step < 1e-7 or rms - now <= 1e-6 * rms):
            return turn, shift, before, now, done, hit.sum()
        w = np.where(np.abs(r) > 0.05, 0.05 / np.abs(r), 1.0)
        row = np.column_stack([np.cross(p, n), n])
        move, _ = linalg.rank_truncated_solve((row * w[:, None]).T @ row, (row * w[:, None]).T @ r, 1e-3)
        rms, step = now, np.linalg.norm(move)
        turn, shift = linalg.so3_exp(move[:3]) @ turn, linalg.so3_exp(move[:3]) @ shift + move[3:]


@pytest.mark.parametrize("slack, rows", [(1 / 16, 4096), (1e-4, 64)])
def test_icp_lays_blocks_together_and_keeps_points_in_place(spark, monkeypatch, slack, rows):
    from scenefold.settings import IcpSettings

    rng = np.random.default_rng(11)
    clouds = []
    for size in (700, 500):
        at = rng.random((size, 2))
        clouds.append(np.column_stack([at, 0.1 * np.sin(6 * at[:, 0]) * np.cos(5 * at[:, 1])]))
    turn = linalg.so3_exp(np.array([0.02, -0.01, 0.03]))
    moved = [cloud @ turn.T + [0.01, -0.02, 0.015] for cloud in clouds]
    # Copies of one position, and points that are no places.
    moved = [np.vstack([m, np.repeat(m[:1], 40, axis=0)]) for m in moved]
    odd = [(0, 9000, float("nan"), 0.0, 0.0), (0, 9001, None, 0.0, 0.0), (1, 9002, float("inf"), 0.0, 0.0)]
    listed = lambda sides: [(pair, 1000 * pair + k, *map(float, p)) for pair, side in enumerate(sides) for k, p in enumerate(side)] + odd
    frame = lambda sides, name: spark.createDataFrame(listed(sides), f"pair int, {name} long, x double, y double, z double")
    written, keep = [], spatial.settle
    count = lambda df: (written.append(keep(df)) or written[-1])
    for module in (spatial, icp):
        monkeypatch.setattr(module, "settle", count)
    for name, value in (("SLACK", slack), ("SOURCE_ROWS", rows), ("TARGET_ROWS", max(16, rows // 4)), ("TASK_ROWS", 300)):
        monkeypatch.setattr(icp, name, value, raising=False)
    start = spark.createDataFrame([(pair, 1.0, EYE, [0.0] * 3) for pair in (0, 1)], f"pair int, {SIM3}")
    found = {r.pair: r for r in icp.icp_refine(frame(moved, "qid"), frame(clouds, "tid"), start, IcpSettings(maximum_distance=0.5, normal_radius=0.3)).collect()}
    for pair in (0, 1):
        turn_, shift, before, after, rounds, hits = _brute_icp(moved[pair], clouds[pair], 0.5, 0.3)
        row = found[pair]
        assert np.allclose(row.rotation, turn_.ravel(), atol=1e-9) and np.allclose(row.translation, shift, atol=1e-9)
        assert row.rms_before == pytest.approx(before, abs=1e-9) and row.rms_after == pytest.approx(after, abs=1e-9)
        assert (row.iterations, row.correspondences) == (rounds, hits)
    if slack == 1 / 16:
        # A round of joins wrote every source with the boxes that it met.
        assert sum(df.count() for df in written) <= 8 * sum(map(len, moved))


# --- graphs --------------------------------------------------------------

def test_pose_graph_with_a_loop(spark):
    nodes = spark.createDataFrame([(0, i, 1.0, EYE, [x, 0.0, 0.0]) for i, x in enumerate((0.0, 1.0, 2.4))], f"g int, window_index int, {SIM3}")
    edges = spark.createDataFrame(
        [(0, a, b, 1.0, EYE, [x, 0.0, 0.0], w, loop) for a, b, x, w, loop in ((0, 1, 1.0, 1.0, False), (1, 2, 1.0, 1.0, False), (0, 2, 2.0, 2.0, True))],
        f"g int, src int, dst int, {SIM3}, information double, loop_closure boolean")
    rows = {r.window_index: r for r in graph.optimise_pose_graph(nodes, edges, "g").collect()}
    assert rows[1].translation[0] == pytest.approx(1.0, abs=1e-4) and rows[2].translation[0] == pytest.approx(2.0, abs=1e-4)
    assert rows[0].final_cost < rows[0].initial_cost * 1e-6 and rows[0].loop_edges == 1
    with pytest.raises(PoseGraphError):
        graph.optimise_pose_graph(nodes.filter("window_index <> 1"), edges, "g")


def test_a_loop_of_turned_and_scaled_windows_closes(spark):
    rng = np.random.default_rng(3)
    truth = [(np.array(1.0), np.eye(3), np.zeros(3))]
    steps = [(np.exp(np.array(rng.normal(0, 0.1))), linalg.so3_exp(rng.normal(0, 0.3, 3)), rng.normal(size=3)) for _ in range(7)]
    for one in steps:
        truth.append(linalg.sim3_compose(truth[-1], one))
    loop = linalg.sim3_compose(linalg.sim3_inverse(truth[0]), truth[-1])
    pack = lambda pose: (float(pose[0]), np.asarray(pose[1]).ravel().tolist(), np.asarray(pose[2]).tolist())
    rough = [(0, i, *pack((p[0] * (1 + 0.02 * (i > 0)), p[1], p[2] + 0.1 * (i > 0)))) for i, p in enumerate(truth)]
    edges = [(0, i, i + 1, *pack(one), 1.0, False) for i, one in enumerate(steps)] + [(0, 0, 7, *pack(loop), 4.0, True)]
    rows = graph.optimise_pose_graph(spark.createDataFrame(rough, f"g int, window_index int, {SIM3}"),
                                     spark.createDataFrame(edges, f"g int, src int, dst int, {SIM3}, information double, loop_closure boolean"), "g").collect()
    assert len(rows) == 8
    for row in rows:
        scale, rotation, translation = truth[row.window_index]
        assert row.scale == pytest.approx(scale, abs=1e-6) and np.allclose(np.reshape(row.rotation, (3, 3)), rotation, atol=1e-6)
        assert np.allclose(row.translation, translation, atol=1e-5) and row.final_cost < 1e-10 < row.initial_cost


def test_nearest_by_a_tree_scores_few_pairs():
    from scenefold.operators.kdtree import Tree

    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 3)) * 20
    places = np.round(centres[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 3)), 1)
    places[100:140] = places[50]
    asked = np.r_[centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 3)), places[:50], [[1e6, 0, 0]]]
    tree = Tree(places)
    at, d2 = tree.nearest(asked)
    assert tree.evaluations < 0.05 * len(places) * len(asked)
    for q in range(len(asked)):
        every = ((places - asked[q]) ** 2).sum(axis=1)
        assert at[q] == np.argmin(every) and d2[q] == pytest.approx(every.min())
    one = Tree(np.zeros((20, 3)))
    assert one.nearest(np.ones((2, 3)))[0].tolist() == [0, 0]


def test_components_match_union_find(spark):
    rng = np.random.default_rng(7)
    edges = rng.integers(0, 60, size=(45, 2))
    nodes = spark.range(60).withColumnRenamed("id", "node")
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in edges] + [(i, i + 1) for i in range(40, 55)], "src long, dst long")
    found = {r.node: r.component for r in graph.components(nodes, frame).collect()}
    parent = list(range(60))
    root = lambda v: v if parent[v] == v else root(parent[v])
    for a, b in [(r.src, r.dst) for r in frame.collect()]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert found == {v: root(v) for v in range(60)}


def test_topology_example(spark):
    points = spark.createDataFrame([(x, 0.1, 0.1) for x in (0.1, 1.1, 8.1)], "x double, y double, z double")
    cells = ordering.global_index(surface.occupied_cells(points, 1.0), surface.KEY, "node")
    row = graph.topology(graph.components(cells, graph.cell_edges(cells))).first()
    assert (row.components, row.largest, row.isolated) == (2, 2, 1)


def test_pose_chain_is_the_running_product(spark):
    steps = [(i, 1.0 if i == 0 else 2.0, EYE, [0.0, 0.0, 0.0] if i == 0 else [1.0, 0.0, 0.0]) for i in range(6)]
    rows = graph.chain_poses(spark.createDataFrame(steps, f"window_index int, {SIM3}")).orderBy("window_index").collect()
    assert [r.scale for r in rows] == [2.0**i for i in range(6)]
    assert [r.translation[0] for r in rows] == [2.0**i - 1 for i in range(6)]


def test_covisibility(spark):
    seen = spark.createDataFrame([(0, t, f) for t, fs in enumerate(([0, 2, 4], [0, 2], [1, 3])) for f in fs], "g int, point_id long, frame_index long")
    weights = matching.covisible_frames(seen, ["g"])
    assert {(r.frame_a, r.frame_b): r.shared_tracks for r in weights.collect()} == {(0, 2): 2, (0, 4): 1, (2, 4): 1, (1, 3): 1}
    frames = spark.createDataFrame([(0, i, 0.0, 0.0, 1.0) for i in range(5)], "g int, frame_index long, fx double, fy double, fz double")
    rows = graph.covisibility_batches(frames, weights, "g", 3, 1).collect()
    batches = [sorted(r.frame_index for r in rows if r.batch == b) for b in sorted({r.batch for r in rows})]
    assert all(len(b) == 3 for b in batches) and set(itertools.chain(*batches)) == set(range(5)) and [0, 2, 4] in batches


def test_revisit_needs_distance_and_gap(spark):
    cameras = spark.createDataFrame([(i, x, 0.0, 0.0, 0.0, 0.0, 1.0) for i, x in enumerate((0.0, 1.0, 0.1))],
                                    "window_index int, x double, y double, z double, fx double, fy double, fz double")
    rows = matching.camera_path_revisits(cameras, 2, 0.25, 0.9).collect()
    assert [(r.earlier, r.later) for r in rows] == [(0, 2)]
    assert rows[0].nearest_centre_distance == pytest.approx(0.1)


def test_revisits_repeat_a_camera_for_few_cells_and_lose_none(spark):
    rng = np.random.default_rng(17)
    grid = np.round(rng.random((60, 3)) * 2, 1)
    cameras = spark.createDataFrame(
        [(i // 3, *map(float, p), 1.0, 0.0, 0.0) for i, p in enumerate(grid)] + [(40, math.inf, 0.0, 0.0, 1.0, 0.0, 0.0), (41, math.nan, 0.0, 0.0, 1.0, 0.0, 0.0)],
        "window_index int, x double, y double, z double, fx double, fy double, fz double")
    axes = list(zip("xyz", ("cx", "cy", "cz")))
    assert matching._reached_cells(cameras, 0.25, 0.5, axes).count() <= 8 * 60
    found = {(r.earlier, r.later) for r in matching.camera_path_revisits(cameras, 2, 0.25, 0.9).collect()}
    gap = np.sqrt(((grid[:, None] - grid[None]) ** 2).sum(-1))
    assert found == {(a // 3, b // 3) for a, b in zip(*np.nonzero(gap <= 0.25)) if b // 3 >= a // 3 + 2}


# --- surfaces and planes -------------------------------------------------

def test_tsdf_collapses_two_sheets(spark):
    rows = [(i * 0.02 + 0.003, j * 0.02 + 0.003, z, *((200, 0, 0) if f == 7 else (0, 200, 0)), 1.0, 0.01, f) for z, f in ((0.006, 7), (-0.006, 2)) for i in range(11) for j in range(11)]
    frame = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int, confidence double, radius double, frame_index int")
    camera = spark.createDataFrame([(0.0, 0.0, 1.0)], "x double, y double, z double")
    out = surface.fuse_tsdf(frame, camera, TsdfSettings(voxel_size=0.02, minimum_hits=1)).collect()
    assert out and all(r.first_observing_frame == 2 and abs(r.z) < 0.011 and r.nz > 0.9 for r in out)
    # Equal parts of red and green mixed in linear light stay bright.
    assert any(r.r > 140 and r.g > 140 for r in out)


def test_few_observations_pass_through(spark):
    rows = [(float(i), 0.0, 0.0, 1, 2, 3, 1.0, 0.1, i) for i in range(7)] + [(0.0, 0.0, math.nan, 1, 2, 3, 1.0, 0.1, 9)]
    frame = spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int, confidence double, radius double, frame_index int")
    assert surface.fuse_tsdf(frame, None).count() == 7


def test_preview_keeps_both_ends_and_the_budget(spark):
    ends = spark.createDataFrame([(i, v + d, v + d, v + d) for i, (v, d) in enumerate(((0.0, 0.0), (0.0, 0.01), (100.0, 0.0), (100.0, 0.01)))], "i int, x double, y double, z double")
    kept = surface.spatial_preview(ends, ["i"], PreviewSettings(budget=2)).collect()
    assert len(kept) == 2 and sorted(r.x > 50 for r in kept) == [False, True]
    line = spark.createDataFrame([(i, float(i), 2.0 * i, 3.0 * i) for i in range(32)], "i int, x double, y double, z double")
    assert surface.spatial_preview(line, ["i"], PreviewSettings(budget=5)).count() == 5
    assert surface.spatial_preview(line, ["i"]).count() == 32


def test_planes_keep_holes(spark):
    rows = []
    for i in range(100):
        for j in range(80):
            if not (30 <= i < 70 and j < 50):
                rows += [(i * 0.02 + d, j * 0.02 + d, 0.0) for d in (0.0, 0.002)]
    names = {n: F.lit(v) for n, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0), ("confidence", 1.0), ("radius", 0.01))}
    frame = spark.createDataFrame(rows, "x double, y double, z double").withColumns({**names, "r": F.lit(90), "g": F.lit(90), "b": F.lit(90), "first_observing_frame": F.lit(-1)})
    found, cells = planes.extract_planes(frame, ["x", "y"], ArchitectureSettings(minimum_plane_support=500, cell_size_fraction=0.02))
    assert len(found) == 1 and abs(found[0].normal[2]) > 0.999
    rows = cells.collect()
    assert len(rows) > 300 and not [r for r in rows if 0.75 <= r.x <= 1.25 and r.y <= 0.85]
    assert {r.first_observing_frame for r in rows} == {-1}
    two = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "i int, x double, y double").withColumns({**names, "z": F.lit(0.0), "radius": F.lit(0.078), "r": F.lit(1), "g": F.lit(1), "b": F.lit(1)})
    vertices, indices = planes.mesh_from_cells(two, ["i"])
    assert vertices.count() == 8 and indices.count() == 12 and indices.agg(F.max("vertex")).first()[0] == 7


def test_planes_write_their_points_once(spark, monkeypatch):
    """Three stacked sheets: the search finds all, and only the first round writes points."""
    rows = [(i * 0.02, j * 0.02, float(k)) for k, n in enumerate((60, 50, 40)) for i in range(n) for j in range(50)]
    names = {n: F.lit(v) for n, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0), ("confidence", 1.0), ("radius", 0.01))}
    frame = spark.createDataFrame(rows, "x double, y double, z double").withColumns({**names, "r": F.lit(90), "g": F.lit(90), "b": F.lit(90), "first_observing_frame": F.lit(0)})
    written = []
    real = planes.settle
    monkeypatch.setattr(planes, "settle", lambda df: written.append("ordinal" in df.columns) or real(df))
    found, cells = planes.extract_planes(frame, ["x", "y", "z"], ArchitectureSettings(minimum_plane_support=1500, cell_size_fraction=0.02))
    assert [round(abs(p.offset)) for p in found] == [0, 1, 2] and [p.support for p in found] == [3000, 2500, 2000]
    assert written.count(True) == 1
    # Places among rows with gaps are those of the rows that are left.
    left = spark.range(0, 9000).select((F.col("id") * 3).alias("ordinal"), *[F.col("id").cast("double").alias(a) for a in "xyz"]).filter("ordinal % 2 = 0")
    kept = sorted(r.ordinal for r in left.collect())
    at = planes._at_places(left, planes._blocks(left), np.array([0, 1, 700, 2999, 4499]))
    assert {k: v[0] for k, v in at.items()} == {k: kept[k] / 3 for k in (0, 1, 700, 2999, 4499)}


# --- hashes --------------------------------------------------------------

def mix(value):
    return value & hashing.U64_MAX


def test_hashes_follow_the_wrapping_definition(spark):
    row = spark.createDataFrame([(5, 17, 23)], "f int, px int, py int").select(hashing.observation_hash(F.col("f"), F.col("px"), F.col("py")).alias("h")).first()
    v = 5 ^ 0x9E3779B97F4A7C15
    v ^= mix(17 * 0xBF58476D1CE4E5B9)
    v = mix(((v << 27) | (v >> 37)) * 0x94D049BB133111EB) if v < 1 << 37 else mix((mix(v << 27) | (v >> 37)) * 0x94D049BB133111EB)
    v ^= mix(23 * 0x369DEA0F31A53F85)
    v ^= v >> 29
    assert row.h + (1 << 63) == v
    assert hashing.sample_threshold(12, 12) == hashing.U64_MAX
    assert hashing.sample_threshold(55_000_000, 6_000_000) == hashing.sample_threshold(55_000_000, 6_000_000) < hashing.U64_MAX


# --- depth ---------------------------------------------------------------

def test_frame_scale_smoothing_and_gates(spark):
    settings = FrameGlobalSettings(minimum_scale_samples=3)
    rows = [(f, 0, p, 0.1 * f + (0.01 if p % 5 == 0 else 0.0)) for f in range(4) for p in range(10)]
    rows += [(9, 0, p, 0.0) for p in range(2)]
    evidence = spark.createDataFrame(rows, "frame_index int, window_index int, point_id long, log_ratio double")
    reports_ = depth.frame_scale_reports(evidence, ["window_index", "frame_index"], settings)
    by_frame = {r.frame_index: r for r in reports_.collect()}
    assert by_frame[2].log_scale == pytest.approx(0.2) and by_frame[2].held_out_median_log_error == pytest.approx(0.01)
    assert by_frame[9].scale is None
    ordered = ordering.global_index(reports_, ["frame_index"])
    held = evidence.filter("point_id % 5 = 0")
    smoothed = {r.frame_index: r for r in depth.smooth_scales(ordered, held, [], "ordinal", settings).collect()}
    assert smoothed[0].log_scale == pytest.approx(0.1) and smoothed[1].log_scale == pytest.approx(0.15)
    assert smoothed[9].log_scale is None
    gate = lambda good, total: depth.frame_coverage(spark.range(total).select(
        F.when(F.col("id") < good, 1.0).alias("scale"), F.lit(0.0).alias("held_out_median_log_error")), []).first().passed
    assert gate(200, 230) and not gate(195, 230)


def test_view_ranking(spark):
    rows = [(0, 0, 1.0, 0.31, 80), (1, 0, 1.0, 0.04, 12)]
    ranked = spark.createDataFrame(rows, "window_index int, frame_index int, scale double, held_out_median_log_error double, scale_samples long")
    assert depth.canonical_views(ranked, []).first().window_index == 1
    rows = [(0, 0, 0, 0.10, 0.99, 5), (1, 0, 0, 0.11, 0.0, 5)]
    predictions = spark.createDataFrame(rows, "batch_index int, source_slot int, frame_index int, train_median_log_error double, held_out_median_log_error double, scale_samples long")
    assert depth.canonical_predictions(predictions, []).first().batch_index == 0


def test_depth_calibration_example(spark):
    points = [p for p in range(200)]
    held = spark.createDataFrame([(p,) for p in points], "p long").select("p", hashing.keyed_hold_out("a", F.lit("pose"), F.col("p")).alias("h")).collect()
    train, out = [r.p for r in held if not r.h][:3], [r.p for r in held if r.h][:1]
    evidence = spark.createDataFrame([(0, p, math.log(2.0)) for p in train + out], "frame_index int, point_id long, log_ratio double")
    from scenefold.settings import CalibrationSettings

    row = depth.calibrate_batches(evidence, ["frame_index"], "a", F.lit("pose"), CalibrationSettings(minimum_train=3, minimum_held_out=1)).first()
    assert row.scale == pytest.approx(2.0) and row.held_out_median_log_error == pytest.approx(0.0) and row.accepted


def test_z_buffer_resample_tiles_and_track_report(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    points = spark.createDataFrame([(0, 0, 0.0, 0.0, 4.0), (0, 1, 0.0, 0.0, 2.0), (0, 2, 0.0, 0.0, -1.0)], "g int, pid long, x double, y double, z double")
    camera = spark.createDataFrame([(0, 7, 1.0, 1.0, 1.0, 1.0, eye)], "g int, frame_index int, fx double, fy double, cx double, cy double, w2c array<double>")
    seen = depth.z_buffer(points, camera, ["g"], 3, 3).collect()
    assert [(r.px, r.py, r.depth) for r in seen] == [(1, 1, 2.0)]
    source = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, math.nan)], "px int, py int, depth double")
    target = {(r.px, r.py): r.depth for r in depth.resample_nearest(source, [], (2, 2), (4, 4)).collect()}
    assert len(target) == 16 and target[0, 0] == 1.0 and target[0, 2] == 3.0 and target[3, 3] is None
    both = spark.createDataFrame([(x, y, 2.0, 3.0 if x < 2 and y < 2 else None) for x in range(4) for y in range(4)], "px int, py int, depth double, reference double")
    ratios = {(r.px, r.py): r.ratio for r in depth.tile_ratio(both, [], 4, 4, 2, 3).collect()}
    assert ratios[0, 0] == 1.5 and ratios[1, 1] == 1.5 and ratios[3, 3] == 1.0 and len(ratios) == 16
    raster = spark.createDataFrame([(1, 1, 4.0)], "px int, py int, depth double").withColumn("frame_index", F.lit(0))
    sample = spark.createDataFrame([(0, 0.5, 0.5, 4.0)], "frame_index int, u double, v double, expected double")
    report = depth.track_depth_report(depth.local_minimum_depth(sample, raster, ["frame_index"]), []).first()
    assert (report.observations, report.covered_observations, report.coverage, report.median_abs_log_depth_error) == (1, 1, 1.0, 0.0)


def test_verification_treats_missing_values_unequally(spark):
    profile = {"minimum_measured_windows": 1, "minimum_fused_points": 1, "minimum_sequential_inlier_ratio": 0.5, "maximum_sequential_rms_residual": 1.0, "require_loop_closure": False}
    row = spark.createDataFrame([(1, 1, True, None, None, 0)], "measured_windows int, fused_points int, finite_points boolean, minimum_inlier_ratio double, maximum_rms_residual double, loop_closures int")
    assert reports.verify(row, profile).first().violations == ["minimum_inlier_ratio"]


def test_text_model_filter_repairs_references(spark):
    images = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "a~bridge-1")], "image_id long, camera_id long, name string")
    observations = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 10), (3, 0, 11)], "image_id long, slot int, point_id long")
    tracks = spark.createDataFrame([(10, 1, 0), (10, 2, 0), (11, 3, 0)], "point_id long, image_id long, slot int")
    cameras = spark.createDataFrame([(1,), (2,)], "camera_id long")
    _, kept, agreed, used = matching.filter_text_model(images, observations, tracks, cameras, ~F.col("name").contains("~bridge-"))
    assert sorted((r.image_id, r.slot, r.point_id) for r in kept.collect()) == [(1, 0, 10), (1, 1, -1), (2, 0, 10)]
    assert sorted((r.point_id, r.image_id, r.slot) for r in agreed.collect()) == [(10, 1, 0), (10, 2, 0)]
    assert [r.camera_id for r in used.collect()] == [1]


def test_keep_first_union_needs_overlap(spark):
    a = spark.range(20).withColumn("v", F.lit("a"))
    b = spark.range(8, 30).withColumn("v", F.lit("b"))
    merged = {r.id: r.v for r in matching.keep_first_union([a, b], ["id"]).collect()}
    assert merged[10] == "a" and merged[25] == "b" and len(merged) == 30
    with pytest.raises(PoseError):
        matching.keep_first_union([a, b.filter("id > 15")], ["id"])


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    frame = cloud(spark, rng.random((300, 3)), "i").withColumns({"confidence": F.lit(1.0), "radius": F.lit(0.1), "frame_index": F.col("i") % 5})
    key = lambda df: sorted((r.kx, r.ky, r.kz, round(r.x, 9), r.contributors) for r in surface.fuse_voxels(df).collect())
    assert key(frame) == key(frame.repartition(13, "y"))


def test_a_third_of_all_rows_on_one_key(spark):
    """One frame, one pixel, one position and one cell hold a third of the rows."""
    rng = np.random.default_rng(11)
    n, hot = 6000, 2000
    data = pd.DataFrame({
        "i": range(n), "window_index": rng.integers(0, 4, n), "frame_index": rng.integers(0, 40, n), "px": rng.integers(0, 9, n), "py": rng.integers(0, 9, n),
        "x": rng.random(n) * 9, "y": rng.random(n) * 9, "z": rng.random(n) * 9, "confidence": rng.random(n) + 0.1, "radius": 0.1, "depth": rng.random(n)})
    data.loc[: hot - 1, ["frame_index", "px", "py"]] = 7
    data.loc[: hot - 1, ["x", "y", "z"]] = 4.5
    frame = spark.createDataFrame(data)
    owned = surface.first_owner(frame).toPandas()
    expected = data[data.window_index == data.groupby("frame_index").window_index.transform("min")]
    assert sorted(owned.i) == sorted(expected.i)
    voxel = spark.createDataFrame([(0.5,)], "voxel double")
    assert surface.fuse_voxels(frame, voxel).agg(F.max("contributors"), F.sum("contributors")).first()[1] == n
    pairs_ = matching.shared_pixel_pairs(frame, ["i"])
    last = data.groupby(["window_index", "frame_index", "px", "py"]).i.max().reset_index()
    last["window_index"] += 1
    assert pairs_.count() == len(data.drop(columns="i").merge(last, on=["window_index", "frame_index", "px", "py"]))
    queries = frame.select(F.col("i").cast("long").alias("qid"), "x", "y", "z")
    moments = spatial.radius_moments(queries, queries, 0.4).filter("qid = 0").first()
    xyz = data[["x", "y", "z"]].to_numpy()
    assert moments.n == (((xyz - xyz[0]) ** 2).sum(axis=1) <= 0.16).sum() >= hot
    nearest = depth.nearest_per_pixel(frame.select("px", "py", "depth", F.col("i").alias("pid")), []).toPandas()
    assert np.allclose(nearest.sort_values(["px", "py"]).depth, data.groupby(["px", "py"]).depth.min())
    middle = quantiles.upper_median(frame, ["frame_index"], "depth", "m").toPandas().set_index("frame_index").m
    assert middle[7] == sorted(data[data.frame_index == 7].depth)[(data.frame_index == 7).sum() // 2]


def test_fits_write_their_pairs_once_and_send_the_transforms_to_them(spark, monkeypatch):
    rng = np.random.default_rng(11)
    xyz = rng.random((80, 3))
    rows = [(k, *p, *(1.5 * p + k), 1.0) for k in range(2) for p in xyz.tolist() for p in [np.array(p)]]
    pairs = spark.createDataFrame([tuple(float(v) if i else int(v) for i, v in enumerate(r)) for r in rows],
                                  "k int, sx double, sy double, sz double, tx double, ty double, tz double, w double")
    bent = pairs.withColumn("tz", F.col("tz") + F.when(F.col("sx") > 0.9, 5.0).otherwise(0.0))
    written, settle = [], similarity.settle

    def counted(df):
        out = settle(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(similarity, "settle", counted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fit in (similarity.robust_fit, similarity.provider_fit, similarity.huber_fit):
            written.clear()
            found = fit(bent, ["k"])
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan.split("Scan")[0] and "BroadcastHashJoin" in plan
            assert sum(n == 160 for n in written) == 1
            if fit is not similarity.huber_fit:
                kept = {r.k: (r.inlier_count, r.scale) for r in found.collect()}
                assert {k: v[0] for k, v in kept.items()} == {k: int((xyz[:, 0] <= 0.9).sum()) for k in range(2)}
                assert all(v[1] == pytest.approx(1.5) for v in kept.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_local_minimum_repeats_a_sample_for_few_tiles(spark):
    rng = np.random.default_rng(19)
    grid = {(int(x), int(y)): float(d) for x, y, d in zip(rng.integers(-6, 12, 120), rng.integers(-6, 12, 120), rng.random(120))}
    raster = spark.createDataFrame([(0, x, y, d) for (x, y), d in grid.items()], "frame_index int, px int, py int, depth double")
    spots = [(float(u), float(v)) for u in range(-8, 14) for v in range(-8, 14)]
    samples = spark.createDataFrame([(0, u + 0.25, v - 0.25) for u, v in spots] + [(0, None, 1.0)], "frame_index int, u double, v double")
    assert depth._reached_tiles(samples).count() <= 2.5 * len(spots)
    found = {(r.u, r.v): r.measured for r in depth.local_minimum_depth(samples, raster, ["frame_index"]).collect()}
    assert len(found) == len(spots) + 1 and found[(None, 1.0)] is None
    for u, v in spots:
        near = [grid[p] for p in ((u + i, v + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if p in grid]
        assert found[(u + 0.25, v - 0.25)] == (min(near) if near else None)


def test_pose_graphs_of_one_shape_are_solved_together():
    from scenefold.functions import linalg
    from scenefold.settings import PoseGraphSettings

    rng = np.random.default_rng(4)
    chains = [5, 3, 5, 1, 5]
    links = [n if n > 1 else 0 for n in chains]
    pose = lambda n: (1 + 0.02 * rng.normal(size=n), linalg.so3_exp(0.2 * rng.normal(size=(n, 3))), rng.normal(size=(n, 3)))
    nodes, steps = pose(sum(chains)), pose(sum(links))
    edges = {"src": np.concatenate([[*range(n - 1), 0] for n in chains if n > 1]), "dst": np.concatenate([[*range(1, n), n - 1] for n in chains if n > 1]),
             "inverse": linalg.sim3_inverse(steps), "information": np.ones(sum(links))}
    together, initial, final, rounds = graph._solve_graphs(nodes, edges, np.array(chains), np.array(links), PoseGraphSettings())
    assert final[3] == rounds[3] == 0 and (final <= initial).all() and (rounds[[0, 1, 2, 4]] > 0).all()
    low = edge = 0
    for i, (n, many) in enumerate(zip(chains, links)):
        part = {k: tuple(p[edge : edge + many] for p in v) if k == "inverse" else v[edge : edge + many] for k, v in edges.items()}
        alone, _, cost, _ = graph._solve_graphs(tuple(p[low : low + n] for p in nodes), part, np.array([n]), np.array([many]), PoseGraphSettings())
        assert cost[0] == pytest.approx(final[i], rel=1e-9)
        for a, b in zip(alone, together):
            np.testing.assert_allclose(a, b[low : low + n], atol=1e-6)
        low, edge = low + n, edge + many


def test_rows_of_a_task_follow_the_table(spark, tmp_path):
    from scenefold import session

    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.spread(table, "id").rdd.getNumPartitions() == least
    many = session.spread(table, "id", share=10_000)
    assert many.rdd.getNumPartitions() == session.file_bytes(table) // 10_000 > least
    assert session.spread(table.join(table, "id"), "id", table=table, share=10_000).rdd.getNumPartitions() == many.rdd.getNumPartitions()
    assert session.file_bytes(spark.range(5)) == 0
