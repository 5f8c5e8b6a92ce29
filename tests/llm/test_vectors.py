import numpy as np

from scenefold.llm import vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int, shard int, kind int")


def exact(ids, points, every, k):
    out = {}
    for i, q in zip(ids, points, strict=True):
        if i % every == 0:
            scored = sorted(((-float(np.dot(q, p)), j) for j, p in zip(ids, points, strict=True) if j != i))
            out[i] = [j for _, j in scored[:k]]
    return out


def test_recall_order_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24)) * 3
    points = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 24))).astype(np.float32)
    index = vectors.build_index(table(spark, [(i, p.tolist(), 1, 1, 1) for i, p in enumerate(points)]), shard_rows=400)
    assert index.count() == 4
    queries = table(spark, [(i, points[i].tolist(), 0, 0, 0) for i in range(0, 1500, 20)])
    rows = vectors.nearest(queries, index, 20).collect()
    wide = points.astype(np.float64)
    want = exact(range(1500), wide, 20, 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(np.dot(wide[r.query_id], wide[r.vec_id]))) < 1e-9
    assert all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.95


def test_copies_ties_and_unusable_rows(spark):
    one, two = [1.0, 0.0], [0.0, 2.0]
    rows = [(i, one, 1, 1, 1) for i in range(60)] + [(60, two, 1, 1, 1), (80, two, 1, 1, 1)]
    rows += [(100, None, 1, 1, 1), (120, [0.0, 0.0], 1, 1, 1), (140, [1.0, None], 1, 1, 1), (160, [float("nan"), 1.0], 1, 1, 1), (180, [float("inf"), 1.0], 1, 1, 1)]
    rows += [(200, [1.0, 2.0, 3.0], 1, 1, 1), (220, [], 1, 1, 1), (None, one, 1, 1, 1), (3, one, 1, 1, 1)]
    got = {}
    for r in vectors.self_search(table(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 80}
    assert got[0] == [(i, 1.0) for i in range(1, 21)]
    assert got[40] == [(i, 1.0) for i in range(20)]
    assert got[60][0] == (80, 4.0) and got[60][1:] == [(i, 0.0) for i in range(19)]
    assert vectors.self_search(table(spark, [])).count() == 0
    assert vectors.self_search(table(spark, [(20, one, 1, 1, 1)])).count() == 0
