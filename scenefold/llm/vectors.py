"""Approximate nearest neighbours: robust-pruned directed graphs, one for each shard.

Vectors are dealt over shards of about ``SHARD_ROWS`` rows by a hash of their id.
In each shard a directed graph is built in batches: a greedy beam search proposes
neighbours, pruning with a relaxed distance keeps near and diverse edges, and
backward edges are pruned alike. The largest inner product becomes the smallest
distance by one more coordinate (the square root of the largest squared norm minus
the own one). Every query runs a beam search in every shard; scores are then
taken exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .common import stored, with_workers

#: Vectors of one graph, about; bounds the memory of a task.
SHARD_ROWS = 4096
#: Out-degree, beam of the build, relaxation of the pruning and beam of a search.
DEGREE, BUILD_BEAM, RELAX, SEARCH_BEAM = 32, 48, 1.2, 128
BATCH = 256
WIDTH = 4


def _distances(points: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of targets[i] to points[ids[i, j]]; missing ids (-1) are infinitely far."""
    near = points[np.maximum(ids, 0)]
    gaps = np.einsum("ijk,ijk->ij", near, near) - 2 * np.einsum("ijk,ik->ij", near, targets) + np.einsum("ik,ik->i", targets, targets)[:, None]
    gaps[ids < 0] = np.inf
    return gaps


def beam_search(graph: np.ndarray, points: np.ndarray, targets: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` nearest points met, for all targets in step."""
    n, rows = len(targets), np.arange(len(targets))
    ids = np.full((n, beam), -1, dtype=np.int32)
    ids[:, 0] = entry
    far = _distances(points, ids, targets)
    done = ids < 0
    seen = np.zeros((n, len(points)), dtype=bool)
    seen[:, entry] = True
    while len(rows):
        waiting = np.where(done[rows], np.inf, far[rows])
        pick = np.argpartition(waiting, min(WIDTH, beam - 1), axis=1)[:, :WIDTH]
        open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
        going = open_.any(axis=1)
        rows, pick, open_ = rows[going], pick[going], open_[going]
        if not len(rows):
            break
        chosen = np.where(open_, ids[rows[:, None], pick], -1)
        flags = done[rows]
        np.put_along_axis(flags, pick, True, axis=1)
        done[rows] = flags
        new = np.where(chosen[:, :, None] >= 0, graph[np.maximum(chosen, 0)], -1).reshape(len(rows), -1)
        new[(new >= 0) & seen[rows[:, None], np.maximum(new, 0)]] = -1
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        at, column = np.nonzero(new >= 0)
        seen[rows[at], new[at, column]] = True
        all_ids = np.concatenate([ids[rows], new], axis=1)
        all_far = np.concatenate([far[rows], _distances(points, new, targets[rows])], axis=1)
        all_done = np.concatenate([done[rows], new < 0], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, best, 1)
        far[rows] = np.take_along_axis(all_far, best, 1)
        done[rows] = np.take_along_axis(all_done, best, 1)
    return ids, far


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """For each owner at most ``degree`` candidates, nearest first; a kept one removes
    the candidates that lie ``relax`` times nearer to it than to the owner."""
    candidates = np.sort(np.where(candidates == owners[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    own = _distances(points, candidates, points[owners])
    order = np.argsort(own, axis=1)
    candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    near = points[np.maximum(candidates, 0)]
    norms = np.einsum("ijk,ijk->ij", near, near)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    kept = np.full((len(owners), degree), -1, dtype=np.int32)
    alive, rows = np.isfinite(own), np.arange(len(owners))
    for slot in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        kept[some, slot] = candidates[some, first[some]]
        alive &= relax * relax * between[rows, first] > own
        alive[rows, first] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """(neighbours, entry point) of distinct points."""
    n = len(points)
    random = np.random.default_rng(n)
    if n <= degree + 1:
        graph = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        graph[np.arange(n), np.arange(n)] = -1
        return graph, 0
    graph = random.integers(0, n, (n, degree), dtype=np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    for alpha in (1.0, relax):
        order = random.permutation(n)
        for start in range(0, n, BATCH):
            owners = order[start : start + BATCH]
            found, _ = beam_search(graph, points, points[owners], entry, beam)
            graph[owners] = robust_prune(points, owners, np.concatenate([found, graph[owners]], axis=1), alpha, degree)
            source, target = np.repeat(owners, degree), graph[owners].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads, first, counts = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(heads), counts.max()), -1, dtype=np.int32)
            back[np.repeat(np.arange(len(heads)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
            wide = np.concatenate([graph[heads], back], axis=1)
            wide.sort(axis=1)
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            full = (wide >= 0).sum(axis=1) > degree
            wide = -np.sort(-wide, axis=1)
            graph[heads[~full]] = wide[~full, :degree]
            for part in range(0, int(full.sum()), BATCH):
                some = np.flatnonzero(full)[part : part + BATCH]
                graph[heads[some]] = robust_prune(points, heads[some], wide[some], alpha, degree)
    return graph, entry


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Points whose distances from (query, 0) order like the inner products, descending."""
    squares = (vectors * vectors).sum(axis=1)
    last = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.concatenate([vectors, last[:, None]], axis=1).astype(np.float32)


def _build(table: pa.Table) -> pa.Table:
    """One row per shard: distinct vectors, their ids (smallest first) and the graph."""
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    ids = table.column("vec_id").to_numpy()
    vectors = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), dim)
    distinct, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.lexsort((ids, which))
    starts = np.searchsorted(which[order], np.arange(len(distinct) + 1)).astype(np.int64)
    scale = np.abs(distinct).max()  # keeps the graph's single precision in range; scores use the originals
    graph, entry = build_graph(_lifted(distinct / scale))
    return pa.table(
        {"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "entry": pa.array([entry], pa.int32()),
         "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), "starts": pa.array([starts.tobytes()], pa.binary()),
         "vectors": pa.array([distinct.tobytes()], pa.binary()), "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary())}
    )


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, coordinates added from first to last."""
    total = np.zeros(vectors.shape[:2])
    for k in range(queries.shape[1]):
        total += queries[:, None, k] * vectors[:, :, k]
    return total


def _search(k: int, beam: int):
    def answers(index: dict, query_ids: np.ndarray, queries: np.ndarray):
        vectors, ids, starts = index["vectors"], index["ids"], index["starts"]
        out = ([], [], [])
        for begin in range(0, len(queries), BATCH):
            part, part_ids = queries[begin : begin + BATCH], query_ids[begin : begin + BATCH]
            norms = np.abs(part).max(axis=1, keepdims=True)
            targets = np.concatenate([part / norms, np.zeros((len(part), 1))], axis=1).astype(np.float32)
            found, _ = beam_search(index["graph"], index["points"], targets, index["entry"], beam)
            scores = exact_scores(part, vectors[np.maximum(found, 0)])
            scores[found < 0] = -np.inf
            for row in range(len(part)):
                best = []
                for j in np.argsort(-scores[row], kind="stable"):
                    if found[row, j] < 0 or len(best) > k and scores[row, j] < best[k][0]:
                        break
                    # Of copies of one vector only the k + 1 smallest ids can be among the nearest k.
                    here = ids[starts[found[row, j]] : min(starts[found[row, j] + 1], starts[found[row, j]] + k + 1)]
                    best += [(scores[row, j], i) for i in here.tolist()]
                best = sorted((x for x in best if x[1] != part_ids[row]), key=lambda x: (-x[0], x[1]))[:k]
                out[0].extend([int(part_ids[row])] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(s for s, _ in best)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, place = None, None
        for batch in batches:
            places = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), strict=True))
            start = 0
            while start < len(places):
                end = start
                while end < len(places) and places[end] == places[start]:
                    end += 1
                part, (dim, shard, kind) = batch.slice(start, end - start), places[start]
                start = end
                if kind == 0:
                    row, place = part.slice(0, 1).to_pylist()[0], (dim, shard)
                    vectors = np.frombuffer(row["vectors"]).reshape(-1, dim)
                    index = {
                        "vectors": vectors, "points": _lifted(vectors / np.abs(vectors).max()), "ids": np.frombuffer(row["ids"], np.int64),
                        "starts": np.frombuffer(row["starts"], np.int64), "graph": np.frombuffer(row["graph"], np.int32).reshape(len(vectors), -1), "entry": row["entry"],
                    }
                elif place == (dim, shard):
                    flat = np.asarray(part.column("v").flatten(), dtype=np.float64).reshape(len(part), dim)
                    yield answers(index, part.column("vec_id").to_numpy(), flat)
                else:
                    raise ValueError(f"no index for shard {shard}")

    return run


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part.

    Left out: null ids, null, empty or zero vectors, vectors holding null or
    non-finite components. Repeated rows of an id count once; of different
    vectors of one id the smallest counts.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def build_index(table: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards, written to the shared folder; every usable row is in one."""
    rows = usable(table)
    shards = max(1, -(-rows.count() // shard_rows))
    placed = with_workers(rows).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    built = placed.groupBy("dim", "shard").applyInArrow(
        _build, "dim int, shard int, entry int, ids binary, starts binary, vectors binary, graph binary"
    )
    return stored(built, "graphs")


def nearest(queries: DataFrame, index: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` best of each query (vec_id, embedding) over all shards of its dimension.

    Returns query_id, rank, vec_id and score (inner product); a vector of the
    query's own id is left out. Shards stream their queries, so a task holds one
    graph and one batch.
    """
    wanted = usable(queries).join(index.select("dim", "shard"), "dim")
    rows = index.withColumns({"kind": F.lit(0), "vec_id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>")}).unionByName(
        wanted.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    tasks = max(1, index.select("dim", "shard").count())
    found = (
        with_workers(rows).repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        .mapInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Search the table for its rows whose id ``every`` divides."""
    return nearest(table.where(F.col("vec_id") % every == 0), build_index(table), k)
