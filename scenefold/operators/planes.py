"""Dominant planes, their supported cells and a mesh over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import ArchitectureError
from ..functions import cameras as C
from ..functions import hashing, linalg
from ..functions import vectors as V
from ..session import settle
from ..settings import ArchitectureSettings
from .ordering import global_index, stride_for_cap, stride_sample
from .surface import bounds, valid_surfel


@dataclass(frozen=True)
class Plane:
    normal: tuple[float, float, float]
    offset: float
    support: int

    def distance(self) -> Column:
        n = V.vec(*[F.lit(v) for v in self.normal])
        return F.abs(V.dot(n, V.vec("x", "y", "z")) - self.offset)


#: Rows of the blocks by which points that are left are counted.
BLOCK_ROWS = 1_024


def canonical(normal: np.ndarray) -> np.ndarray:
    axis = 2 - int(np.argmax(np.abs(normal)[::-1]))
    return -normal if normal[axis] < 0 else normal


def fit_plane(points: DataFrame, minimum_rank: int = 1) -> tuple[tuple[float, float, float], float] | None:
    """Least-squares plane; the covariance is one mergeable aggregate."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    row = points.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in "xyz"],
        *[F.covar_pop(a, b).alias(a + b) for a, b in pairs],
    ).first()
    if row["n"] < 3:
        return None
    covariance = linalg.symmetric_from_upper(np.array([row[a + b] for a, b in pairs], dtype=float), 3)
    values, vectors = np.linalg.eigh(covariance)
    if not np.isfinite(values).all() or (values > 1e-12 * max(values[-1], 1e-300)).sum() < minimum_rank:
        return None
    normal = canonical(vectors[:, 0])
    return tuple(float(v) for v in normal), float(normal @ np.array([row[a] for a in "xyz"]))


def hypothesis_support(points: DataFrame, normals: np.ndarray, offsets: np.ndarray, tolerance: float) -> np.ndarray:
    """Inlier count of every plane hypothesis.

    The hypotheses are a fixed few hundred rows of constants; each Arrow batch
    counts all of them at once and only the counts are shuffled.
    """
    count = len(normals)

    def score(batches):
        total = np.zeros(count, dtype=np.int64)
        for batch in batches:
            xyz = batch[["x", "y", "z"]].to_numpy()
            total += (np.abs(xyz @ normals.T - offsets) <= tolerance).sum(axis=0)
        yield pd.DataFrame({"h": np.arange(count), "n": total})

    partial = points.select("x", "y", "z").mapInPandas(score, "h long, n long")
    found = {row["h"]: row["n"] for row in partial.groupBy("h").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(h, 0) for h in range(count)], dtype=np.int64)


def _blocks(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of ``ordinal`` that hold points, and how many: one row per BLOCK_ROWS of the input."""
    counted = points.groupBy(F.floor(F.col("ordinal") / BLOCK_ROWS).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("b")
    return counted["b"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.int64)


def _at_places(points: DataFrame, blocks: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> dict[int, np.ndarray]:
    """The points at the given places in the order of ``ordinal``, which may have gaps.

    The counts tell the block of a place; only those blocks are numbered.
    """
    numbers, counts = blocks
    ends = np.cumsum(counts)
    at = np.searchsorted(ends, wanted, side="right")
    inside = wanted - (ends[at] - counts[at])
    block = F.floor(F.col("ordinal") / BLOCK_ROWS)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("ordinal")) - 1
    # Block and rank as one number.
    pairs = {int(numbers[i]) * BLOCK_ROWS + int(r): int(w) for i, r, w in zip(at, inside, wanted, strict=True)}
    numbered = points.select("ordinal", "x", "y", "z", block.alias("_b")).filter(F.col("_b").isin(sorted({int(numbers[i]) for i in at})))
    place = F.col("_b") * BLOCK_ROWS + rank
    rows = numbered.withColumn("_place", place).filter(F.col("_place").isin(sorted(pairs))).select("_place", "x", "y", "z").collect()
    return {pairs[r["_place"]]: np.array([r["x"], r["y"], r["z"]]) for r in rows}


def _hypotheses(points: DataFrame, blocks: tuple[np.ndarray, np.ndarray], trials: int):
    """Trial numbers, unit normals and offsets of reproducible three-point planes."""
    picks = hashing.index_for_seed(np.arange(1, 3 * trials + 1), int(blocks[1].sum())).reshape(trials, 3)
    distinct = (picks[:, 0] != picks[:, 1]) & (picks[:, 0] != picks[:, 2]) & (picks[:, 1] != picks[:, 2])
    at = _at_places(points, blocks, np.unique(picks[distinct].astype(np.int64)))
    kept, normals, offsets = [], [], []
    for trial in np.flatnonzero(distinct):
        a, b, c = (at[int(i)] for i in picks[trial])
        normal = np.cross(b - a, c - a)
        area = np.linalg.norm(normal)
        if not np.isfinite(area) or area <= 0:
            continue
        normal = canonical(normal / area)
        kept.append(int(trial))
        normals.append(normal)
        offsets.append(float(normal @ a))
    return kept, np.array(normals).reshape(-1, 3), np.array(offsets)


def hypothesis_table(points: DataFrame, trials: int, tolerance: float) -> DataFrame:
    """Support of every usable three-point plane, one row per trial."""
    kept, normals, offsets = _hypotheses(points, _blocks(points), trials)
    support = hypothesis_support(points, normals, offsets, tolerance)
    return points.sparkSession.createDataFrame([(t, int(n)) for t, n in zip(kept, support)], "trial long, support long")


def seed_plane(points: DataFrame, blocks: tuple[np.ndarray, np.ndarray], tolerance: float, trials: int):
    """Best of ``trials`` reproducible three-point planes over rows in the order of ``ordinal``."""
    _, normals, offsets = _hypotheses(points, blocks, trials)
    if not len(normals):
        return None
    support = hypothesis_support(points, normals, offsets, tolerance)
    best = int(np.argmax(support))
    return (tuple(float(v) for v in normals[best]), float(offsets[best])) if support[best] > 0 else None


def plane_cells(points: DataFrame, plane: Plane, edge: float, minimum_support: int, index: int = 0) -> DataFrame:
    """Surfels of the plane cells holding enough points; other cells stay holes.

    A frame of -1 or NULL is unknown and never wins against a known frame.
    """
    n = V.vec(*[F.lit(v) for v in plane.normal])
    u, v = C.plane_basis(n)
    p = V.vec("x", "y", "z")
    frame = F.when(F.col("first_observing_frame") >= 0, F.col("first_observing_frame"))
    placed = points.withColumns({"_u": V.dot(u, p), "_v": V.dot(v, p), "_f": frame})
    cells = placed.groupBy(F.floor(F.col("_u") / edge).alias("cu"), F.floor(F.col("_v") / edge).alias("cv")).agg(
        F.count(F.lit(1)).alias("contributors"), F.avg("_u").alias("_mu"), F.avg("_v").alias("_mv"),
        ((F.sum("r") + F.sum("g") + F.sum("b")) / (3.0 * F.count(F.lit(1)))).alias("_tone"),
        F.avg(F.greatest("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce(F.min("_f"), F.lit(-1)).alias("first_observing_frame"),
    ).filter(F.col("contributors") >= minimum_support)
    where = V.add(V.scale(n, F.lit(plane.offset)), V.add(V.scale(u, F.col("_mu")), V.scale(v, F.col("_mv"))))
    tone = F.floor(F.least(F.greatest("_tone", F.lit(70.0)), F.lit(225.0)))
    return cells.select(
        F.lit(index).alias("plane"), "cu", "cv", *[c.alias(a) for c, a in zip(where, "xyz")],
        *[c.alias(a) for c, a in zip(n, ("nx", "ny", "nz"))],
        (tone - 16).cast("short").alias("r"), tone.cast("short").alias("g"), (tone - 24).cast("short").alias("b"),
        "confidence", F.lit(0.78 * edge).alias("radius"), "first_observing_frame", "contributors",
    )


def extract_planes(points: DataFrame, order: list[str], settings: ArchitectureSettings = ArchitectureSettings()):
    """Dominant planes by repeated three-point search; returns (planes, surfels).

    A supported plane that yields no cell is recorded nowhere, but its points
    still leave the search, so the search always ends.

    The points are ordered and written once. What a round leaves is a filter on them,
    and its places are found by counts of blocks.
    """
    if not ((settings.maximum_source_points is None or settings.maximum_source_points > 2) and settings.maximum_planes > 0 and settings.plane_distance_fraction > 0
            and settings.cell_size_fraction > 0 and settings.trials_per_plane > 0 and settings.minimum_cell_support > 0):
        raise ArchitectureError("plane settings are out of range")
    finite = points.filter(valid_surfel())
    extent = bounds(finite).first()["diagonal"]
    empty = plane_cells(finite.limit(0), Plane((0.0, 0.0, 1.0), 0.0, 0), 1.0, 1)
    if not extent or extent <= 2.0**-23:
        return [], empty
    tolerance = max(extent * settings.plane_distance_fraction, 1e-5)
    edge = max(extent * settings.cell_size_fraction, tolerance * 1.5)
    if settings.maximum_source_points is not None:
        finite = stride_sample(finite, order, stride_for_cap(finite.count(), settings.maximum_source_points))
    needed = ["x", "y", "z", "r", "g", "b", "confidence", "first_observing_frame"]
    ordered = finite.repartitionByRange(*order).sortWithinPartitions(*order).select(*needed)
    # Numbers that rise with the order and jump between tasks; a block stays within a task.
    remaining = settle(ordered.withColumn("ordinal", F.monotonically_increasing_id()))
    planes: list[Plane] = []
    surfels: list[DataFrame] = []
    while len(planes) < settings.maximum_planes:
        blocks = _blocks(remaining)
        if blocks[1].sum() < 3:
            break
        seed = seed_plane(remaining, blocks, tolerance, settings.trials_per_plane)
        if seed is None:
            break
        fitted = fit_plane(remaining.filter(Plane(*seed, 0).distance() <= tolerance))
        if fitted is None:
            break
        candidate = Plane(*fitted, 0)
        support = remaining.filter(candidate.distance() <= tolerance)
        count = support.count()
        if count < settings.minimum_plane_support:
            break
        cells = settle(plane_cells(support, candidate, edge, settings.minimum_cell_support, len(planes)))
        if cells.limit(1).count():
            planes.append(Plane(candidate.normal, candidate.offset, count))
            surfels.append(cells)
        remaining = remaining.filter(candidate.distance() > tolerance)
    result = empty
    for cells in surfels:
        result = result.unionByName(cells)
    return planes, result


def mesh_from_cells(cells: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Four vertices and two triangles per cell, numbered in ``order``."""
    good = valid_surfel() & V.positive(F.col("radius"))
    unit = V.normalize(V.vec("nx", "ny", "nz"))
    usable = cells.filter(good).withColumns(dict(zip(("nx", "ny", "nz"), unit))).filter("nx is not null")
    numbered = settle(global_index(usable, order, "cell"))
    n = V.vec("nx", "ny", "nz")
    numbered = V.columns(numbered, C.plane_basis(n)[0], ("_ux", "_uy", "_uz"))
    numbered = V.columns(numbered, V.cross(n, V.vec("_ux", "_uy", "_uz")), ("_vx", "_vy", "_vz"))
    half = F.col("radius") / 1.56
    signs = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    corners = F.array(*[
        F.struct(F.lit(i).alias("corner"), *[
            (F.col(a) + half * (su * F.col(f"_u{a}") + sv * F.col(f"_v{a}"))).alias(a) for a in "xyz"
        ]) for i, (su, sv) in enumerate(signs)
    ])
    vertices = numbered.withColumn("_c", F.explode(corners)).select(
        (F.col("cell") * 4 + F.col("_c.corner")).alias("vertex"), "_c.x", "_c.y", "_c.z", "nx", "ny", "nz", "r", "g", "b")
    order_ = F.array(*[F.lit(i) for i in (0, 1, 2, 0, 2, 3)])
    indices = numbered.select("cell", F.posexplode(order_).alias("slot", "corner")).select(
        (F.col("cell") * 6 + F.col("slot")).alias("position"), (F.col("cell") * 4 + F.col("corner")).alias("vertex"))
    return vertices, indices
