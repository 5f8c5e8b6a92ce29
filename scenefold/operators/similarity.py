"""Similarity fits as mergeable sums.

A fit of any number of correspondences is one aggregation per key (weighted
moments about a per-key shift, combined map-side) followed by a batched 3x3
solve on one row per key. No task ever holds the correspondences of a seam.

Correspondences have ``sx, sy, sz`` (source), ``tx, ty, tz`` (target), ``w``
and optionally the target normal ``tnx, tny, tnz``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import StitchError
from ..functions import cameras as C
from ..functions import linalg
from ..functions import vectors as V
from ..functions.types import SIM3
from ..session import BROADCAST_ROWS, settle
from ..settings import SeamGate
from .common import equi
from .quantiles import GROUP_ROWS, statistics, upper_median_of

_S, _T = ("sx", "sy", "sz"), ("tx", "ty", "tz")
_CROSS = [(a, b) for a in range(3) for b in range(3)]
_SELF = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
MOMENTS = (
    ["w_sum"] + [f"m_{c}" for c in _S + _T] + [f"st_{a}{b}" for a, b in _CROSS] + [f"ss_{a}{b}" for a, b in _SELF]
)
_SHIFT = [f"o_{c}" for c in _S + _T]


def with_shift(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the plain mean of each key; moments about it do not cancel badly."""
    means = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"o_{c}") for c in _S + _T])
    return equi(pairs, means, keys)


def _settled_pairs(pairs: DataFrame, keys: list[str], columns: list[str]):
    """The pairs, written once; their shift as a table of one row per key; a join on tables of that size; whether the groups are small.

    The join sends such a table to every task where the keys are few, so that the
    pairs of a long seam are not shuffled once per round.
    """
    base = settle(pairs.select(*keys, *columns))
    means = settle(base.groupBy(*keys).agg(*[F.avg(c).alias(f"o_{c}") for c in _S + _T], F.count(F.lit(1)).alias("_n")))
    size = means.agg(F.max("_n"), F.count(F.lit(1))).first()
    few = bool(keys) and size[1] <= BROADCAST_ROWS

    def on_keys(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), keys) if few else equi(left, right, keys)

    return base, means.drop("_n"), on_keys, (size[0] or 0) <= GROUP_ROWS, few


def moment_sums(weight: Column) -> list[Column]:
    """The 22 sums of one fit, about the shift columns."""
    d = {c: F.col(c) - F.col(f"o_{c}") for c in _S + _T}
    sums = [F.sum(weight).alias("w_sum")]
    sums += [F.sum(weight * d[c]).alias(f"m_{c}") for c in _S + _T]
    sums += [F.sum(weight * d[_S[a]] * d[_T[b]]).alias(f"st_{a}{b}") for a, b in _CROSS]
    sums += [F.sum(weight * d[_S[a]] * d[_S[b]]).alias(f"ss_{a}{b}") for a, b in _SELF]
    return sums + [F.first(o).alias(o) for o in _SHIFT]


def _centred(batch: pd.DataFrame):
    total = batch["w_sum"].to_numpy()
    safe = np.where(total > 0, total, 1.0)
    means = batch[[f"m_{c}" for c in _S + _T]].to_numpy() / safe[:, None]
    ms, mt = means[:, :3], means[:, 3:]
    cross = batch[[f"st_{a}{b}" for a, b in _CROSS]].to_numpy().reshape(-1, 3, 3)
    cross = cross - total[:, None, None] * ms[:, :, None] * mt[:, None, :]
    spread = linalg.symmetric_from_upper(batch[[f"ss_{a}{b}" for a, b in _SELF]].to_numpy(), 3)
    spread = spread - total[:, None, None] * ms[:, :, None] * ms[:, None, :]
    shift = batch[_SHIFT].to_numpy()
    return total, cross, spread, ms + shift[:, :3], mt + shift[:, 3:]


def _fit(batch: pd.DataFrame, strict: bool) -> pd.DataFrame:
    total, cross, spread, source_mean, target_mean = _centred(batch)
    rotation = linalg.horn_rotation(np.nan_to_num(cross))
    energy = np.trace(spread, axis1=1, axis2=2)
    matched = np.einsum("nij,nji->n", rotation, cross)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = matched / energy
    usable = np.isfinite(total) & (total > 0)
    if strict:
        # A line of points cannot fix a rotation: its covariance has a vanishing
        # second invariant. A plane of points can.
        second = (energy**2 - np.einsum("nij,nji->n", spread, spread)) / 2
        usable &= (energy > 1e-14) & np.isfinite(second) & (second > energy**2 * 1e-10)
        usable &= np.isfinite(scale) & (scale > 0)
    else:
        # The relative profile keeps going with neutral parts instead.
        vague = np.linalg.norm(cross, axis=(1, 2)) <= 1e-30
        rotation[vague] = linalg.EYE3
        scale = np.where((energy > 1e-30) & np.isfinite(scale) & (scale > 0), scale, 1.0)
    shift = target_mean - scale[:, None] * np.einsum("nij,nj->ni", rotation, source_mean)
    rows = {
        "scale": np.where(usable, scale, np.nan),
        "rotation": [r if ok else None for r, ok in zip(rotation.reshape(-1, 9).tolist(), usable)],
        "translation": [t if ok else None for t, ok in zip(shift.tolist(), usable)],
    }
    frame = pd.DataFrame(rows)
    frame["scale"] = frame["scale"].where(usable, None)
    return frame


@F.pandas_udf(SIM3)
def _strict_fit(batch: pd.DataFrame) -> pd.DataFrame:
    return _fit(batch, True)


@F.pandas_udf(SIM3)
def _neutral_fit(batch: pd.DataFrame) -> pd.DataFrame:
    return _fit(batch, False)


def solve(sums: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """One similarity per row of sums; NULL parts where the geometry is degenerate."""
    udf = _strict_fit if strict else _neutral_fit
    packed = F.struct(*MOMENTS, *_SHIFT)
    return sums.withColumn("_fit", udf(packed)).select(*keys, *[c for c in sums.columns if c not in
                           [*keys, *MOMENTS, *_SHIFT]], "_fit.*")


def fit_similarity(pairs: DataFrame, keys: list[str], strict: bool = True, weight: str = "w") -> DataFrame:
    """Weighted least-squares similarity per key."""
    sums = with_shift(pairs, keys).groupBy(*keys).agg(*moment_sums(F.col(weight)), F.count(F.lit(1)).alias("pairs"))
    return solve(sums, keys, strict)


def residual(prefix: str = "") -> Column:
    """Distance of the transformed source to the target, transform columns attached."""
    moved = C.sim3_apply(C.sim3(prefix), V.vec(*_S))
    return V.length(V.sub(moved, V.vec(*_T)))


# --- trimming fit --------------------------------------------------------

def _plane_sums() -> list[Column]:
    n = V.vec("tnx", "tny", "tnz")
    size = V.length(n)
    usable = F.coalesce(V.finite(size) & (size >= 0.5), F.lit(False))
    n = V.scale(n, 1 / F.when(usable, size))
    p = C.sim3_apply(C.sim3(), V.vec(*_S))
    r = V.dot(n, V.sub(p, V.vec(*_T)))
    row = [*n, *V.cross(p, n)]
    w = F.when(usable, F.col("w"))
    sums = [F.sum(w * row[i] * row[j]).alias(f"h_{i}{j}") for i in range(6) for j in range(i, 6)]
    sums += [F.sum(-w * row[i] * r).alias(f"g_{i}") for i in range(6)]
    return sums + [F.count(w).alias("usable")]


@F.pandas_udf(SIM3)
def _plane_step(batch: pd.DataFrame) -> pd.DataFrame:
    """Ridge-regularised point-to-plane correction composed onto each transform."""
    upper = batch[[f"h_{i}{j}" for i in range(6) for j in range(i, 6)]].to_numpy(dtype=float)
    system = linalg.symmetric_from_upper(np.nan_to_num(upper), 6) + 1e-6 * np.eye(6)
    right = np.nan_to_num(batch[[f"g_{i}" for i in range(6)]].to_numpy(dtype=float))
    step = np.linalg.solve(system, right[..., None])[..., 0]
    angle = np.linalg.norm(step[:, 3:], axis=1)
    apply_ = (batch["usable"].to_numpy() >= 6) & np.isfinite(step).all(axis=1) & (angle <= 0.1)
    turn = linalg.so3_exp(step[:, 3:])
    out_rotation, out_translation = [], []
    for ok, correction, shift, rotation, translation in zip(apply_, turn, step[:, :3], batch["rotation"], batch["translation"]):
        if rotation is None or not ok:
            out_rotation.append(rotation)
            out_translation.append(translation)
            continue
        out_rotation.append((correction @ np.asarray(rotation).reshape(3, 3)).ravel().tolist())
        out_translation.append((correction @ np.asarray(translation) + shift).tolist())
    return pd.DataFrame({"scale": batch["scale"], "rotation": out_rotation, "translation": out_translation})


def robust_fit(pairs: DataFrame, keys: list[str], refine: bool = True, rounds: int = 3) -> DataFrame:
    """Trimmed similarity per key.

    Each round fits the current inliers and keeps those within three times the
    upper-median residual; a key stops when fewer than three would stay or
    nothing changes. A point-to-plane step follows where normals allow.
    Returns the transform, ``correspondence_count``, ``inlier_count``,
    ``rms_residual`` and ``normalized_rms_residual``.
    """
    if "tnx" not in pairs.columns:
        pairs = pairs.withColumns({c: F.lit(None).cast("double") for c in ("tnx", "tny", "tnz")})
    base, known, on_keys, small, few = _settled_pairs(pairs, keys, [*_S, *_T, "w", "tnx", "tny", "tnz"])
    names = ("scale", "rotation", "translation")
    # The pairs are never rewritten: ``known`` has, per key, the transform and limit
    # of every round that trimmed it, and an inlier is within all of these limits.
    known, trims = known.withColumn("_open", F.lit(True)), []

    def marked() -> DataFrame:
        inside = F.lit(True)
        for trim in trims:
            within = F.coalesce(residual(trim) <= F.col(f"{trim}limit"), F.lit(False))
            inside = inside & (F.col(f"{trim}limit").isNull() | within)
        spent = [f"{trim}{n}" for trim in trims for n in (*names, "limit")]
        return on_keys(base, known).withColumn("_in", inside).drop("_open", *spent)

    for index in range(rounds):
        work, trim = marked(), f"_t{index}_"
        fit = settle(solve(work.filter("_in").groupBy(*keys).agg(*moment_sums(F.col("w"))), keys))
        measured = on_keys(work, fit).withColumn("_r", residual())
        if small:
            middle = measured.filter("_in").groupBy(*keys).agg(upper_median_of("_r").alias("_middle"))
        else:
            middle = statistics(measured.filter("_in"), keys, {"_middle": ("_r", None)}, few=few)
        limits = settle(on_keys(fit, middle).withColumn(f"{trim}limit", F.greatest(3 * F.col("_middle"), F.lit(1e-5))).drop("_middle"))
        near = F.col("_in") & (F.col("_r") <= F.col(f"{trim}limit"))
        counts = on_keys(measured, limits.select(*keys, f"{trim}limit")).groupBy(*keys).agg(
            F.sum(F.col("_in").cast("long")).alias("_before"), F.sum(near.cast("long")).alias("_after")
        )
        stops = (F.col("_after") < 3) | (F.col("_after") == F.col("_before"))
        advance = F.col("_open") & ~F.coalesce(stops, F.lit(True))
        decided = equi(equi(known, limits.withColumnsRenamed({n: f"{trim}{n}" for n in names}), keys), counts, keys)
        decided = decided.withColumn("_open", advance)
        known = settle(decided.withColumn(f"{trim}limit", F.when(F.col("_open"), F.col(f"{trim}limit"))).drop("_before", "_after"))
        trims.append(trim)
        if not known.filter("_open").limit(1).count():
            break
    work = marked()
    inliers = work.filter("_in")
    fit = settle(solve(inliers.groupBy(*keys).agg(*moment_sums(F.col("w"))), keys))
    if refine:
        sums = on_keys(inliers, fit).groupBy(*keys).agg(
            *_plane_sums(), *[F.first(c).alias(c) for c in ("scale", "rotation", "translation")]
        )
        packed = F.struct(*[c for c in sums.columns if c not in keys])
        fit = settle(sums.withColumn("_fit", _plane_step(packed)).select(*keys, "_fit.*"))
    return _summarised(work, fit, keys, on_keys)


def _summarised(work: DataFrame, fit: DataFrame, keys: list[str], on_keys) -> DataFrame:
    r = residual()
    spread = [F.var_pop(F.when(F.col("_in"), F.col(c))) for c in _T]
    summary = on_keys(work, fit).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("scale", "rotation", "translation")],
        F.count(F.lit(1)).alias("correspondence_count"),
        F.sum(F.col("_in").cast("long")).alias("inlier_count"),
        F.sqrt(F.avg(F.when(F.col("_in"), r * r))).alias("rms_residual"),
        F.sqrt(spread[0] + spread[1] + spread[2]).alias("_extent"),
    )
    return summary.withColumn(
        "normalized_rms_residual",
        F.when((F.col("_extent") > 1e-9) & (F.col("inlier_count") >= 3), F.col("rms_residual") / F.col("_extent")),
    ).drop("_extent")


# --- Huber fit -----------------------------------------------------------

def huber_fit(pairs: DataFrame, keys: list[str], rounds: int = 8) -> DataFrame:
    """Iteratively reweighted similarity per key, tolerant of flat geometry.

    The Huber width follows the upper-median residual of each round; a key
    stops once its transform moves by less than 1e-12. Returns the transform,
    the weighted RMS and the pair count.
    """
    base, shift, on_keys, small, few = _settled_pairs(pairs, keys, [*_S, *_T, "w"])
    names = ("scale", "rotation", "translation")
    delta = F.col("_delta")
    # State of a round, one row per key: the transform and Huber width that
    # define the next weights. The pairs themselves are never rewritten.
    state, final = None, None
    for index in range(rounds):
        if state is None:
            weighted = on_keys(base, shift).withColumn("_weight", F.col("w"))
        else:
            r = residual()
            weighted = on_keys(base, equi(shift, state.filter("_open"), keys)).withColumn(
                "_weight", F.col("w") * F.when(r <= delta, 1.0).otherwise(delta / r)
            ).drop(*names, "_delta", "_open")
        sums = weighted.groupBy(*keys).agg(*moment_sums(F.col("_weight")), F.count(F.lit(1)).alias("pairs"))
        d = [(F.col(f"ss_{a}{a}") - F.col(f"m_{_S[a]}") * F.col(f"m_{_S[a]}") / F.col("w_sum")) for a in range(3)]
        sums = sums.withColumn("_scene", F.sqrt(F.greatest(d[0] + d[1] + d[2], F.lit(0.0)) / F.col("pairs")))
        fit = settle(solve(sums, keys, strict=False))
        measured = on_keys(base, fit).withColumn("_r", residual())
        if small:
            middle = measured.groupBy(*keys).agg(upper_median_of("_r").alias("_middle"))
        else:
            middle = statistics(measured, keys, {"_middle": ("_r", None)}, few=few)
        width = F.greatest(1.345 * F.col("_middle"), 1e-6 * F.col("_scene") + 1e-30)
        fresh = equi(fit, middle, keys).select(*keys, *names, width.alias("_delta"))
        if state is None:
            merged = fresh.withColumn("_open", F.lit(True))
        else:
            old = state.filter("_open").select(*keys, *[F.col(n).alias(f"_old_{n}") for n in names])
            moved = F.abs(F.col("scale") - F.col("_old_scale"))
            for n in ("rotation", "translation"):
                gap = F.zip_with(n, f"_old_{n}", lambda a, b: F.abs(a - b))
                moved = moved + F.aggregate(gap, F.lit(0.0), lambda a, b: a + b)
            merged = equi(fresh, old, keys).select(
                *keys, *names, "_delta", (moved >= 1e-12).alias("_open")
            ).unionByName(state.filter(~F.col("_open")))
        state = settle(merged)
        if index + 1 == rounds or not state.filter("_open").limit(1).count():
            break
    r = residual()
    weight = F.col("w") * F.when(r <= delta, 1.0).otherwise(delta / r)
    return on_keys(base, state).groupBy(*keys).agg(
        *[F.first(n).alias(n) for n in names],
        F.count(F.lit(1)).alias("pairs"),
        F.sqrt(F.sum(weight * r * r) / F.sum(weight)).alias("rms_residual"),
    )


# --- provider alignment --------------------------------------------------

def provider_fit(pairs: DataFrame, keys: list[str], rounds: int = 6, minimum: int = 12) -> DataFrame:
    """Alignment of two camera trajectories, trimmed against their extent.

    The threshold of a round is ``max(3 median, 0.03 extent, 1e-5)`` with the
    true median of all residuals; fewer than ``minimum`` inliers is NULL.
    """
    base, shift, on_keys, _, few = _settled_pairs(pairs.withColumn("w", F.lit(1.0)), keys, [*_S, *_T, "w"])
    names = ("scale", "rotation", "translation")
    span = [F.max(c) - F.min(c) for c in _T]
    extent = settle(base.groupBy(*keys).agg(F.sqrt(span[0] ** 2 + span[1] ** 2 + span[2] ** 2).alias("_extent")))
    # The inliers follow from the transform and limit of the last round, so the pairs are written once.
    last = None

    def marked() -> DataFrame:
        if last is None:
            return on_keys(base, shift).withColumn("_in", F.lit(True))
        inside = F.coalesce(residual("_last_") <= F.col("_last_limit"), F.lit(False))
        return on_keys(base, equi(shift, last, keys)).withColumn("_in", inside).drop("_last_limit", *[f"_last_{n}" for n in names])

    for _ in range(rounds):
        work = marked()
        fit = settle(solve(work.filter("_in").groupBy(*keys).agg(*moment_sums(F.col("w"))), keys))
        measured = on_keys(work, fit).withColumn("_r", residual())
        middle = statistics(measured, keys, {"_middle": ("_r", 0.5)}, few=few)
        limit = F.greatest(3 * F.col("_middle"), 0.03 * F.col("_extent"), F.lit(1e-5))
        fresh = settle(equi(equi(fit, middle, keys), extent, keys).withColumn("_last_limit", limit).drop("_middle", "_extent"))
        compared = on_keys(measured, fresh.select(*keys, "_last_limit"))
        changed = compared.filter(F.col("_in") != F.coalesce(F.col("_r") <= F.col("_last_limit"), F.lit(False))).limit(1).count()
        last = fresh.withColumnsRenamed({n: f"_last_{n}" for n in names})
        if not changed:
            break
    work = marked()
    fit = settle(solve(work.filter("_in").groupBy(*keys).agg(*moment_sums(F.col("w"))), keys))
    summary = _summarised(work, fit, keys, on_keys)
    enough = F.col("inlier_count") >= minimum
    return summary.withColumns({n: F.when(enough, F.col(n)) for n in ("scale", "rotation", "translation")})


# --- gates ---------------------------------------------------------------

def seam_violations(alignments: DataFrame, gate: SeamGate = SeamGate()) -> DataFrame:
    """Alignments that must stop a reconstruction, with the reasons."""
    ratio = F.col("inlier_count") / F.col("correspondence_count")
    normalized = F.col("normalized_rms_residual")
    reasons = F.array_compact(F.array(
        F.when(F.col("scale").isNull(), "degenerate geometry"),
        F.when(F.col("correspondence_count") < gate.minimum_correspondences, "too few correspondences"),
        F.when(ratio < gate.minimum_inlier_ratio, "inlier ratio"),
        F.when(~F.coalesce(V.finite(normalized) & (normalized <= gate.maximum_normalized_rms), F.lit(False)), "residual"),
        F.when(~F.col("scale").between(gate.minimum_scale, gate.maximum_scale), "scale"),
    ))
    return alignments.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def require_seams(alignments: DataFrame, gate: SeamGate = SeamGate()) -> DataFrame:
    bad = seam_violations(alignments, gate).limit(5).collect()
    if bad:
        raise StitchError(f"seam gate: {[row.asDict() for row in bad]}")
    return alignments


def loop_gate(alignments: DataFrame, minimum: int, ratio: float, rms: float) -> DataFrame:
    """Loop measurements that may enter the graph; scale is reset to 1."""
    good = (
        (F.col("correspondence_count") >= minimum)
        & (F.col("inlier_count") / F.col("correspondence_count") >= ratio)
        & (F.col("rms_residual") <= rms)
        & F.col("scale").isNotNull()
    )
    return alignments.filter(good).withColumn("scale", F.lit(1.0))
