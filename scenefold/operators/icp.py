"""Point-to-plane refinement for many window pairs at once.

Every iteration matches blocks of sources with blocks of targets, adds 27 sums
per pair and makes a batched eigen-truncated solve. The blocks that may meet are
laid together once, with slack for small motions: a round moves one row of sums
for each block and the small transform table, not points. The layout is made
anew when a transform has moved points by more than the slack.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import cameras as C
from ..functions import linalg
from ..functions import vectors as V
from ..functions import types as K
from ..session import BROADCAST_ROWS, has_at_most, settle
from ..settings import IcpSettings
from .spatial import blocks, surface_normals

#: Points of a block of sources and of a block of targets; points of a task that cuts blocks.
SOURCE_ROWS, TARGET_ROWS, TASK_ROWS = 4096, 1024, 65536
#: Rows of a layout that are dealt to one task, on average.
LAYOUT_ROWS = 128
#: The part of the matching distance by which points may move in one layout.
SLACK = 1 / 16

_UPPER = [(i, j) for i in range(6) for j in range(i, 6)]
_STEP = K.struct(scale=K.DOUBLE, rotation=K.DOUBLES, translation=K.DOUBLES, step=K.DOUBLE, rank=K.LONG)


def _solver(tolerance: float):
    @F.pandas_udf(_STEP)
    def apply(batch: pd.DataFrame) -> pd.DataFrame:
        upper = batch[[f"h_{i}{j}" for i, j in _UPPER]].to_numpy(dtype=float)
        gradient = batch[[f"g_{i}" for i in range(6)]].to_numpy(dtype=float)
        step, rank = linalg.rank_truncated_solve(linalg.symmetric_from_upper(upper, 6), gradient, tolerance)
        turn = linalg.so3_exp(step[:, :3])
        rotation = turn @ np.array(batch["rotation"].tolist(), dtype=float).reshape(-1, 3, 3)
        shift = np.einsum("nij,nj->ni", turn, np.array(batch["translation"].tolist(), dtype=float)) + step[:, 3:]
        return pd.DataFrame({
            "scale": batch["scale"], "rotation": rotation.reshape(-1, 9).tolist(), "translation": shift.tolist(),
            "step": np.linalg.norm(step, axis=1), "rank": rank,
        })

    return apply


def _laid_together(asked: DataFrame, offered: DataFrame, distance: float, slack: float) -> DataFrame:
    """Rows of each block of sources: the block, then the blocks of targets that may hold a nearest point, by distance.

    Some target is no farther than the farthest corner of any box, so boxes beyond the
    least of these are left out. Points may move by ``slack`` afterwards.
    """
    box = lambda side: [f"{side}block", *[f"{side}{end}_{a}" for end in ("low", "high") for a in "xyz"]]
    gap = [F.greatest(F.col(f"tlow_{a}") - F.col(f"qhigh_{a}"), F.col(f"qlow_{a}") - F.col(f"thigh_{a}"), F.lit(0.0)) for a in "xyz"]
    far = [F.greatest(F.col(f"thigh_{a}") - F.col(f"qlow_{a}"), F.col(f"qhigh_{a}") - F.col(f"tlow_{a}")) for a in "xyz"]
    met = settle(asked.select("pair", *box("q")).join(offered.select("pair", *box("t")), "pair").select(
        "qblock", "tblock", V.length(gap).alias("gap"), V.length(far).alias("far")))
    sure = met.groupBy("qblock").agg(F.min("far").alias("sure"))
    # A little more than the bounds: only the points decide.
    limit = F.least(F.lit(distance + slack), F.col("sure") + 2 * slack) * (1 + 1e-9)
    kept = settle(met.join(sure, "qblock").filter(F.col("gap") <= limit).select("qblock", "tblock", "gap"))
    packed = [c for c in offered.columns if c not in ("pair", "tblock")]
    rows = asked.drop(*box("q")[1:]).withColumn("gap", F.lit(-1.0)).unionByName(
        kept.join(offered.select("pair", "tblock", *packed), "tblock").drop("tblock"), allowMissingColumns=True)
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), kept.count() // LAYOUT_ROWS)
    return _in_order(rows, tasks)


def _in_order(rows: DataFrame, tasks: int) -> DataFrame:
    return settle(rows.repartition(tasks, "qblock").sortWithinPartitions("qblock", "gap"))


class _Block:
    """Sources of a block under a transform and the nearest target found so far of each."""

    def __init__(self, row, distance: float):
        s = np.stack([np.frombuffer(getattr(row, f"q_s{a}")) for a in "xyz"], axis=1) * row.scale
        turn = np.asarray(row.rotation, dtype=float).reshape(3, 3)
        self.at = np.stack([turn[i, 0] * s[:, 0] + turn[i, 1] * s[:, 1] + turn[i, 2] * s[:, 2] + row.translation[i] for i in range(3)], axis=1)
        laid = np.stack([np.frombuffer(getattr(row, f"q_{a}")) for a in "xyz"], axis=1)
        self.pair, self.count, self.distance = row.pair, np.frombuffer(row.q_count), distance
        drift = np.linalg.norm(self.at - laid, axis=1)
        self.drift = float(drift.max()) if np.isfinite(drift).all() else np.inf
        self.best = np.full(len(s), np.inf)
        # Cell and id, which decide ties, then place and normal of the nearest target.
        self.order, self.target = np.zeros((len(s), 4), dtype=np.int64), np.full((len(s), 6), np.nan)

    def meet(self, row) -> None:
        low, high = (np.array([getattr(row, f"t{end}_{a}") for a in "xyz"]) for end in ("low", "high"))
        gap = np.maximum(np.maximum(low - self.at, self.at - high), 0.0)
        near = np.flatnonzero(gap[:, 0] ** 2 + gap[:, 1] ** 2 + gap[:, 2] ** 2 <= np.minimum(self.best, self.distance**2) * (1 + 1e-9))
        if not len(near):
            return
        t = np.stack([np.frombuffer(getattr(row, f"t_{c}")) for c in ("x", "y", "z", "nx", "ny", "nz")], axis=1)
        order = np.column_stack([np.floor(t[:, :3] / self.distance).astype(np.int64), np.frombuffer(row.t_tid, dtype=np.int64)])
        # Of equal distances the last cell wins, then the last id.
        last = np.lexsort((order[:, 3], order[:, 2], order[:, 1], order[:, 0]))[::-1]
        t, order = t[last], order[last]
        for start in range(0, len(near), 512):
            some = near[start:start + 512]
            d = [t[None, :, i] - self.at[some, None, i] for i in range(3)]
            d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            to = d2.argmin(axis=1)
            d2 = d2[np.arange(len(some)), to]
            better, tied = d2 < self.best[some], d2 == self.best[some]
            for c in range(4):
                better |= tied & (order[to, c] > self.order[some, c])
                tied &= order[to, c] == self.order[some, c]
            some, to, d2 = some[better], to[better], d2[better]
            self.best[some], self.order[some], self.target[some] = d2, order[to], t[to]

    def sums(self, delta: float) -> pd.DataFrame:
        hit = (self.best <= self.distance**2) & ~np.isnan(self.target[:, 3])
        p, t, n, count = self.at[hit], self.target[hit, :3], self.target[hit, 3:], self.count[hit]
        r = ((p - t) * n).sum(axis=1)
        size = np.abs(r)
        w = count * (np.where(size > delta, delta / np.where(size > 0, size, 1.0), 1.0) if delta > 0 else 1.0)
        row = np.column_stack([np.cross(p, n), n])
        matrix, gradient = (row * w[:, None]).T @ row, (row * w[:, None]).T @ r
        return pd.DataFrame([{
            "pair": self.pair, **{f"h_{i}{j}": matrix[i, j] for i, j in _UPPER}, **{f"g_{i}": gradient[i] for i in range(6)},
            "_found": int(count.sum()), "_square": float((count * r * r).sum()), "_drift": self.drift}])


def _matcher(distance: float, delta: float):
    def match(batches):
        number, block = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.qblock != number:
                    if block is not None:
                        yield block.sums(delta)
                    number, block = row.qblock, _Block(row, distance)
                else:
                    block.meet(row)
        if block is not None:
            yield block.sums(delta)

    return match


def icp_refine(sources: DataFrame, targets: DataFrame, initial: DataFrame, settings: IcpSettings = IcpSettings()) -> DataFrame:
    """Refine the source-to-target transform of every ``pair`` (an integer).

    ``sources``: pair, qid, x, y, z. ``targets``: pair, tid, x, y, z. ``initial``:
    pair, scale, rotation, translation. The scale is kept. A pair without a
    normal or a first correspondence is absent from the result.

    One layout serves all pairs; blocks only meet within a pair.
    """
    distance = float(settings.maximum_distance)
    finite = V.all_finite(*[F.col(a) for a in "xyz"])
    sources, targets = sources.filter(finite), targets.filter(finite)
    normals = surface_normals(targets.select("pair", F.col("tid").alias("qid"), "x", "y", "z"),
                              settings.normal_radius, by=["pair"])
    # Equal positions are one row: of targets the last, of sources with their number.
    surface = settle(
        targets.groupBy("pair", "x", "y", "z").agg(F.max("tid").cast("long").alias("tid"))
        .join(normals.select(F.col("qid").alias("tid"), "nx", "ny", "nz"), "tid", "left")
    )
    offered = blocks(surface, ["tid", "x", "y", "z", "nx", "ny", "nz"], distance, ["pair"], "t", TARGET_ROWS, TASK_ROWS)
    sources = settle(sources.groupBy("pair", "x", "y", "z").agg(F.count(F.lit(1)).cast("double").alias("count")))
    few = has_at_most(initial, BROADCAST_ROWS)
    names = ("scale", "rotation", "translation")
    state = settle(initial.select("pair", *names).withColumns({
        "rms_before": F.lit(None).cast("double"), "rms": F.lit(None).cast("double"),
        "iterations": F.lit(0), "rank": F.lit(0).cast("long"), "correspondences": F.lit(0).cast("long"),
        "open": F.lit(True), "step": F.lit(None).cast("double"),
    }))

    def layout(current: DataFrame) -> DataFrame:
        moved = C.sim3_apply(C.sim3(), V.vec("x", "y", "z"))
        placed = settle(sources.join(current.select("pair", *names), "pair").select(
            "pair", "count", *[F.col(a).alias(f"s{a}") for a in "xyz"], *[m.alias(a) for m, a in zip(moved, "xyz")]))
        asked = blocks(placed, ["sx", "sy", "sz", "x", "y", "z", "count"], distance, ["pair"], "q", SOURCE_ROWS, TASK_ROWS)
        return _laid_together(asked, offered, distance, distance * SLACK)

    kind = dict(initial.dtypes)["pair"]
    partial = ", ".join([f"pair {kind}", *[f"h_{i}{j} double" for i, j in _UPPER], *[f"g_{i} double" for i in range(6)],
                         "_found long", "_square double", "_drift double"])

    def matched(laid: DataFrame, current: DataFrame) -> DataFrame:
        """Sums per pair over its matches, with the farthest motion since the layout."""
        current = current.select("pair", *names)
        rows = laid.join(F.broadcast(current), "pair") if few else _in_order(laid.join(current, "pair"), laid.rdd.getNumPartitions())
        return settle(rows.mapInPandas(_matcher(distance, settings.huber_delta), partial).groupBy("pair").agg(
            *[F.sum(f"h_{i}{j}").alias(f"h_{i}{j}") for i, j in _UPPER], *[F.sum(f"g_{i}").alias(f"g_{i}") for i in range(6)],
            F.sum("_found").alias("_found"), F.sqrt(F.sum("_square") / F.nullif(F.sum("_found"), F.lit(0))).alias("_rms"), F.max("_drift").alias("_drift")))

    solver, laid = _solver(settings.rank_tolerance), None
    for iteration in range(settings.maximum_iterations + 1):
        waiting = state.filter("open")
        if laid is None:
            laid = layout(waiting)
        sums = matched(laid, waiting)
        if sums.filter(F.col("_drift") > distance * SLACK).limit(1).count():
            laid = layout(waiting)
            sums = matched(laid, waiting)
        sums = sums.filter("_found > 0").drop("_drift")
        # The residual of the last step is measured by this round's matches.
        measured = state.filter("open").join(sums, "pair", "left")
        gain = F.col("rms") - F.col("_rms")
        settled = (F.col("iterations") > 0) & (
            (F.col("step") < settings.step_tolerance)
            | ((F.col("rms") > 0) & (gain <= settings.relative_rmse * F.col("rms")))
        )
        lost = F.col("_rms").isNull()
        short = F.coalesce(F.col("_found") < settings.minimum_correspondences, F.lit(True))
        go_on = ~lost & ~short & ~F.coalesce(settled, F.lit(False)) & F.lit(iteration < settings.maximum_iterations)
        measured = measured.withColumn("_go", go_on).withColumns({
            "rms_before": F.coalesce("rms_before", "_rms"), "rms": F.col("_rms"),
            "correspondences": F.when(F.col("_go"), F.col("_found")).otherwise(F.col("correspondences")),
        })
        packed = F.struct(*names, *[f"h_{i}{j}" for i, j in _UPPER], *[f"g_{i}" for i in range(6)])
        moved = measured.filter("_go").withColumn("_s", solver(packed)).select(
            "pair", "_s.scale", "_s.rotation", "_s.translation", "rms_before", "rms",
            (F.col("iterations") + 1).alias("iterations"), F.col("_s.rank").alias("rank"), "correspondences",
            F.lit(True).alias("open"), F.col("_s.step").alias("step"))
        # A pair whose matches vanish entirely is dropped, as there is no residual to report.
        stopped = measured.filter("not _go and _rms is not null").withColumn("open", F.lit(False)).select(*state.columns)
        state = settle(state.filter("not open").unionByName(stopped).unionByName(moved.select(*state.columns)))
        if not state.filter("open").limit(1).count():
            break
    return state.select("pair", *names, "rms_before", F.col("rms").alias("rms_after"), "correspondences", "iterations", "rank")
