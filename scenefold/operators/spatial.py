"""Distance joins over 3-D points.

* nearest: queries and targets are packed into blocks of near points. A block of
  queries is laid beside the blocks of targets that may hold a nearest point of
  one of its queries, and each query walks a k-d tree over these;
* moments: the query point looks at the 27 cells of edge ``radius`` around it.
  Where a cell holds more than ``leaf_rows`` distinct positions, blocks meet
  whose boxes are near enough.

So a dense clump costs a few blocks instead of shuffled pairs, equal positions
are collapsed to one row first, and the result is exact either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import linalg
from ..functions import vectors as V
from ..functions.types import VECTOR
from ..session import has_at_most, settle
from .kdtree import Tree

LEAF_ROWS = 256
# Stands for a NULL id in packed arrays; it comes first in either order, as NULL does.
NO_ID = -(1 << 63)
CELL = ["cx", "cy", "cz"]
_AXES = ("x", "y", "z")


def floor_cell(edge, prefix: str = "", names=CELL) -> list[Column]:
    return [F.floor(F.col(f"{prefix}{a}") / edge).alias(n) for a, n in zip(_AXES, names)]


def round_cell(edge, prefix: str = "", names=CELL) -> list[Column]:
    """Cells centred on multiples of the edge (half away from zero)."""
    return [F.round(F.col(f"{prefix}{a}") / edge).cast("long").alias(n) for a, n in zip(_AXES, names)]


def _level_cell(edge: float, level) -> list[Column]:
    # Scaling by a power of two is exact, so a child index halves to its parent.
    return [F.floor(F.col(a) / F.lit(edge) * F.lit(float(2**level))).alias(n) for a, n in zip(_AXES, CELL)]


def around(df: DataFrame, reach: int = 1) -> DataFrame:
    """Repeat each row for the cells up to ``reach`` away on every axis."""
    steps = [F.lit(v) for v in range(-reach, reach + 1)]
    for name in CELL:
        df = df.withColumn("_d", F.explode(F.array(*steps))).withColumn(name, F.col(name) + F.col("_d"))
    return df.drop("_d")


def _distance2(target: str = "t") -> Column:
    delta = [F.col(f"{target}{a}") - F.col(a) for a in _AXES]
    return delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2]


def place_on_curve(radius: float, bits: int = 10) -> Column:
    """Place on a Z-order curve; it only decides which points share a block."""
    place = F.lit(0).cast("long")
    for axis, name in enumerate("xyz"):
        cell = F.pmod(F.floor(F.col(name) * (16 / radius)) + (1 << (bits - 1)), F.lit(1 << bits))
        for bit in range(bits):
            place = place + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(1), 3 * bit + axis)
    return place


def is_flat(targets: DataFrame, radius: float, by: list[str] | None = None, leaf_rows: int = LEAF_ROWS) -> bool:
    """Whether no cell of edge ``radius`` is crowded; loops over fixed targets ask once."""
    distinct = targets.select(*(by or []), *_AXES).distinct()
    counts = distinct.groupBy(*(by or []), *_level_cell(float(radius), 0)).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.filter(F.col("_n") > leaf_rows).limit(1).count()


def _target_columns(points: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    return points.select(*key, *[F.col(a).alias(f"t{a}") for a in _AXES], *carried)


def _tie_order(tie: str, radius: float, tid: str) -> Column:
    cell = [F.floor(F.col(f"t{a}") / F.lit(radius)) for a in _AXES]
    if tie == "lowest_id":
        return F.struct(F.col("_d2"), F.col(tid))
    if tie == "first_in_cell_order":
        return F.struct(F.col("_d2"), *cell, F.col(tid))
    if tie == "last_in_cell_order":
        return F.struct(F.col("_d2"), *[-c for c in cell], -F.col(tid))
    raise ValueError(tie)


# Queries of a block, and points of a task that cuts blocks.
QUERY_ROWS, TASK_ROWS = 8192, 65536
# So many targets of a layout are in one tree.
TREE_ROWS = 131_072


def nearest_within(queries: DataFrame, targets: DataFrame, radius: float, tie: str = "lowest_id",
                   by: list[str] | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Nearest target of every query point at a distance of at most ``radius``.

    ``queries`` has ``qid, x, y, z`` and ``targets`` has ``tid, x, y, z`` with
    unique integer ids; queries without a target are absent from the result
    ``(qid, tid, d2)``. Points only meet within equal ``by`` columns. Targets come
    in blocks of at most ``leaf_rows``; the shuffles carry points and blocks, not
    pairs of points.
    """
    by, radius = by or [], float(radius)
    kinds = dict(queries.dtypes) | dict(targets.dtypes)
    pick = F.max("tid") if tie == "last_in_cell_order" else F.min("tid")
    distinct = places(targets, "tid", by).groupBy(*by, *_AXES).agg(pick.alias("tid"))
    offered = blocks(settle(_packable(distinct, "tid")), ["tid", *_AXES], radius, by, "t", leaf_rows, TASK_ROWS)
    asked = blocks(settle(_packable(places(queries, "qid", by), "qid")), ["qid", *_AXES], radius, by, "q", QUERY_ROWS, TASK_ROWS)
    rows = laid_together(asked, offered, radius, by)
    found = rows.mapInPandas(_nearest_matcher(tie, radius), "qid long, tid long, _d2 double, tx double, ty double, tz double")
    back = lambda name: F.nullif(F.col(name), F.lit(NO_ID)).cast(kinds[name]).alias(name)
    found = found.select(back("qid"), back("tid"), "_d2", "tx", "ty", "tz")
    # One row for each query already, unless an id repeats.
    return found.groupBy("qid").agg(
        F.min_by(F.struct("tid", "_d2"), _tie_order(tie, radius, "tid")).alias("_best")
    ).select("qid", F.col("_best.tid").alias("tid"), F.col("_best._d2").alias("d2"))


def places(points: DataFrame, id_name: str, by: list[str]) -> DataFrame:
    """Rows that can be near others: with finite coordinates, here as doubles, and a known group."""
    at = points.select(id_name, *by, *[F.col(a).cast("double").alias(a) for a in _AXES])
    at = at.filter(V.all_finite(*[F.col(a) for a in _AXES]))
    return at.dropna(subset=by) if by else at


def _packable(points: DataFrame, id_name: str) -> DataFrame:
    return points.withColumn(id_name, F.coalesce(F.col(id_name).cast("long"), F.lit(NO_ID)))


def unpacked(row, columns: list[str], side: str) -> np.ndarray:
    """Packed doubles of a block as columns of one array."""
    return np.stack([np.frombuffer(getattr(row, f"{side}_{c}")) for c in columns], axis=1)


def tie_columns(at: np.ndarray, ids: np.ndarray, tie: str, radius: float) -> list[np.ndarray]:
    """What decides between targets at one distance, smallest first, as ``_tie_order`` has it."""
    if tie == "lowest_id":
        return [ids]
    cells = list(np.floor(at / radius).T)
    return [*cells, ids] if tie == "first_in_cell_order" else [*[-c for c in cells], -ids]


def _nearest_matcher(tie: str, radius: float):
    limit = radius * radius

    def match(batches):
        for row, parts in gathered(batches, TREE_ROWS):
            qid, q = np.frombuffer(row.q_qid, dtype=np.int64), unpacked(row, _AXES, "q")
            best, tid, at, order = np.full(len(q), np.inf), np.empty(len(q), dtype=np.int64), np.empty(q.shape), None
            for part in parts:
                ids, t = np.concatenate([np.frombuffer(r.t_tid, dtype=np.int64) for r in part]), np.concatenate([unpacked(r, _AXES, "t") for r in part])
                keys = tie_columns(t, ids, tie, radius)
                # The tree gives the first of equal distances.
                first = np.lexsort(keys[::-1])
                ids, t, keys = ids[first], t[first], [k[first] for k in keys]
                to, d2 = Tree(t, 16).nearest(q)
                better, tied = d2 < best, d2 == best
                if order is None:
                    order = [np.empty(len(q), dtype=k.dtype) for k in keys]
                for have, key in zip(order, keys):
                    better |= tied & (key[to] < have)
                    tied &= key[to] == have
                best[better], tid[better], at[better] = d2[better], ids[to[better]], t[to[better]]
                for have, key in zip(order, keys):
                    have[better] = key[to[better]]
            hit = best <= limit
            yield pd.DataFrame({"qid": qid[hit], "tid": tid[hit], "_d2": best[hit], **{f"t{a}": at[hit, i] for i, a in enumerate(_AXES)}})

    return match


# Targets of at most this many rows (32 bytes each) are held by every task.
HELD_TARGETS = 100_000


def nearest(queries: DataFrame, targets: DataFrame, leaf_rows: int = LEAF_ROWS, held: int = HELD_TARGETS) -> DataFrame:
    """Nearest target at any distance; the lowest id wins a tie.

    The targets are counted. A small side, such as the cameras of a capture, goes
    to the tasks as a k-d tree and each batch of queries walks it without a
    shuffle. A larger one takes the blocks of ``nearest_within``, with a radius
    that spans both sets. Both give the same rows.
    """
    finite = F.lit(True)
    for axis in _AXES:
        finite = finite & F.col(axis).isNotNull() & ~F.isnan(axis) & (F.abs(F.col(axis)) < float("inf"))
    queries, targets = queries.select("qid", *_AXES).filter(finite), targets.select("tid", *_AXES).filter(finite)
    if has_at_most(targets, held):
        return _nearest_held(queries, targets)
    both = queries.select(*_AXES).unionByName(targets.select(*_AXES))
    spans = both.agg(*[(F.max(a) - F.min(a)).alias(a) for a in _AXES]).first()
    reach = float(np.sqrt(sum((spans[a] or 0.0) ** 2 for a in _AXES))) or 1.0
    return nearest_within(queries, targets, reach * (1 + 1e-9), "lowest_id", leaf_rows=leaf_rows)


def _nearest_held(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """One tree over the small side, made once; each batch of queries walks it."""
    rows = targets.toPandas().sort_values("tid", kind="stable")
    if not len(rows):
        return queries.limit(0).select("qid", F.lit(None).cast(targets.schema["tid"].dataType).alias("tid"), F.lit(0.0).alias("d2"))
    ids, tree = rows["tid"].to_numpy(), Tree(rows[list(_AXES)].to_numpy(dtype=float))

    def score(batches):
        for pdf in batches:
            at, d2 = tree.nearest(pdf[list(_AXES)].to_numpy(dtype=float))
            yield pd.DataFrame({"qid": pdf["qid"], "tid": ids[at], "d2": d2})

    kinds = dict(queries.dtypes) | dict(targets.dtypes)
    return queries.mapInPandas(score, f"qid {kinds['qid']}, tid {kinds['tid']}, d2 double")


_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def radius_moments(queries: DataFrame, targets: DataFrame, radius: float, by: list[str] | None = None,
                   leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Count, sums and second moments of the targets within ``radius``.

    Moments are taken about the query point, which keeps them well scaled:
    ``qid, n, s_x, s_y, s_z, s_xx, s_xy, s_xz, s_yy, s_yz, s_zz``.
    """
    by = by or []
    limit = float(radius) * float(radius)
    asking = ["qid", *by, *_AXES]
    queries = queries.select(*asking)
    targets = targets.groupBy(*by, *_AXES).agg(F.count(F.lit(1)).alias("_w"))
    names = ["n", *[f"s_{a}" for a in _AXES], *[f"s_{a}{b}" for a, b in _PAIRS]]
    if is_flat(targets, radius, by, leaf_rows):
        cell = _level_cell(float(radius), 0)
        key = [*by, *CELL]
        asked = around(queries.select(*asking, *cell))
        found = asked.join(_target_columns(targets.withColumns(dict(zip(CELL, cell))), key, ["_w"]), key)
        d = {a: F.col(f"t{a}") - F.col(a) for a in _AXES}
        w = F.col("_w")
        terms = found.filter(_distance2() <= limit).select(
            "qid", w.cast("double").alias("n"), *[(w * d[a]).alias(f"s_{a}") for a in _AXES],
            *[(w * d[a] * d[b]).alias(f"s_{a}{b}") for a, b in _PAIRS],
        )
    else:
        terms = _block_terms(queries, targets, radius, by, names, max(1, leaf_rows * 16))
    return terms.groupBy("qid").agg(*[F.sum(c).alias(c) for c in names]).withColumn("n", F.col("n").cast("long"))


# --- blocks --------------------------------------------------------------

# Blocks of queries in a task meet so many blocks of targets at most.
MET_BLOCKS = 64


def blocks(points: DataFrame, columns: list[str], radius: float, by: list[str], side: str, rows: int, task_rows: int | None = None) -> DataFrame:
    """Points near each other as rows of at most ``rows`` points: a number, the box, and the columns as packed arrays.

    A task takes ``task_rows`` points that are near on the curve, ``rows`` if not given, and halves them along the longest side.
    """
    kinds, types = dict(points.dtypes), {"bigint": "int64", "double": "float64"}
    place = place_on_curve(radius).alias("_place")
    tasks = max(1, -(-points.count() // (task_rows or rows)))
    dealt = points.select(*by, *dict.fromkeys([*columns, *_AXES]), place).repartitionByRange(tasks, *by, "_place", *_AXES)
    box = [f"{side}{end}_{a}" for end in ("low", "high") for a in _AXES]

    def pack(batches):
        frames = [pdf for pdf in batches if len(pdf)]
        if not frames:
            return
        whole = pd.concat(frames, ignore_index=True)
        groups = whole.groupby(by, sort=False) if by else [((), whole)]
        for key, group in groups:
            tree = Tree(group[list(_AXES)].to_numpy(dtype=float), rows)
            laid = {c: group[c].to_numpy().astype(types[kinds[c]])[tree.order] for c in columns}
            leaves, packed = np.flatnonzero(tree.child[:, 0] < 0), []
            for start, end in ((s, min(s + rows, tree.end[leaf])) for leaf in leaves for s in range(tree.first[leaf], tree.end[leaf], rows)):
                row = dict(zip(by, key)) | {f"{side}_{c}": laid[c][start:end].tobytes() for c in columns}
                for i, a in enumerate(_AXES):
                    row |= {f"{side}low_{a}": tree.places[start:end, i].min(), f"{side}high_{a}": tree.places[start:end, i].max()}
                packed.append(row)
            yield pd.DataFrame(packed)

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], *[f"{c} double" for c in box], *[f"{side}_{c} binary" for c in columns]])
    return settle(dealt.mapInPandas(pack, schema).withColumn(f"{side}block", F.monotonically_increasing_id()))


def laid_together(asked: DataFrame, offered: DataFrame, radius: float, by: list[str], want: int = 1, around: bool = False) -> DataFrame:
    """Rows of each block of queries: the block, then the blocks of targets that may hold one of the ``want`` nearest of a query.

    A box's farthest corner bounds its targets from above, its nearest side from
    below; each query is held against the boxes near its block. The boxes alone are
    brought together (64 bytes a block). Targets that are not open (``topen``, all
    if the column is missing) do not count among the wanted ones. The block's row has
    ``q_sure``, packed: to this squared distance, the limit at most, a query has all targets.
    With ``around`` every place in the box of the block has them to the largest of these.
    """
    ends = [f"t{end}_{a}" for end in ("low", "high") for a in _AXES]
    number = F.col("topen") if "topen" in offered.columns else F.octet_length("t_x") / 8
    table = offered.select(*by, "tblock", number.cast("double").alias("_open"), *ends).toPandas()
    groups = [(key, part) for key, part in table.groupby(by)] if by else [((), table)] if len(table) else []
    boxes = {key: (part["tblock"].to_numpy(), part["_open"].to_numpy(), part[ends[:3]].to_numpy(), part[ends[3:]].to_numpy()) for key, part in groups}
    limit = float(radius) * float(radius)
    # A little more than the radius: only the points decide.
    most = limit * (1 + 1e-9)

    def lay(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if (box := boxes.get(tuple(getattr(row, k) for k in by))) is not None:
                    yield _near_boxes(row, *box, most, want, around)

    met = settle(asked.mapInPandas(lay, "qblock long, q_sure binary, t_blocks array<bigint>, t_gaps array<double>"))
    near = met.select("qblock", F.explode(F.arrays_zip("t_blocks", "t_gaps")).alias("_near")).select(
        "qblock", F.col("_near.t_blocks").alias("tblock"), F.col("_near.t_gaps").alias("gap"))
    packed = [c for c in offered.columns if c not in (*by, "tblock", "topen")]
    heads = asked.join(met.select("qblock", "q_sure"), "qblock").select(
        "qblock", F.lit(-1.0).alias("gap"), "q_sure", *[c for c in asked.columns if c.startswith("q_")])
    rows = heads.unionByName(near.join(offered.select("tblock", *packed), "tblock").drop("tblock"), allowMissingColumns=True)
    return rows.repartition("qblock").sortWithinPartitions("qblock", "gap")


def _near_boxes(row, blocks_: np.ndarray, open_: np.ndarray, low: np.ndarray, high: np.ndarray, most: float, want: int, around: bool) -> pd.DataFrame:
    """The boxes that the queries of one block may need, with their distance to the block."""
    some, gap, reach = needed_boxes(unpacked(row, _AXES, "q"), open_, low, high, most, want, around)
    return pd.DataFrame([{"qblock": row.qblock, "q_sure": reach.tobytes(), "t_blocks": blocks_[some], "t_gaps": gap}])


def _square(v: np.ndarray) -> np.ndarray:
    return v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1] + v[..., 2] * v[..., 2]


def _reach(far: np.ndarray, open_: np.ndarray, want: int) -> np.ndarray:
    """The least squared distance within which boxes with enough open targets lie whole, for each row."""
    full = open_ >= want
    if full.any():
        return far[:, full].min(axis=1)
    if open_.sum() < want:
        return np.full(len(far), np.inf)
    order = far.argsort(axis=1)
    enough = (open_[order].cumsum(axis=1) >= want).argmax(axis=1)
    return np.take_along_axis(far, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]


def needed_boxes(q: np.ndarray, open_: np.ndarray, low: np.ndarray, high: np.ndarray, most: float, want: int, around: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes that may hold one of the ``want`` nearest open targets of a query, their squared distances to the
    box of the queries, and for each query the squared distance, ``most`` at most, to which they hold every target."""
    # First the queries as a whole, which leaves few boxes.
    bottom, top = q.min(axis=0), q.max(axis=0)
    gap = _square(np.maximum(np.maximum(low - top, bottom - high), 0.0))
    bound = min(most, _reach(_square(np.maximum(high - bottom, top - low))[None], open_, want)[0])
    some = np.flatnonzero(gap <= bound)
    needed, reach = np.zeros(len(some), dtype=bool), np.full(len(q), most)
    step = max(1, 250_000 // max(1, len(some)))
    for start in range(0, len(q) if len(some) else 0, step):
        at = q[start:start + step, None]
        below, above = low[some] - at, at - high[some]
        sure = np.minimum(most, _reach(_square(np.maximum(np.abs(below), np.abs(above))), open_[some], want))
        needed |= (_square(np.maximum(np.maximum(below, above), 0.0)) <= sure[:, None]).any(axis=0)
        reach[start:start + step] = sure
    if around:
        some = np.flatnonzero(gap <= reach.max())
        return some, gap[some], reach
    return some[needed], gap[some[needed]], reach


def gathered(batches, rows: int):
    """Of a layout: each block of queries with its rows of targets, in parts of about ``rows`` targets.

    The parts of a block must be read before the next block.
    """
    stream = (row for pdf in batches for row in pdf.itertuples(index=False))
    row = next(stream, None)

    def parts():
        nonlocal row
        part, held = [], 0
        while row is not None and row.qblock == head.qblock:
            part.append(row)
            held += len(row.t_x) // 8
            row = next(stream, None)
            if held >= rows:
                yield part
                part, held = [], 0
        if part:
            yield part

    while row is not None:
        head, row = row, next(stream, None)
        yield head, parts()


def _block_terms(queries: DataFrame, targets: DataFrame, radius: float, by: list[str], names: list[str], rows: int) -> DataFrame:
    """Terms of ``radius_moments`` for crowded targets: blocks of points meet where their boxes are near enough.

    A task holds one pair of blocks at a time, and the shuffles carry blocks, not
    pairs of points, whose number may grow with the square of a clump.
    """
    limit = float(radius) * float(radius)
    queries, targets = settle(queries), settle(targets.withColumn("_w", F.col("_w").cast("double")))
    if not queries.limit(1).count() or not targets.limit(1).count():
        return queries.limit(0).select("qid", *[F.lit(0.0).alias(n) for n in names])
    asked = blocks(queries.withColumn("qid", F.col("qid").cast("long")), ["qid", *_AXES], radius, by, "q", rows)
    offered = blocks(targets, [*_AXES, "_w"], radius, by, "t", rows)
    gap = [F.greatest(F.col(f"tlow_{a}") - F.col(f"qhigh_{a}"), F.col(f"qlow_{a}") - F.col(f"thigh_{a}"), F.lit(0.0)) for a in _AXES]
    box = lambda side: [f"{side}block", *[f"{side}{end}_{a}" for end in ("low", "high") for a in _AXES]]
    here, there = asked.select(*by, *box("q")), offered.select(*by, *box("t"))
    # A little more than the radius: only the points decide.
    met = (here.join(there, by) if by else here.crossJoin(there)).filter(
        gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= limit * (1 + 1e-9)).select("qblock", "tblock")
    pairs = met.join(asked.select("qblock", *[f"q_{c}" for c in ("qid", *_AXES)]), "qblock").join(
        offered.select("tblock", *[f"t_{c}" for c in (*_AXES, "_w")]), "tblock")
    pairs = pairs.repartition("qblock", F.floor(F.col("tblock") / MET_BLOCKS))

    def meet(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.frombuffer(row.q_qid, dtype=np.int64)
                q = np.stack([np.frombuffer(getattr(row, f"q_{a}")) for a in _AXES], axis=1)
                t = np.stack([np.frombuffer(getattr(row, f"t_{a}")) for a in _AXES], axis=1)
                w = np.frombuffer(row.t__w)
                # Moments about the middle of the targets, then moved to each query.
                origin = (t.min(axis=0) + t.max(axis=0)) / 2
                u, o = t - origin, origin - q
                terms = np.column_stack([w, *[w * u[:, i] for i in range(3)], *[w * u[:, _AXES.index(a)] * u[:, _AXES.index(b)] for a, b in _PAIRS]])
                sums = np.empty((len(q), terms.shape[1]))
                for start in range(0, len(q), 256):
                    d = [t[None, :, i] - q[start:start + 256, None, i] for i in range(3)]
                    sums[start:start + 256] = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= limit).astype(float) @ terms
                n, first = sums[:, :1], sums[:, 1:4]
                moved = first + n * o
                pairs_ = [(_AXES.index(a), _AXES.index(b)) for a, b in _PAIRS]
                second = [sums[:, 4 + k] + o[:, i] * first[:, j] + o[:, j] * first[:, i] + n[:, 0] * o[:, i] * o[:, j] for k, (i, j) in enumerate(pairs_)]
                out = pd.DataFrame(np.column_stack([n, moved, *second]), columns=names)
                out.insert(0, "qid", ids)
                yield out[out["n"] > 0]

    return pairs.drop("qblock", "tblock").mapInPandas(meet, "qid long, " + ", ".join(f"{c} double" for c in names))


@F.pandas_udf(VECTOR)
def _pca_normal(n: pd.Series, sx: pd.Series, sy: pd.Series, sz: pd.Series, xx: pd.Series, xy: pd.Series,
                xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    count = n.to_numpy(dtype=float)
    mean = np.stack([s.to_numpy() for s in (sx, sy, sz)], axis=-1) / count[:, None]
    upper = np.stack([s.to_numpy() for s in (xx, xy, xz, yy, yz, zz)], axis=-1)
    covariance = linalg.symmetric_from_upper(upper, 3) - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
    normals = linalg.smallest_eigenvector(covariance)
    # The sign of an eigenvector is arbitrary; the largest component is made
    # positive so that repeated runs agree until cameras decide.
    leading = np.take_along_axis(normals, np.abs(normals).argmax(axis=-1)[:, None], axis=-1)
    return pd.DataFrame(normals * np.where(leading < 0, -1.0, 1.0), columns=["nx", "ny", "nz"])


def surface_normals(points: DataFrame, radius: float, minimum: int = 3, by: list[str] | None = None,
                    leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Local plane normal of every point ``(qid, x, y, z)``; absent below ``minimum`` neighbours."""
    moments = radius_moments(points, points, radius, by, leaf_rows).filter(F.col("n") >= minimum)
    names = ["n", *[f"s_{a}" for a in _AXES], *[f"s_{a}{b}" for a, b in _PAIRS]]
    return moments.withColumn("_normal", _pca_normal(*names)).select("qid", "n", "_normal.*")


def orient_towards_cameras(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Flip normals that face away from the nearest camera centre.

    ``points`` has ``qid, x, y, z, nx, ny, nz``; ``cameras`` has ``tid, x, y, z``.
    """
    seen = nearest(points, cameras).join(
        cameras.select("tid", *[F.col(a).alias(f"camera_{a}") for a in _AXES]), "tid"
    ).drop("tid", "d2")
    n = V.vec("nx", "ny", "nz")
    towards = V.sub(V.vec("camera_x", "camera_y", "camera_z"), V.vec("x", "y", "z"))
    sign = F.when(V.dot(n, towards) < 0, -1.0).otherwise(1.0)
    joined = points.join(seen, "qid", "left")
    return joined.withColumns({c: F.col(c) * sign for c in ("nx", "ny", "nz")}).drop(
        *[f"camera_{a}" for a in _AXES]
    )
