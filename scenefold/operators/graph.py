"""Components, pose chains, pose graphs and co-visibility groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import PoseGraphError, ScheduleError
from ..functions import cameras as C
from ..functions import linalg
from ..session import settle
from ..settings import PoseGraphSettings


# --- connected components ------------------------------------------------

_FORWARD = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) > (0, 0, 0)]


def cell_edges(cells: DataFrame, key=("kx", "ky", "kz")) -> DataFrame:
    """Undirected edges between touching cells (26 neighbours), each once."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip(step, key)]) for step in _FORWARD])
    shifted = cells.withColumn("_s", F.explode(steps)).select(
        F.col("node").alias("src"), *[(F.col(k) + F.col(f"_s.{k}")).alias(k) for k in key])
    return shifted.join(cells.withColumnRenamed("node", "dst"), list(key)).select("src", "dst")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of the component of every node (``node, component``).

    Hooking and shortcutting: every round each tree hooks onto the smallest
    grandparent seen across an edge, then pointers jump. Rounds grow with the
    logarithm of the longest path, not with the path. All steps are joins on
    unique pointer rows and minimum aggregates, so a node with many neighbours
    is combined before the shuffle.
    """
    both = settle(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    parent = settle(nodes.select("node", F.col("node").alias("parent")))
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        lifted = settle(parent.join(up, "parent"))
        across = both.join(lifted.select(F.col("node").alias("dst"), F.col("grand").alias("seen")), "dst")
        best = across.groupBy("src").agg(F.min("seen").alias("seen")).withColumnRenamed("src", "node")
        offers = lifted.join(best, "node", "left")
        own = offers.select("node", F.least("grand", F.coalesce("seen", "grand")).alias("parent"))
        hooks = offers.filter("seen is not null").select(F.col("parent").alias("node"), F.col("seen").alias("parent"))
        fresh = settle(own.unionByName(hooks).groupBy("node").agg(F.min("parent").alias("parent")))
        # The labels are stable once every grandparent is.
        jumped = fresh.join(fresh.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        moved = jumped.join(lifted.select("node", F.col("grand").alias("old")), "node").filter("grand <> old")
        parent = fresh
        if not moved.limit(1).count():
            return parent.withColumnRenamed("parent", "component")


def topology(labels: DataFrame) -> DataFrame:
    """Component count, largest and isolated cells."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
        F.coalesce(F.sum((F.col("size") == 1).cast("long")), F.lit(0)).alias("isolated"), F.coalesce(F.sum("size"), F.lit(0)).alias("cells"),
    )


# --- pose chains ---------------------------------------------------------

def chain_poses(relative: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """World pose of every window from the transforms to its predecessor.

    ``relative`` has one row per window, the identity at window 0. A prefix
    product by doubling: after round k a row holds the product of its last
    ``2^k`` steps.
    """
    keys = keys or []
    names = ("scale", "rotation", "translation")
    poses = settle(relative.select(*keys, "window_index", *names))
    longest = poses.agg(F.max("window_index")).first()[0] or 0
    for power in range(max(1, math.ceil(math.log2(longest + 1))) if longest else 0):
        reach = 2**power
        earlier = poses.select(
            *keys, (F.col("window_index") + reach).alias("window_index"), *[F.col(n).alias(f"outer_{n}") for n in names])
        joined = poses.join(earlier, [*keys, "window_index"], "left")
        product = C.sim3_compose(C.sim3("outer_"), C.sim3())
        merged = C.sim3_columns(product, "p_")
        has = F.col("outer_scale").isNotNull()
        poses = settle(joined.select(
            *keys, "window_index", *[F.when(has, column).otherwise(F.col(n)).alias(n) for column, n in zip(merged, names)]))
    return poses


def relative_edges(poses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sequential graph edges ``previous^-1 * pose`` of world poses."""
    keys = keys or []
    names = ("scale", "rotation", "translation")
    before = poses.select(*keys, (F.col("window_index") + 1).alias("window_index"), *[F.col(n).alias(f"b_{n}") for n in names])
    relative = C.sim3_compose(C.sim3_inverse(C.sim3("b_")), C.sim3())
    return poses.join(before, [*keys, "window_index"]).select(
        *keys, (F.col("window_index") - 1).cast("int").alias("src"), F.col("window_index").cast("int").alias("dst"),
        *C.sim3_columns(relative), F.lit(1.0).alias("information"), F.lit(False).alias("loop_closure"))


# --- pose graph ----------------------------------------------------------

def _edge_errors(start, end, inverse):
    """Seven residuals per edge: translation, rotation log, log scale (any leading batch)."""
    s, r, t = linalg.sim3_compose(inverse, linalg.sim3_compose(linalg.sim3_inverse(start), end))
    return np.concatenate([t, linalg.so3_log(r), np.log(s)[..., None]], axis=-1)


def _at(nodes, index):
    return nodes[0][..., index], nodes[1][..., index, :, :], nodes[2][..., index, :]


def _residuals(nodes, edges):
    return _edge_errors(_at(nodes, edges["src"]), _at(nodes, edges["dst"]), edges["inverse"])


def _moved(nodes, steps):
    s, r, t = nodes
    return s * np.exp(steps[..., 6]), r @ linalg.so3_exp(steps[..., 3:6]), t + steps[..., :3]


def _jacobians(nodes, edges, step: float):
    """Central differences of the residuals by both endpoints, each (graphs, edges, 7, 7).

    All seven axes and both signs are one batched evaluation per endpoint.
    """
    nudges = np.concatenate([np.eye(7), -np.eye(7)])[:, None, :] * step
    shifted = _moved(nodes, nudges[:, None])
    src, dst = edges["src"], edges["dst"]
    out = {}
    for side, errors in (
        ("src", _edge_errors(_at(shifted, src), _at(nodes, dst), edges["inverse"])),
        ("dst", _edge_errors(_at(nodes, src), _at(shifted, dst), edges["inverse"])),
    ):
        out[side] = np.moveaxis((errors[:7] - errors[7:]) / (2 * step), 0, -1)
    return out


def _normal_system(nodes, edges, step: float):
    """Gauss-Newton matrices and gradients of half the weighted squares, over nodes 1, 2, ..."""
    graphs, count = nodes[0].shape
    sides = _jacobians(nodes, edges, step)
    both = np.concatenate([sides["src"], sides["dst"]], axis=3)
    axes = np.concatenate([7 * edges[side][:, None] + np.arange(7) for side in ("src", "dst")], axis=1)
    weighted = edges["information"][:, :, None, None] * both
    size = 7 * count
    first = np.arange(graphs)[:, None]
    cells = (axes[:, :, None] * size + axes[:, None, :]).ravel() + first * size**2
    matrix = np.bincount(cells.ravel(), (np.swapaxes(weighted, -1, -2) @ both).ravel(), graphs * size**2).reshape(graphs, size, size)
    pulls = np.einsum("geij,gei->gej", weighted, _residuals(nodes, edges))
    gradient = np.bincount((axes.ravel() + first * size).ravel(), pulls.ravel(), graphs * size).reshape(graphs, size)
    return matrix[:, 7:, 7:], gradient[:, 7:]


def _steps(matrix, gradient, damping):
    """Damped steps of all graphs; where damping is too small to make a system regular, the shortest least-squares step."""
    systems = matrix + damping[:, None, None] * np.eye(matrix.shape[-1])
    out = np.empty_like(gradient)
    regular = damping > 1e-10 * np.einsum("gii->gi", matrix).max(axis=1)
    out[regular] = np.linalg.solve(systems[regular], -gradient[regular][..., None])[..., 0]
    for i in np.flatnonzero(~regular):
        out[i] = np.linalg.lstsq(systems[i], -gradient[i], rcond=None)[0]
    return out


def _optimise(nodes, edges, settings: PoseGraphSettings):
    """Least squares over all nodes but the first, as a trust region of each graph of a batch.

    All graphs have the same ``src`` and ``dst``. The damping is absolute and follows the
    gain ratio (actual over predicted decrease, Nielsen's rule), so each system is solved
    once: a step with a poor ratio shrinks the region for the next linearisation or repeats
    with the same one. A graph that is done leaves the batch.
    """
    graphs, count = nodes[0].shape
    nodes = tuple(part.copy() for part in nodes)
    among = lambda table, rows: {n: table[n] if n in ("src", "dst") else tuple(p[rows] for p in table[n]) if n == "inverse" else table[n][rows] for n in table}
    cost_of = lambda state, table: 0.5 * np.einsum("ge,gei->g", table["information"], _residuals(state, table) ** 2)
    initial = cost_of(nodes, edges)
    cost, accepted = initial.copy(), np.zeros(graphs, dtype=np.int64)
    left = np.flatnonzero(initial > 0) if count > 1 else np.arange(0)
    matrix, gradient = np.empty((graphs, 7 * count - 7, 7 * count - 7)), np.empty((graphs, 7 * count - 7))

    def linearise(rows):
        if len(rows):
            matrix[rows], gradient[rows] = _normal_system(tuple(p[rows] for p in nodes), among(edges, rows), settings.difference_step)

    linearise(left)
    growth = np.full(graphs, 2.0)
    damping = settings.initial_damping * np.maximum(np.einsum("gii->gi", matrix).max(axis=1, initial=0.0), 1e-12) if len(left) else np.ones(graphs)
    for _ in range(4 * settings.maximum_iterations):
        if not len(left):
            break
        step = _steps(matrix[left], gradient[left], damping[left])
        predicted = 0.5 * np.einsum("gi,gi->g", step, damping[left, None] * step - gradient[left])
        whole = np.concatenate([np.zeros((len(left), 7)), step], axis=1).reshape(len(left), count, 7)
        moved = _moved(tuple(p[left] for p in nodes), whole)
        after = cost_of(moved, among(edges, left))
        gain = cost[left] - after
        ratio = np.where(predicted > 0, gain / np.where(predicted > 0, predicted, 1.0), -1.0)
        good = ratio > 0
        taken, refused = left[good], left[~good]
        settled = gain[good] <= settings.relative_cost * initial[taken]
        for part, new in zip(nodes, moved):
            part[taken] = new[good]
        cost[taken] = after[good]
        accepted[taken] += 1
        damping[taken] *= np.maximum(1 / 3, 1 - (2 * ratio[good] - 1) ** 3)
        growth[taken] = 2.0
        damping[refused] *= growth[refused]
        growth[refused] *= 2
        again = taken[~settled & (accepted[taken] < settings.maximum_iterations)]
        stuck = ~np.isfinite(damping[refused]) | (np.abs(step[~good]).max(axis=1, initial=0.0) < 1e-14)
        linearise(again)
        left = np.sort(np.concatenate([again, refused[~stuck]]))
    return nodes, 2 * initial, 2 * cost, accepted


# Numbers in the systems of the graphs that are solved together, and rows of nodes and edges in a task's group.
SYSTEM_NUMBERS, GRAPH_ROWS = 4_000_000, 20_000


def _solve_graphs(nodes, edges, counts, links, settings: PoseGraphSettings):
    """Poses, costs and iterations of many graphs; those of one shape are solved together.

    ``nodes`` and ``edges`` are sorted by graph, ``counts`` and ``links`` say how many each has.
    """
    first, start = np.cumsum(counts) - counts, np.cumsum(links) - links
    nodes = tuple(part.copy() for part in nodes)
    initial, final, iterations = np.zeros(len(counts)), np.zeros(len(counts)), np.zeros(len(counts), dtype=np.int64)
    shapes: dict[tuple, list[int]] = {}
    for graph, (count, at, many) in enumerate(zip(counts, start, links)):
        if many:
            shapes.setdefault((count, edges["src"][at : at + many].tobytes(), edges["dst"][at : at + many].tobytes()), []).append(graph)
    for (count, *_), members in shapes.items():
        many = links[members[0]]
        most = max(1, SYSTEM_NUMBERS // (49 * int(count) ** 2))
        for low in range(0, len(members), most):
            chosen = np.array(members[low : low + most])
            node, edge = first[chosen][:, None] + np.arange(count), start[chosen][:, None] + np.arange(many)
            table = {"src": edges["src"][edge[0]], "dst": edges["dst"][edge[0]], "inverse": tuple(p[edge] for p in edges["inverse"]),
                     "information": edges["information"][edge]}
            state, initial[chosen], final[chosen], iterations[chosen] = _optimise(tuple(p[node] for p in nodes), table, settings)
            for part, new in zip(nodes, state):
                part[node] = new
    return nodes, initial, final, iterations


def optimise_pose_graph(nodes: DataFrame, edges: DataFrame, key: str, settings: PoseGraphSettings = PoseGraphSettings()) -> DataFrame:
    """Loop-corrected window poses of every graph (one graph per ``key`` value).

    ``nodes``: key, window_index 0..n-1, scale, rotation, translation. ``edges``:
    key, src, dst, similarity, information, loop_closure. The dense solve of one
    graph is within one task, and graphs of one shape are solved together; a graph
    has one node per window of a capture, and one above the stated limit is
    refused, not truncated.
    """
    sizes = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("window_index").alias("m"), F.min("window_index").alias("z"))
    bad = sizes.filter((F.col("n") > settings.maximum_nodes) | (F.col("m") != F.col("n") - 1) | (F.col("z") != 0)).limit(1).collect()
    if bad:
        raise PoseGraphError(f"graph {bad[0][key]!r} has {bad[0]['n']} nodes or gaps in its window numbers")
    # One edge table row may repeat a node pair; its number is bounded with the nodes.
    crowded = edges.groupBy(key).agg(F.count(F.lit(1)).alias("e")).join(sizes, key).filter("e > n * n").limit(1).collect()
    if crowded:
        raise PoseGraphError(f"graph {crowded[0][key]!r} repeats node pairs; merge them first")
    kind = dict(nodes.dtypes)[key]
    schema = (f"{key} {kind}, window_index int, scale double, rotation array<double>, translation array<double>, "
              "initial_cost double, final_cost double, iterations int, loop_edges long")

    def solve(node_rows: pd.DataFrame, edge_rows: pd.DataFrame) -> pd.DataFrame:
        codes, _ = pd.factorize(pd.concat([node_rows[key], edge_rows["_graph"]]), use_na_sentinel=False)
        node_rows = node_rows.assign(_code=codes[: len(node_rows)]).sort_values(["_code", "window_index"])
        edge_rows = edge_rows.assign(_code=codes[len(node_rows) :]).sort_values(["_code", "src", "dst", "loop_closure"])
        graphs = int(codes.max()) + 1
        counts, links = (np.bincount(rows["_code"], minlength=graphs) for rows in (node_rows, edge_rows))
        if (counts == 0).any():
            raise PoseGraphError("edges of a graph without nodes")
        unpack = lambda rows: (
            rows["scale"].to_numpy(dtype=float), np.array(rows["rotation"].tolist(), dtype=float).reshape(-1, 3, 3),
            np.array(rows["translation"].tolist(), dtype=float).reshape(-1, 3))
        index = {"src": edge_rows["src"].to_numpy(), "dst": edge_rows["dst"].to_numpy(),
                 "inverse": linalg.sim3_inverse(unpack(edge_rows)), "information": edge_rows["information"].to_numpy(dtype=float)}
        state, initial, final, iterations = _solve_graphs(unpack(node_rows), index, counts, links, settings)
        loops = np.bincount(edge_rows["_code"], edge_rows["loop_closure"].to_numpy(dtype=float), graphs).astype(np.int64)
        code = node_rows["_code"].to_numpy()
        return pd.DataFrame({
            key: node_rows[key].to_numpy(), "window_index": node_rows["window_index"].to_numpy(), "scale": state[0],
            "rotation": state[1].reshape(-1, 9).tolist(), "translation": state[2].tolist(), "initial_cost": initial[code],
            "final_cost": final[code], "iterations": iterations[code], "loop_edges": loops[code],
        })

    # Many small graphs share a group, of a bounded number of rows; a graph is never split.
    rows = nodes.count() + edges.count()
    bucket = F.pmod(F.xxhash64(key), F.lit(max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // GRAPH_ROWS)))).alias("_bucket")
    dealt = edges.select("*", bucket).withColumnRenamed(key, "_graph")
    return nodes.select("*", bucket).groupBy("_bucket").cogroup(dealt.groupBy("_bucket")).applyInPandas(solve, schema)


# --- co-visibility groups ------------------------------------------------

class _Cover:
    """Frames not yet in a core, and what a growing group shares with every frame."""

    def __init__(self, shared: np.ndarray, axes: np.ndarray, least: float) -> None:
        self.shared, self.sees = shared, axes @ axes.T >= least
        self.open = np.ones(len(shared), dtype=bool)
        self.weight = shared.sum(axis=1)

    def _join(self, frame: int) -> None:
        self.open[frame] = False
        self.weight = self.weight - self.shared[frame]
        self.pull = self.pull + self.shared[frame]
        self.gap = np.minimum(self.gap, np.abs(np.arange(len(self.open)) - frame))
        self.fits = self.fits & self.sees[frame]

    def _by_pull(self, allowed: np.ndarray) -> np.ndarray:
        """Allowed frames that fit: most shared tracks first, then the closest in time, then the earliest."""
        frames = np.flatnonzero(allowed & self.fits)
        return frames[np.lexsort((frames, self.gap[frames], -self.pull[frames]))]

    def next_group(self, core_size: int, context_size: int) -> tuple[list[int], list[int]]:
        """A core of open frames around the best connected one, and frames of context for it."""
        count = len(self.open)
        self.pull, self.gap, self.fits = np.zeros(count, dtype=np.int64), np.full(count, count), np.ones(count, dtype=bool)
        core = [int(np.argmax(np.where(self.open, self.weight, -1)))]
        self._join(core[0])
        while len(core) < core_size and len(found := self._by_pull(self.open)):
            core.append(int(found[0]))
            self._join(core[-1])
        outside = ~np.isin(np.arange(count), core)
        return core, self._by_pull(outside)[: max(context_size, 3 - len(core))].tolist()


def covisibility_batches(frames: DataFrame, weights: DataFrame, key: str, size: int = 16, overlap: int = 4,
                         minimum_direction: float = -1.0, maximum_frames: int = 1800) -> DataFrame:
    """Greedy cover of a capture's frames by groups that share many tracks.

    ``frames``: key, frame_index, fx, fy, fz (viewing direction). ``weights``:
    key, frame_a, frame_b, shared_tracks. The cover is sequential by definition
    and runs once per capture over at most ``maximum_frames`` frames; longer
    captures are refused.
    """
    if size < 3 or not 0 <= overlap < size or not -1.0 <= minimum_direction <= 1.0:
        raise ScheduleError("batch settings are out of range")
    counted = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wrong = counted.filter((F.col("n") > maximum_frames) | (F.col("n") < 3)).limit(1).collect()
    if wrong:
        raise ScheduleError(f"capture {wrong[0][key]!r} has {wrong[0]['n']} frames")
    kind = dict(frames.dtypes)[key]

    def cover(frame_rows: pd.DataFrame, pair_rows: pd.DataFrame) -> pd.DataFrame:
        frame_rows = frame_rows.sort_values("frame_index")
        ids = frame_rows["frame_index"].to_numpy()
        shared = pd.DataFrame(0, index=ids, columns=ids)
        known = pair_rows[pair_rows["frame_a"].isin(ids) & pair_rows["frame_b"].isin(ids)]
        if len(known):
            shared = known.pivot_table(index="frame_a", columns="frame_b", values="shared_tracks", aggfunc="last", fill_value=0).reindex(index=ids, columns=ids, fill_value=0)
        axes = frame_rows[["fx", "fy", "fz"]].to_numpy(dtype=float)
        groups = _Cover(shared.to_numpy() + shared.to_numpy().T, axes / np.linalg.norm(axes, axis=1, keepdims=True), minimum_direction)
        parts = []
        while groups.open.any():
            core, context = groups.next_group(size - overlap, overlap)
            members = sorted(core + context)
            if len(members) < 3:
                raise ScheduleError(f"frame {ids[core[0]]} has fewer than three compatible views")
            parts.append(pd.DataFrame({key: frame_rows[key].iloc[0], "batch": len(parts), "frame_index": ids[members], "core": np.isin(members, core)}))
        return pd.concat(parts)

    return frames.groupBy(key).cogroup(weights.withColumnRenamed(key, "_graph").groupBy("_graph")).applyInPandas(
        cover, f"{key} {kind}, batch int, frame_index long, core boolean")


def largest_model(models: DataFrame) -> DataFrame:
    """The sparse model with the most registered images."""
    return models.orderBy(F.desc("registered_images"), "model").limit(1)
