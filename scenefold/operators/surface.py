"""From pixels to points, and from points to one surface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import BackprojectionError, ConfigurationError
from ..functions import cameras as C
from ..functions import hashing
from ..functions import vectors as V
from ..functions.types import INVERSES
from ..session import broadcast_if_small, settle
from ..settings import BackprojectionSettings, PreviewSettings, TsdfSettings
from .common import attach, equi
from .ordering import global_index
from .quantiles import percentiles, upper_median
from .spatial import floor_cell, orient_towards_cameras, round_cell, surface_normals

KEY = ["kx", "ky", "kz"]


# --- back-projection -----------------------------------------------------

def check_calibration(views: DataFrame) -> DataFrame:
    """Views with unusable intrinsics or non-finite matrices, as violations."""
    good = (
        (F.size("k") == 9) & F.size("w2c").isin(12, 16)
        & F.forall("k", V.finite) & F.forall("w2c", V.finite)
        & (F.col("k").getItem(0) > 0) & (F.col("k").getItem(4) > 0)
    )
    return views.filter(~F.coalesce(good, F.lit(False)))


def _neighbour(name: str, along: str, across: str, view: list[str]) -> Column:
    """Value of the next pixel along one axis, NULL unless it is exactly adjacent."""
    order = Window.partitionBy(*view, across).orderBy(along)
    return F.when(F.lead(along).over(order) == F.col(along) + 1, F.lead(name).over(order))


def backproject(pixels: DataFrame, views: DataFrame, settings: BackprojectionSettings = BackprojectionSettings(),
                normals: bool = True) -> DataFrame:
    """World points of the confident depth pixels.

    The normal compares a pixel with its right and lower neighbour in the full
    raster (one raster line per window partition, so partitions are bounded by
    the image size) and falls back to the direction of the camera.
    """
    if settings.stride < 1:
        raise BackprojectionError("pixel stride must be at least 1")
    view = ["window_index", "frame_index"]
    usable = V.positive(F.col("depth"))
    if normals:
        depth = F.when(usable, F.col("depth"))
        pixels = pixels.withColumn("_d", depth)
        pixels = pixels.withColumn("_right", _neighbour("_d", "px", "py", view))
        pixels = pixels.withColumn("_down", _neighbour("_d", "py", "px", view))
    on_grid = (F.col("px") % settings.stride == 0) & (F.col("py") % settings.stride == 0)
    kept = pixels.filter(
        usable & on_grid & V.finite(F.col("confidence")) & (F.col("confidence") >= settings.minimum_confidence)
    )
    joined = kept.join(views, view)
    k = F.col("k")
    fx, fy, cx, cy = k.getItem(0), k.getItem(4), k.getItem(2), k.getItem(5)

    def ray(px: Column, py: Column, depth: Column) -> V.Vec:
        return (px - cx) * depth / fx, (py - cy) * depth / fy, depth

    px, py, depth = F.col("px"), F.col("py"), F.col("depth")
    out = V.columns(joined, C.camera_to_world("w2c", ray(px, py, depth)), ("x", "y", "z"))
    radius = settings.radius_pixels * depth / F.least(fx, fy)
    n = ("nx", "ny", "nz")
    if normals:
        # Each step is its own projection: nested, the repeated norms would
        # multiply the expression beyond what code generation accepts.
        centre = ray(px, py, depth)
        right = V.sub(ray(px + 1, py, F.col("_right")), centre)
        down = V.sub(ray(px, py + 1, F.col("_down")), centre)
        away = V.sub(C.camera_centre("w2c"), V.vec("x", "y", "z"))
        both = F.col("_right").isNotNull() & F.col("_down").isNotNull()
        direction = tuple(F.when(both, s).otherwise(a) for s, a in zip(V.cross(down, right), away))
        out = V.columns(out, direction, n)
        out = V.columns(out, V.normalize(V.vec(*n), 1e-12, "forward"), n)
        out = V.columns(out, V.rotate_back(C.w2c_rotation("w2c"), V.vec(*n)), n)
        out = V.pin(V.columns(out, V.normalize(V.vec(*n), 1e-12, "forward"), n), *n)
    else:
        out = out.withColumns({name: F.lit(None).cast("double") for name in n})
    return out.select(*view, "px", "py", "x", "y", "z", *n, "r", "g", "b", "confidence", radius.alias("radius"))


@F.pandas_udf(INVERSES)
def _inverses(k: pd.Series, w2c: pd.Series) -> pd.DataFrame:
    """Full inverses of intrinsics and pose; one row per view."""
    lens = np.array(k.tolist(), dtype=float).reshape(-1, 3, 3)
    pose = np.tile(np.eye(4), (len(w2c), 1, 1))
    pose[:, :3] = np.array([row[:12] for row in w2c], dtype=float).reshape(-1, 3, 4)
    as_rows = lambda m, n: np.linalg.inv(m).astype(np.float32).astype(float).reshape(-1, n).tolist()
    return pd.DataFrame({"kinv": as_rows(lens, 9), "c2w": as_rows(pose, 16)})


def backproject_exact(pixels: DataFrame, views: DataFrame, minimum_confidence: float | None = None) -> DataFrame:
    """Positions through full matrix inverses, which also hold for non-rigid poses.

    The inverses are rounded to single precision, as the recorded results are.
    """
    gate = V.positive(F.col("depth")) & V.finite(F.col("confidence"))
    if minimum_confidence is not None:
        gate = gate & (F.col("confidence") >= minimum_confidence)
    inverted = views.withColumn("_i", _inverses("k", "w2c")).select("window_index", "frame_index", "_i.*")
    joined = pixels.filter(gate).join(inverted, ["window_index", "frame_index"])
    k, depth = V.matrix("kinv", 3, 3), F.col("depth")
    ray = V.rotate(k, (F.col("px") * depth, F.col("py") * depth, depth))
    c2w = V.matrix("c2w", 4, 4)
    world = V.add(V.rotate(c2w, ray), (c2w[0][3], c2w[1][3], c2w[2][3]))
    return V.columns(joined, world, ("x", "y", "z")).drop("kinv", "c2w")


def dense_points(pixels: DataFrame, views: DataFrame, stride: int, minimum_confidence: Column | float) -> DataFrame:
    """Tool variant: differences on the strided grid, edges repeat the last difference."""
    view = ["window_index", "frame_index"]
    sampled = pixels.filter((F.col("px") % stride == 0) & (F.col("py") % stride == 0)).join(views, view)
    k = F.col("k")
    local = ((F.col("px") - k.getItem(2)) * F.col("depth") / k.getItem(0),
             (F.col("py") - k.getItem(5)) * F.col("depth") / k.getItem(4), F.col("depth"))
    sampled = sampled.withColumns(dict(zip(("lx", "ly", "lz"), local)))
    row, column = Window.partitionBy(*view, "py").orderBy("px"), Window.partitionBy(*view, "px").orderBy("py")

    def step(name: str, order) -> Column:
        ahead = F.lead(name).over(order) - F.col(name)
        behind = F.col(name) - F.lag(name).over(order)
        return F.coalesce(ahead, behind, F.lit(0.0))

    names = ("lx", "ly", "lz")
    stepped = sampled.withColumns({f"dx_{n}": step(n, row) for n in names})
    stepped = stepped.withColumns({f"dy_{n}": step(n, column) for n in names})
    n = ("nx", "ny", "nz")
    raw = V.cross(V.vec(*[f"dx_{c}" for c in names]), V.vec(*[f"dy_{c}" for c in names]))
    stepped = V.columns(stepped, raw, n)
    stepped = V.columns(stepped, V.rotate_back(C.w2c_rotation("w2c"), V.vec(*n)), n)
    stepped = V.columns(stepped, V.normalize(V.vec(*n), 1e-8), n)
    stepped = V.columns(stepped, C.camera_to_world("w2c", V.vec(*names)), ("x", "y", "z"))
    stepped = V.pin(stepped, *n, "x", "y", "z")
    gate = (
        V.all_finite(F.col("x"), F.col("y"), F.col("z")) & V.positive(F.col("depth")) & V.finite(F.col("confidence"))
        & (F.col("confidence") >= minimum_confidence) & F.col("nx").isNotNull()
    )
    return stepped.filter(gate).select(*view, "px", "py", "x", "y", "z", *n, "r", "g", "b", "confidence")


# --- ownership -----------------------------------------------------------

def first_owner(rows: DataFrame, keys: list[str] | None = None, window: str = "window_index") -> DataFrame:
    """Rows of a frame only from the earliest window that saw it.

    The owner is a minimum per frame (combined before the shuffle), so a frame
    with very many pixels never becomes one sort.
    """
    keys = [*(keys or []), "frame_index"]
    owner = rows.groupBy(*keys).agg(F.min(window).alias("_owner"))
    return rows.join(owner, keys).filter(F.col(window) == F.col("_owner")).drop("_owner")


def positional_owner(members: DataFrame, overlap: int) -> DataFrame:
    """Skip the first ``overlap`` views of every window but the first."""
    return members.filter((F.col("window_index") == 0) | (F.col("view_index") >= overlap))


def owned_counts(rows: DataFrame, frames: DataFrame, clamp_unknown: bool = False) -> DataFrame:
    """Rows per frame over all frames, zeros included."""
    frame = F.greatest("frame_index", F.lit(0)) if clamp_unknown else F.col("frame_index")
    counts = rows.groupBy(frame.alias("frame_index")).agg(F.count(F.lit(1)).alias("points"))
    return frames.select("frame_index").distinct().join(counts, "frame_index", "left").fillna(0, ["points"])


def at_least_window_percentile(pixels: DataFrame, percentile: float = 55.0) -> DataFrame:
    """Pixels at or above the confidence percentile of their window."""
    # One row per window: known before the join, so that the pixels are not shuffled for it.
    limit = broadcast_if_small(settle(percentiles(pixels, ["window_index"], "confidence", {"_limit": percentile / 100.0})))
    return pixels.join(limit, "window_index").filter(F.col("confidence") >= F.col("_limit")).drop("_limit")


def transform_points(points: DataFrame, poses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Move points of each window into the world by its similarity."""
    keys = [*(keys or []), "window_index"]
    joined = points.join(poses.select(*keys, "scale", "rotation", "translation"), keys)
    s = C.sim3()
    moved = dict(zip("xyz", C.sim3_apply(s, V.vec("x", "y", "z"))))
    if "nx" in points.columns:
        moved |= dict(zip(("nx", "ny", "nz"), V.normalize(V.rotate(s[1], V.vec("nx", "ny", "nz")), 1e-12, "forward")))
    if "radius" in points.columns:
        moved["radius"] = F.col("radius") * s[0]
    return joined.withColumns(moved).select(*points.columns)


# --- validity ------------------------------------------------------------

def valid_observation() -> Column:
    """Gate of the voxel and TSDF fusions."""
    return V.all_finite(F.col("x"), F.col("y"), F.col("z")) & V.positive(F.col("confidence")) & V.positive(F.col("radius"))


def valid_surfel() -> Column:
    """Gate of the architecture extraction."""
    names = ("x", "y", "z", "nx", "ny", "nz")
    return V.all_finite(*[F.col(c) for c in names])


# --- extents -------------------------------------------------------------

def bounds(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    finite = points.filter(V.all_finite(F.col("x"), F.col("y"), F.col("z")))
    ends = [f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))]
    spans = [F.pow(F.col(f"high_{a}") - F.col(f"low_{a}"), F.lit(2.0)) for a in "xyz"]
    return finite.groupBy(*(keys or [])).agg(*ends).withColumn("diagonal", F.sqrt(spans[0] + spans[1] + spans[2]))


# --- voxel fusion --------------------------------------------------------

def voxel_edge(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Twice the upper-median radius, at least 1e-6."""
    keys = keys or []
    radii = points.filter(V.positive(F.col("radius")))
    return upper_median(radii, keys, "radius", "_middle").select(
        *keys, F.greatest(2 * F.col("_middle"), F.lit(1e-6)).alias("voxel")
    )


def fuse_voxels(points: DataFrame, edge: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Confidence-weighted surfel per occupied voxel, as one mergeable aggregate.

    ``edge`` holds the ``voxel`` column (one row, or one per key).
    """
    keys = keys or []
    edge = voxel_edge(points, keys) if edge is None else edge
    placed = equi(points.filter(valid_observation()), edge, keys)
    cells = placed.withColumns(dict(zip(KEY, round_cell(F.col("voxel"), names=KEY))))
    w = F.col("confidence")
    sums = [F.sum(w * F.col(c)).alias(f"_{c}") for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b") if c in points.columns]
    merged = cells.groupBy(*keys, *KEY).agg(
        *sums, F.sum(w).alias("_w"), F.avg("radius").alias("radius"),
        F.min("frame_index").alias("first_observing_frame"), F.count(F.lit(1)).alias("contributors"),
    )
    total = F.greatest("_w", F.lit(1e-6))
    out = {a: F.col(f"_{a}") / total for a in "xyz"}
    if "nx" in points.columns:
        mean = tuple(F.col(f"_{c}") / total for c in ("nx", "ny", "nz"))
        out |= dict(zip(("nx", "ny", "nz"), V.normalize(mean, 1e-12, "forward")))
    if "r" in points.columns:
        out |= {c: F.least(F.greatest(F.round(F.col(f"_{c}") / total), F.lit(0.0)), F.lit(255.0)).cast("short") for c in "rgb"}
    out["confidence"] = F.col("_w") / F.col("contributors")
    tail = ["confidence", "radius", "first_observing_frame", "contributors"]
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b") if c in out]
    return merged.withColumns(out).select(*keys, *KEY, *names, *tail)


def occupied_cells(points: DataFrame, voxel: float, keys: list[str] | None = None) -> DataFrame:
    """Distinct floor cells (the topology grid)."""
    finite = points.filter(V.all_finite(F.col("x"), F.col("y"), F.col("z")))
    return finite.select(*(keys or []), *floor_cell(F.lit(voxel), names=KEY)).distinct()


# --- TSDF ----------------------------------------------------------------

def tsdf_voxel(observations: DataFrame, settings: TsdfSettings) -> float:
    if settings.voxel_size is not None and settings.voxel_size > 0:
        return float(settings.voxel_size)
    diagonal = bounds(observations).first()["diagonal"] or 0.0
    relative = (settings.voxel_fraction if settings.voxel_fraction > 0 else 0.004) * diagonal
    return float(relative) if relative > 0 else settings.degenerate_voxel


def splat(observations: DataFrame, voxel: float | Column, settings: TsdfSettings = TsdfSettings()) -> DataFrame:
    """One row per observation and voxel along its normal inside the truncation band.

    A step is skipped when it falls in the voxel of the step before; that voxel
    is recomputed from the step number, so no ordering is needed.
    """
    edge = F.lit(voxel) if not isinstance(voxel, Column) else voxel
    truncation = settings.truncation_voxels * edge
    band = int(-(-settings.truncation_voxels // 1))
    steps = F.sequence(F.lit(-band), F.lit(band))
    spread = observations.withColumn("_step", F.explode(steps))

    def cell(step: Column) -> list[Column]:
        return [F.floor((F.col(a) + step * edge * F.col(f"n{a}")) / edge) for a in "xyz"]

    here, before = cell(F.col("_step")), cell(F.col("_step") - 1)
    fresh = (F.col("_step") == -band) | (here[0] != before[0]) | (here[1] != before[1]) | (here[2] != before[2])
    spread = spread.filter(fresh).withColumns(dict(zip(KEY, here)))
    centre = tuple((F.col(k) + 0.5) * edge for k in KEY)
    distance = V.dot(V.sub(centre, V.vec("x", "y", "z")), V.vec("nx", "ny", "nz"))
    return spread.withColumn("sd", distance).filter(F.abs("sd") <= truncation).drop("_step")


def tsdf_cells(splats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Inverse-radius weighted sums per voxel; colours in linear light."""
    w = 1.0 / (F.col("radius") + 1e-12)
    colours = [F.sum(w * C.srgb_to_linear(F.col(c))).alias(f"_{c}") for c in "rgb"] if "r" in splats.columns else []
    return splats.groupBy(*(keys or []), *KEY).agg(
        F.sum(w).alias("weight"), F.sum(w * F.col("sd")).alias("_sd"),
        *[F.sum(w * F.col(n)).alias(f"_{n}") for n in ("nx", "ny", "nz")], *colours,
        F.count(F.lit(1)).alias("hits"), F.min("frame_index").alias("first_observing_frame"),
    )


def zero_crossing(cells: DataFrame, voxel: float | Column, settings: TsdfSettings = TsdfSettings(),
                  keys: list[str] | None = None) -> DataFrame:
    """Surfels of the voxels whose mean signed distance is within half a voxel."""
    edge = F.lit(voxel) if not isinstance(voxel, Column) else voxel
    sd = F.col("_sd") / F.col("weight")
    n = V.normalize(tuple(F.col(f"_{c}") / F.col("weight") for c in ("nx", "ny", "nz")))
    kept = cells.filter((F.col("hits") >= max(settings.minimum_hits, 1)) & (F.col("weight") > 0) & (F.abs(sd) <= edge / 2))
    kept = kept.withColumns({"sd": sd, **dict(zip(("nx", "ny", "nz"), n))}).filter("nx is not null")
    position = {a: (F.col(k) + 0.5) * edge - F.col("sd") * F.col(f"n{a}") for a, k in zip("xyz", KEY)}
    colours = {c: C.linear_to_srgb(F.col(f"_{c}") / F.col("weight")) for c in "rgb"} if "_r" in cells.columns else {}
    return kept.withColumns({**position, **colours}).select(
        *(keys or []), *KEY, "x", "y", "z", "nx", "ny", "nz", *colours, F.lit(1.0).alias("confidence"),
        (settings.output_radius_voxels * edge).alias("radius"), "first_observing_frame", F.col("hits").alias("contributors"),
    )


def fuse_tsdf(observations: DataFrame, cameras: DataFrame | None, settings: TsdfSettings = TsdfSettings()) -> DataFrame:
    """One zero-crossing layer of surfels from raw observations.

    ``observations``: x, y, z, r, g, b, confidence, radius, frame_index.
    ``cameras``: x, y, z of the camera centres, or None. Fewer than eight usable
    observations, or an empty layer, pass the observations through.
    """
    needed = ["x", "y", "z", "r", "g", "b", "confidence", "radius", "frame_index"]
    usable = settle(observations.select(*needed).filter(valid_observation()).withColumn("qid", F.monotonically_increasing_id()))

    def passed_through() -> DataFrame:
        return usable.select(
            *[F.lit(None).cast("long").alias(k) for k in KEY], "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"),
            F.lit(1.0).alias("nz"), "r", "g", "b", F.lit(1.0).alias("confidence"), "radius",
            F.col("frame_index").alias("first_observing_frame"), F.lit(1).cast("long").alias("contributors"))

    if usable.limit(settings.minimum_observations).count() < settings.minimum_observations:
        return passed_through()
    voxel = tsdf_voxel(usable, settings)
    radius = max(settings.normal_radius or settings.normal_radius_voxels * voxel, 1e-6)
    normals = surface_normals(usable, radius).drop("n")
    oriented = usable.join(normals, "qid")
    if cameras is not None and cameras.limit(1).count():
        numbered = cameras.select("x", "y", "z").withColumn("tid", F.monotonically_increasing_id())
        oriented = orient_towards_cameras(settle(oriented), settle(numbered))
    surfels = settle(zero_crossing(tsdf_cells(splat(oriented, voxel, settings)), voxel, settings))
    return surfels if surfels.limit(1).count() else passed_through()


# --- sampling ------------------------------------------------------------

def hash_sample(points: DataFrame, candidates: int, budget: int, frame: str = "frame_index") -> DataFrame:
    """About ``budget`` observations, chosen by a hash of frame and source pixel."""
    threshold = hashing.threshold_to_signed(hashing.sample_threshold(candidates, budget))
    return points.filter(hashing.observation_hash(F.col(frame), F.col("px"), F.col("py")) <= F.lit(threshold))


def lowest_hashes(df: DataFrame, hash_column: str, count: int, tie: str) -> DataFrame:
    """The ``count`` rows with the smallest hash.

    A count per hash prefix finds the prefix in which the limit falls; only that
    one prefix is sorted, so neither the driver nor a task holds ``count`` rows.
    """
    if count <= 0:
        return df.limit(0)
    prefix = F.shiftright(hash_column, 48)
    sizes = sorted(df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["p"])
    taken = 0
    for row in sizes:
        if taken + row["n"] > count:
            edge = df.filter(prefix == row["p"]).orderBy(hash_column, tie).limit(count - taken)
            return df.filter(prefix < row["p"]).unionByName(edge)
        taken += row["n"]
    return df


def spatial_preview(points: DataFrame, order: list[str], settings: PreviewSettings = PreviewSettings()) -> DataFrame:
    """Bounded preview: the lowest-hash point of every occupied cell, then a hash sample.

    Adds ``ordinal`` (position in ``order``) and ``anchor``. The 64-cell grid
    bounds the anchors, whatever the input size.
    """
    if settings.budget < 1 or settings.grid < 1:
        raise ConfigurationError("preview budget and grid must be positive")
    indexed = settle(global_index(points, order))
    total = indexed.count()
    if total <= settings.budget:
        return indexed.withColumn("anchor", F.lit(False))
    low_high = bounds(indexed)
    if low_high.first()["diagonal"] is None:
        return indexed.filter(F.col("ordinal") < settings.budget).withColumn("anchor", F.lit(False))
    finite = V.all_finite(F.col("x"), F.col("y"), F.col("z"))
    hashed = indexed.withColumn("_hash", hashing.preview_hash(F.col("ordinal"), F.col("x"), F.col("y"), F.col("z")))
    placed = attach(settle(hashed.filter(finite)), low_high)
    epsilon = 2.0**-23

    def cell(axis: str) -> Column:
        span = F.greatest(F.col(f"high_{axis}") - F.col(f"low_{axis}"), F.lit(epsilon))
        index = F.floor((F.col(axis) - F.col(f"low_{axis}")) / span * settings.grid)
        return F.least(F.greatest(index, F.lit(0)), F.lit(settings.grid - 1))

    placed = placed.withColumns(dict(zip(KEY, (cell(a) for a in "xyz")))).drop(*[c for c in low_high.columns])
    best = placed.groupBy(*KEY).agg(F.min_by(F.struct("ordinal", "_hash"), F.struct("_hash", "ordinal")).alias("_a"))
    anchors = lowest_hashes(settle(best.select("_a.ordinal", "_a._hash")), "_hash", settings.budget, "ordinal")
    anchors = settle(anchors)
    used = anchors.count()
    rest = placed.drop(*KEY).join(anchors.select("ordinal"), "ordinal", "left_anti")
    share = settings.budget - used
    threshold = min(int(share / total * float(hashing.U64_MAX)), hashing.U64_MAX)
    candidates = rest.filter(F.col("_hash") <= F.lit(hashing.threshold_to_signed(threshold)))
    sampled = lowest_hashes(settle(candidates), "_hash", share, "ordinal")
    anchored = placed.drop(*KEY).join(anchors.select("ordinal"), "ordinal", "left_semi")
    return anchored.withColumn("anchor", F.lit(True)).unionByName(sampled.withColumn("anchor", F.lit(False))).drop("_hash")
