"""Depth rasters: scale calibration, visibility, resampling and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import FusionError
from ..functions import cameras as C
from ..functions import hashing
from ..functions import vectors as V
from ..session import settle
from ..settings import CalibrationSettings, FrameGlobalSettings
from .common import attach, equi, first_by, latest_by
from .matching import bilinear
from .ordering import adjacent
from .quantiles import is_small, median, percentiles, statistics


# --- scale from tracks ---------------------------------------------------

def scale_reports(evidence: DataFrame, keys: list[str], hold_out: Column, minimum_train: int, train_error: bool = True) -> DataFrame:
    """Log-scale and held-out error per key.

    The scale is the median log ratio of the training tracks, the error the
    median deviation of the held-out ones from it. Too few training tracks, or
    no held-out one, leave both NULL.
    """
    marked = evidence.withColumn("_held", hold_out)
    counts = marked.groupBy(*keys).agg(
        F.sum((~F.col("_held")).cast("long")).alias("scale_samples"), F.sum(F.col("_held").cast("long")).alias("held_out_samples"))
    train = statistics(marked, keys, {"_log": (F.when(~F.col("_held"), F.col("log_ratio")), 0.5)})
    usable = (F.col("scale_samples") >= minimum_train) & (F.col("held_out_samples") > 0)
    base = counts.join(train, keys, "left").withColumn("log_scale", F.when(usable, F.col("_log"))).drop("_log")
    if not is_small(marked):
        # One row per key; settled, because the deviations are then gone through twice.
        base = settle(base)
    deviation = marked.join(base.select(*keys, "log_scale"), keys).withColumn("_e", F.abs(F.col("log_ratio") - F.col("log_scale")))
    wanted = {"held_out_median_log_error": (F.when(F.col("_held"), F.col("_e")), 0.5)}
    if train_error:
        wanted["train_median_log_error"] = (F.when(~F.col("_held"), F.col("_e")), 0.5)
    return base.join(statistics(deviation, keys, wanted, within=marked), keys, "left").withColumn("scale", F.exp("log_scale"))


def frame_scale_reports(evidence: DataFrame, keys: list[str], settings: FrameGlobalSettings = FrameGlobalSettings()) -> DataFrame:
    return scale_reports(evidence, keys, hashing.modulo_hold_out(F.col("point_id")), settings.minimum_scale_samples, train_error=False)


def calibrate_batches(evidence: DataFrame, keys: list[str], fold: str, pose: Column,
                      settings: CalibrationSettings = CalibrationSettings()) -> DataFrame:
    """Calibration of every prediction with its acceptance flag."""
    held = hashing.keyed_hold_out(fold, pose, F.col("point_id"))
    reports = scale_reports(evidence, keys, held, 1)
    accepted = (
        (F.col("scale_samples") >= settings.minimum_train) & (F.col("held_out_samples") >= settings.minimum_held_out)
        & F.col("held_out_median_log_error").isNotNull()
    )
    return reports.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def is_accepted(settings: FrameGlobalSettings = FrameGlobalSettings()) -> Column:
    good = F.col("scale").isNotNull() & (F.col("held_out_median_log_error") <= settings.maximum_held_out_error)
    return F.coalesce(good, F.lit(False))


def canonical_views(reports: DataFrame, keys: list[str], settings: FrameGlobalSettings = FrameGlobalSettings()) -> DataFrame:
    """One view per frame: accepted, lower error, more samples, earlier window."""
    error = F.coalesce("held_out_median_log_error", F.lit(float("inf")))
    return first_by(reports, [*keys, "frame_index"],
                    [~is_accepted(settings), error, -F.col("scale_samples"), F.col("window_index")])


def canonical_predictions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One prediction per frame by training error only; held-out tracks stay unseen."""
    error = F.coalesce("train_median_log_error", F.lit(float("inf")))
    return first_by(rows, [*keys, "frame_index"],
                    [error, -F.col("scale_samples"), F.col("batch_index"), F.col("source_slot")])


def smooth_scales(reports: DataFrame, held_out: DataFrame, keys: list[str], ordinal: str,
                  settings: FrameGlobalSettings = FrameGlobalSettings()) -> DataFrame:
    """Median of the neighbouring log-scales, kept where the held-out tracks still agree.

    Neighbours lie within ``smoothing_radius`` positions and frames with no
    rejected report in between. Adds ``smoothed_log`` and updates ``log_scale``,
    ``scale`` and ``held_out_median_log_error``.
    """
    reach = settings.smoothing_radius
    if reach == 0:
        return reports.withColumn("smoothed_log", F.lit(None).cast("double"))
    tagged = reports.withColumn("_ok", is_accepted(settings))
    offsets = [d for d in range(-reach, reach + 1) if d != 0]

    def at(name: str, d: int):
        return lambda w: (F.lead(name, d) if d > 0 else F.lag(name, -d)).over(w)

    columns = {}
    for d in offsets:
        tag = f"{'p' if d > 0 else 'm'}{abs(d)}"
        columns |= {f"_ok_{tag}": at("_ok", d), f"_log_{tag}": at("log_scale", d), f"_frame_{tag}": at("frame_index", d)}
    seen = adjacent(tagged, keys, ordinal, columns, before=reach, after=reach)
    picks = [F.col("log_scale")]
    for d in offsets:
        side, size = ("p" if d > 0 else "m"), abs(d)
        clear = F.lit(True)
        for step in range(1, size + 1):
            clear = clear & F.coalesce(F.col(f"_ok_{side}{step}"), F.lit(False))
        near = F.abs(F.col(f"_frame_{side}{size}") - F.col("frame_index")) <= reach
        picks.append(F.when(clear & near, F.col(f"_log_{side}{size}")))
    logs = F.array_sort(F.array_compact(F.array(*picks)))
    size = F.size("_logs")
    middle = (F.element_at("_logs", F.floor((size + 1) / 2).cast("int")) + F.element_at("_logs", F.floor(size / 2).cast("int") + 1)) / 2
    smoothed = seen.withColumn("_logs", logs).withColumn("smoothed_log", F.when(F.col("_ok") & (size > 1), middle))
    smoothed = smoothed.select(*reports.columns, "smoothed_log")
    errors = held_out.join(smoothed.filter("smoothed_log is not null").select(*keys, "frame_index", "smoothed_log"), [*keys, "frame_index"])
    errors = statistics(errors, [*keys, "frame_index"], {"_error": (F.abs(F.col("log_ratio") - F.col("smoothed_log")), 0.5)}, within=held_out)
    joined = smoothed.join(errors, [*keys, "frame_index"], "left")
    better = F.coalesce(F.col("_error") <= settings.maximum_held_out_error, F.lit(False))
    return joined.withColumns({
        "held_out_median_log_error": F.when(better, F.col("_error")).otherwise(F.col("held_out_median_log_error")),
        "scale": F.when(better, F.exp("smoothed_log")).otherwise(F.col("scale")),
        "log_scale": F.when(better, F.col("smoothed_log")).otherwise(F.col("log_scale")),
    }).drop("_error")


def frame_coverage(reports: DataFrame, keys: list[str], settings: FrameGlobalSettings = FrameGlobalSettings()) -> DataFrame:
    """Accepted share of all frames against the required share."""
    covered = F.sum(is_accepted(settings).cast("long"))
    return reports.groupBy(*keys).agg(covered.alias("fused_frames"), F.count(F.lit(1)).alias("total_frames")).withColumn(
        "passed", (F.col("total_frames") > 0) & (F.col("fused_frames") >= settings.minimum_frame_coverage * F.col("total_frames")))


def rebase_points(points: DataFrame, raster: tuple[int, int]) -> DataFrame:
    """Move measured points to their global camera at the calibrated scale.

    One row needs the measured point (px, py, x, y, z, nx, ny, nz, radius,
    confidence), its view (w2c, k), the global camera (global_w2c, f, cx, cy,
    radial, width, height) and ``scale``. Rows that cannot be moved are dropped.
    """
    w, h = F.lit(raster[0]), F.lit(raster[1])
    names = ("x", "y", "z", "nx", "ny", "nz")
    gate = (
        V.all_finite(*[F.col(c) for c in names]) & V.positive(F.col("radius")) & V.positive(F.col("confidence"))
        & V.positive(F.col("scale"))
    )
    u = C.resize_centre(F.col("px"), w, F.col("width"))
    v = C.resize_centre(F.col("py"), h, F.col("height"))
    lens = (F.col("f"), F.col("cx"), F.col("cy"), F.col("radial"))
    # One projection per step keeps every expression small.
    local = C.camera_depth("w2c", V.vec("x", "y", "z"))
    moved = points.filter(gate).withColumn("_local", F.when(V.positive(local), local))
    moved = C.undistort(moved.withColumn("_depth", F.col("_local") * F.col("scale")), u, v, lens, ("_rx", "_ry")).filter("_rx is not null and _local is not null")
    depth = F.col("_depth")
    moved = V.columns(moved, C.camera_to_world("global_w2c", (F.col("_rx") * depth, F.col("_ry") * depth, depth)), names[:3])
    moved = V.columns(moved, V.rotate(C.w2c_rotation("w2c"), V.vec(*names[3:])), names[3:])
    moved = V.columns(moved, V.rotate_back(C.w2c_rotation("global_w2c"), V.vec(*names[3:])), names[3:])
    moved = V.columns(moved, V.normalize(V.vec(*names[3:]), 1e-6), names[3:])
    pixel_radius = F.col("radius") * F.least(F.col("k").getItem(0), F.col("k").getItem(4)) / F.col("_local")
    moved = moved.withColumn("radius", pixel_radius * depth / F.col("f"))
    moved = V.pin(moved, *names, "radius")
    good = V.all_finite(*[F.col(c) for c in names[:3]]) & F.col("nx").isNotNull() & V.positive(F.col("radius"))
    return moved.filter(good).drop("_local", "_rx", "_ry", "_depth")


# --- visibility ----------------------------------------------------------

def z_buffer(points: DataFrame, cameras: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Nearest projected point per pixel where each point belongs to one camera key.

    ``points``: keys, pid, x, y, z. ``cameras``: keys, frame_index, fx, fy, cx,
    cy, w2c, unique per key. The first point wins equal depths. The minimum
    combines before the shuffle, so a pixel hit by very many points is no hot spot.
    """
    joined = points.join(cameras, keys)
    seen = V.columns(joined, C.world_to_camera("w2c", V.vec("x", "y", "z")), ("_cx", "_cy", "_cz"))
    seen = seen.withColumn("depth", F.when(V.positive(F.col("_cz")), F.col("_cz"))).filter("depth is not null")
    seen = seen.withColumns({
        "_px": F.rint(F.col("fx") * F.col("_cx") / F.col("depth") + F.col("cx")),
        "_py": F.rint(F.col("fy") * F.col("_cy") / F.col("depth") + F.col("cy")),
    }).filter(F.col("_px").between(0, width - 1) & F.col("_py").between(0, height - 1))
    placed = seen.select(*keys, "frame_index", F.col("_px").cast("int").alias("px"), F.col("_py").cast("int").alias("py"), "depth", "pid")
    return nearest_per_pixel(placed, [*keys, "frame_index"])


def z_buffer_all(points: DataFrame, cameras: DataFrame, width: int, height: int, maximum_cameras: int = 1800) -> DataFrame:
    """Every point tested against every camera of one capture.

    A capture has at most ``maximum_cameras`` frames (checked), so the cameras
    travel as a constant of a few hundred kilobytes. Each Arrow batch is
    projected at once and reduced to its own pixel minima before the shuffle.
    """
    rows = cameras.select("frame_index", "fx", "fy", "cx", "cy", "w2c").limit(maximum_cameras + 1).collect()
    if len(rows) > maximum_cameras:
        raise FusionError(f"a capture has at most {maximum_cameras} cameras")
    views = [(int(r.frame_index), r.fx, r.fy, r.cx, r.cy, np.array(r.w2c[:12], dtype=float).reshape(3, 4)) for r in rows]

    def run(batches):
        for batch in batches:
            xyz, pid = batch[["x", "y", "z"]].to_numpy(), batch["pid"].to_numpy()
            for frame, fx, fy, cx, cy, pose in views:
                p = xyz @ pose[:, :3].T + pose[:, 3]
                front = np.isfinite(p).all(axis=1) & (p[:, 2] > 0)
                p, ids = p[front], pid[front]
                px, py = np.rint(fx * p[:, 0] / p[:, 2] + cx), np.rint(fy * p[:, 1] / p[:, 2] + cy)
                inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
                out = pd.DataFrame({"frame_index": frame, "px": px[inside].astype(np.int32), "py": py[inside].astype(np.int32),
                                    "depth": p[inside, 2], "pid": ids[inside]})
                yield out.sort_values(["depth", "pid"]).drop_duplicates(["px", "py"])

    seen = points.select("pid", "x", "y", "z").mapInPandas(run, "frame_index int, px int, py int, depth double, pid long")
    return nearest_per_pixel(seen, ["frame_index"])


def nearest_per_pixel(samples: DataFrame, keys: list[str]) -> DataFrame:
    return first_by(samples, [*keys, "px", "py"], [F.col("depth"), F.col("pid")])


def tile_ratio(pixels: DataFrame, keys: list[str], width: int, height: int, cells: int, minimum: int) -> DataFrame:
    """Median of reference over predicted depth per tile, 1 where too few pixels agree.

    ``pixels``: keys, px, py, depth (predicted), reference. Every pixel keeps its row.
    """
    cell_w, cell_h = max(1, -(-width // cells)), max(1, -(-height // cells))
    tiled = pixels.withColumns({"tx": F.floor(F.col("px") / cell_w), "ty": F.floor(F.col("py") / cell_h)})
    both = V.positive(F.col("depth")) & V.positive(F.col("reference"))
    ratio = F.when(both, F.col("reference") / F.when(both, F.col("depth")))
    valid = tiled.withColumn("_ratio", ratio).filter(F.col("_ratio").between(0.5, 2.0))
    tile = [*keys, "tx", "ty"]
    enough = valid.groupBy(*tile).agg(F.count(F.lit(1)).alias("samples")).filter(F.col("samples") >= minimum)
    middle = median(valid, tile, "_ratio", "ratio").join(enough, tile)
    return tiled.join(middle.select(*tile, "ratio"), tile, "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))


def resample_nearest(pixels: DataFrame, keys: list[str], source: tuple[int, int], target: tuple[int, int],
                     colour: bool = False) -> DataFrame:
    """Nearest resize by computing, for each source pixel, the target pixels it feeds.

    Depth maps pixel centres (half to even); colour uses the integer floor map.
    The target indices of one source index form a short range, found by
    inverting the monotonic map, so no target grid is generated.
    """
    def spread(df: DataFrame, name: str, size_in: int, size_out: int) -> DataFrame:
        reach = -(-size_out // size_in) + 1
        middle = F.floor((F.col(name) + 0.5) * size_out / size_in)
        candidate = F.explode(F.sequence(middle - reach, middle + reach))
        df = df.withColumn("_t", candidate).filter(F.col("_t").between(0, size_out - 1))
        if colour:
            back = F.floor(F.col("_t") * size_in / size_out)
        else:
            back = F.least(F.greatest(F.rint((F.col("_t") + 0.5) * size_in / size_out - 0.5), F.lit(0.0)), F.lit(float(size_in - 1)))
        return df.filter(back == F.col(name)).withColumn(name, F.col("_t").cast("int")).drop("_t")

    resized = spread(spread(pixels, "px", source[0], target[0]), "py", source[1], target[1])
    if not colour:
        resized = resized.withColumn("depth", F.when(V.positive(F.col("depth")), F.col("depth")))
    return resized


def fill_from_reference(pixels: DataFrame, frame_keys: list[str]) -> DataFrame:
    """Take the reference depth where it was seen and lift its confidence.

    Seen pixels get at least the 75th confidence percentile of their frame, so
    that the later percentile gate keeps them.
    """
    floor = percentiles(pixels.filter(V.finite(F.col("confidence"))), frame_keys, "confidence", {"_floor": 0.75})
    seen = V.positive(F.col("reference"))
    return pixels.join(floor, frame_keys, "left").withColumns({
        "depth": F.when(seen, F.col("reference")).otherwise(F.col("depth")),
        "confidence": F.when(seen, F.greatest("confidence", "_floor")).otherwise(F.col("confidence")),
        "replaced": seen,
    }).drop("_floor")


# --- summaries -----------------------------------------------------------

def depth_summary(pixels: DataFrame, keys: list[str], value: str = "depth") -> DataFrame:
    """Valid count, coverage, median and 95th percentile."""
    valid = V.positive(F.col(value))
    counts = pixels.groupBy(*keys).agg(
        F.sum(valid.cast("long")).alias("valid_pixels"), F.count(F.lit(1)).alias("pixels"))
    spread = percentiles(pixels.filter(valid), keys, value, {"depth_median": 0.5, "depth_p95": 0.95})
    return counts.join(spread, keys, "left").withColumn("coverage", F.col("valid_pixels") / F.col("pixels"))


def track_depth_report(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and log error of dense depth at sparse tracks.

    ``samples``: keys, expected (track depth), measured (NULL where unseen).
    """
    both = V.positive(F.col("expected")) & F.col("measured").isNotNull()
    marked = samples.withColumn("_e", F.when(both, F.abs(F.log(F.col("measured") / F.when(both, F.col("expected"))))))
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.count("_e").alias("covered_observations"))
    spread = percentiles(marked.filter("_e is not null"), keys, "_e",
                         {"median_abs_log_depth_error": 0.5, "p95_abs_log_depth_error": 0.95})
    return equi(counts, spread, keys, "left").withColumn("coverage", F.col("covered_observations") / F.col("observations"))


def local_minimum_depth(samples: DataFrame, raster: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest depth in the 3x3 pixels around ``(u, v)`` as ``measured`` (NULL if none)."""
    tiles = raster.select(*keys, F.col("px").alias("_px"), F.col("py").alias("_py"), "depth").withColumns(
        {"_tx": F.shiftright("_px", 2), "_ty": F.shiftright("_py", 2)})
    found = _reached_tiles(samples).join(tiles, [*keys, "_tx", "_ty"], "left")
    inside = (F.abs(F.col("_px") - F.col("_u")) <= 1) & (F.abs(F.col("_py") - F.col("_v")) <= 1)
    return found.groupBy(*samples.columns).agg(F.min(F.when(inside, F.col("depth"))).alias("measured"))


def _reached_tiles(samples: DataFrame) -> DataFrame:
    """Each sample once for every tile of 4x4 pixels that the 3x3 pixels around it touch."""
    around = lambda c: F.explode_outer(F.sequence(F.shiftright(F.col(c) - 1, 2), F.shiftright(F.col(c) + 1, 2)))
    placed = samples.withColumns({"_u": F.rint("u").cast("int"), "_v": F.rint("v").cast("int")})
    return placed.withColumn("_tx", around("_u")).withColumn("_ty", around("_v"))


def bilinear_depth(samples: DataFrame, raster: DataFrame, keys: list[str], query_keys: list[str], size: tuple[int, int]) -> DataFrame:
    """Tool variant of the bilinear sample: the edge repeats, only the result must be positive."""
    inside = F.col("u").between(0, size[0] - 1) & F.col("v").between(0, size[1] - 1)
    return bilinear(samples.filter(inside), raster, keys, query_keys, "depth", clamp=size)


def global_ratio_report(ratios: DataFrame) -> DataFrame:
    """Per-frame errors after one median ratio over all frames.

    ``ratios``: frame_index, ratio. The global median is one row and is attached.
    """
    scale = median(ratios.filter(V.positive(F.col("ratio"))), [], "ratio", "global_ratio")
    marked = attach(ratios.filter(V.positive(F.col("ratio"))), scale).withColumn("_e", F.abs(F.log(F.col("ratio") / F.col("global_ratio"))))
    counts = marked.groupBy("frame_index").agg(F.count(F.lit(1)).alias("track_samples"), F.first("global_ratio").alias("global_ratio"))
    middle = median(marked, ["frame_index"], "ratio", "median_ratio")
    errors = percentiles(marked, ["frame_index"], "_e", {"median_abs_log_error": 0.5, "p95_abs_log_error": 0.95})
    return counts.join(middle, "frame_index").join(errors, "frame_index")


def coloured_depth(pixels: DataFrame, frame_keys: list[str]) -> DataFrame:
    """Preview colours of inverse depth between its 2nd and 98th percentile; invalid is black."""
    valid = V.positive(F.col("depth"))
    inverse = pixels.withColumn("_inverse", F.when(valid, 1.0 / F.when(valid, F.col("depth"))))
    ends = percentiles(inverse.filter("_inverse is not null"), frame_keys, "_inverse", {"_low": 0.02, "_high": 0.98})
    joined = inverse.join(ends, frame_keys, "left")
    fraction = (F.col("_inverse") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-8))
    colours = C.depth_colour(fraction)
    return joined.withColumns({
        name: F.when(F.col("_inverse").isNotNull(), colour).otherwise(F.lit(0).cast("short"))
        for name, colour in zip("rgb", colours)
    }).drop("_inverse", "_low", "_high")


def newest_per_pixel(points: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last stored point of each source pixel."""
    return latest_by(points, [*keys, "px", "py"], order)
