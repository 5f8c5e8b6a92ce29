"""Ordered operators without a single-task window.

A global or per-group row number comes from a range partitioning plus
per-partition offsets; row-frame windows run in fixed-size blocks with halo
rows. No step sends one whole group to one task.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import ScheduleError
from ..session import settle
from ..settings import KeyframeSettings, WindowSettings
from .common import apply_by_bucket, equi

BLOCK_ROWS = 65_536
# Frame signatures are a few kilobytes each, so look-ahead blocks are smaller.
LOOKAHEAD_ROWS = 4_096
_POSITION_BITS = 33


def global_index(df: DataFrame, order: list, out: str = "ordinal", keys: list[str] | None = None) -> DataFrame:
    """Zero-based position of every row in the total order ``keys + order``.

    With ``keys`` the position restarts in each group. ``order`` must be total
    for a reproducible result. One range shuffle, one checkpoint (which pins
    the sampled range bounds) and one count per partition; the offsets table
    has one row per partition.
    """
    keys = keys or []
    columns = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = settle(ranged.withColumn("_position", F.monotonically_increasing_id()))
    partition = F.shiftrightunsigned("_position", _POSITION_BITS)
    local = F.col("_position").bitwiseAND((1 << _POSITION_BITS) - 1)
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(partition.alias("_partition")).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select("_partition", "_offset")
    )
    numbered = (
        placed.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn(out, (F.col("_offset") + local).cast("long"))
        .drop("_partition", "_offset", "_position")
    )
    if not keys:
        return numbered
    first = numbered.groupBy(*keys).agg(F.min(out).alias("_first"))
    columns = [c for c in numbered.columns if c != out]
    return numbered.join(first, keys).select(*columns, (F.col(out) - F.col("_first")).alias(out))


def with_halo(df: DataFrame, ordinal: str, before: int, after: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Copy rows into the blocks whose row frames can see them.

    Adds ``_block`` and ``_owned``. A window partitioned by the group keys and
    ``_block`` then holds at most ``block + before + after`` rows; keep the rows
    with ``_owned`` afterwards.
    """
    low = F.floor(F.greatest(F.col(ordinal) - after, F.lit(0)) / block)
    high = F.floor((F.col(ordinal) + before) / block)
    return df.withColumn("_block", F.explode(F.sequence(low, high))).withColumn(
        "_owned", F.floor(F.col(ordinal) / block) == F.col("_block")
    )


def adjacent(df: DataFrame, keys: list[str], ordinal: str, columns: dict[str, Column], before: int = 1, after: int = 0,
             block: int = BLOCK_ROWS) -> DataFrame:
    """Evaluate window expressions that look at most ``before``/``after`` rows away.

    ``columns`` maps output names to functions of the block window.
    """
    haloed = with_halo(df, ordinal, before, after, block)
    window = Window.partitionBy(*keys, "_block").orderBy(ordinal)
    return (
        haloed.withColumns({name: build(window) for name, build in columns.items()})
        .filter("_owned")
        .drop("_block", "_owned")
    )


# --- sampling and numbering ---------------------------------------------

def stride_for_cap(count: int, cap: int) -> int:
    """Stride that keeps at most ``cap`` rows."""
    return max(1, -(-count // cap))


def stride_for_target(count: int, target: int = 3000) -> int:
    """Stride of the key cloud: ``count // target``, so nearly twice the target may stay."""
    return max(1, count // target)


def stride_sample(df: DataFrame, order: list, stride: int) -> DataFrame:
    if stride == 1:
        return df
    return global_index(df, order, "_ordinal").filter(F.col("_ordinal") % stride == 0).drop("_ordinal")


def chunk_numbers(df: DataFrame, order: list, rows: int = 50_000) -> DataFrame:
    """Number ordered output chunks of ``rows`` rows."""
    return global_index(df, order).withColumn("chunk", F.floor(F.col("ordinal") / rows).cast("long"))


# --- window schedule -----------------------------------------------------

def _step(settings: WindowSettings) -> int:
    if settings.size <= 0 or not 0 <= settings.overlap < settings.size:
        raise ScheduleError("overlap must be smaller than the window size")
    return settings.size - settings.overlap


def _frame_counts(frames: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return frames.groupBy(*keys).agg((F.max(ordinal) + 1).alias("_frames"))


def _with_counts(frames: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return equi(frames, _frame_counts(frames, keys, ordinal), keys)


def window_schedule(frames: DataFrame, keys: list[str] | None = None, ordinal: str = "ordinal",
                    settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Half-open windows ``[start, stop)`` over numbered frames.

    The frame at position ``s`` opens a window when ``s`` is a multiple of the
    step and the previous window did not already reach the end.
    """
    keys, step = keys or [], _step(settings)
    start = F.col(ordinal)
    opens = (start % step == 0) & ((start == 0) | (start - step + settings.size < F.col("_frames")))
    return _with_counts(frames, keys, ordinal).filter(opens).select(
        *keys,
        (start / step).cast("long").alias("window_index"),
        start.cast("long").alias("start"),
        F.least(start + settings.size, F.col("_frames")).cast("long").alias("stop"),
    )


def window_members(frames: DataFrame, keys: list[str] | None = None, ordinal: str = "ordinal",
                   settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Every frame once per window holding it, by arithmetic on its position."""
    keys, step = keys or [], _step(settings)
    position = F.col(ordinal)
    first = F.greatest(F.floor((position - settings.size) / step) + 1, F.lit(0))
    last = F.floor(position / step)
    members = _with_counts(frames, keys, ordinal).withColumn("window_index", F.explode(F.sequence(first, last)))
    start = F.col("window_index") * step
    kept = (F.col("window_index") == 0) | (start - step + settings.size < F.col("_frames"))
    return members.filter(kept).drop("_frames")


def batch_schedule(frames: DataFrame, keys: list[str] | None = None, ordinal: str = "ordinal",
                   size: int = 16, overlap: int = 4) -> DataFrame:
    """Fixed-size variant: a tail shorter than three frames re-uses the last frames."""
    keys = keys or []
    windows = window_schedule(frames, keys, ordinal, WindowSettings(size, overlap))
    short = F.col("stop") - F.col("start") < 3
    reused = F.greatest(F.col("stop") - max(3, size), F.lit(0))
    # A re-used tail equal to the window before it is not repeated: that is the
    # case exactly when the sequence ends one step after a window start at 0.
    repeats = short & (reused == (F.col("window_index") - 1) * (size - overlap)) & (F.col("window_index") > 0)
    return windows.filter(~repeats).withColumn("start", F.when(short, reused).otherwise(F.col("start")).cast("long"))


# --- keyframes -----------------------------------------------------------

def valid_gaps(fps: float, settings: KeyframeSettings = KeyframeSettings()) -> bool:
    """Whether the gaps make a band; otherwise every candidate is kept."""
    numbers = (fps, settings.minimum_gap_seconds, settings.maximum_gap_seconds)
    return all(math.isfinite(x) and x > 0 for x in numbers) and settings.minimum_gap_seconds <= settings.maximum_gap_seconds


def gap_frames(fps: float, settings: KeyframeSettings = KeyframeSettings()) -> tuple[int, int]:
    low = max(1, math.ceil(settings.minimum_gap_seconds * fps))
    return low, max(1, math.ceil(settings.maximum_gap_seconds * fps))


def best_followers(frames: DataFrame, keys: list[str], low: int, high: int, novelty,
                   settings: KeyframeSettings, ordinal: str = "ordinal", block: int = BLOCK_ROWS) -> DataFrame:
    """For each frame the frame that would follow it as a keyframe.

    The choice depends only on the frame itself, so it is a bounded look-ahead
    and not a scan: the frames ``low..high`` positions ahead are gathered (at
    most ``high - low + 1``), the best accepted score wins, and with none the
    farthest frame does. ``frames`` has ``signature`` and ``sharpness``.
    """
    haloed = with_halo(_with_counts(frames, keys, ordinal), ordinal, 0, high, block)
    window = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(low, high)
    ahead = F.collect_list(F.struct(F.col(ordinal).alias("o"), "signature", "sharpness")).over(window)
    scored = F.transform(
        F.filter(
            "_ahead",
            lambda f: (f["sharpness"] >= settings.minimum_sharpness)
            & (novelty(F.col("signature"), f["signature"]) >= settings.minimum_novelty),
        ),
        # Largest score first, then the lower position.
        lambda f: F.struct(
            (f["sharpness"] * novelty(F.col("signature"), f["signature"])).alias("score"), (-f["o"]).alias("o")
        ),
    )
    last = F.col("_frames") - 1
    fallback = F.least(F.col(ordinal) + high, last)
    return (
        haloed.withColumn("_ahead", ahead)
        .filter("_owned")
        .select(
            *keys,
            ordinal,
            "_frames",
            F.when(
                F.least(F.col(ordinal) + low, last) < last,
                F.coalesce(-F.array_max(scored)["o"], fallback),
            ).alias("follower"),
        )
    )


def keyframes(frames: DataFrame, keys: list[str], fps: float, novelty, settings: KeyframeSettings = KeyframeSettings(),
              ordinal: str = "ordinal", block: int = BLOCK_ROWS) -> DataFrame:
    """Positions of the selected keyframes of every sequence.

    The selection is the path that starts at position 0 and follows
    ``best_followers``. It is traced in two levels so that no task holds a
    whole sequence: each block of ``block`` rows reports, for every position
    at which the path could enter it, where the path leaves; the short list of
    block entries is chained per sequence; then every block marks its own rows.
    """
    if not valid_gaps(fps, settings):
        return frames.select(*keys, ordinal)
    low, high = gap_frames(fps, settings)
    followers = best_followers(frames, keys, low, high, novelty, settings, ordinal, min(block, LOOKAHEAD_ROWS))
    followers = settle(followers.withColumn("_block", F.floor(F.col(ordinal) / block).cast("long")))
    key_ddl = "".join(f"{name} {kind}, " for name, kind in followers.dtypes if name in keys)

    # Level 1: exits of every possible entry (the first `high` rows of a block).
    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordinal)
        base, stop = int(pdf[ordinal].iloc[0]), int(pdf[ordinal].iloc[-1])
        follow = pdf["follower"].fillna(-1).to_numpy().astype(np.int64)
        leave = np.full(len(pdf), -1, dtype=np.int64)
        for position in range(len(pdf) - 1, -1, -1):
            target = follow[position]
            if target >= 0:
                leave[position] = target if target > stop else leave[target - base]
        entries = np.arange(min(high, len(pdf)))
        head = pdf.iloc[: len(entries)]
        return head[[*keys, "_block"]].assign(entry=head[ordinal].to_numpy(), leave=leave[entries])

    entry_ddl = f"{key_ddl}_block long, entry long, leave long"
    table = settle(apply_by_bucket(followers, [*keys, "_block"], exits, entry_ddl))

    # Level 2: one row per block and entry, i.e. 1/block of the sequence.
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        leave = dict(zip(pdf["entry"], pdf["leave"]))
        visited, position = [], 0
        while position >= 0:
            visited.append(position)
            position = leave.get(position, -1)
        out = pd.DataFrame({"entry": visited})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "entry"]]

    if keys:
        entered = apply_by_bucket(table, keys, chain, f"{key_ddl}entry long")
    else:
        entered = table.groupBy().applyInPandas(chain, "entry long")
    entered = entered.withColumn("_block", F.floor(F.col("entry") / block).cast("long"))

    # Level 3: mark the path inside each block.
    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordinal)
        base, frames_total = int(pdf[ordinal].iloc[0]), int(pdf["_frames"].iloc[0])
        follow = pdf["follower"].fillna(-1).to_numpy().astype(np.int64)
        picked, position = set(), int(pdf["entry"].iloc[0]) if pd.notna(pdf["entry"].iloc[0]) else -1
        while 0 <= position - base < len(pdf):
            picked.add(position)
            position = int(follow[position - base])
        if frames_total <= 2:
            picked.update(pdf[ordinal])
        elif int(pdf[ordinal].iloc[-1]) == frames_total - 1:
            picked.add(frames_total - 1)
        return pdf[pdf[ordinal].isin(picked)][[*keys, ordinal]]

    marked = settle(followers.join(entered, [*keys, "_block"], "left"))
    return apply_by_bucket(marked, [*keys, "_block"], mark, f"{key_ddl}{ordinal} long")


# --- checks and schedules over time -------------------------------------

def monotonic_violations(df: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """Rows whose value is not strictly above the previous one."""
    previous = adjacent(df, keys, ordinal, {"_previous": lambda w: F.lag(value).over(w)})
    return previous.filter(F.col(value) <= F.col("_previous")).drop("_previous")


def uniform_rate(df: DataFrame, keys: list[str], ordinal: str, millis: str = "timestamp_millis") -> DataFrame:
    """Step, evenly spaced leading frames and rate of each sequence.

    One trailing frame may break the step (a clipped tail); with more the rate
    is NULL and frames have to be taken one timestamp at a time. A sequence
    whose timestamps do not increase has ``increasing = false``.
    """
    gaps = adjacent(df, keys, ordinal, {"_gap": lambda w: F.col(millis) - F.lag(millis).over(w)})
    summary = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min_by("_gap", F.when(F.col("_gap").isNotNull(), F.col(ordinal))).alias("step"),
        F.coalesce(F.min("_gap") > 0, F.lit(True)).alias("increasing"),
    )
    joined = equi(gaps, summary, keys)
    broken = F.min(F.when(F.col("_gap") != F.col("step"), F.col(ordinal)))
    carried = [F.first(c).alias(c) for c in ("frames", "step", "increasing")]
    return joined.groupBy(*keys).agg(*carried, broken.alias("_broken")).select(
        *keys, "frames", "step", "increasing",
        F.coalesce("_broken", "frames").alias("uniform_frames"),
    ).withColumn(
        "frames_per_second",
        F.when((F.col("step") > 0) & (F.col("uniform_frames") >= F.col("frames") - 1),
               1000.0 / F.when(F.col("step") > 0, F.col("step"))),
    )


def bridge_schedule(df: DataFrame, keys: list[str], ordinal: str, rate: float, millis: str = "timestamp_millis") -> DataFrame:
    """Evenly spaced timestamps strictly inside each gap longer than one period.

    Inside a gap starting at ``t`` the k-th bridge is ``ceil(t + 1000 k / rate)``
    in exact integer arithmetic; the decimal ``rate`` is taken as a fraction.
    """
    exact = Fraction(str(rate))
    if not 0 < exact <= 1000:
        raise ScheduleError("bridge rate must be in (0, 1000]")
    up, down = exact.numerator, 1000 * exact.denominator
    gaps = adjacent(df, keys, ordinal, {"_next": lambda w: F.lead(millis).over(w)}, before=0, after=1)
    span = F.col("_next") - F.col(millis)
    steps = F.floor((span * up - 1) / down)
    return (
        gaps.filter(steps >= 1)
        .withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), steps)))
        .withColumn("bridge_millis", (F.col(millis) + F.ceil(F.col("step") * down / up)).cast("long"))
        .filter(F.col("bridge_millis") < F.col("_next"))
        .drop("_next", "step")
    )
