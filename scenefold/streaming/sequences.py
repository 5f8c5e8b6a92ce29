"""Window schedules and keyframes of captures whose frames are still arriving.

Each capture is a key of ``transformWithState``. Frames may come late and out of order
within their capture: they wait in the state until those before them are there. What is
decided is given out at once and never changes; what depends on the end of the capture
(its last window, its last keyframe) waits for the end. A capture ends with a row whose
``closed`` is true, or, where ``idle_millis`` is given, when the watermark has passed its
newest event by that much (an event-time timer). Rows behind the end of a capture, and
frames that were there before, change nothing.

The state of a capture is a few numbers and the frames that wait: those ahead of a gap
and, for keyframes, those in reach of the last one. Frames wait in blocks of neighbours,
so that a batch asks the state store once for a block and not once for a frame; a task
holds few blocks at a time. All rows given out together are those of
``operators.ordering`` over the whole capture.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..errors import ScheduleError
from ..operators.ordering import gap_frames, valid_gaps
from ..settings import KeyframeSettings, WindowSettings

#: Frames of a block, and the blocks that a task holds before it writes them back.
BLOCK_FRAMES, HELD_BLOCKS = 256, 64
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> SparkSession:
    """``transformWithState`` needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class CaptureProcessor(StatefulProcessor):
    """Puts the frames of a capture in order and asks for what can be decided."""

    progress = "frames long, newest long, ended boolean"
    #: What is known of the work done, and what is kept of a frame beside its ordinal.
    memory, frame = "", ()

    def __init__(self, names: list[str], idle_millis: int | None) -> None:
        self.names, self.idle = names, idle_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", f"{self.progress}, {self.memory}")
        kept = ", ".join(["ordinal: bigint", *self.frame])
        self.waiting = handle.getMapState("waiting", "block long", f"frames array<struct<{kept}>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self._now()
        if now["ended"]:
            return
        self.held, self.changed = {}, set()
        closed, newest = False, now["newest"]
        for row in rows:
            closed = closed or bool(row["closed"])
            if row["millis"] is not None:
                newest = max(newest, row["millis"])
            if row["ordinal"] is not None and row["ordinal"] >= now["frames"]:
                self._keep(row["ordinal"], self.kept(row))
        first = now["frames"]
        while self._frame(now["frames"]) is not None:
            now["frames"] += 1
        if not self.frame:
            # Only the place of a frame counts: those in order need not wait.
            self._drop(first, now["frames"])
        yield from self._give(key, now, closed)
        if self.idle is not None and not closed and newest > now["newest"]:
            self._stop_timers()
            self.handle.registerTimer(newest + self.idle)
        now["newest"] = newest
        self._remember(now, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._now()
        self.held, self.changed = {}, set()
        if not now["ended"]:
            yield from self._give(key, now, True)
            self._remember(now, True)

    def close(self) -> None:
        pass

    def _now(self) -> dict:
        held = self.state.get()
        names = [p.split()[0] for p in f"{self.progress}, {self.memory}".split(", ")]
        return dict(zip(names, held, strict=True)) if held is not None else dict.fromkeys(names, 0) | {"ended": False}

    def _remember(self, now: dict, ended: bool) -> None:
        now["ended"] = ended
        self.state.update(tuple(now.values()))
        if ended:
            # The capture itself stays known, so that late rows do not open it anew.
            self.waiting.clear()
            self._stop_timers()
        else:
            self._write_back()

    def _stop_timers(self) -> None:
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def _give(self, key, now: dict, closed: bool) -> Iterator[Row]:
        for values in self.decide(now, closed):
            yield Row(*self.names)(*key, *values)

    def _write_back(self) -> None:
        for block in self.changed:
            if frames := self.held[block]:
                self.waiting.updateValue((block,), ([(ordinal, *kept) for ordinal, kept in frames.items()],))
            else:
                self.waiting.removeKey((block,))
        self.held, self.changed = {}, set()

    def _block(self, block: int) -> dict[int, tuple]:
        """The waiting frames of a block by their ordinal."""
        if block not in self.held:
            if len(self.held) >= HELD_BLOCKS:
                self._write_back()
            stored = self.waiting.getValue((block,))
            self.held[block] = {ordinal: tuple(kept) for ordinal, *kept in stored[0]} if stored is not None else {}
        return self.held[block]

    def _frame(self, ordinal: int) -> tuple | None:
        return self._block(ordinal // BLOCK_FRAMES).get(ordinal)

    def _keep(self, ordinal: int, kept: tuple) -> None:
        self._block(ordinal // BLOCK_FRAMES)[ordinal] = kept
        self.changed.add(ordinal // BLOCK_FRAMES)

    def _drop(self, first: int, last: int) -> None:
        for block in range(first // BLOCK_FRAMES, -(-last // BLOCK_FRAMES) if last > first else 0):
            frames = self._block(block)
            for ordinal in range(max(first, block * BLOCK_FRAMES), min(last, (block + 1) * BLOCK_FRAMES)):
                if frames.pop(ordinal, None) is not None:
                    self.changed.add(block)

    def kept(self, row: Row) -> tuple:
        raise NotImplementedError

    def decide(self, now: dict, closed: bool) -> Iterator[tuple]:
        raise NotImplementedError


class ScheduleProcessor(CaptureProcessor):
    """Full windows as soon as their last frame is there, the last one at the end."""

    memory = "windows long"

    def __init__(self, names: list[str], settings: WindowSettings, idle_millis: int | None) -> None:
        super().__init__(names, idle_millis)
        if settings.size <= 0 or not 0 <= settings.overlap < settings.size:
            raise ScheduleError("overlap must be smaller than the window size")
        self.size, self.step = settings.size, settings.size - settings.overlap

    def kept(self, row: Row) -> tuple:
        return ()

    def decide(self, now: dict, closed: bool) -> Iterator[tuple]:
        frames = now["frames"]
        while now["windows"] * self.step + self.size <= frames:
            start = now["windows"] * self.step
            yield now["windows"], start, start + self.size
            now["windows"] += 1
        start = now["windows"] * self.step
        covered = (now["windows"] - 1) * self.step + self.size if now["windows"] else 0
        if closed and start < frames and covered < frames:
            yield now["windows"], start, frames
            now["windows"] += 1


class KeyframeProcessor(CaptureProcessor):
    """The next keyframe as soon as all frames in reach of the last one are there."""

    memory, frame = "last long, begun boolean", ("signature: array<double>", "sharpness: double")

    def __init__(self, names: list[str], fps: float, novelty: Callable, settings: KeyframeSettings, idle_millis: int | None) -> None:
        super().__init__(names, idle_millis)
        self.low, self.high = gap_frames(fps, settings) if valid_gaps(fps, settings) else (0, 0)
        self.novelty, self.settings = novelty, settings

    def kept(self, row: Row) -> tuple:
        return list(row["signature"]), row["sharpness"]

    def _best(self, last: int, stop: int) -> int | None:
        """The frame with the largest accepted score in ``last + low .. stop``, the first of equals."""
        seen = self._frame(last)[0]
        best, chosen = None, None
        for ordinal in range(last + self.low, stop + 1):
            signature, sharpness = self._frame(ordinal)
            change = self.novelty(seen, signature)
            if sharpness >= self.settings.minimum_sharpness and change >= self.settings.minimum_novelty:
                if best is None or sharpness * change > best:
                    best, chosen = sharpness * change, ordinal
        return chosen

    def decide(self, now: dict, closed: bool) -> Iterator[tuple]:
        frames = now["frames"]
        if not frames:
            return
        if not now["begun"]:
            now["begun"] = True
            yield (0,)
        if not self.low:
            # Gaps that make no band keep every frame.
            for ordinal in range(now["last"] + 1, frames):
                yield (ordinal,)
            self._drop(now["last"], frames - 1)
            now["last"] = frames - 1
            return
        before = now["last"]
        end = frames - 1
        # Not closed: the end is somewhere behind what is there, so a frame more than the reach decides.
        while now["last"] + self.low < end and (closed or now["last"] + self.high <= end):
            stop = min(now["last"] + self.high, end)
            chosen = self._best(now["last"], stop)
            now["last"] = stop if chosen is None else chosen
            yield (now["last"],)
        if closed:
            if frames <= 2:
                rest = range(now["last"] + 1, frames)
            else:
                rest = range(end, end + 1) if now["last"] < end else ()
            for ordinal in rest:
                yield (ordinal,)
        self._drop(before, now["last"])


def _prepared(frames: DataFrame, key: str, ordinal: str, columns: dict, closed: str | None, millis: str | None) -> DataFrame:
    return frames.select(
        F.col(key), F.col(ordinal).cast("long").alias("ordinal"), *[F.col(c).alias(n) for n, c in columns.items()],
        (F.coalesce(F.col(closed), F.lit(False)) if closed else F.lit(False)).alias("closed"),
        (F.unix_millis(F.col(millis).cast("timestamp")) if millis else F.lit(None).cast("long")).alias("millis"),
        *([F.col(millis)] if millis else []))


def _run(frames: DataFrame, key: str, processor: CaptureProcessor, millis: str | None) -> DataFrame:
    use_state_store(frames.sparkSession)
    out = ", ".join([f"{key} {frames.schema[key].dataType.simpleString()}", *(f"{name} long" for name in processor.names[1:])])
    return frames.groupBy(key).transformWithState(
        processor, outputStructType=StructType.fromDDL(out), outputMode="Append", timeMode="EventTime" if millis else "None")


def window_stream(frames: DataFrame, key: str, ordinal: str = "ordinal", settings: WindowSettings = WindowSettings(), closed: str | None = "closed",
                  millis: str | None = None, idle_millis: int | None = None) -> DataFrame:
    """``ordering.window_schedule`` of a stream of frames: key, window_index, start, stop.

    ``closed`` names the column that ends a capture, ``millis`` the event time with a
    watermark for ``idle_millis``.
    """
    rows = _prepared(frames, key, ordinal, {}, closed, millis)
    return _run(rows, key, ScheduleProcessor([key, "window_index", "start", "stop"], settings, idle_millis if millis else None), millis)


def mean_change(a: list, b: list) -> float:
    """Mean absolute difference of two signatures, 0 for unequal lengths."""
    return sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a) if len(a) == len(b) and len(a) else 0.0


def keyframe_stream(frames: DataFrame, key: str, fps: float, ordinal: str = "ordinal", settings: KeyframeSettings = KeyframeSettings(),
                    novelty: Callable = mean_change, closed: str | None = "closed", millis: str | None = None, idle_millis: int | None = None) -> DataFrame:
    """``ordering.keyframes`` of a stream of frames with ``signature`` (array) and ``sharpness``: key and ordinal."""
    rows = _prepared(frames, key, ordinal, {"signature": "signature", "sharpness": "sharpness"}, closed, millis)
    return _run(rows, key, KeyframeProcessor([key, ordinal], fps, novelty, settings, idle_millis if millis else None), millis)
