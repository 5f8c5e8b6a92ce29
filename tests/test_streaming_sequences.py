"""Schedules and keyframes over arriving frames equal those over whole captures."""

import random

import pytest
from pyspark.sql import functions as F

from scenefold.operators import ordering
from scenefold.settings import KeyframeSettings, WindowSettings
from scenefold.streaming import increments, sequences

SCHEMA = "capture string, ordinal long, signature array<double>, sharpness double, closed boolean"
KEY = KeyframeSettings(minimum_novelty=0.1, minimum_sharpness=0.02)


def captures(rng):
    return {f"c{n}": [(i, [rng.random()], rng.random()) for i in range(n)] for n in (1, 2, 3, 5, 6, 11, 12, 13, 21, 22, 47)}


def deliver(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i


def stream(spark, tmp_path):
    return increments.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, "*.parquet", 1)


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    rng, path = random.Random(5), tmp_path_factory.mktemp("arrivals")
    whole = captures(rng)
    rows = [(c, i, s, q, False) for c, frames in whole.items() for i, s, q in frames]
    rng.shuffle(rows)
    repeats = rng.sample(rows, 20)
    third = len(rows) // 3
    ends = [(c, None, None, None, True) for c in whole]
    late = [("c13", 13, [0.5], 0.5, False)]
    deliver(spark, path, [rows[:third], rows[third : 2 * third] + repeats[:10], rows[2 * third :] + repeats[10:], ends, late])
    frames = spark.createDataFrame([r[:4] for r in rows], "capture string, ordinal long, signature array<double>, sharpness double")
    return path, frames


@pytest.mark.parametrize("size,overlap", [(12, 3), (4, 0), (5, 4)])
def test_windows_of_a_stream(spark, delivered, tmp_path, size, overlap):
    path, frames = delivered
    settings = WindowSettings(size, overlap)
    windows = sequences.window_stream(stream(spark, path), "capture", settings=settings)
    increments.run_to_table(windows, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() >= 2
    expected = ordering.window_schedule(frames, ["capture"], settings=settings)
    assert sorted(out.drop("batch").collect()) == sorted(expected.collect())


@pytest.mark.parametrize("settings", [KEY, KeyframeSettings(0.5, 0.5, 0.1, 0.02), KeyframeSettings(0.6, 0.4)])
def test_keyframes_of_a_stream(spark, delivered, tmp_path, settings):
    path, frames = delivered
    chosen = sequences.keyframe_stream(stream(spark, path), "capture", 8.0, settings=settings)
    increments.run_to_table(chosen, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    novelty = lambda a, b: F.abs(a[0] - b[0])
    expected = ordering.keyframes(frames, ["capture"], 8.0, novelty, settings)
    assert sorted(out.collect()) == sorted(expected.select("capture", "ordinal").collect())


def test_a_restart_goes_on_from_the_state(spark, tmp_path):
    row = lambda i, end=False: ("a", None if end else i, [0.0], 1.0, end)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for batch in ([row(i) for i in (0, 1, 2, 4)], [row(3), row(5)], [row(6), row(0, True)]):
        deliver(spark, tmp_path, [batch])
        increments.run_to_table(sequences.window_stream(stream(spark, tmp_path), "capture", settings=WindowSettings(4, 1)), out, state, "append")
    rows = spark.read.parquet(out).orderBy("window_index").collect()
    assert [(r.window_index, r.start, r.stop) for r in rows] == [(0, 0, 4), (1, 3, 7)]


def test_idle_captures_end_by_a_timer(spark, tmp_path):
    schema = "capture string, ordinal long, at timestamp"
    base = "2024-01-01 00:00:"
    batches = [[("a", i, f"{base}0{i}") for i in range(3)], [("b", 0, f"{base}30")], [("b", 1, f"{base}31")]]
    for rows in batches:
        spark.createDataFrame(rows, "capture string, ordinal long, at string").select("capture", "ordinal", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames = increments.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "*.parquet", 1).withWatermark("at", "1 second")
    windows = sequences.window_stream(frames, "capture", settings=WindowSettings(4, 1), closed=None, millis="at", idle_millis=5000)
    increments.run_to_table(windows, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.capture, r.window_index, r.start, r.stop) for r in rows] == [("a", 0, 0, 3)]


class Store:
    """State of one capture in memory, as a handle gives it out; counts what is asked."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.map.pop(key, None)

    def clear(self):
        self.calls += 1
        self.map = {}

    exists = lambda self: self.value is not None
    containsKey = lambda self, key: self.getValue(key) is not None


@pytest.mark.parametrize("block,held,most", [(256, 64, 60), (2, 2, None)])
def test_the_store_is_asked_for_blocks_of_frames(monkeypatch, block, held, most):
    monkeypatch.setattr(sequences, "BLOCK_FRAMES", block, raising=False)
    monkeypatch.setattr(sequences, "HELD_BLOCKS", held, raising=False)
    rng = random.Random(3)
    rows = [{"ordinal": i, "signature": [rng.random()], "sharpness": rng.random(), "closed": False, "millis": None} for i in range(300)]
    ends = [{"ordinal": None, "signature": None, "sharpness": None, "closed": True, "millis": None}]
    whole, parts = [], list(rows)
    rng.shuffle(parts)
    for batches in ([rows + ends], [parts[:100], parts[100:200], parts[200:], ends]):
        for processor in (sequences.ScheduleProcessor(["capture", "window_index", "start", "stop"], WindowSettings(), None),
                          sequences.KeyframeProcessor(["capture", "ordinal"], 8.0, sequences.mean_change, KEY, None)):
            store = Store()
            processor.init(store)
            whole.append([tuple(r) for batch in batches for r in processor.handleInputRows(("a",), iter(batch), None)])
            assert not store.map
            assert most is None or store.calls <= most
    assert whole[0] == whole[2] and whole[1] == whole[3] and len(whole[0]) == 33


def test_files_of_a_batch_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    from scenefold.workloads import streams

    spark.range(100_000).write.parquet(str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert streams._deal(table, str(tmp_path / "one")) == 1
    monkeypatch.setattr(streams, "FILE_BYTES", 20_000)
    files = streams._deal(table, str(tmp_path / "many"))
    assert files > 1 and len(list((tmp_path / "many").glob("*.parquet"))) == 4 * files
    assert spark.read.parquet(str(tmp_path / "many")).distinct().count() == 100_000
