"""Formats as data sources: pruning by filters and columns, commits, failed tasks."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In
from pyspark.sql.types import StructType

from scenefold.errors import ImportFormatError
from scenefold.sinks.committed import save
from scenefold.sources import formats
from scenefold.sources.files import committed, committed_chunks, list_files
from test_formats import write_recording


@pytest.fixture(scope="module")
def scenes(spark):
    return formats.register(spark)


def spans(source, schema, tests=()):
    reader = type(source)({**source.options, "push_filters": "true"}).reader(StructType.fromDDL(schema))
    assert list(reader.pushFilters(list(tests))) == list(tests)
    return reader.partitions()


def test_filters_and_columns_of_a_recording(scenes, tmp_path):
    path = str(tmp_path / "a.vps1")
    write_recording(tmp_path / "a.vps1", frames=8)
    source = formats.RecordingSource({"path": path})
    every = spans(source, source.schema())
    assert len(every) == 11
    assert len(spans(source, source.schema(), [EqualTo(("frame_index",), 2)])) == 2
    assert len(spans(source, source.schema(), [In(("window_index",), (0, 1)), GreaterThanOrEqual(("frame_index",), 3)])) == 2
    pixels = scenes.read.format("scene_recording").load(path)
    assert pixels.rdd.getNumPartitions() == 11 and pixels.where("frame_index = 2").count() == 24 and pixels.count() == 132
    chosen = scenes.read.format("scene_recording").option("window_index", "0..1").option("frame_index", "2,3").load(path)
    assert chosen.rdd.getNumPartitions() == 3 and chosen.count() == 36
    scenes.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    once = scenes.read.format("scene_recording").option("push_filters", "true").load(path).where("frame_index = 2")
    assert once.rdd.getNumPartitions() == 2 and once.count() == 24
    scenes.conf.unset("spark.sql.python.filterPushdown.enabled")
    few = scenes.read.format("scene_recording").schema("frame_index int, depth double").load(path)
    assert few.columns == ["frame_index", "depth"] and few.where("frame_index between 1 and 2").agg(F.sum("depth")).first()[0] == 2.0 * 36
    views = scenes.read.format("scene_recording").option("table", "views").load(path).where("window_index = 1").orderBy("frame_index").collect()
    assert [v.frame_index for v in views] == [2, 3, 4] and list(views[0].k) == [2, 0, 1.5, 0, 2, 1, 0, 0, 1]


def test_dense_arrays_read_only_the_rows_that_a_filter_leaves(scenes, tmp_path, monkeypatch):
    for name, step in (("a", 1.0), ("b", 2.0)):
        (tmp_path / name).write_bytes(b"4&6&1&" + (np.arange(24) * step).astype("<f4").tobytes())
    depth = scenes.read.format("scene_dense_array").load(str(tmp_path))
    assert depth.count() == 48 and depth.where("file_name = 'b' and px = 3 and py = 5").first().depth == 46.0
    monkeypatch.setattr(formats, "ROWS_PER_SPAN", 8)
    source = formats.DenseArraySource({"path": str(tmp_path)})
    assert len(spans(source, source.columns)) == 6
    kept = spans(source, source.columns, [EqualTo(("file_name",), "a"), GreaterThanOrEqual(("py",), 4)])
    assert [(s.path[-1], s.known["py"]) for s in kept] == [("a", (4, 5))]
    (tmp_path / "c").write_bytes(b"4&6&1&1234")
    with pytest.raises(ImportFormatError):
        spans(source, source.columns)


def test_prediction_batches_decode_the_wanted_arrays_only(scenes, tmp_path):
    depth = np.arange(24, dtype="f4").reshape(2, 3, 4)
    np.savez(tmp_path / "b0.npz", depth=depth, conf=depth + 1, rgb=np.zeros((1,)), intrinsics=np.zeros((2, 3, 3)), extrinsics=np.zeros((2, 4, 4)), frame_indices=[5, 7])
    path = str(tmp_path / "b0.npz")
    # The colours have a wrong shape; only a reader that asks for them finds out.
    few = scenes.read.format("scene_prediction_batch").schema("frame_index int, px int, py int, depth double, confidence double").load(path)
    assert few.where("frame_index = 7").agg(F.sum("depth"), F.sum("confidence"), F.count("*")).first()[:] == (210.0, 222.0, 12)
    with pytest.raises(Exception, match="inconsistent shapes"):
        scenes.read.format("scene_prediction_batch").load(path).collect()
    source = formats.PredictionBatchSource({"path": path})
    assert len(spans(source, source.columns, [EqualTo(("frame_index",), 7)])) == 1


def test_masks_and_expected_clouds(scenes, tmp_path):
    mask = tmp_path / "m.vsem"
    mask.write_bytes(b"VSEM1" + struct.pack("<III", 2, 2, 2) + struct.pack("<2I", 4, 9) + bytes([0, 1, 2, 3, 4, 5, 6, 0]) + bytes([255] * 8))
    rows = scenes.read.format("scene_semantic_mask").load(str(mask)).where("frame_index = 9").orderBy("y", "x").collect()
    assert [(r.x, r.y, r.class_code, r.confidence) for r in rows] == [(0, 0, 4, 1.0), (1, 0, 5, 1.0), (0, 1, 6, 1.0), (1, 1, 0, 1.0)]
    cloud = tmp_path / "a.cps1"
    cloud.write_bytes(b"CPS1" + struct.pack("<IIII", 1, 2, 3, 1) + struct.pack("<2i", 1, 2) + struct.pack("<9f", *range(9)) + bytes(range(9)) + struct.pack("<3f", 1, 2, 3) + struct.pack("<6f", *range(6)))
    got = scenes.read.format("scene_expected_cloud").load(str(cloud)).orderBy("ordinal").collect()
    assert [(p.ordinal, p.z, p.g, p.radius) for p in got] == [(0, 2.0, 1, 1.0), (1, 5.0, 4, 2.0), (2, 8.0, 7, 3.0)]
    views = tmp_path / "a.mvo1"
    plane = struct.pack("<4f", 1, 2, 3, 4) + struct.pack("<4f", 5, 6, 7, 8) + struct.pack("<21f", *range(21))
    views.write_bytes(b"MVO1" + struct.pack("<IIIII", 1, 2, 2, 0, 1) + struct.pack("<IIII", 0, 2, 2, 2) + plane * 2)
    pixels = scenes.read.format("scene_multiview").load(str(views))
    assert pixels.where("frame_index = 1 and px = 0 and py = 1").first()[2:] == (0, 1, 3.0, 7.0) and pixels.count() == 8


def points(spark, n=25):
    return spark.range(n).select(
        F.floor(F.col("id") / 10).alias("chunk"), F.col("id").alias("ordinal"), *[(F.col("id") * k).cast("double").alias(c) for k, c in enumerate("xyz")],
        *[F.lit(0.5).alias(c) for c in ("nx", "ny", "nz")], *[(F.col("id") % 200).alias(c) for c in "rgb"])


def test_raw_ply_has_the_properties_of_the_file(scenes, tmp_path):
    target = str(tmp_path / "ply")
    commit = save(points(scenes), "scene_ply", target, "chunk", ["ordinal"], chunk_key="chunk")
    assert (commit["chunks"], commit["rows"]) == (3, 25)
    raw = scenes.read.format("scene_ply").option("raw", "true").load(target)
    assert dict(raw.dtypes)["red"] == "smallint" and dict(raw.dtypes)["x"] == "float"
    assert [r.idx for r in scenes.read.format("scene_ply").option("stride", "10").load(target).collect()] == [0, 10, 20]
    assert [(r.idx, r.y) for r in raw.where("idx >= 23").orderBy("idx").collect()] == [(23, 23.0), (24, 24.0)]
    last = scenes.read.format("scene_ply").option("idx", "18..21").load(target)
    assert last.rdd.getNumPartitions() == 2 and [r.idx for r in last.orderBy("idx").collect()] == [18, 19, 20, 21]


def test_a_failed_task_publishes_nothing(scenes, tmp_path):
    target = str(tmp_path / "surfels")
    wrong = points(scenes).withColumn("x", F.when(F.col("ordinal") == 24, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        save(wrong, "scene_ply", target, "chunk", ["ordinal"], chunk_key="chunk")
    assert committed(target) is None and not list(tmp_path.glob("surfels/data-*")) and not list(tmp_path.glob("surfels/_index/*"))
    save(points(scenes), "scene_ply", target, "chunk", ["ordinal"], chunk_key="chunk")
    before = list_files(target)
    with pytest.raises(Exception, match="lost"):
        save(wrong, "scene_ply", target, "chunk", ["ordinal"], chunk_key="chunk")
    assert list_files(target) == before and scenes.read.format("scene_ply").load(target).count() == 25
    # A stray file of an attempt that did not count is not read either.
    (tmp_path / "surfels" / "stray.ply").write_bytes(b"ply\n")
    assert scenes.read.format("scene_ply").load(target).count() == 25


def test_chunks_do_not_depend_on_the_partitioning_and_appends_add(scenes, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    save(points(scenes).repartition(1), "scene_ply", one, "chunk", ["ordinal"], chunk_key="chunk")
    save(points(scenes).repartition(7), "scene_ply", two, "chunk", ["ordinal"], chunk_key="chunk")
    hashes = [c["hash"] for c in committed_chunks(one)]
    assert hashes == [c["hash"] for c in committed_chunks(two)] and len(hashes) == 3
    points(scenes).coalesce(1).write.format("scene_ply").option("rows", "20").mode("append").save(one)
    assert committed(one)["rows"] == 50 and sorted(c["rows"] for c in committed_chunks(one)) == [5, 5, 10, 10, 20]
    assert scenes.read.format("scene_ply").load(one).count() == 50


def test_windows_are_streamed_by_view(scenes, tmp_path):
    rows = scenes.createDataFrame([(0, 0, 2, 0, '{"k":1}', '{"a":1}'), (0, 0, 2, 0, '{"k":1}', '{"a":2}'), (0, 0, 2, 1, '{"k":2}', None)],
                                  "window_index int, start int, stop int, frame_index int, camera string, point string")
    target = str(tmp_path / "w")
    save(rows, "scene_windows", target, "window_index", ["frame_index", "point"], named="hash")
    document = json.loads(open(list_files(target)[0]).read())
    assert document["window"] == {"index": 0, "start": 0, "end": 2}
    assert document["views"] == [{"frame_index": 0, "camera": {"k": 1}, "points": [{"a": 1}, {"a": 2}]}, {"frame_index": 1, "camera": {"k": 2}, "points": []}]
