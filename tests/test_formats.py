"""Readers and writers round trip."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenefold.errors import BundleError, ImportFormatError, VideoError
from scenefold.operators import ordering
from scenefold.sinks import bundle as out_bundle
from scenefold.sinks import clouds, frames
from scenefold.sources import bundle as in_bundle
from scenefold.sources import files, ply, rasters, recordings, sparse_model


@pytest.fixture()
def surfels(spark):
    rows = [(i, float(i), 2.0 * i, -1.0 * i, 0.0, 0.6, 0.8, i % 256, 2, 3, 0.5, 0.25, 4, i + 1) for i in range(25)]
    return spark.createDataFrame(rows, "i int, x double, y double, z double, nx double, ny double, nz double, r short, g short, b short, "
                                       "confidence double, radius double, first_observing_frame int, contributors long")


def joined(folder, pattern):
    return b"".join(p.read_bytes() for p in sorted(folder.glob(pattern)))


def test_ply_scan_of_normals_and_radius(spark, tmp_path):
    path = tmp_path / "a.ply"
    header = b"ply\nformat binary_little_endian 1.0\nelement vertex 3\n" + b"".join(b"property float %s\n" % n for n in (b"x", b"y", b"z", b"nx", b"ny", b"nz")) + b"end_header\n"
    path.write_bytes(header + struct.pack("<18f", 0, 0, 0, 0, 3, 4, 1, 1, 1, 0, 0, 0, float("nan"), 0, 0, 0, 0, 1))
    points = ply.import_points(spark, str(path)).orderBy("idx").collect()
    assert [(p.nx, p.ny, p.nz) for p in points] == [(0, pytest.approx(0.6), pytest.approx(0.8)), (0, 0, 0)]
    assert points[0].radius > 0 and points[0].r == 255
    path.write_bytes(header + b"\0" * 10)
    with pytest.raises(ImportFormatError):
        ply.scan_ply(spark, str(path))


@pytest.mark.parametrize("writer,name", [(clouds.write_ply_binary, "binary"), (clouds.write_ply_text, "text")])
def test_ply_round_trip_in_parts(spark, surfels, tmp_path, writer, name):
    assert writer(surfels, ["i"], str(tmp_path / name), rows=10) == 25
    whole = tmp_path / f"{name}.ply"
    whole.write_bytes(joined(tmp_path / name, "part-*.ply"))
    back = ply.scan_ply(spark, str(whole)).orderBy("idx").collect()
    assert [r.x for r in back] == [float(i) for i in range(25)] and back[7].r == 7 and back[3].nz == pytest.approx(0.8)


def test_ranges_split_a_file(spark, tmp_path):
    path = tmp_path / "numbers"
    path.write_bytes(np.arange(1000, dtype="<i4").tobytes())
    ranges = files.record_ranges(spark, str(path), 0, 4, 1000, 64)
    assert ranges.count() == 16
    values = files.decode_ranges(ranges, lambda payload, row: pd.DataFrame({"v": np.frombuffer(payload, "<i4")}), "v int")
    assert values.agg(F.sum("v"), F.count_distinct("v")).first()[:] == (499500, 1000)


def test_surfel_chunks_splats_and_glb(spark, surfels, tmp_path):
    chunks = clouds.surfel_chunks(surfels, ["i"], 10).orderBy("chunk").collect()
    assert [c.rows for c in chunks] == [10, 10, 5]
    first = clouds.read_surfels(bytes(chunks[0].payload))
    assert len(bytes(chunks[0].payload)) == 12 + 400 and first.x.tolist() == list(range(10)) and first.contributors[9] == 10
    again = clouds.surfel_chunks(surfels.repartition(7), ["i"], 10).orderBy("chunk").collect()
    assert [c.hash for c in chunks] == [c.hash for c in again]
    clouds.write_splats(surfels, ["i"], str(tmp_path / "splat"), rows=10)
    splat = np.frombuffer(joined(tmp_path / "splat", "data-*/*.splat"), clouds.SPLAT)
    assert len(splat) == 25 and splat["s"][0].tolist() == [0.25, 0.25, pytest.approx(0.025)] and splat["c"][5].tolist() == [5, 2, 3, 128]
    clouds.write_glb(surfels, ["i"], str(tmp_path / "glb"), rows=100)
    payload = next((tmp_path / "glb").glob("data-*/*.glb")).read_bytes()
    magic, version, total, length = struct.unpack_from("<4sIII", payload)
    document = json.loads(payload[20:20 + length])
    assert magic == b"glTF" and total == len(payload) and document["accessors"][0]["max"] == [24.0, 48.0, 0.0]


def write_recording(path, frames=4, width=4, height=3, size=3, overlap=1, version=2, tail=b""):
    k, pose = (2, 0, 1.5, 0, 2, 1, 0, 0, 1), (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)
    plane = width * height
    schedule = recordings.window_lengths(frames, size, overlap)
    out = b"VPS1" + struct.pack("<IIIIIIdfI", version, frames, height, width, size, overlap, 0.0, 1.0, 3)
    out += struct.pack("<I", 0) if version == 3 else b""
    out += struct.pack("<I", len(schedule))
    for start, count in schedule:
        out += struct.pack("<I", count)
        for frame in range(start, start + count):
            out += struct.pack("<9f", *k) + struct.pack("<12f", *pose) + struct.pack(f"<{plane}f", *[2.0] * plane) + struct.pack(f"<{plane}f", *[1.0] * plane)
            out += b"".join(bytes(((53 * frame) % 256, (17 * p) % 256, 127)) for p in range(plane))
    path.write_bytes(out + tail)


@pytest.mark.parametrize("version", [2, 3])
def test_recording_scan(spark, tmp_path, version):
    path = tmp_path / "a.vps1"
    write_recording(path, version=version)
    header, views, pixels = recordings.scan_input(spark, str(path))
    assert (header["frames"], header["width"], header["loops"]) == (4, 4, False)
    assert sorted((r.window_index, r.frame_index) for r in views.collect()) == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3)]
    assert pixels.count() == 5 * 12
    row = pixels.filter("window_index = 1 and frame_index = 3 and px = 1 and py = 1").first()
    assert (row.depth, row.r, row.g, row.b) == (2.0, 159, 85, 127)


def test_recording_with_trailing_byte_is_refused(spark, tmp_path):
    path = tmp_path / "b.vps1"
    write_recording(path, tail=b"x")
    with pytest.raises(ImportFormatError):
        recordings.scan_input(spark, str(path))


def test_recording_parts_make_the_recording_again(spark, tmp_path):
    from scenefold.sinks import recordings as out

    path = tmp_path / "d.vps1"
    write_recording(path, version=3)
    header, views, pixels = recordings.scan_input(spark, str(path))
    parts = out.write_input_parts(views, pixels, header, str(tmp_path / "parts"))
    whole = b"".join(open(p, "rb").read() for p in parts)
    assert whole == path.read_bytes()
    with pytest.raises(Exception, match="each pixel"):
        out.write_input_parts(views, pixels.filter("px > 0"), header, str(tmp_path / "other"))


def test_point_chunks_come_back_in_order(spark, tmp_path):
    path = str(tmp_path / "scene")
    out_bundle.create_bundle(path, {"source": "test"})
    rows = [(float(i), 0.5, -1.0, 0.0, 0.0, 1.0, i % 256, 2, 3, 0.5, 0.1, i, 2 * i) for i in range(25)]
    points = spark.createDataFrame(rows, "x double, y double, z double, nx double, ny double, nz double, r short, g short, b short, confidence double, radius double, first_observing_frame int, contributors long")
    listed = lambda: [tuple(r) for r in in_bundle.published(in_bundle.open_manifest(spark, path), "fused_point_chunk_hashes", path).orderBy("chunk").collect()]
    record = out_bundle.write_point_chunks(points.repartition(3), ["x"], path, 10)
    hashes = listed()
    assert (record["chunks"], record["rows"], len(hashes)) == (3, 25, 3)
    out_bundle.write_point_chunks(points, ["x"], path, 10)
    assert listed() == hashes and len(list((tmp_path / "scene" / "chunks").glob("points-*.json"))) == 3
    back = in_bundle.scan_point_chunks(spark, path).orderBy("chunk", "position")
    assert [tuple(r)[2:] for r in back.collect()] == rows


def test_identity_recording_replays_to_one_sheet(spark, tmp_path):
    from scenefold.plans import replay

    path = tmp_path / "c.vps1"
    write_recording(path)
    scene = replay.replay(spark, str(path), "voxel")
    seam = scene.alignments.first()
    assert seam.scale == pytest.approx(1.0) and np.allclose(seam.translation, 0, atol=1e-9)
    points = scene.points.collect()
    assert points and all(p.z == pytest.approx(2.0) for p in points) and sum(p.contributors for p in points) == 4 * 12


def test_expected_clouds(spark, tmp_path):
    path = tmp_path / "a.cps1"
    path.write_bytes(b"CPS1" + struct.pack("<IIII", 1, 2, 3, 1) + struct.pack("<2i", 1, 2) + struct.pack("<9f", *range(9)) + bytes(range(9)) + struct.pack("<3f", 1, 2, 3) + struct.pack("<6f", *range(6)))
    cloud = recordings.scan_expected_cloud(spark, str(path))
    rows = cloud["points"].orderBy("ordinal").collect()
    assert [(r.x, r.r, r.radius) for r in rows] == [(0, 0, 1), (3, 3, 2), (6, 6, 3)]
    path.write_bytes(path.read_bytes().replace(struct.pack("<2i", 1, 2), struct.pack("<2i", 1, 1), 1))
    with pytest.raises(ImportFormatError):
        recordings.scan_expected_cloud(spark, str(path))


# --- rasters -------------------------------------------------------------

def ppm(width, height, value):
    return b"P6\n%d %d\n255\n" % (width, height) + bytes([value]) * (3 * width * height)


def test_ppm_cache_selection_and_bmp(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}.ppm").write_bytes(ppm(40, 30, 60 * i))
    cache = rasters.scan_ppm(spark, str(tmp_path))
    signed = cache.withColumn("s", rasters.frame_signature("rgb", "width", "height")).orderBy("ordinal").collect()
    assert len(signed[0].s.luma) == 768 and signed[2].s.luma[0] == pytest.approx(120 / 255) and signed[0].s.sharpness == 0
    picked = cache.filter("ordinal in (0, 2)").select("ordinal")
    frames.write_selected_cache(cache, picked, str(tmp_path / "out"), 8.0)
    again = rasters.scan_ppm(spark, str(tmp_path / "out"))
    assert sorted(r.file_name for r in again.select("file_name").collect()) == ["frame-000001.ppm", "frame-000002.ppm"]
    listed = rasters.selection_indices(spark, str(tmp_path / "out" / "selection.json"), 2, 8.0).orderBy("ordinal").collect()
    assert [r.source_index for r in listed] == [0, 2]
    with pytest.raises(VideoError):
        rasters.selection_indices(spark, str(tmp_path / "out" / "selection.json"), 3, 8.0)
    (tmp_path / "odd.ppm").write_bytes(ppm(41, 30, 1))
    with pytest.raises(VideoError):
        rasters.scan_ppm(spark, str(tmp_path))
    content = spark.createDataFrame([(bytearray(ppm(3, 2, 9)),)], "content binary")
    bmp = bytes(content.select(frames.ppm_to_bmp("content").alias("b")).first().b)
    assert bmp[:2] == b"BM" and len(bmp) == 54 + 2 * 12 and struct.unpack_from("<I", bmp, 2)[0] == len(bmp)


def test_dense_arrays_batches_and_masks(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(b"2&3&1&" + np.arange(6, dtype="<f4").tobytes())
    pixels = rasters.array_pixels(rasters.scan_dense_arrays(spark, str(tmp_path / "d.bin")), ["path"])
    assert {(r.px, r.py): r.depth for r in pixels.collect()}[1, 2] == 5.0
    np.savez(tmp_path / "b.npz", depth=np.ones((2, 3, 4), "f4"), conf=np.full((2, 3, 4), 2, "f4"), rgb=np.zeros((2, 3, 4, 3), "u1"),
             intrinsics=np.tile(np.eye(3), (2, 1, 1)), extrinsics=np.tile(np.eye(4), (2, 1, 1)), frame_indices=np.array([5, 9]))
    batches = rasters.scan_prediction_batches(spark, str(tmp_path / "b.npz"))
    assert sorted(r.frame_index for r in batches.collect()) == [5, 9]
    assert rasters.batch_pixels(batches).count() == 24
    mask = b"VSEM1" + struct.pack("<III", 2, 2, 1) + struct.pack("<2I", 3, 8) + bytes([1, 4, 2, 6]) + bytes([255, 0, 51, 102])
    (tmp_path / "m.vsem").write_bytes(mask)
    rows = {(r.frame_index, r.x): (r.class_code, r.confidence) for r in rasters.scan_semantic_masks(spark, str(tmp_path / "m.vsem")).collect()}
    assert rows[3, 1] == (4, 0.0) and rows[8, 0] == (2, pytest.approx(0.2))


# --- sparse models -------------------------------------------------------

def test_sparse_text_model(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# comment\n1 SIMPLE_RADIAL 1620 1080 1000 810 540 0.01\n")
    (tmp_path / "images.txt").write_text(
        "# header\n1 1 0 0 0 1 2 3 1 a.png\n10 20 7 30 40 -1 11 21 7\n2 2 0 0 0 0 0 0 1 b.png\n\n3 1 0 0 0 0 0 0 1 c.png\n5 6 8\n")
    (tmp_path / "points3D.txt").write_text("7 1 2 3 9 8 7 0.5 1 0 1 2\n8 0 0 1 1 1 1 0.1 3 0\n9 5 5 5 0 0 0 1.0\n")
    files_ = spark.createDataFrame([(0, "a.png"), (1, "b.png"), (2, "c.png"), (3, "d.png")], "frame_index int, file_name string")
    cameras, poses, tracks, observed = sparse_model.global_model(spark, str(tmp_path), files_)
    assert cameras.first().k == 0.01
    registered = {r.frame_index: r for r in poses.collect()}
    assert registered[0].w2c[3] == 1.0 and np.allclose(registered[1].w2c[:3], [1, 0, 0]) and not registered[3].registered
    assert sorted(r.point_id for r in tracks.collect()) == [7, 8]
    assert sorted((r.point_id, r.frame_index, r.u) for r in observed.collect()) == [(7, 0, 10.0), (8, 2, 5.0)]
    (tmp_path / "cameras.txt").write_text("1 PINHOLE 1620 1080 1000 1000 810 540\n")
    from scenefold.errors import PoseError

    with pytest.raises(PoseError):
        sparse_model.scan_cameras(spark, str(tmp_path / "cameras.txt"))


# --- bundles -------------------------------------------------------------

def test_bundle_life_cycle(spark, surfels, tmp_path):
    path = str(tmp_path / "scene")
    out_bundle.create_bundle(path, {"source": "test"})
    with pytest.raises(BundleError):
        out_bundle.create_bundle(path, {})
    views = spark.createDataFrame([(0, 0, [1.0] * 12, [2.0] * 9), (1, 3, [3.0] * 12, [2.0] * 9)], "window_index int, frame_index int, w2c array<double>, k array<double>")
    points = spark.createDataFrame([(0, 0, 5, 6, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0, 7, 8, 9, 1.0, 0.1)],
                                   "window_index int, frame_index int, px int, py int, x double, y double, z double, nx double, ny double, nz double, r short, g short, b short, confidence double, radius double")
    schedule = spark.createDataFrame([(0, 0, 12), (1, 9, 21)], "window_index int, start int, stop int")
    listed = lambda: {r.hash for r in in_bundle.published(in_bundle.open_manifest(spark, path), "measured_chunk_hashes", path).collect()}
    out_bundle.write_windows(views, points, path, schedule)
    hashes = listed()
    out_bundle.write_windows(views, points, path, schedule)
    assert listed() == hashes
    read_views, read_points = in_bundle.scan_windows(spark, path)
    assert sorted((r.window_index, r.frame_index, r.w2c[0]) for r in read_views.collect()) == [(0, 0, 1.0), (1, 3, 3.0)]
    row = read_points.first()
    assert (row.px, row.py, row.x, row.g, row.radius) == (5, 6, 1.0, 8, 0.1)
    out_bundle.publish_raster(path, "f" * 64)
    out_bundle.publish_raster(path, "f" * 64)
    with pytest.raises(BundleError):
        out_bundle.publish_raster(path, "0" * 64)
    manifest = out_bundle.publish_product(surfels, ["i"], path, "voxel", "surfel", {"point_count": 25})
    assert manifest["selected_world_product"] == "voxel" and manifest["world_products"][0]["point_binary_chunks"]["chunks"] == 1
    out_bundle.update_product(path, "voxel", source_frames=[3, 1, 3], depth_frames=2)
    with pytest.raises(BundleError):
        out_bundle.update_product(path, "voxel", depth_frames=5)
    with pytest.raises(BundleError):
        out_bundle.update_product(path, "voxel", mesh={"indices": 7, "vertices": 4, "maximum_index": 3})
    assert out_bundle.read_manifest(path)["world_products"][0]["source_frames"] == [1, 3]


def test_large_windows_are_written_in_parts(spark, tmp_path):
    """No chunk file holds more than about ``rows`` points, and nothing is lost or doubled."""
    path = str(tmp_path / "scene")
    out_bundle.create_bundle(path, {"source": "test"})
    views = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 2)], "window_index int, frame_index int").withColumns(
        {"w2c": F.array(*[F.col("frame_index").cast("double")] * 12), "k": F.array(*[F.lit(2.0)] * 9)})
    i = F.col("id")
    points = spark.range(1000).select(
        F.when(i < 990, 0).otherwise(1).alias("window_index"), F.when(i < 950, 0).when(i < 990, 1).otherwise(2).alias("frame_index"),
        (i % 8).cast("int").alias("px"), F.floor(i / 8).cast("int").alias("py"), *[(i + n).cast("double").alias(a) for n, a in enumerate(("x", "y", "z", "nx", "ny", "nz"))],
        *[F.lit(n).cast("short").alias(a) for n, a in enumerate("rgb")], F.lit(1.0).alias("confidence"), F.lit(0.1).alias("radius"))
    schedule = spark.createDataFrame([(0, 0, 3), (1, 2, 3)], "window_index int, start int, stop int")
    out_bundle.write_windows(views, points, path, schedule, rows=100)
    documents = [json.loads(f.read_text()) for f in (tmp_path / "scene" / "chunks").glob("*.json")]
    assert max(sum(len(v["points"]) for v in d["views"]) for d in documents) < 200 and len(documents) == 10 + 1 + 1 + 1
    whole = [d["window"] for d in documents if "first_view" not in d["window"]]
    assert whole == [{"index": 1, "start": 2, "end": 3}]
    read_views, read_points = in_bundle.scan_windows(spark, path)
    assert sorted((r.window_index, r.view_index, r.frame_index, r.w2c[0]) for r in read_views.collect()) == [(0, 0, 0, 0.0), (0, 1, 1, 1.0), (0, 2, 2, 2.0), (1, 0, 2, 2.0)]
    key = ["window_index", "frame_index", "px", "py", "x", "nz", "g", "radius"]
    assert sorted(map(tuple, read_points.select(*key).collect())) == sorted(map(tuple, points.select(*key).collect()))


def test_raster_record_and_fingerprint(spark, tmp_path):
    import hashlib

    from scenefold.plans import imports

    for i in range(3):
        (tmp_path / f"frame-00000{i + 1}.ppm").write_bytes(ppm(6, 4, i))
    probe = {"source_sha256": "a" * 64, "duration_seconds": 2.5, "source_width": 12, "source_height": 8, "crop": {"x": 0, "y": 0, "width": 12, "height": 8}}
    document = imports.record_rasters(spark, str(tmp_path), None, 8.0, probe)
    assert [f["timestamp_millis"] for f in document["frames"]] == [0, 125, 250]
    assert document["frames"][1]["sha256"] == hashlib.sha256(ppm(6, 4, 1)).hexdigest()
    assert imports.raster_fingerprint(document) == document["raster_fingerprint"]
    frames_ = spark.createDataFrame([tuple(f.values()) for f in document["frames"]], "frame_index int, file_name string, sha256 string, timestamp_millis long")
    from scenefold.operators import reports

    assert reports.raster_violations(frames_, []).count() == 0
    assert imports.raster_fingerprint(document | {"source_width": 13}) != document["raster_fingerprint"]


def test_capture_quality_of_frames(spark):
    from scenefold.operators import reports

    rows = [(0, 0, bytearray([10] * 12), 2, 2), (0, 1, bytearray([20] * 12), 2, 2), (1, 0, bytearray([5] * 12), 2, 2), (1, 1, bytearray([5] * 12), 2, 2),
            (2, 0, bytearray([5] * 12), 2, 2), (2, 1, bytearray([5] * 18), 3, 2)]
    frames_ = spark.createDataFrame(rows, "c int, ordinal long, rgb binary, width int, height int")
    out = {r.c: r for r in reports.frame_quality(frames_, ["c"], "ordinal").collect()}
    assert out[0].mean_adjacent_luma_delta == pytest.approx(10 / 255) and out[0].disposition == "ready"
    assert out[1].disposition == "recapture" and out[2].mean_adjacent_luma_delta == 0.0


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    from scenefold.operators import surface
    from scenefold.streaming import increments

    def evidence(frame, count):
        return spark.range(count).select((F.col("id") * 0.05).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("confidence"),
                                         F.lit(0.1).alias("radius"), F.lit(frame).alias("frame_index"))

    folder = str(tmp_path / "in")
    evidence(3, 40).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    run = lambda: increments.run_to_table(increments.voxel_stream(increments.arriving(spark, folder, schema, "*.parquet"), 0.2), str(tmp_path / "table"), str(tmp_path / "state"))
    run()
    evidence(1, 30).write.mode("append").parquet(folder)
    run()
    key = lambda df: sorted((r.kx, r.contributors, r.first_observing_frame, round(r.x, 9)) for r in df.collect())
    batch = surface.fuse_voxels(spark.read.parquet(folder), spark.createDataFrame([(0.2,)], "voxel double"))
    assert key(increments.latest(spark, str(tmp_path / "table"), ["kx", "ky", "kz"])) == key(batch)


def test_a_recording_is_dealt_by_view_and_reads_back(spark, tmp_path):
    from scenefold.sinks import recordings as out
    from scenefold.sources.files import committed_chunks
    from scenefold.sources.formats import register

    path, parts = tmp_path / "e.vps1", str(tmp_path / "parts")
    write_recording(path, version=3)
    header, views, pixels = recordings.scan_input(spark, str(path))
    out.write_input_parts(views, pixels, header, parts)
    # A header and one part for each of the five views: no task holds a window.
    assert [c["rows"] for c in committed_chunks(parts)] == [0] + [12] * 5
    back = register(spark).read.format("scene_recording").load(parts)
    assert sorted(back.collect()) == sorted(pixels.select(back.columns).collect())
    cameras = spark.read.format("scene_recording").option("table", "views").load(parts)
    assert sorted(cameras.collect()) == sorted(views.select(cameras.columns).collect())
    with pytest.raises(Exception, match="schedule"):
        out.write_input_parts(views, pixels.filter("window_index = 0 or frame_index = 3"), header, str(tmp_path / "other"))


def test_replay_payloads_are_packed_in_blocks(spark, monkeypatch):
    from scenefold.sinks import clouds

    eye, k = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], [2.0, 0.0, 1.5, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0]
    rows = [(f // 2, f, x, y, float(x), float(y), 1.0 + f, x, y, f) for f in range(3) for x in range(4) for y in range(7)]
    points = spark.createDataFrame(rows, "window_index int, frame_index int, px int, py int, x double, y double, z double, r short, g short, b short")
    views = spark.createDataFrame([(f // 2, f, eye, k) for f in range(3)], "window_index int, frame_index int, w2c array<double>, k array<double>")
    taken = lambda: {r.frame_index: bytes(r.payload) for r in clouds.replay_payloads(points, views).collect()}
    whole = taken()
    monkeypatch.setattr(clouds, "REPLAY_ROWS", 2)
    pieces = taken()
    assert pieces == whole and len(whole) == 3
    assert whole[1][:28] == b"VRPL" + struct.pack("<HHI4f", 2, 0, 28, 2.0, 2.0, 1.5, 1.0)
    assert whole[1][28:58] == struct.pack("<3f3B", 0, 0, 2, 0, 0, 1) + struct.pack("<3f3B", 1, 0, 2, 1, 0, 1)


def test_splats_shuffle_only_their_fields(spark, tmp_path, monkeypatch):
    from scenefold.sinks import committed

    dealt = []
    monkeypatch.setattr(committed, "save", lambda rows, *rest, **options: dealt.append(rows.columns))
    names = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "confidence", "radius"]
    points = spark.range(3).select("id", F.lit("unused").alias("other"), *[F.lit(0.5).alias(c) for c in names])
    clouds.write_splats(points, ["id"], str(tmp_path / "s"), 2)
    assert dealt == [["chunk", "ordinal", *names]]
