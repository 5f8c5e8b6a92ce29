"""Table contracts (DDL strings accepted anywhere Spark takes a schema)."""

PIXELS = (
    "window_index int, frame_index int, px int, py int, depth double, confidence double, "
    "r short, g short, b short"
)
VIEWS = "window_index int, frame_index int, w2c array<double>, k array<double>"
MEASURED_POINTS = (
    "window_index int, frame_index int, px int, py int, x double, y double, z double, "
    "nx double, ny double, nz double, r short, g short, b short, confidence double, radius double"
)
FUSED_POINTS = (
    "x double, y double, z double, nx double, ny double, nz double, r short, g short, b short, "
    "confidence double, radius double, first_observing_frame int, contributors long"
)
SIM3 = "scale double, rotation array<double>, translation array<double>"
ALIGNMENTS = (
    f"window_index int, {SIM3}, correspondence_count long, inlier_count long, "
    "rms_residual double, normalized_rms_residual double"
)
POSE_EDGES = f"src int, dst int, {SIM3}, information double, loop_closure boolean"
WINDOW_POSES = f"window_index int, {SIM3}"
RASTER_MANIFEST = (
    "schema string, source_sha256 string, duration_seconds double, source_width int, source_height int, "
    "crop struct<x:int,y:int,width:int,height:int>, output_width int, output_height int, "
    "frames array<struct<frame_index:int,file_name:string,sha256:string,timestamp_millis:long>>, "
    "raster_fingerprint string"
)
POSE_SOLUTION = (
    "schema string, provider struct<kind:string,version:string,settings_fingerprint:string>, "
    "raster_fingerprint string, coordinate_convention string, "
    "frames array<struct<frame_index:int,image_name:string,registered:boolean,world_to_camera:array<double>>>, "
    "diagnostics struct<input_frames:int,registered_frames:int,duplicate_images:int>, "
    "global_trajectory struct<camera_models:array<struct<camera_id:long,model:string,width:int,height:int,"
    "parameters:array<double>>>,frame_camera_ids:map<string,long>,"
    "tracks:array<struct<point_id:long,position:array<double>,reprojection_error_px:double,"
    "observations:array<struct<frame_index:int,image_xy:array<double>>>>>>"
)
QUALITY_PROFILE = (
    "schema string, name string, minimum_measured_windows int, minimum_fused_points long, "
    "minimum_sequential_inlier_ratio double, maximum_sequential_rms_residual double, "
    "require_loop_closure boolean"
)
DEPTH_BATCH = (
    "batch string, slot int, frame_index long, height int, width int, depth array<float>, "
    "conf array<float>, rgb binary, k array<float>, w2c array<float>"
)
SEMANTIC_PIXELS = "frame_index int, x int, y int, class_code tinyint, confidence double"
REPLAY = "frame_index int, payload binary"

# Interchange tags are "<namespace>.<document>/<version>"; a reader accepts any
# namespace, a writer uses the one it is given.
DOCUMENTS = {
    "scene": "v1",
    "raster": "v1",
    "pose-solution": "v1",
    "decode-selection": "v1",
    "camera": "v1",
    "scene-quality": "v1",
    "scene-verification": "v1",
    "intake-job": "v1",
    "architecture-semantics": "v1",
    "benchmark": "v1",
}
NAMESPACE = "scenefold"


def tag(document: str, namespace: str = NAMESPACE) -> str:
    return f"{namespace}.{document}/{DOCUMENTS[document]}"


def tag_pattern(document: str) -> str:
    """Regular expression accepting the document tag of any namespace."""
    return rf"^[a-z0-9_-]+\.{document}/{DOCUMENTS[document]}$"
