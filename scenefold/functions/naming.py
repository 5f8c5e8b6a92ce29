"""Identifier predicates, names and class codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Allow-list patterns. Fixed values.
PRODUCT_ID = r"^[A-Za-z0-9-]+$"
PRODUCT_QUERY = r"(?:^|&)product=([^&]*)"
SHA256 = r"^[0-9a-f]{64}$"
CHUNK_PATH = r"^/chunks/(fused-|points-|architecture-mesh-)?[0-9A-Fa-f]{64}\.(json|bin)$"
WORLD_PATH = r"^/world(/.*)?$"
SCENE_FILES = ("/manifest.json", "/evidence.json", "/camera-controls.js", "/input-video")
SCENE_FOLDERS = r"^/(chunks|sources|replay/frames|depth/frames)/"
VIDEO_NAME = r"^[^/\\]+\.(mov|mp4|m4v|avi)$"

# Semantic surface classes by code. Fixed values.
SEMANTIC_CLASSES = (
    "unknown",
    "floor",
    "wall",
    "ceiling-or-roof",
    "door-or-opening",
    "window",
    "non-architectural",
)
SURFACE_CODES = (1, 2, 3)
OPENING_CODES = (4, 5)

# Segmentation labels with an architectural class. Fixed values.
LABEL_CLASSES = {
    "floor": 1,
    "flooring": 1,
    "wall": 2,
    "partition": 2,
    "divider": 2,
    "ceiling": 3,
    "roof": 3,
    "roofing": 3,
    "door": 4,
    "doorway": 4,
    "screen door": 4,
    "window": 5,
    "windowpane": 5,
}


def is_product_id(value: Column) -> Column:
    return value.rlike(PRODUCT_ID)


def is_sha256(value: Column) -> Column:
    return value.rlike(SHA256)


def is_chunk_path(value: Column) -> Column:
    return value.rlike(CHUNK_PATH)


def product_in_query(query: Column) -> Column:
    """Requested product id of a query string, NULL when absent or malformed."""
    requested = F.regexp_extract(query, PRODUCT_QUERY, 1)
    return F.when(is_product_id(requested), requested)


def scene_path(request: Column) -> Column:
    """Scene-relative path (query kept) of a served request, NULL when not served."""
    path = F.substring_index(request, "?", 1)
    query = F.substring(request, F.length(path) + 1, F.length(request))
    inside = F.regexp_replace(path, r"^/world", "")
    resolved = (
        F.when(path.rlike(WORLD_PATH), F.when(inside == "", F.lit("/")).otherwise(inside))
        .when(path.isin(*SCENE_FILES) | path.rlike(SCENE_FOLDERS), path)
    )
    return F.concat(resolved, F.when(query == "?", "").otherwise(query))


def is_video_name(value: Column) -> Column:
    return F.lower(value).rlike(VIDEO_NAME)


def bridge_name(image: Column, timestamp_millis: Column, ordinal: Column) -> Column:
    """``stem~bridge-<12 digit ms>-<6 digit ordinal>.ext``"""
    stem = F.regexp_extract(image, r"^(.*?)(\.[^.]*)?$", 1)
    extension = F.regexp_extract(image, r"(\.[^.]*)$", 1)
    return F.concat(
        stem, F.lit("~bridge-"), F.lpad(timestamp_millis.cast("string"), 12, "0"),
        F.lit("-"), F.lpad(ordinal.cast("string"), 6, "0"), extension,
    )


def semantic_code(label: Column) -> Column:
    """Class code of a segmentation label; labels outside the table are not architectural."""
    key = F.lower(F.trim(label))
    pairs = [F.lit(v) for item in LABEL_CLASSES.items() for v in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(6)).cast("tinyint")


def semantic_name(code: Column) -> Column:
    """NULL for an unknown code, so that a validation can report it."""
    names = F.array(*[F.lit(name) for name in SEMANTIC_CLASSES])
    return F.when((code >= 0) & (code < len(SEMANTIC_CLASSES)), F.element_at(names, code.cast("int") + 1))


def supports_surface(code: Column) -> Column:
    return code.isin(*SURFACE_CODES)


def is_opening(code: Column) -> Column:
    return code.isin(*OPENING_CODES)


def log_tail(log: Column, characters: int = 2000) -> Column:
    return F.right(log, F.lit(characters))
