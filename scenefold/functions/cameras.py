"""Camera, projection and similarity expressions.

W2C matrices are row-major 3x4 (or 4x4) arrays with ``camera = R * world + t``;
a similarity maps ``p`` to ``R * (s * p) + t``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from . import vectors as V
from .vectors import Vec


# --- rigid cameras -------------------------------------------------------

def w2c_rotation(w2c: str | Column) -> list[list[Column]]:
    source = F.col(w2c) if isinstance(w2c, str) else w2c
    return [[source.getItem(4 * r + c) for c in range(3)] for r in range(3)]


def w2c_translation(w2c: str | Column) -> Vec:
    source = F.col(w2c) if isinstance(w2c, str) else w2c
    return tuple(source.getItem(4 * r + 3) for r in range(3))


def camera_centre(w2c: str | Column) -> Vec:
    back = V.rotate_back(w2c_rotation(w2c), w2c_translation(w2c))
    return tuple(-value for value in back)


def camera_forward(w2c: str | Column) -> Vec:
    return tuple(w2c_rotation(w2c)[2])


def world_to_camera(w2c: str | Column, p: Vec) -> Vec:
    return V.add(V.rotate(w2c_rotation(w2c), p), w2c_translation(w2c))


def camera_to_world(w2c: str | Column, p: Vec) -> Vec:
    return V.rotate_back(w2c_rotation(w2c), V.sub(p, w2c_translation(w2c)))


def camera_depth(w2c: str | Column, p: Vec) -> Column:
    source = F.col(w2c) if isinstance(w2c, str) else w2c
    return source.getItem(8) * p[0] + source.getItem(9) * p[1] + source.getItem(10) * p[2] + source.getItem(11)


def is_rigid(w2c: str | Column, tolerance: float = 1e-3) -> Column:
    """Unit rows, orthogonal rows and determinant +1, each within ``tolerance``."""
    rows = w2c_rotation(w2c)
    source = F.col(w2c) if isinstance(w2c, str) else w2c
    gate = F.forall(source, lambda value: V.finite(value))
    for row in rows:
        gate = gate & (F.abs(V.length(tuple(row)) - 1) <= tolerance)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        gate = gate & (F.abs(V.dot(tuple(rows[a]), tuple(rows[b]))) <= tolerance)
    determinant = V.dot(tuple(rows[0]), V.cross(tuple(rows[1]), tuple(rows[2])))
    return gate & (F.abs(determinant - 1) <= tolerance)


def quaternion_to_w2c(qw, qx, qy, qz, t: Vec) -> Column:
    """3x4 matrix of a (not necessarily unit) quaternion and a translation."""
    norm = F.sqrt(qw * qw + qx * qx + qy * qy + qz * qz)
    w, x, y, z = (F.try_divide(value, norm) for value in (qw, qx, qy, qz))
    rows = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    return F.array(*[cell for row, shift in zip(rows, t) for cell in (*row, shift)])


# --- pixels --------------------------------------------------------------

def resize_centre(value: Column, source: Column, target: Column) -> Column:
    """Pixel-centre resize used by every raster operator."""
    return (value + 0.5) * target / source - 0.5


def image_to_raster_pixel(u: Column, v: Column, camera: tuple[Column, Column], raster: tuple[Column, Column]):
    """Nearest raster pixel of an image position, NULL outside or on unequal aspect."""
    same_aspect = (camera[0] > 0) & (camera[1] > 0) & (camera[0] * raster[1] == camera[1] * raster[0])
    x = F.round(resize_centre(u, camera[0], raster[0]))
    y = F.round(resize_centre(v, camera[1], raster[1]))
    inside = same_aspect & (x >= 0) & (y >= 0) & (x < raster[0]) & (y < raster[1])
    return F.when(inside, x.cast("int")), F.when(inside, y.cast("int"))


# The next two work on DataFrames: each step is its own projection, because
# nested into one expression the repeated sub-terms would multiply.

Lens = tuple[Column, Column, Column, Column]


def undistort(df: DataFrame, u: Column, v: Column, lens: Lens, out: tuple[str, str], rounds: int = 8) -> DataFrame:
    """Add the camera ray (x, y, 1) of an image position under one radial coefficient.

    Fixed-point iteration; NULL where it degenerates.
    """
    f, cx, cy, k = lens
    safe = F.when(f > 0, f)
    df = df.withColumns({"_xd": (u - cx) / safe, "_yd": (v - cy) / safe})

    def step(ray: Column, _) -> Column:
        factor = 1 + k * (ray["x"] * ray["x"] + ray["y"] * ray["y"])
        usable = F.when(V.finite(factor) & (F.abs(factor) >= 1e-8), factor)
        return F.struct((F.col("_xd") / usable).alias("x"), (F.col("_yd") / usable).alias("y"))

    # One higher-order step per round keeps the expression linear in the rounds.
    start = F.struct(F.col("_xd").alias("x"), F.col("_yd").alias("y"))
    df = df.withColumn("_ray", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    good = V.all_finite(F.col("_ray.x"), F.col("_ray.y"))
    df = df.withColumns({name: F.when(good, F.col(f"_ray.{axis}")) for name, axis in zip(out, "xy")})
    return V.pin(df.drop("_xd", "_yd", "_ray"), *out)


def project(df: DataFrame, point: Vec, lens: Lens, camera: tuple[Column, Column], raster: tuple[Column, Column],
            out: tuple[str, str, str]) -> DataFrame:
    """Keep camera-space points that fall inside the raster, with pixel and depth columns."""
    f, cx, cy, k = lens
    u, v, depth = out
    df = df.withColumn(depth, F.when(V.positive(point[2]), point[2]))
    df = df.withColumns({u: point[0] / F.col(depth), v: point[1] / F.col(depth)})
    df = df.withColumn("_lens", 1 + k * (F.col(u) * F.col(u) + F.col(v) * F.col(v)))
    df = df.withColumns({
        u: resize_centre(f * F.col(u) * F.col("_lens") + cx, camera[0], raster[0]),
        v: resize_centre(f * F.col(v) * F.col("_lens") + cy, camera[1], raster[1]),
    }).drop("_lens")
    inside = (F.col(u) >= 0) & (F.col(v) >= 0) & (F.col(u) < raster[0] - 1) & (F.col(v) < raster[1] - 1)
    return V.pin(df, u, v, depth).filter(inside & V.all_finite(F.col(u), F.col(v)))


def frustum(df: DataFrame, w2c: str, lens: Lens, width: Column, height: Column) -> DataFrame:
    """One row per image corner: its unit world direction, and the axes and view angles of the camera."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
                        for i, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    df = df.withColumn("_corner", F.explode(corners)).withColumn("corner", F.col("_corner.i"))
    df = undistort(df, F.col("_corner.x") * width, F.col("_corner.y") * height, lens, ("_u", "_v"))
    rotation = w2c_rotation(w2c)
    df = V.columns(df, V.rotate_back(rotation, (F.col("_u"), F.col("_v"), F.lit(1.0))), ("dx", "dy", "dz"))
    df = V.columns(df, V.normalize(V.vec("dx", "dy", "dz")), ("dx", "dy", "dz"))
    return df.withColumns({
        "right": V.struct3(tuple(rotation[0])), "up": V.struct3(tuple(-value for value in rotation[1])),
        "vertical_fov": 2 * F.atan(height / (2 * lens[0])), "aspect": width / height,
    }).drop("_corner", "_u", "_v")


def centre_crop(width: Column, height: Column, target_width: int, target_height: int):
    """Largest centred crop of the target aspect, in integer arithmetic."""
    wide = width * target_height > height * target_width
    crop_width = F.when(wide, F.floor(height * target_width / target_height)).otherwise(width).cast("int")
    crop_height = F.when(wide, height).otherwise(F.floor(width * target_height / target_width)).cast("int")
    return F.struct(
        F.floor((width - crop_width) / 2).cast("int").alias("x"),
        F.floor((height - crop_height) / 2).cast("int").alias("y"),
        crop_width.alias("width"),
        crop_height.alias("height"),
    )


# --- similarities --------------------------------------------------------

Sim3 = tuple[Column, list[list[Column]], Vec]


def sim3(prefix: str = "") -> Sim3:
    """Similarity held in columns ``scale``, ``rotation`` (9) and ``translation`` (3)."""
    t = F.col(f"{prefix}translation")
    return F.col(f"{prefix}scale"), V.matrix(f"{prefix}rotation", 3, 3), tuple(t.getItem(i) for i in range(3))


def sim3_apply(s: Sim3, p: Vec) -> Vec:
    return V.add(V.rotate(s[1], V.scale(p, s[0])), s[2])


def sim3_compose(outer: Sim3, inner: Sim3) -> Sim3:
    return outer[0] * inner[0], V.matmul(outer[1], inner[1]), sim3_apply(outer, inner[2])


def sim3_inverse(s: Sim3) -> Sim3:
    """NULL parts when the scale cannot be inverted."""
    inverse = F.when(V.positive(s[0]), 1 / F.when(s[0] > 0, s[0]))
    transposed = [[s[1][c][r] for c in range(3)] for r in range(3)]
    shift = V.scale(V.rotate(transposed, s[2]), -inverse)
    return inverse, transposed, shift


def sim3_columns(s: Sim3, prefix: str = "") -> list[Column]:
    return [
        s[0].alias(f"{prefix}scale"),
        V.flat(s[1]).alias(f"{prefix}rotation"),
        F.array(*s[2]).alias(f"{prefix}translation"),
    ]


def quaternion_from_normal(n: Vec) -> tuple[Column, Column, Column, Column]:
    """Shortest rotation (x, y, z, w) taking +Z to the normal."""
    norm = V.length(n)
    usable = F.coalesce(V.finite(norm) & (norm >= 1e-6), F.lit(False))
    x, y, z = (component / F.when(usable, norm) for component in n)
    flipped = z < -0.999999
    # |(-y, x, 0, 1 + z)| of a unit vector
    size = F.sqrt(2 * (1 + F.greatest(z, F.lit(-0.999999))))

    def pick(value, at_flip, at_zero):
        return F.when(~usable, F.lit(at_zero)).when(flipped, F.lit(at_flip)).otherwise(value)

    return (
        pick(-y / size, 1.0, 0.0),
        pick(x / size, 0.0, 0.0),
        pick(F.lit(0.0), 0.0, 0.0),
        pick((1 + z) / size, 0.0, 1.0),
    )


# --- colour --------------------------------------------------------------

def srgb_to_linear(channel: Column) -> Column:
    value = channel / 255.0
    return F.when(value <= 0.04045, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(value: Column) -> Column:
    value = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    encoded = F.when(value <= 0.0031308, 12.92 * value).otherwise(
        1.055 * F.pow(value, F.lit(1.0 / 2.4)) - 0.055
    )
    return F.round(encoded * 255.0).cast("short")


# Gradient of the depth preview from far to near, evenly spaced. Fixed values.
DEPTH_STOPS = (
    (0.10, 0.12, 0.55),
    (0.00, 0.78, 0.95),
    (0.05, 0.82, 0.26),
    (0.98, 0.88, 0.08),
    (0.86, 0.08, 0.04),
)


def depth_blend(fraction: Column) -> list[Column]:
    """Gradient channels (0..1) of a value scaled to 0..1."""
    last = len(DEPTH_STOPS) - 1
    position = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * last
    lower = F.least(F.floor(position), F.lit(last - 1)).cast("int")
    share = position - lower
    channels = []
    for channel in range(3):
        stops = F.array(*[F.lit(stop[channel]) for stop in DEPTH_STOPS])
        channels.append(stops.getItem(lower) * (1 - share) + stops.getItem(lower + 1) * share)
    return channels


def depth_colour(fraction: Column) -> list[Column]:
    return [F.rint(value * 255.0).cast("short") for value in depth_blend(fraction)]


# --- planes --------------------------------------------------------------

def canonical_normal(n: Vec) -> Vec:
    """Flip so that the largest component is positive; the later axis wins a tie."""
    ax, ay, az = (F.abs(component) for component in n)
    leading = F.when((az >= ax) & (az >= ay), n[2]).when(ay >= ax, n[1]).otherwise(n[0])
    sign = F.when(leading < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return V.scale(n, sign)


def plane_basis(n: Vec) -> tuple[Vec, Vec]:
    """Two unit directions spanning the plane with unit normal ``n``."""
    steep = F.abs(n[2]) < 0.9
    reference = (F.lit(0.0), F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0))
    u = V.normalize(V.cross(reference, n), degenerate="forward")
    return u, V.cross(n, u)


