"""3-vector and 3x3 expressions as Columns. A vector is a tuple of three Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Vec = tuple[Column, Column, Column]


def vec(x, y, z) -> Vec:
    as_column = lambda v: F.col(v) if isinstance(v, str) else (v if isinstance(v, Column) else F.lit(float(v)))
    return as_column(x), as_column(y), as_column(z)


def finite(value: Column) -> Column:
    """NaN compares above every number in Spark, so the gate has to be explicit."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def all_finite(*values: Column) -> Column:
    gate = finite(values[0])
    for value in values[1:]:
        gate = gate & finite(value)
    return gate


def positive(value: Column) -> Column:
    return finite(value) & (value > 0)


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, factor) -> Vec:
    return a[0] * factor, a[1] * factor, a[2] * factor


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Vec, b: Vec) -> Column:
    return dot(sub(a, b), sub(a, b))


def normalize(a: Vec, threshold: float = 0.0, degenerate: str = "null") -> Vec:
    """Unit vector; at or below ``threshold`` NULL or (0, 0, 1).

    ``degenerate`` is "null" or "forward", because callers differ in what a
    vanishing vector means.
    """
    norm = length(a)
    usable = finite(norm) & (norm > threshold)
    fallback = (None, None, None) if degenerate == "null" else (0.0, 0.0, 1.0)
    return tuple(
        F.when(usable, component / norm).otherwise(F.lit(other).cast("double"))
        for component, other in zip(a, fallback)
    )


def matrix(name: str | Column, rows: int, columns: int) -> list[list[Column]]:
    """View a row-major array column as nested Columns."""
    source = F.col(name) if isinstance(name, str) else name
    return [[source.getItem(r * columns + c) for c in range(columns)] for r in range(rows)]


def rotate(m: list[list[Column]], v: Vec) -> Vec:
    return tuple(m[r][0] * v[0] + m[r][1] * v[1] + m[r][2] * v[2] for r in range(3))


def rotate_back(m: list[list[Column]], v: Vec) -> Vec:
    """Multiply with the transpose of the 3x3 part."""
    return tuple(m[0][c] * v[0] + m[1][c] * v[1] + m[2][c] * v[2] for c in range(3))


def matmul(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[sum((a[r][k] * b[k][c] for k in range(1, 3)), a[r][0] * b[0][c]) for c in range(3)] for r in range(3)]


def flat(m: list[list[Column]]) -> Column:
    return F.array(*[cell for row in m for cell in row])


def struct3(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def pin(df: DataFrame, *names: str) -> DataFrame:
    """Compute these columns here, once.

    A later filter on them would otherwise be pushed below the projections that
    build them and repeat their whole expression; it stops at a generator.
    """
    rest = [c for c in df.columns if c not in names]
    packed = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_pinned"))
    return packed.select(*rest, *[F.col(f"_pinned.{name}").alias(name) for name in names])


def columns(df, v: Vec, names: tuple[str, str, str]):
    return df.withColumns(dict(zip(names, v)))
