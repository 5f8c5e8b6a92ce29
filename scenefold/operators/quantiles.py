"""Exact order statistics by descending through a histogram.

Values fall into buckets by a monotone function of the value: its sign and the
logarithm of its size, 4,096 buckets for each doubling. One aggregate counts buckets
and combines before the shuffle; running sums of a group's few buckets tell in which
one every wanted rank lies. A second aggregate counts the values of those buckets, and
running sums tell the value. All measures and ranks of a call descend together.

No row count is taken first, nothing is sorted as a whole, and a task holds the buckets
of a group, or the distinct values of one bucket. Infinite values and NaN (which sorts
last) are values like others; nulls are not counted.

Where the planner's own statistics say that the whole input is small (SMALL_BYTES of
files), no group can be larger, and Spark's exact ``percentile`` takes one aggregate
instead of two. That costs no job; both ways give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GROUP_ROWS = 2_000_000
#: An input that the planner puts below this many bytes fits one task as a whole.
SMALL_BYTES = 16 << 20
#: Buckets for each doubling of the value.
PER_DOUBLING = 4096
# Above the logarithm of the largest double and the reciprocal of the smallest. Fixed value.
_BEYOND = 1100 * PER_DOUBLING


def largest_group(df: DataFrame, keys: list[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def bucket_of(value: Column) -> Column:
    """A number that never falls when the value rises; null for null."""
    size = F.floor(F.log2(F.abs(value)) * PER_DOUBLING) + _BEYOND
    return (
        F.when(F.isnan(value), F.lit(4 * _BEYOND))
        .when(F.abs(value) == F.lit(float("inf")), F.signum(value).cast("long") * 3 * _BEYOND)
        .when(value == 0, F.lit(0))
        .when(value.isNotNull(), F.signum(value).cast("long") * size)
        .cast("long")
    )


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the key columns of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def is_small(df: DataFrame) -> bool:
    """Whether the planner bounds the size of ``df`` by SMALL_BYTES; unknown sizes count as large."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return False
    try:
        return plan.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_BYTES
    except ValueError:
        # Estimates of joins multiply, to numbers of thousands of digits that Python refuses to parse.
        return False


def statistics(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column | str, float | None]], within: DataFrame | None = None,
               few: bool = False) -> DataFrame:
    """One row per group with the order statistics of ``wanted``.

    ``wanted`` maps an output name to (value, fraction): the linearly interpolated
    percentile at that fraction, or for None the element ``count // 2`` of the sorted
    values. A group without values has nulls; without ``keys`` there is always one row.
    ``within`` is a table that has at least the rows of ``df`` and a size that the
    planner knows better. ``few`` says that one row per group fits every task, so that
    the second aggregate reads its values where they are.
    """
    if is_small(df if within is None else within):
        at = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
        named = {f"_v{i}": at(v) for i, (v, _) in enumerate(wanted.values())}
        picks = [(F.percentile(f"_v{i}", F.lit(float(f))) if f is not None else upper_median_of(f"_v{i}")).alias(name)
                 for i, (name, (_, f)) in enumerate(wanted.items())]
        return df.select(*keys, *[c.alias(n) for n, c in named.items()]).groupBy(*keys).agg(*picks)
    values: list[Column | str] = []
    numbered: dict[str, tuple[int, float | None]] = {}
    for name, (value, fraction) in wanted.items():
        same = [i for i, v in enumerate(values) if v is value or (isinstance(v, str) and isinstance(value, str) and v == value)]
        if not same:
            values.append(value)
        numbered[name] = (same[0] if same else len(values) - 1, fraction)
    column = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
    if len(values) == 1:
        rows = df.select(*keys, F.lit(0).alias("_m"), column(values[0]).alias("_v"))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("_m"), column(v).alias("_v")) for i, v in enumerate(values)])
        rows = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")
    rows = rows.withColumn("_b", bucket_of(F.col("_v")))
    own = [*keys, "_m"]

    counted = rows.groupBy(*own, "_b").agg(F.count("_v").alias("_c"))
    whole = Window.partitionBy(*own)
    running = whole.orderBy(F.asc_nulls_first("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"_n": F.sum("_c").over(whole), "_until": F.sum("_c").over(running)})
    ranks = []
    for name, (measure, fraction) in numbered.items():
        position = F.floor(F.col("_n") / 2).cast("double") if fraction is None else F.lit(float(fraction)) * (F.col("_n") - 1)
        for end in (F.floor(position), F.ceil(position)):
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit(measure).alias("m"), end.cast("long").alias("rank"), position.alias("position")))
    picked = placed.withColumn("_w", F.explode(F.array(*ranks))).filter(
        (F.col("_w.m") == F.col("_m")) & (F.col("_w.rank") < F.col("_until")) & (F.col("_w.rank") >= F.col("_until") - F.col("_c")))
    picked = picked.select(*own, "_b", (F.col("_until") - F.col("_c")).alias("_before"), "_w.name", "_w.rank", "_w.position").distinct()

    chosen = picked.select(*own, "_b", "_before").distinct()
    inside = _on(rows, F.broadcast(chosen) if few else chosen, [*own, "_b"]).groupBy(*own, "_b", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    within = Window.partitionBy(*own, "_b", "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_until", F.col("_before") + F.sum("_c").over(within)).drop("_before")
    found = _on(inside, picked.drop("_before"), [*own, "_b"]).filter(
        (F.col("rank") < F.col("_until")) & (F.col("rank") >= F.col("_until") - F.col("_c")))

    out = []
    for name in wanted:
        mine = F.col("name") == name
        low, high = F.min(F.when(mine, F.col("_v"))), F.max(F.when(mine, F.col("_v")))
        share = F.max(F.when(mine, F.col("position") - F.floor("position")))
        # Equal ends are the value itself, also where it is infinite.
        out.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
    result = found.groupBy(*keys).agg(*out)
    return _on(counted.select(*keys).distinct(), result, keys, "left") if keys else result


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles, one output column per entry of ``fractions``."""
    return statistics(df, keys, {name: (value, fraction) for name, fraction in fractions.items()})


def median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """True median: the mean of the two middle values of an even count."""
    return percentiles(df, keys, value, {out: 0.5})


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "upper_median") -> DataFrame:
    """Element ``count // 2`` of the sorted values."""
    return statistics(df, keys, {out: (value, None)})


def upper_median_of(value: str) -> Column:
    """Aggregate form for groups of proven size: the discrete median from above."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")
