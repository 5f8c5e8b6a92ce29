"""Helpers shared by the relational operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def attach(left: DataFrame, small: DataFrame) -> DataFrame:
    """Pair every row with the few rows of an aggregate, by a scalar subquery.

    ``small`` is one row, or a handful: it is evaluated once and travels as a
    value, so there is no join and no shuffle of ``left``.
    """
    packed = small.agg(F.collect_list(F.struct(*small.columns)).alias("_rows")).scalar()
    listed = left.withColumn("_rows", packed).withColumn("_row", F.explode("_rows"))
    return listed.select(*left.columns, *[F.col(f"_row.{name}").alias(name) for name in small.columns])


def equi(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``; without keys ``right`` is an aggregate and is attached."""
    return left.join(right, keys, how) if keys else attach(left, right)


def latest_by(df: DataFrame, keys: list[str], order: list[Column], smallest: bool = False) -> DataFrame:
    """One row per key, the last (or first) in ``order``, by a mergeable aggregate.

    Unlike a ranking window this combines before the shuffle, so one key with a
    third of all rows does not become one large sort.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if smallest else F.max_by
    return (
        df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    )


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return latest_by(df, keys, order, smallest=True)


def apply_by_bucket(df: DataFrame, group: list[str], function, schema: str, bucket_rows: int = 200_000) -> DataFrame:
    """``applyInPandas`` for very many small groups.

    Whole groups are hashed into buckets of about ``bucket_rows`` rows, so one
    Arrow exchange serves many groups. ``df`` should be settled: it is counted.
    """
    buckets = max(1, -(-df.count() // bucket_rows), df.sparkSession.sparkContext.defaultParallelism)

    def run(pdf):
        parts = [function(part) for _, part in pdf.groupby(group, sort=False)]
        return pd.concat(parts, ignore_index=True)

    return df.withColumn("_bucket", F.pmod(F.xxhash64(*group), F.lit(buckets))).groupBy("_bucket").applyInPandas(run, schema)
