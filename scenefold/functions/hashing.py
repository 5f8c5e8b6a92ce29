"""Wrapping 64-bit mixers as vectorised UDFs.

Spark's ANSI arithmetic refuses to wrap, so these run on numpy ``uint64``. A
hash is returned as the signed bit pattern in the high-bit-flipped order, i.e.
``signed_hash`` orders rows exactly as the unsigned value would.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .types import LONG

U64_MAX = (1 << 64) - 1

# Mixing constants. Fixed values.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
MIX_C = np.uint64(0x369DEA0F31A53F85)


def to_signed(values: np.ndarray) -> np.ndarray:
    """Order-preserving map from uint64 to int64."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def threshold_to_signed(threshold: int) -> int:
    return threshold - (1 << 63)


def sample_threshold(candidates: int, budget: int) -> int:
    """Largest hash that is kept so that about ``budget`` of ``candidates`` survive."""
    if candidates <= budget:
        return U64_MAX
    return min(int(budget / candidates * float(U64_MAX)), U64_MAX)


def _observation_values(frame: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = frame.astype(np.uint64) ^ GOLDEN
        value = value ^ (px.astype(np.uint64) * MIX_A)
        value = ((value << np.uint64(27)) | (value >> np.uint64(37))) * MIX_B
        value = value ^ (py.astype(np.uint64) * MIX_C)
        return value ^ (value >> np.uint64(29))


def _position_values(index: np.ndarray, coordinates: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = index.astype(np.uint64) ^ GOLDEN
        for axis in coordinates:
            bits = np.ascontiguousarray(axis.astype(np.float32)).view(np.uint32).astype(np.uint64)
            value = (value ^ bits) * MIX_A
            value = value ^ (value >> np.uint64(27))
        return value ^ (value >> np.uint64(31))


def index_for_seed(seed: np.ndarray | int, bound: int) -> np.ndarray:
    """Deterministic index in ``[0, bound)`` for each seed."""
    with np.errstate(over="ignore"):
        value = np.atleast_1d(np.asarray(seed, dtype=np.uint64)) ^ GOLDEN
        value = (value ^ (value >> np.uint64(30))) * MIX_A
        value = (value ^ (value >> np.uint64(27))) * MIX_B
        value = value ^ (value >> np.uint64(31))
    return (value % np.uint64(bound)).astype(np.int64)


@F.pandas_udf(LONG)
def _observation_hash(frame: pd.Series, px: pd.Series, py: pd.Series) -> pd.Series:
    return pd.Series(to_signed(_observation_values(frame.to_numpy(), px.to_numpy(), py.to_numpy())))


@F.pandas_udf(LONG)
def _preview_hash(index: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    values = _position_values(index.to_numpy(), [axis.to_numpy() for axis in (x, y, z)])
    return pd.Series(to_signed(values))


def observation_hash(frame: Column, px: Column, py: Column) -> Column:
    return _observation_hash(frame.cast("long"), px.cast("long"), py.cast("long"))


def preview_hash(index: Column, x: Column, y: Column, z: Column) -> Column:
    return _preview_hash(index.cast("long"), x.cast("double"), y.cast("double"), z.cast("double"))


def keyed_hold_out(fold: str, pose: Column, point: Column) -> Column:
    """Stable fifth of the points: leading 64 bits of a SHA-256 divisible by five."""
    digest = F.sha2(F.concat_ws(":", F.lit(fold), pose.cast("string"), point.cast("string")), 256)
    leading = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(leading, F.lit(5).cast("decimal(20,0)")) == 0


def modulo_hold_out(point: Column) -> Column:
    return F.pmod(point, F.lit(5)) == 0
