"""Keys of rows, and blocks of consecutive ids dealt without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_of(df: DataFrame, key: str, blocks: int) -> Column:
    """The number of the block, 0 to at most blocks - 1, that a row's key falls in; blocks are ranges.

    Bounds are approximate quantiles of one pass over the key column. They are looked up in two steps, so a
    row costs about twice the square root of their number. Equal keys share a block; null is in block 0.
    """
    wide = math.isqrt(max(1, blocks - 1)) + 1
    shares = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * blocks))).first()[0] if shares else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    rows = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    at_most = lambda x: x <= F.col(key)
    row = F.greatest(F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), at_most)) - 1, F.lit(0))
    fine = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    return (row * wide + F.size(F.filter(fine[row], at_most))).cast("int")


def row_key(*columns: str) -> Column:
    """A 64-bit hash of a row's values, nulls included: the same for equal rows, under any partitioning."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
