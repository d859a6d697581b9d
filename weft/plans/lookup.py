"""Joining many rows with a smaller table of unique keys, whatever the skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of the files, of a side that may be broadcast; beyond, only heavy keys are.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 100_000, 32 << 20
MAX_HEAVY = 1000


def small(df: DataFrame) -> bool:
    """Whether a written table is small enough to be broadcast, by its files and by counting."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= MAX_BROADCAST_BYTES and df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def lookup(rows: DataFrame, by_key: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key``, a written table with one row per key.

    A :func:`small` table is broadcast. A larger one
    is split: keys with more than 1/MAX_HEAVY of the rows, fewer than MAX_HEAVY
    by counting, are broadcast, the rest is shuffled. ``how``: inner or left.
    """
    if small(by_key):
        return rows.join(F.broadcast(by_key), on, how)
    sizes = rows.groupBy(*on).count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    heavy = F.broadcast(sizes.where(F.col("count") * MAX_HEAVY > total).select(*on))
    hot = rows.join(heavy, on, "left_semi").join(F.broadcast(by_key.join(heavy, on, "left_semi")), on, how)
    cold = rows.join(heavy, on, "left_anti").join(by_key, on, how)
    return hot.unionByName(cold)
