"""The vector table: upsert, remove, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.plans.storage import materialize

#: Queries that are sent out at once against all vectors.
MAX_QUERIES = 4096


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fails on a vector of another dimension."""
    good = F.size(column) == dim
    return vectors.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("vector of dimension "), F.size(column).cast("string"), F.lit(f", not {dim}"))).isNull()))


def upsert_vectors(old: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of repeated keys in a batch the last (by ``order``) wins, and replaces the old vector."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*old.columns)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def remove_vectors(old: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what is left, one row with the number ``removed``); unknown ids do not count."""
    ids = ids.select(key).distinct()
    return old.join(ids, key, "left_anti"), old.join(ids, key, "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def info(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.agg(F.max(F.size(column)).alias("dim"), F.count(F.lit(1)).alias("count"), F.lit(32).alias("bit_width"))


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the entries with ``dim`` finite components that are not all zero."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    x = column.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        use = np.isfinite(length) & (length > 0)
    return np.flatnonzero(good.to_numpy(zero_copy_only=False))[use], x[use] / length[use, None]


def nearest(
    queries: DataFrame, vectors: DataFrame, key: str, k: int, allowed: DataFrame | None = None, column: str = "embedding", block: int = MAX_QUERIES
) -> DataFrame:
    """query_id, key, score, rank of the k best per query, ties to the lesser key.

    queries: query_id, query array<float>. They are sent out a block at a time, so
    vectors are scored where they lie, by one matrix product per batch, and only
    the best k of each batch are shuffled. ``allowed`` (key) restricts the vectors
    before any is scored; an empty one gives no hits. Vectors that are null, all
    zero or of another length than the query, or have a null or NaN, give no hit.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select(key).distinct(), key, "left_semi")
    types, vtypes = dict(queries.dtypes), dict(vectors.dtypes)
    schema = f"query_id {types['query_id']}, `{key}` {vtypes[key]}, score double"
    asked = materialize(queries.select("query_id", "query"), "near-queries")
    count = asked.count()
    blocks = -(-count // block) or 1
    parts = []
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = mine.toArrow().combine_chunks()  # a block of queries
        by_dim: dict[int, tuple[pa.Array, np.ndarray]] = {}
        lists = got.column("query").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64()))
        for dim in set(pc.list_value_length(lists).to_pylist()) - {None, 0}:
            rows, unit = _units(lists, dim)
            if len(rows):
                by_dim[dim] = got.column("query_id").take(pa.array(rows)), unit
        if by_dim:
            parts.append(vectors.select(key, column).mapInArrow(_scored(by_dim, key, column, k), schema))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(by_dim: dict, key: str, column: str, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (ids, query) in by_dim.items():
                rows, unit = _units(batch.column(column), dim)
                if not len(rows):
                    continue
                keys = batch.column(key).take(pa.array(rows))
                near = np.round(query @ unit.T, 12)  # equal vectors have equal scores, whatever the order of summing
                least = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
                i, j = np.nonzero(near >= least[:, None])  # ties at the last place go on
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)).combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids.take(pa.array(i)), keys.take(pa.array(j)), pa.array(near[i, j])], ["query_id", key, "score"])

    return scan
