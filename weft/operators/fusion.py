"""Reciprocal rank fusion of several ranked lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.native import fit_budget

RRF_K = 60.0


def fuse(legs: dict[str, DataFrame], keep: int, id: str = "chunk_id", by: list[str] | None = None) -> DataFrame:
    """id, fused, legs, and for each leg its rank: the best ``keep`` by the sum of 1 / (60 + rank).

    legs: name -> (id, rank), and the columns ``by`` if there are several queries.
    """
    by = by or []
    parts = [df.select(*by, id, F.lit(name).alias("leg"), F.col("rank").cast("double").alias("rank")) for name, df in legs.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    total = union.groupBy(*by, id).agg(
        F.sum(1.0 / (F.lit(RRF_K) + F.col("rank"))).alias("fused"),
        F.count(F.lit(1)).alias("legs"),
        *[F.min(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank") for name in legs],
    )
    if not by:
        return total.orderBy(F.desc("fused"), id).limit(keep)
    w = Window.partitionBy(*by).orderBy(F.desc("fused"), id)
    return total.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def media_to_text(hits: DataFrame, id: str = "chunk_id") -> DataFrame:
    """A hit on raw media (ordinal 0) stands for the first text chunk of its document; of several the best counts."""
    moved = hits.withColumn(id, F.regexp_replace(id, ":0000$", ":0001"))
    return moved.groupBy(id).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))


def budgeted(candidates: DataFrame, budget: int, by: str = "query_id", id: str = "chunk_id") -> DataFrame:
    """by, id, n: what a reader of the ranked candidates of each query takes who skips what does not fit the budget any more.

    candidates: by, id, rank, size; the ranked hits of a query, some hundreds at most.
    """
    types = dict(candidates.dtypes)

    def take(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", id], kind="stable").reset_index(drop=True)
        kept = fit_budget(group["size"].tolist(), budget)
        return group.loc[kept, [by, id]].assign(n=range(1, len(kept) + 1))

    return candidates.select(by, id, "rank", "size").groupBy(by).applyInPandas(take, f"`{by}` {types[by]}, `{id}` {types[id]}, n int")
