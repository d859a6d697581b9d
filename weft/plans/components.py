"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.storage import materialize

MAX_ROUNDS = 50


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node of its component) for every node of an edge.

    Each round is written out, so no lineage grows and a lost executor costs one
    round. A round sends every edge once; the number of rounds grows with the
    logarithm of the largest component's diameter. Loops, repeated and null
    edges do no harm; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = materialize(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    e = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            both = df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = df
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(MAX_ROUNDS):
        e = materialize(star(star(e, True), False), "cc-round")
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
