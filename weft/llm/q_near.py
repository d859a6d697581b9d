"""Queries of problem 5: chunk texts that share most of their three-word sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.near_duplicates import near_duplicates
from weft.plans.components import connected_components
from weft.plans.storage import materialize
from weft.sources.tables import table

#: A class of exact copies up to this size is written out as all its pairs; a larger one is a star: each member is paired with the first, which alone stands in pairs with other texts.
COPIES_AS_PAIRS = 200


def _near(spark: SparkSession, d: str, stages: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "chunk_triples"), "chunk_id", "text", threshold=0.6, width=3, stages=stages)


def written_pairs(members: DataFrame, pairs: DataFrame, copies_as_pairs: int = COPIES_AS_PAIRS) -> DataFrame:
    """chunk_a < chunk_b of all similar chunks; see COPIES_AS_PAIRS for large classes of copies."""
    members = materialize(members.select("id", "fp"), "near-members")
    classes = members.groupBy("fp").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size"))
    speak = members.join(classes, "fp").where((F.col("size") <= copies_as_pairs) | (F.col("id") == F.col("head")))
    left = lambda df: df.select(F.col("fp").alias("a"), F.col("id").alias("x"))
    right = lambda df: df.select(F.col("fp").alias("b"), F.col("id").alias("y"))
    across = pairs.select("a", "b").join(left(speak), "a").join(right(speak), "b").select("x", "y")
    copied = classes.where("size > 1")
    small = members.join(copied.where(F.col("size") <= copies_as_pairs).select("fp"), "fp")
    same = left(small).join(right(small), F.col("a") == F.col("b")).where("x < y").select("x", "y")
    large = members.join(copied.where(F.col("size") > copies_as_pairs), "fp").where("id <> head").select(F.col("head").alias("x"), F.col("id").alias("y"))
    return (
        across.unionByName(same).unionByName(large).where("x <> y")
        .select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return written_pairs(*_near(spark, d))


def p5_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts that met in the index, that the ring left, and that are similar."""
    stages: dict[str, DataFrame] = {}
    _near(spark, d, stages)
    met, ring, similar = (stages[x].agg(F.count(F.lit(1)).alias(x)) for x in ("met", "ring", "similar"))
    return met.crossJoin(ring).crossJoin(similar)  # one row each


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk in a group of alike chunks: its group (the least chunk id), its links to other texts, its exact copies."""
    members, pairs = _near(spark, d)
    members = materialize(members.select("id", "fp"), "near-members")
    components = connected_components(pairs, "a", "b")
    links = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("fp").agg(F.min("id").alias("head"), (F.count(F.lit(1)) - 1).alias("copies"))
    named = (
        classes.join(components.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp")).join(links, "fp", "left")
    )
    groups = named.groupBy("component").agg(F.min("head").alias("group_id"))
    return (
        members.join(named.join(groups, "component"), "fp")
        .where("links is not null or copies > 0")
        .select(F.col("id").alias("chunk_id"), "group_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    )


QUERIES = {"p5_found": p5_found, "p5_pruned": p5_pruned, "p5_groups": p5_groups}
_PAIRS = """
said as (
  select distinct chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from chunk_triples where text is not null
), shingle as (
  select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s
  from said where len(w) >= 3
), size as (select chunk_id, count(*) n from shingle group by 1),
common as (
  select x.chunk_id a, y.chunk_id b, count(*) c from shingle x join shingle y on x.s = y.s and x.chunk_id < y.chunk_id group by 1, 2
), pair as (
  select a, b, c = p.n and c = q.n same from common join size p on p.chunk_id = a join size q on q.chunk_id = b
  where c::double / (p.n + q.n - c) >= 0.6 - 1e-9
)"""
ORACLES = {
    "p5_found": f"with {_PAIRS} select a chunk_a, b chunk_b from pair",
    "p5_groups": f"""
with recursive {_PAIRS},
both_ways as (select a, b, same from pair union all select b, a, same from pair),
class as (select chunk_id, least(chunk_id, coalesce(min(b) filter (same), chunk_id)) head, count(b) filter (same) copies from size left join both_ways on a = chunk_id group by 1),
link as (select distinct x.head u, y.head v from both_ways join class x on x.chunk_id = a join class y on y.chunk_id = b where not same),
reach as (select head u, head v from class where head = chunk_id union select reach.u, link.v from reach join link on link.u = reach.v),
top as (select u, min(v) group_id from reach group by 1)
select chunk_id, group_id, (select count(*) from link where link.u = head) links, copies from class join top on top.u = head
where copies > 0 or head in (select u from link)""",
}
