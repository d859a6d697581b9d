"""Queries of problem 2: the most similar vectors of upsert_req."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.vectors import exact_neighbours, latest, most_similar, neighbours
from weft.plans.storage import materialize
from weft.sources.tables import table

DIM = 64
K = 5
LEAST = 0.90
#: Neighbours of any cosine share fewer pivots: longer files, more of them, and most of each reranked.
WIDE = {"posted": 5, "share": 0.6, "density": 0.65}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "upsert_req"), ["req_id", "pos"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours(*most_similar(_rows(spark, d), DIM, K, LEAST), K).where(F.col("cosine") >= LEAST)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar ids of every id, however similar; posted more widely, as distant neighbours share fewer pivots."""
    return neighbours(*most_similar(_rows(spark, d), DIM, K, **WIDE), K).withColumn("cosine", F.round("cosine", 6))


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar rows of all for every id divisible by 100, by brute force in blocks: what recall is measured against."""
    rows = _rows(spark, d)
    return exact_neighbours(rows, rows.where("id % 100 = 0"), DIM, K).withColumn("cosine", F.round("cosine", 6))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of both searches for the ids divisible by 100, against brute force over all rows."""
    rows = _rows(spark, d)
    exact = materialize(exact_neighbours(rows, rows.where("id % 100 = 0"), DIM, K), "vectors-exact")
    out = []
    for name, found, truth in (
        ("p2_found", neighbours(*most_similar(rows, DIM, K, LEAST), K), exact.where(F.col("cosine") >= LEAST)),
        ("p2_neighbours", neighbours(*most_similar(rows, DIM, K, **WIDE), K), exact),
    ):
        hit = truth.join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
        out.append(hit.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")).withColumn("query", F.lit(name)))
    return out[0].unionByName(out[1]).select("query", "wanted", "found", (F.col("found") / F.col("wanted")).alias("recall"))


QUERIES = {"p2_found": p2_found, "p2_exact": p2_exact, "p2_neighbours": p2_neighbours, "p2_recall": p2_recall}
ORACLES = {
    "p2_exact": f"""
with last as (select * from (select *, row_number() over (partition by id order by req_id desc, pos desc) r from upsert_req where id is not null) where r = 1),
v as (select id, vector::double[] v from last where len(vector) = {DIM} and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(vector, lambda x: x <> 0)) > 0),
near as (select q.id, e.id other, list_cosine_similarity(q.v, e.v) cosine from v q join v e on q.id <> e.id where q.id % 100 = 0)
select id, other, round(cosine, 6) cosine from (select *, row_number() over (partition by id order by round(cosine, 9) desc, other) r from near) where r <= {K}"""
}
