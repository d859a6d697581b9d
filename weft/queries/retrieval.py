"""Vectors, keywords and their fusion over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.operators import vectors as V
from weft.operators.fusion import fuse
from weft.operators.keyword import bm25, keyword_hits, postings
from weft.plans.storage import materialize
from weft.sources.tables import table

#: The question that the keyword queries ask.
QUESTION = "harbour turbine measurement and the railway pipeline storage archive"
TERMS = ["measurement", "pipeline", "harbour", "turbine", "railway", "storage"]
K, KEEP = 24, 12


def _index(spark: SparkSession, d: str, begins: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    posting, chunk_len = postings(table(spark, d, "documents"), "doc_id", begins=begins)
    return materialize(posting, "postings"), materialize(chunk_len, "lengths")


def term_df(spark: SparkSession, d: str) -> DataFrame:
    posting, _ = postings(table(spark, d, "documents"), "doc_id")
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def keyword_prefix_max(spark: SparkSession, d: str) -> DataFrame:
    """The best BM25 score of any term for every document that has one."""
    posting, lengths = _index(spark, d, TERMS)
    return bm25(posting, lengths, TERMS, "doc_id").groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("score"))


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    posting, lengths = _index(spark, d, TERMS)
    return keyword_hits(posting, lengths, TERMS, K, "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    hits = V.nearest(_queries(spark, d), table(spark, d, "embeddings"), "vec_id", K)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_allowlist(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    allowed = vectors.where("label in (1, 3)").select("vec_id")
    hits = V.nearest(_queries(spark, d), vectors, "vec_id", K, allowed)
    return hits.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def vector_info(spark: SparkSession, d: str) -> DataFrame:
    return V.info(V.checked(table(spark, d, "embeddings"), 64))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(X.norm(e), 6).alias("norm"), F.round(X.norm(X.normalized(e)), 4).alias("unit"))


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The batch of upsert_req laid over the vectors: one row per id, that of its last request."""
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    batch = table(spark, d, "upsert_req").distinct()
    new = V.upsert_vectors(old, batch, "id", ["req_id", "pos"])
    return new.select("id", F.size("vector").alias("dim"), F.round(F.try_element_at("vector", F.lit(1)).cast("double"), 5).alias("head"))


def vector_remove(spark: SparkSession, d: str) -> DataFrame:
    """Ids of retired chunks are removed; ids without a vector do not count."""
    rows = table(spark, d, "upsert_req").select("id").distinct()
    gone = table(spark, d, "chunk").where("modality <> 'text'").select(F.col("veckey").alias("id"))
    left, removed = V.remove_vectors(rows, gone, "id")
    return left.agg(F.count(F.lit(1)).alias("left")).crossJoin(removed)


def rrf_fused(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector hits fused; the vector leg asks with the least vector id."""
    posting, lengths = _index(spark, d, TERMS)
    words = keyword_hits(posting, lengths, TERMS, K, "doc_id")
    vectors = table(spark, d, "embeddings")
    query = vectors.groupBy().agg(F.min_by("embedding", "vec_id").alias("query")).select(F.lit(0).alias("query_id"), "query")
    near = V.nearest(query, vectors, "vec_id", K).withColumnRenamed("vec_id", "doc_id")
    top = fuse({"keyword": words, "vector": near}, KEEP, "doc_id")
    return top.select("doc_id", F.round("fused", 9).alias("fused"), "legs", F.col("keyword_rank").cast("long").alias("keyword_rank"), F.col("vector_rank").cast("long").alias("vector_rank"))


QUERIES = {
    f.__name__: f
    for f in (term_df, keyword_prefix_max, keyword_topk, knn_cosine, knn_allowlist, vector_info, vector_norms, vector_upsert, vector_remove, rrf_fused)
}

_TOKENS = """
tok as (select doc_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) term from documents),
posting as (select term, doc_id, count(*) tf from tok group by 1, 2), dl as (select doc_id, count(*) dl from tok group by 1)"""
_BM25 = f"""{_TOKENS},
q as (select unnest([{', '.join(repr(t) for t in TERMS)}]) q),
hit as (select q, doc_id, sum(tf)::double tf from posting join q on starts_with(term, q) group by 1, 2),
df as (select q, count(*)::double df from hit group by 1), st as (select count(*)::double n, avg(dl) avgdl from dl),
score as (select q, doc_id, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) score
  from hit join df using (q) join dl using (doc_id) cross join st),
kw as (select doc_id, max(score) score from (select *, row_number() over (partition by q order by score desc, doc_id) r from score) where r <= {K} group by 1),
ranked as (select doc_id, score, row_number() over (order by score desc, doc_id) rank from kw)"""
_KNN = """
select q.vec_id query_id, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) score,
  row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) rank
from embeddings q, embeddings e where q.vec_id % 100 = 0"""

ORACLES = {
    "term_df": f"with {_TOKENS} select term, count(*) df, sum(tf)::bigint cf from posting group by 1",
    "keyword_prefix_max": f"with {_BM25} select doc_id, round(max(score), 6) score from score group by 1",
    "keyword_topk": f"with {_BM25} select doc_id, round(score, 6) score, rank from ranked",
    "knn_cosine": f"select query_id, vec_id, round(score, 6) score, rank from ({_KNN}) where rank <= {K}",
    "knn_allowlist": f"select query_id, vec_id, rank from ({_KNN} and e.label in (1, 3)) where rank <= {K}",
    "vector_info": "select max(len(embedding))::int dim, count(*) count, 32 bit_width from embeddings",
    "vector_norms": "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) norm, 1.0::double unit from embeddings",
    "vector_upsert": """
with new as (select * from (select *, row_number() over (partition by id order by req_id desc, pos desc) r from (select distinct * from upsert_req)) where r = 1),
u as (select vec_id id, embedding vector from embeddings where vec_id not in (select id from new) union all select id, vector from new)
select id, len(vector)::int dim, round(vector[1]::double, 5) head from u""",
    "vector_remove": """
with ids as (select distinct id from upsert_req), gone as (select distinct veckey from chunk where modality <> 'text')
select count(*) filter (id not in (select veckey from gone)) "left", count(*) filter (id in (select veckey from gone)) removed from ids""",
    "rrf_fused": f"""with {_BM25},
vec as (select e.vec_id doc_id, row_number() over (order by list_cosine_similarity((select arg_min(embedding, vec_id) from embeddings)::double[], e.embedding::double[]) desc, e.vec_id) rank from embeddings e),
legs as (select doc_id, 'k' leg, rank from ranked union all select doc_id, 'v', rank from vec where rank <= {K})
select doc_id, round(sum(1.0::double / (60.0::double + rank)), 9) fused, count(*) legs, min(rank) filter (leg = 'k') keyword_rank, min(rank) filter (leg = 'v') vector_rank
from legs group by 1 order by sum(1.0::double / (60.0::double + rank)) desc, doc_id limit {KEEP}""",
}
