"""Keyword search: an inverted index as two tables, and BM25 over it.

Textbook BM25 with k1 = 1.2 and b = 0.75 over chunk texts. A query term matches
every word that it begins; its frequency in a chunk is that of all such words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import salient_terms, words
from weft.plans.storage import materialize

K1, B = 1.2, 0.75
#: Terms that one pass looks for, about; they become one filter.
MAX_TERMS_AT_ONCE = 1000


def _begins(term, terms: list[str]):
    return reduce(lambda a, b: a | b, (F.startswith(term, F.lit(t)) for t in terms))


def postings(texts: DataFrame, id: str = "chunk_id", text: str = "text", split=words, begins: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(posting: term, id, tf; chunk_len: id, dl). Texts without a word have neither.

    begins: the index holds only words that one of these begins, and no others are shuffled.
    """
    said = texts.select(id, split(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    mine = F.col("_w") if begins is None else F.filter("_w", lambda w: _begins(w, begins) if begins else F.lit(False))
    posting = said.select(id, F.explode(mine).alias("term")).groupBy("term", id).agg(F.count(F.lit(1)).alias("tf"))
    return posting.select("term", id, "tf"), said.select(id, F.size("_w").cast("long").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """queries: query_id, query -> query_id, term: the salient words."""
    return queries.select("query_id", F.explode(salient_terms(F.col("query"))).alias("term"))


def bm25(posting: DataFrame, chunk_len: DataFrame, terms: list[str], id: str = "chunk_id") -> DataFrame:
    """term, id, score for every chunk with a word that a term begins. Only those words are read from the posting table."""
    if not terms:
        return posting.sparkSession.createDataFrame([], f"term string, {id} {dict(posting.dtypes)[id]}, score double")
    wanted = _begins(F.col("term"), terms)
    begun = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.startswith(F.col("term"), t))
    hits = posting.where(wanted).select(F.explode(begun).alias("q"), id, "tf").groupBy("q", id).agg(F.sum("tf").cast("double").alias("tf"))
    df = hits.groupBy("q").agg(F.count(F.lit(1)).cast("double").alias("df"))
    stats = chunk_len.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        hits.join(F.broadcast(df), "q").join(chunk_len, id).crossJoin(F.broadcast(stats))  # one row of statistics
        .select(F.col("q").alias("term"), id, (idf * part).alias("score"))
    )


def keyword_hits(posting: DataFrame, chunk_len: DataFrame, terms: list[str], k: int, id: str = "chunk_id") -> DataFrame:
    """id, score, rank: the best k chunks of each term; of a chunk's scores the best counts."""
    scored = bm25(posting, chunk_len, terms, id)
    per_term = Window.partitionBy("term").orderBy(F.desc("score"), id)
    best = scored.withColumn("_rn", F.row_number().over(per_term)).where(F.col("_rn") <= k).groupBy(id).agg(F.max("score").alias("score"))
    return ranked(best, "score", id)  # at most k rows per term


def keyword_hits_many(posting: DataFrame, chunk_len: DataFrame, queries: DataFrame, k: int, id: str = "chunk_id") -> DataFrame:
    """query_id, id, score, rank: :func:`keyword_hits` of several queries (query_id, query), scored in one pass over the postings per block of terms."""
    terms = materialize(query_terms(queries), "query-terms")
    distinct = terms.select("term").distinct()
    blocks = materialize(distinct.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(distinct.count() * 2 // MAX_TERMS_AT_ONCE + 1))), "query-blocks")
    per_term = Window.partitionBy("term").orderBy(F.desc("score"), id)
    found = []
    for b in sorted(r["block"] for r in blocks.select("block").distinct().collect()):
        wanted = sorted(r["term"] for r in blocks.where(F.col("block") == b).collect())
        found.append(bm25(posting, chunk_len, wanted, id).withColumn("_rn", F.row_number().over(per_term)).where(F.col("_rn") <= k))
    scored = reduce(DataFrame.unionByName, found or [bm25(posting, chunk_len, [], id)])
    best = terms.join(scored, "term").groupBy("query_id", id).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id)))


def ranked(df: DataFrame, score: str, id: str) -> DataFrame:
    """Rank of a small result, best first, ties to the lesser id."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id)))
