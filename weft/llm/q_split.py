"""Queries of problem 3: chunk texts longer than the limit of their document's mime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.split import split_oversized
from weft.plans.lookup import lookup
from weft.plans.storage import materialize
from weft.sources.tables import table

BYTES_PER_TOKEN = 4


def _texts(spark: SparkSession, d: str) -> DataFrame:
    options = table(spark, d, "chunk_options").select(
        F.col("mime").alias("option"),
        (F.col("max_tokens") * BYTES_PER_TOKEN).alias("limit"),
        F.floor(F.col("target_tokens") * BYTES_PER_TOKEN * F.col("overlap")).cast("int").alias("overlap"),
    )
    known = {r["option"]: (r["limit"], r["overlap"]) for r in options.collect()}  # one row per mime
    # documents whose option is the same as that of every other mime need not be known
    listed = [m for m, x in known.items() if m != "*" and x != known.get("*")]
    smallest = min((limit for limit, _ in known.values() if limit is not None), default=0)
    docs = table(spark, d, "doc").groupBy("docid").agg(F.max_by("mime", "loaded_at").alias("mime")).select(
        F.col("docid").alias("doc_id"), F.when(F.col("mime").isin(listed), F.col("mime")).alias("option")
    )
    docs = materialize(docs.where("doc_id is not null and option is not null and option <> '*'"), "split-mimes")
    # copies of a row count once; only texts that some option calls too long go on
    long = table(spark, d, "chunk_triples").where(F.octet_length("text") > smallest).select(
        "chunk_id", "doc_id", "text",
        F.coalesce("byte_start", F.lit(0)).alias("first"),
        (F.octet_length("text") - (F.col("byte_end") - F.col("byte_start"))).alias("lead"),
    )
    rows = lookup(long, docs, ["doc_id"], "left").withColumn("option", F.coalesce("option", F.lit("*")))
    lead = F.when((F.col("lead") >= 0) & (F.col("lead") <= F.col("first")), F.col("lead")).otherwise(0)
    return lookup(rows, options, ["option"]).withColumn("base", F.col("first") - lead)


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d).where(F.octet_length("text") > F.col("limit")).dropDuplicates(["chunk_id", "doc_id", "text", "base"])
    return split_oversized(texts, ["chunk_id"])


def p3_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk that is cut: its bytes, the bytes its pieces cover, holes or overlaps between them, pieces over the limit or whose text is not theirs.

    Chunks of one id with several texts are left out, since their pieces are not told apart.
    """
    texts = _texts(spark, d).where(F.octet_length("text") > F.col("limit")).dropDuplicates(["chunk_id", "doc_id", "text", "base"])
    once = materialize(texts.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.first("limit").alias("most"), F.first("base").alias("base"), F.max(F.octet_length("text")).alias("bytes")).where("n = 1"), "split-once")
    cut = split_oversized(texts, ["chunk_id"]).join(once, "chunk_id")
    before = F.lag("byte_end").over(Window.partitionBy("chunk_id").orderBy("piece"))
    cut = cut.withColumn("hole", (F.col("byte_start") != F.coalesce(before, F.col("base"))).cast("long"))
    wrong = (F.octet_length("text") > F.col("most")) | (F.octet_length("text") != F.col("byte_end") - F.col("text_start")) | (F.col("byte_start") < F.col("text_start"))
    return cut.groupBy("chunk_id").agg(
        F.first("bytes").cast("long").alias("bytes"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("covered"), F.sum("hole").alias("holes"),
        F.sum(wrong.cast("long")).alias("wrong"), (F.count(F.lit(1)) > 1).alias("cut"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_texts(spark, d), ["chunk_id"]).where("piece = 2").select("chunk_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_tiling": p3_tiling, "p3_pieces": p3_pieces}
ORACLES = {
    "p3_tiling": """
with d as (select docid, arg_max(mime, loaded_at) mime from doc group by 1),
l as (select t.chunk_id, octet_length(encode(t.text))::bigint bytes, coalesce(o.max_tokens, f.fallback) * 4 most,
  t.doc_id, t.text, coalesce(t.byte_start, 0) f0, octet_length(encode(t.text)) - (t.byte_end - t.byte_start) lead
from chunk_triples t left join d on d.docid = t.doc_id left join (select * from chunk_options where mime <> '*') o on o.mime = d.mime
cross join (select max_tokens as fallback from chunk_options where mime = '*') f),
g as (select distinct chunk_id, bytes, doc_id, text, f0 - case when lead >= 0 and lead <= f0 then lead else 0 end base from l where bytes > most)
select chunk_id, max(bytes) bytes, max(bytes) covered, 0::bigint holes, 0::bigint wrong, true cut from g group by 1 having count(*) = 1""",
    "p3_found": """
select distinct t.chunk_id
from chunk_triples t
left join (select docid, arg_max(mime, loaded_at) mime from doc group by 1) d on d.docid = t.doc_id
left join (select * from chunk_options where mime <> '*') o on o.mime = d.mime
cross join (select max_tokens as fallback from chunk_options where mime = '*') f
where octet_length(encode(t.text)) > 4 * coalesce(o.max_tokens, f.fallback)
"""
}
