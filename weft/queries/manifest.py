"""The manifest: documents, paths and chunks as keyed tables, and what changes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import tables as T
from weft.operators.orphans import tidy_key
from weft.plans.maintain import compared
from weft.sources.tables import table


def _doc(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: of repeated deliveries the last."""
    doc = table(spark, d, "doc").withColumn("superseded_by", tidy_key(F.col("superseded_by")))
    return T.last_per_key(doc, ["docid"], ["loaded_at"])


def _path(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "path").withColumn("docid", tidy_key(F.col("docid"))).where("docid is not null")
    return T.last_per_key(p.distinct(), ["relpath"], ["loaded_at", "mtime", "size", "docid"])


def _chunk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").withColumn("docid", tidy_key(F.col("docid")))
    return T.last_per_key(c.distinct(), ["chunkid"], ["loaded_at", "byte_end"])


def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    return T.scoreboard(_doc(spark, d), _chunk(spark, d)).select("docs", "chunks", "superseded")


def superseded_docs(spark: SparkSession, d: str) -> DataFrame:
    return T.superseded(_doc(spark, d)).select("docid", "superseded_by")


def latest_docs(spark: SparkSession, d: str) -> DataFrame:
    return _doc(spark, d).select("docid", "bytes", "stage", "vacuumed", "superseded_by")


def paths_of(spark: SparkSession, d: str) -> DataFrame:
    p = _path(spark, d)
    return p.groupBy("docid").agg(F.count(F.lit(1)).alias("paths"), F.min("relpath").alias("first_path"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The tree as it would be found now: paths whose size is odd were touched, those ending in 7 were edited, and copies appeared."""
    p = _path(spark, d).where("mtime is not null")
    edited = F.col("size") % 10 == 7
    old = p.select(
        "relpath", F.when(edited | (F.col("size") % 2 == 1), F.col("mtime") + 60).otherwise(F.col("mtime")).alias("mtime"), "size",
        F.when(edited, F.concat(F.lit("new-"), "docid")).otherwise(F.col("docid")).alias("docid"),
    )
    more = p.where("size % 10 in (3, 4)").select(F.concat(F.lit("copies/"), "relpath").alias("relpath"), "mtime", "size", "docid")
    fresh = p.where("size % 10 = 5").select(F.concat(F.lit("fresh/"), "relpath").alias("relpath"), "mtime", "size", F.concat(F.lit("fresh-"), "docid").alias("docid"))
    return old.unionByName(more).unionByName(fresh)


def change_classify(spark: SparkSession, d: str) -> DataFrame:
    return T.classify(_files(spark, d), _path(spark, d), _doc(spark, d)).select("relpath", "kind", "replaces")


def fast_skip(spark: SparkSession, d: str) -> DataFrame:
    same, others = T.unread(_files(spark, d), _path(spark, d), _doc(spark, d))
    return same.agg(F.count(F.lit(1)).alias("skipped")).crossJoin(others.agg(F.count(F.lit(1)).alias("read")))


def path_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _path(spark, d).select("relpath", "mtime", "size", "docid")
    return T.upsert(old, _files(spark, d), ["relpath"])


def doc_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = _doc(spark, d).select("docid", "bytes")
    new = _files(spark, d).groupBy("docid").agg(F.max("size").alias("bytes"))
    return T.insert_ignore(old, new, ["docid"])


def stage_update(spark: SparkSession, d: str) -> DataFrame:
    """Documents that all their chunks have reached the graph for are committed."""
    done = table(spark, d, "chunk_triples").groupBy(F.col("doc_id").alias("docid")).agg(F.min((~F.col("extraction_failed")).cast("int")).alias("good")).where("good = 1")
    return T.set_stage(_doc(spark, d), done.select("docid"), 6).select("docid", "stage")


def forget_docs(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table when the superseded documents are forgotten."""
    doc, path, chunk = _doc(spark, d), _path(spark, d), _chunk(spark, d)
    new = T.forget(doc, path, chunk, T.superseded(doc).select("docid"))
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tab"), "rows") for name, df in zip(("doc", "path", "chunk"), new)]
    marked = new[0].where("vacuumed = 1").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("vacuumed").alias("tab"), "rows")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(marked)


def verify_files(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a comparison of the tree with the manifest; the document id stands for the hash."""
    doc = _doc(spark, d).select("docid", F.col("docid").alias("tap_hash"), F.lit(None).cast("string").alias("full_hash"), F.lit(False).alias("paranoid"))
    files = _files(spark, d).where("size % 10 <> 9").select("relpath", F.when(F.col("size") % 10 != 2, F.col("docid")).alias("tap_hash"), F.lit(None).cast("string").alias("full_hash"))
    return compared(files, _path(spark, d), doc).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each content once, at its first document, with the number of places that hold it."""
    docs = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("content"), "doc_id")
    return docs.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("places"))


def chunk_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Vector keys of all requests with their chunk; keys of no chunk are dropped."""
    keys = table(spark, d, "upsert_req").select(F.col("id").alias("veckey")).distinct()
    return _chunk(spark, d).join(keys, "veckey").select("veckey", "chunkid")


QUERIES = {
    f.__name__: f
    for f in (
        scoreboard, superseded_docs, latest_docs, paths_of, change_classify, fast_skip, path_upsert, doc_insert_ignore, stage_update, forget_docs,
        verify_files, content_dedup, chunk_key_lookup,
    )
}

_BASE = """
d as (select * exclude (r) from (select * replace (nullif(lower(trim(superseded_by)), '') as superseded_by), row_number() over (partition by docid order by loaded_at desc) r from doc) where r = 1),
p as (select * exclude (r) from (select *, row_number() over (partition by relpath order by loaded_at desc nulls last, mtime desc nulls last, size desc nulls last, docid desc) r
  from (select distinct relpath, mtime, size, lower(trim(docid)) docid, loaded_at from path where trim(docid) <> '')) where r = 1),
c as (select * exclude (r) from (select *, row_number() over (partition by chunkid order by loaded_at desc, byte_end desc nulls last) r
  from (select distinct * replace (nullif(lower(trim(docid)), '') as docid) from chunk)) where r = 1),
pm as (select * from p where mtime is not null),
f as (
  select relpath, case when size % 10 = 7 or size % 2 = 1 then mtime + 60 else mtime end mtime, size, case when size % 10 = 7 then 'new-' || docid else docid end docid from pm
  union all select 'copies/' || relpath, mtime, size, docid from pm where size % 10 in (3, 4)
  union all select 'fresh/' || relpath, mtime, size, 'fresh-' || docid from pm where size % 10 = 5),
done as (select docid from d where stage >= 6 and vacuumed = 0)"""

ORACLES = {
    "scoreboard": f"with {_BASE} select count(*) filter (superseded_by is null and vacuumed = 0) docs, (select count(*) from c) chunks, count(*) filter (superseded_by is not null and vacuumed = 0) superseded from d",
    "superseded_docs": f"with {_BASE} select docid, superseded_by from d where superseded_by is not null and vacuumed = 0",
    "latest_docs": f"with {_BASE} select docid, bytes, stage, vacuumed, superseded_by from d",
    "paths_of": f"with {_BASE} select docid, count(*) paths, min(relpath) first_path from p group by 1",
    "change_classify": f"""
with {_BASE}, j as (
  select f.*, p.docid old, p.mtime om, p.size os, p.docid in (select docid from done) old_done, f.docid in (select docid from done) is_done,
    row_number() over (partition by f.docid order by f.relpath) rn from f left join p using (relpath)), k as (
  select *, case when mtime = om and size = os and coalesce(old_done, false) then 'unchanged' when docid = old and is_done then 'touched'
    when is_done or rn > 1 then 'duplicate' when old is not null and old <> docid then 'changed' else 'new' end kind from j)
select relpath, kind, case when old <> docid and kind <> 'unchanged' then old end replaces from k""",
    "fast_skip": f"""
with {_BASE}, s as (select exists (select 1 from p where p.relpath = f.relpath and p.mtime = f.mtime and p.size = f.size and p.docid in (select docid from done)) same from f)
select count(*) filter (same) skipped, count(*) filter (not same) "read" from s""",
    "path_upsert": f"with {_BASE} select relpath, mtime, size, docid from f union all select relpath, mtime, size, docid from p where relpath not in (select relpath from f)",
    "doc_insert_ignore": f"with {_BASE} select docid, bytes from d union all select docid, max(size) from f where docid not in (select docid from d) group by 1",
    "stage_update": f"with {_BASE}, g as (select doc_id from chunk_triples group by 1 having bool_and(not extraction_failed)) select docid, case when docid in (select doc_id from g) then 6 else stage end stage from d",
    "forget_docs": f"""
with {_BASE}, o as (select docid from d where superseded_by is not null and vacuumed = 0)
select 'doc' tab, count(*) "rows" from d union all select 'path', count(*) from p where docid not in (select docid from o)
union all select 'chunk', count(*) from c where docid is null or docid not in (select docid from o)
union all select 'vacuumed', count(*) from d where vacuumed = 1 or docid in (select docid from o)""",
    "verify_files": f"""
with {_BASE}, k as (select p.relpath, p.docid from p join d using (docid)), fs as (select relpath, case when size % 10 <> 2 then docid end h from f where size % 10 <> 9),
j as (select k.docid, fs.relpath fr, h from k full join fs using (relpath))
select case when docid is null then 'unknown' when fr is null then 'missing' when h is null then 'unreadable' when h = docid then 'ok' else 'drifted' end status, count(*) files from j group by 1""",
    "content_dedup": "select sha256(text) content, min(doc_id) doc_id, count(*) places from documents where text is not null group by 1",
    "chunk_key_lookup": f"with {_BASE} select veckey, chunkid from c where veckey in (select id from upsert_req)",
}
