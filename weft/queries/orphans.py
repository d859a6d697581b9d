"""Queries of problem 4: references of chunk, path and doc to rows of doc."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.orphans import Orphans, find_orphans, references
from weft.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> Orphans:
    doc = table(spark, d, "doc")
    refs = (
        references(table(spark, d, "chunk"), "chunk", "chunkid", "docid", "loaded_at", late=True)
        .unionByName(references(table(spark, d, "path"), "path", "relpath", "docid", "loaded_at", late=True))
        .unionByName(references(doc, "doc", "docid", "superseded_by", "loaded_at", late=False))
    )
    return find_orphans(refs, doc, "docid", "loaded_at", F.col("vacuumed") == 1)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).rows.select("tab", "row_key").distinct()


def p4_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).counts


_ROWS = """
with refs as (
  select distinct 'chunk' tab, chunkid row_key, lower(trim(docid)) k, loaded_at from chunk
  union select distinct 'path', relpath, lower(trim(docid)), loaded_at from path
  union select distinct 'doc', docid, lower(trim(superseded_by)), loaded_at from doc
), known as (
  select lower(trim(docid)) k, min(loaded_at) first_at, max(vacuumed) vac from doc where trim(docid) <> '' group by 1
), orphan as (
  select tab, row_key, strftime(refs.loaded_at, '%Y-%m') period,
    case when known.k is null then 'absent' when vac = 1 then 'deleted' else 'late' end reason
  from refs left join known using (k)
  where refs.k <> '' and (known.k is null or vac = 1
    or (tab <> 'doc' and first_at > refs.loaded_at + interval 24 hour))
)"""

QUERIES = {"p4_found": p4_found, "p4_orphan_counts": p4_orphan_counts}
ORACLES = {
    "p4_found": _ROWS + " select distinct tab, row_key from orphan",
    "p4_orphan_counts": _ROWS + " select tab, period, reason, count(*)::bigint orphans from orphan group by all",
}
