"""Changes to keyed tables as joins: each takes the old and the new rows and gives the rows of the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.model import COMMITTED


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; the window group limit drops the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; new keys must be unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti"))


def set_stage(doc: DataFrame, ids: DataFrame, stage: int) -> DataFrame:
    """ids: docid."""
    hit = doc.join(ids.select("docid", F.lit(True).alias("_hit")).distinct(), "docid", "left")
    return hit.withColumn("stage", F.when(F.col("_hit"), F.lit(stage)).otherwise(F.col("stage"))).select(*doc.columns)


def supersede(doc: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: docid, by. A document superseded in several ways takes the least successor."""
    by = pairs.groupBy("docid").agg(F.min("by").alias("_by"))
    return doc.join(by, "docid", "left").withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*doc.columns)


def forget(doc: DataFrame, path: DataFrame, chunk: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of ``ids`` lose their chunks and paths and are marked; their rows stay."""
    gone = ids.select("docid").distinct()
    marked = doc.join(gone.withColumn("_gone", F.lit(1)), "docid", "left").withColumn("vacuumed", F.coalesce("_gone", "vacuumed"))
    return marked.select(*doc.columns), path.join(gone, "docid", "left_anti").select(*path.columns), chunk.join(gone, "docid", "left_anti").select(*chunk.columns)


def live(doc: DataFrame) -> DataFrame:
    return doc.where("superseded_by is null and vacuumed = 0")


def superseded(doc: DataFrame) -> DataFrame:
    return doc.where("superseded_by is not null and vacuumed = 0")


def scoreboard(doc: DataFrame, chunk: DataFrame) -> DataFrame:
    """docs, chunks, superseded in one row."""
    is_live = F.col("superseded_by").isNull() & (F.col("vacuumed") == 0)
    docs = doc.agg(
        F.count(F.when(is_live, 1)).alias("docs"),
        F.count(F.when(F.col("superseded_by").isNotNull() & (F.col("vacuumed") == 0), 1)).alias("superseded"),
    )
    return docs.crossJoin(chunk.agg(F.count(F.lit(1)).alias("chunks")))  # one row each


def classify(files: DataFrame, path: DataFrame, doc: DataFrame) -> DataFrame:
    """What a run does with each file: unchanged, touched, duplicate, changed or new.

    files: relpath, mtime, size, docid (null for a file whose content was not
    read because path, time and size are known). Of several new files of one
    content the first path is the work, the others are duplicates. ``replaces``
    is the document that a changed path held.
    """
    known = path.select("relpath", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("docid").alias("_old"))
    done = doc.where((F.col("stage") >= COMMITTED) & (F.col("vacuumed") == 0)).select(F.col("docid").alias("_done"), F.lit(True).alias("_is_done")).distinct()
    old_done = done.select(F.col("_done").alias("_old"), F.col("_is_done").alias("_old_done"))
    # one row per content, aggregated where the files lie: a content may have any number of copies
    first = files.where("docid is not null").groupBy("docid").agg(F.min("relpath").alias("_first"))
    first = first.join(done, first.docid == F.col("_done"), "left").drop("_done")
    j = files.join(known, "relpath", "left").join(old_done, "_old", "left").join(first, "docid", "left")
    same = (F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size"))
    kind = (
        F.when(same & F.coalesce("_old_done", F.lit(False)), "unchanged")
        .when((F.col("docid") == F.col("_old")) & F.coalesce("_is_done", F.lit(False)), "touched")
        .when(F.coalesce("_is_done", F.lit(False)) | (F.col("_first") < F.col("relpath")), "duplicate")
        .when(F.col("_old").isNotNull() & (F.col("_old") != F.col("docid")), "changed")
        .otherwise("new")
    )
    changed = F.col("_old").isNotNull() & (F.col("_old") != F.col("docid"))
    return j.withColumn("kind", kind).select(*files.columns, "kind", F.when(changed & (F.col("kind") != "unchanged"), F.col("_old")).alias("replaces"))


def flagged(files: DataFrame, path: DataFrame, doc: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """files and ``known``: whether path, time and size are known and the document is done, and the path is none of ``forced``; others are read."""
    done = doc.where((F.col("stage") >= COMMITTED) & (F.col("vacuumed") == 0)).select("docid").distinct()
    same = path.join(done, "docid", "left_semi").select("relpath", "mtime", "size", F.lit(True).alias("known"))
    if forced is not None:
        same = same.join(forced.select("relpath"), "relpath", "left_anti")
    out = files.join(same, ["relpath", "mtime", "size"], "left")
    return out.select(*files.columns, F.coalesce("known", F.lit(False)).alias("known"))


def unread(files: DataFrame, path: DataFrame, doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose path, time and size are known and whose document is done, all others): only the others are read."""
    found = flagged(files, path, doc)
    return found.where("known").drop("known"), found.where("not known").drop("known")
