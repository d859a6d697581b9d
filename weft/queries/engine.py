"""The engine itself over the whole corpus: documents as files of a tree, ingested, changed, verified and vacuumed."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import Options
from weft.operators.store import Store
from weft.operators.tables import live
from weft.plans import maintain
from weft.plans.ingest import ingest
from weft.plans.storage import work_dir
from weft.sources.tables import table
from weft.sources.walk import walk

#: The scenario: documents of this source get another line, files of that source are deleted.
CHANGED, DELETED = "notes", "tickets"
LINE = "\nOne more line at the end.\n"


def _folder(spark: SparkSession) -> str:
    """A new folder that executors can open as files."""
    at = work_dir(spark)
    if re.match(r"[a-z0-9]+://", at) and not at.startswith("file://"):
        raise ValueError("a tree of files needs a shared folder that is mounted")
    return f"{re.sub(r'^file:/*', '/', at)}/weft/tree-{uuid.uuid4().hex}"


def _write(docs: DataFrame, root: str, text) -> int:
    """One file per document with a text, named by source and id; returns how many."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, key, said in zip(batch["source"], batch["doc_id"], batch["text"]):
                os.makedirs(f"{root}/{source}", exist_ok=True)
                with open(f"{root}/{source}/{key}.txt", "wb") as f:
                    f.write(said.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"n": [len(batch)]})

    written = docs.where("text is not null and source is not null").select("source", "doc_id", text.alias("text")).mapInPandas(write, "n long")
    return written.agg(F.sum("n")).first()[0] or 0


def engine_walk(spark: SparkSession, d: str) -> DataFrame:
    """Path, size, mime and modality of every file that the walk admits."""
    root = _folder(spark)
    os.makedirs(root)
    _write(table(spark, d, "documents"), root, F.col("text"))
    return walk(spark, root).select("relpath", "size", "mime", "modality")


def engine_life(spark: SparkSession, d: str) -> DataFrame:
    """What a database says of itself at five moments: step, docs, superseded, paths, bytes that its live documents' chunks cover, and what the step did.

    1 first ingest (files read), 2 unchanged (files skipped), 3 after changes and deletions (documents superseded),
    4 verified (files missing), 5 vacuumed (documents cleared).
    """
    docs, root = table(spark, d, "documents"), _folder(spark)
    os.makedirs(root)
    o = Options(db=f"{root}-db", root=root)
    _write(docs, root, F.col("text"))
    rows = []

    def note(step: int, done: int) -> None:
        store = Store(spark, o.db)
        status = maintain.status(spark, o)
        covered = store.read("chunk").join(live(store.read("doc")).select("docid"), "docid", "left_semi").agg(F.sum(F.col("byte_end") - F.col("byte_start"))).first()[0]
        rows.append((step, status["docs"], status["superseded"], store.read("path").count(), covered or 0, done))

    note(1, ingest(spark, o)["new"])
    note(2, ingest(spark, o)["skipped"])
    _write(docs.where(F.col("source") == CHANGED), root, F.concat("text", F.lit(LINE)))
    shutil.rmtree(f"{root}/{DELETED}", ignore_errors=True)
    note(3, ingest(spark, o)["superseded"])
    note(4, maintain.verify(spark, o)["missing"])
    note(5, maintain.vacuum(spark, o)["vacuumed"])
    return spark.createDataFrame(rows, "step int, docs long, superseded long, paths long, bytes long, done long")


QUERIES = {f.__name__: f for f in (engine_walk, engine_life)}
_FILES = "f as (select doc_id, source, text, octet_length(encode(text))::bigint n from documents where text is not null and source is not null and not contains(text, chr(0)))"
ORACLES = {
    "engine_walk": f"with {_FILES} select source || '/' || doc_id || '.txt' relpath, n size, 'text/plain' mime, 'text' modality from f",
    "engine_life": f"""
with {_FILES}, old as (select distinct text, n from f),
now as (select source, case when source = '{CHANGED}' then text || '{LINE}' else text end text from f),
kept as (select distinct text, octet_length(encode(text))::bigint n from now), gone as (select text from old except select text from kept),
every as (select text from old union select text from kept)
select 1::int step, (select count(*) from old) docs, 0::bigint superseded, (select count(*) from f) paths, (select sum(n)::bigint from old) bytes, (select count(*) from old) done
union all select 2, (select count(*) from old), 0, (select count(*) from f), (select sum(n)::bigint from old), (select count(*) from f)
union all select 3, (select count(*) from kept), (select count(*) from gone), (select count(*) from f), (select sum(n)::bigint from kept), (select count(*) from gone)
union all select 4, (select count(*) from kept), (select count(*) from gone), (select count(*) from f), (select sum(n)::bigint from kept), (select count(*) from f where source = '{DELETED}')
union all select 5, (select count(*) from kept), 0, (select count(*) from f), (select sum(n)::bigint from kept), (select count(*) from gone)""",
}
