"""Maintenance: status, verify, vacuum, and graph queries over a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import Options
from weft.operators import graph
from weft.operators.store import Store
from weft.operators.tables import forget, scoreboard, superseded
from weft.plans import sparql
from weft.plans.ingest import Providers, ingest
from weft.plans.search import Retrieval
from weft.plans.storage import materialize
from weft.sources.turtle import read_turtle, write_turtle
from weft.sources.walk import walk, with_identity


def status(spark: SparkSession, options: Options) -> dict:
    store = Store(spark, options.db)
    row = scoreboard(store.read("doc"), store.read("chunk")).first()
    return {**row.asDict(), "version": store.version, **{k: v for k, v in store.meta().items()}}


def compared(files: DataFrame, path: DataFrame, doc: DataFrame) -> DataFrame:
    """relpath, status: ok, drifted, missing, unreadable or unknown, from a full outer join of files and known paths.

    files: relpath, tap_hash, full_hash. Each document is compared by the kind of hash it was stored with.
    """
    known = path.join(doc.select("docid", F.col("tap_hash").alias("_tap"), F.col("full_hash").alias("_full"), "paranoid"), "docid")
    j = known.select("relpath", "docid", "_tap", "_full", "paranoid").join(files.withColumn("_there", F.lit(True)), "relpath", "full_outer")
    now = F.when(F.col("paranoid"), F.col("full_hash")).otherwise(F.col("tap_hash"))
    stored = F.when(F.col("paranoid"), F.col("_full")).otherwise(F.col("_tap"))
    return j.select(
        "relpath",
        F.when(F.col("docid").isNull(), "unknown").when(F.col("_there").isNull(), "missing").when(now.isNull(), "unreadable")
        .when(now == stored, "ok").otherwise("drifted").alias("status"),
    )


def verify(spark: SparkSession, options: Options, providers: Providers | None = None) -> dict:
    """Counts by status; with ``fix`` the drifted files are ingested again, whatever their time and size."""
    store = Store(spark, options.db)
    root = options.root or store.meta().get("root", "")
    doc = store.read("doc")
    full = options.paranoid or doc.where("paranoid").limit(1).count() > 0
    files = with_identity(walk(spark, root, options.include, options.exclude), full).select("relpath", "tap_hash", "full_hash")
    found = compared(files, store.read("path"), doc)
    counts = {s: 0 for s in ("ok", "drifted", "missing", "unreadable", "unknown")} | {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
    if options.fix and counts["drifted"]:
        options.root = root
        counts["fixed"] = ingest(spark, options, providers, only=materialize(found.where("status = 'drifted'").select("relpath"), "drifted"))["new"]
    return counts


def vacuum(spark: SparkSession, options: Options) -> dict:
    """Superseded documents lose their paths, chunks, vectors, postings and graph rows; their document rows stay, marked."""
    store = Store(spark, options.db)
    with store:
        doc, path, chunk = store.read("doc"), store.read("path"), store.read("chunk")
        ids = superseded(doc).select("docid")
        count = ids.count()
        if count:
            new_doc, new_path, new_chunk = forget(doc, path, chunk, ids)
            gone = chunk.join(ids, "docid", "left_semi").select("chunk_id")
            rest = {t: store.read(t).join(gone, "chunk_id", "left_anti") for t in ("vector", "vector_code", "mention", "entity", "tagged", "relation", "posting", "chunk_len")}
            store.commit({"doc": new_doc, "path": new_path, "chunk": new_chunk, **rest})  # each table is one folder again
        return {"vacuumed": count, "folders": store.clean()}


def triples(store: Store) -> DataFrame:
    """The graph of a database as a view of its tables."""
    chunk = store.read("chunk")
    following = chunk.select("docid", (F.col("ordinal") - 1).alias("ordinal"), F.lit(True).alias("has_next")).where("ordinal > 0")
    chunk = chunk.join(following, ["docid", "ordinal"], "left")
    entity = store.read("entity").select("chunk_id", F.col("label").alias("name"), "type")
    relation = store.read("relation").select("chunk_id", "seq", F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "confidence")
    derived = graph.triple_view(
        graph.doc_triples(store.read("doc").where("vacuumed = 0"), store.read("path"), chunk), graph.chunk_triples(chunk),
        graph.tag_triples(store.read("tagged")), graph.entity_triples(entity), graph.relation_triples(relation),
    )
    if store.parts("withdrawn"):
        derived = sparql.minus(derived, store.read("withdrawn"))
    return derived.unionByName(store.read("stated")) if store.parts("stated") else derived


def graph_update(spark: SparkSession, options: Options) -> dict:
    """Commits an update of the graph: what it states or takes back is kept beside the tables that triples follow from."""
    store = Store(spark, options.db)
    with store:
        now = triples(store)
        form, change = sparql.change_of(now, options.query)
        change = materialize(change, "graph-change")
        key = sparql.TRIPLE_KEY
        there = materialize(change.intersect(now.select(*key)), "graph-there")
        new = there if form == "delete" else materialize(sparql.minus(change, there), "graph-new")
        count = new.count()
        if count:
            stated, withdrawn = store.read("stated"), store.read("withdrawn")
            if form == "insert":
                back = materialize(new.intersect(withdrawn), "graph-back")  # taken back before: follows again
                store.commit({"stated": stated.unionByName(sparql.minus(new, back)), "withdrawn": sparql.minus(withdrawn, back)})
            else:
                own = materialize(new.intersect(stated), "graph-own")
                store.commit({"stated": sparql.minus(stated, own), "withdrawn": withdrawn.unionByName(sparql.minus(new, own)).distinct()})
        return {form: count}


def graph_load(spark: SparkSession, options: Options, path: str) -> dict:
    """Adds the statements of a Turtle file that the graph does not hold yet."""
    store = Store(spark, options.db)
    with store:
        new = materialize(sparql.minus(read_turtle(spark, path).distinct(), triples(store).select(*sparql.TRIPLE_KEY)), "graph-loaded")
        count = new.count()
        if count:
            store.commit({}, {"stated": new})
        return {"loaded": count}


def graph_export(spark: SparkSession, options: Options, path: str) -> dict:
    """Writes the graph as a folder of text, one statement per line."""
    write_turtle(triples(Store(spark, options.db)), path)
    return {"exported": path}


def graph_query(spark: SparkSession, options: Options) -> DataFrame:
    store = Store(spark, options.db)
    words = Retrieval(store, Providers.default(), include_superseded=True).word_search()
    return sparql.run(triples(store), options.query, words)
