"""Ingest: files of a tree become documents, chunks, vectors, postings and graph rows of one new snapshot.

Only files whose path, time or size changed are read; of these only unknown
contents are chunked, embedded and extracted. One commit at the end makes all of
it visible, or nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.native import ChunkOptions, chunk_udf, strip_html
from weft.functions.quantize import encoded
from weft.functions.text import rel_slug, slugify
from weft.model import COMMITTED, Options
from weft.operators.keyword import postings
from weft.operators.store import Store
from weft.operators.tables import classify, flagged, upsert
from weft.plans.providers import LLM, Embedder, HashEmbedder, MediaDeriver, MediaEmbedder, RuleLLM, extract
from weft.plans.storage import materialize
from weft.sources.walk import walk, with_content, with_identity

EMBED_BATCH = 16


@dataclass
class Providers:
    embedder: Embedder
    llm: LLM
    media: MediaDeriver | None = None
    media_embedder: MediaEmbedder | None = None

    @classmethod
    def default(cls) -> Providers:
        return cls(HashEmbedder(), RuleLLM())


def texts_of(files: DataFrame, media: MediaDeriver | None) -> DataFrame:
    """docid, mime, modality, text of the files' contents; media without a deriver have the text null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content, mime, modality in zip(batch["content"], batch["mime"], batch["modality"]):
                if content is None:
                    texts.append(None)
                elif modality != "text":
                    texts.append(media.derive(content, mime, modality) if media else None)
                else:
                    text = bytes(content).decode("utf-8", "replace")
                    texts.append(strip_html(text) if mime == "text/html" else text)
            yield batch[["docid", "mime", "modality"]].assign(text=texts)

    source = with_content(files.select("docid", "abspath", "mime", "modality"))
    return source.mapInPandas(read, "docid string, mime string, modality string, text string")


def chunks_of(texts: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """chunk_id, docid, ordinal, byte_start, byte_end, modality, text of all texts."""
    mime = F.when(F.col("modality") == "text", F.col("mime")).otherwise("text/plain")
    exploded = texts.where("text is not null").select("docid", F.explode(chunk_udf(options)("text", mime)).alias("c"))
    return exploded.select(
        F.format_string("%s:%04d", "docid", "c.ordinal").alias("chunk_id"), "docid", "c.ordinal", "c.byte_start", "c.byte_end",
        F.lit("text").alias("modality"), "c.text",
    )


def embed(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunk_id, docid, modality, embedding; fails if the embedder leaves one out or changes its dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, vectors = batch["text"].tolist(), []
            for i in range(0, len(texts), EMBED_BATCH):
                got = embedder.embed(texts[i : i + EMBED_BATCH])
                if len(got) != len(texts[i : i + EMBED_BATCH]) or any(len(v) != embedder.dim for v in got):
                    raise ValueError("the embedder gave too few vectors or some of another dimension")
                vectors.extend(got)
            yield batch[["chunk_id", "docid", "modality"]].assign(embedding=vectors)

    return chunks.select("chunk_id", "docid", "modality", "text").mapInPandas(
        run, "chunk_id string, docid string, modality string, embedding array<float>"
    )


def media_vectors(files: DataFrame, embedder: MediaEmbedder) -> DataFrame:
    """One vector per image or sound, under ordinal 0 of its document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [None if c is None else embedder.embed_media(bytes(c), m) for c, m in zip(batch["content"], batch["mime"])]
            rows = batch[["docid", "modality"]].assign(embedding=got)
            rows.insert(0, "chunk_id", rows["docid"] + ":0000")
            yield rows[[v is not None for v in got]]

    source = with_content(files.where("modality <> 'text'").select("docid", "abspath", "mime", "modality").dropDuplicates(["docid"]))
    return source.mapInPandas(run, "chunk_id string, docid string, modality string, embedding array<float>")


EXTRACTED = (
    "chunk_id string, summary string, extraction_failed boolean, tags array<string>, entities array<struct<name:string,type:string>>, "
    "relations array<struct<subject:string,predicate:string,object:string,confidence:double>>"
)


def extracted(chunks: DataFrame, llm: LLM) -> DataFrame:
    """What the model finds in each chunk; a failure marks the chunk and stops nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, text in zip(batch["chunk_id"], batch["text"]):
                found = extract(llm, text)
                e = found or {"summary": "", "tags": [], "entities": [], "relations": []}
                rows.append((chunk, e["summary"], found is None, e["tags"], e["entities"], e["relations"]))
            yield pd.DataFrame(rows, columns=["chunk_id", "summary", "extraction_failed", "tags", "entities", "relations"])

    return chunks.select("chunk_id", "text").mapInPandas(run, EXTRACTED)


def graph_rows(found: DataFrame) -> dict[str, DataFrame]:
    """entity, mention, tagged and relation rows of :func:`extracted`."""
    entity = found.select("chunk_id", F.explode("entities").alias("e")).select(
        "chunk_id", slugify(F.col("e.name")).alias("slug"), F.col("e.name").alias("label"), F.col("e.type").alias("type")
    ).where("slug <> ''")
    tagged = found.select("chunk_id", F.explode("tags").alias("label")).select("chunk_id", slugify(F.col("label")).alias("slug"), "label")
    relation = found.select("chunk_id", F.posexplode("relations").alias("seq", "r")).select(
        "chunk_id", "seq", slugify(F.col("r.subject")).alias("s"), rel_slug(F.col("r.predicate")).alias("p"), slugify(F.col("r.object")).alias("o"),
        "r.confidence",
    )
    return {
        "entity": entity.distinct(), "mention": entity.select("chunk_id", "slug").distinct(), "tagged": tagged.where("slug <> ''").distinct(),
        "relation": relation.where("s <> '' and o <> ''"),
    }


def _whole(store: Store, chunks: DataFrame) -> None:
    """Every new chunk must be in the rows that were written for it, or nothing becomes visible."""
    wanted, got = chunks.count(), chunks.select("chunk_id").join(store.read("chunk").select("chunk_id"), "chunk_id", "left_semi").count()
    if got < wanted:
        raise RuntimeError(f"only {got} of {wanted} chunks were written")


def ingest(
    spark: SparkSession, options: Options, providers: Providers | None = None, only: DataFrame | None = None, files: DataFrame | None = None
) -> dict:
    """Bring the database up to the tree's state; returns counts. ``only`` (relpath): paths read again although time and size are known."""
    providers = providers or Providers.default()
    store = Store(spark, options.db)
    with store:
        store.clean()
        files = files if files is not None else walk(spark, options.root, options.include, options.exclude)
        path, doc = store.read("path"), store.read("doc")
        forced = only.select("relpath").distinct() if only is not None else spark.createDataFrame([], "relpath string")
        # one job walks the tree and sets aside what is known
        files = materialize(flagged(files, path, doc, None if only is None else forced), "ingest-files")
        seen = {r["known"]: r["count"] for r in files.groupBy("known").count().collect()}
        same = seen.get(True, 0)
        if not seen.get(False, 0):
            return {"new": 0, "skipped": same, "superseded": 0, "chunks": 0, "failed": 0}
        others = files.where("not known").drop("known")
        read = materialize(with_identity(others, options.paranoid), "ingest-read").where("docid is not null")
        known = path.join(forced, "relpath", "left_anti").unionByName(path.join(forced, "relpath", "left_semi").withColumn("mtime", F.lit(-1).cast("long")))
        kinds = materialize(classify(read, known, doc), "ingest-kinds")
        counts = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
        report = {
            "new": counts.get("new", 0) + counts.get("changed", 0), "skipped": same + counts.get("unchanged", 0) + counts.get("touched", 0) + counts.get("duplicate", 0),
            "superseded": 0, "chunks": 0, "failed": 0,
        }
        if not kinds.take(1):
            return report  # nothing changed: no provider is started

        work = kinds.where("kind in ('new', 'changed')")
        chunks = materialize(chunks_of(texts_of(work, providers.media)), "ingest-chunks")
        vectors = embed(chunks, providers.embedder)
        meta = store.meta()
        if meta.get("embedding_dim", str(providers.embedder.dim)) != str(providers.embedder.dim):
            raise ValueError(f"the database holds vectors of dimension {meta['embedding_dim']}, the embedder gives {providers.embedder.dim}")
        found = materialize(extracted(chunks, providers.llm), "ingest-extracted")
        posting, chunk_len = postings(chunks)

        now = F.current_timestamp()
        made = work.select(
            "docid", F.col("size").alias("bytes"), "mime", "modality", F.lit(COMMITTED).alias("stage"), now.alias("ingested_at"),
            F.lit(None).cast("string").alias("superseded_by"), F.lit(0).alias("vacuumed"), "tap_hash", "full_hash",
            F.lit(options.paranoid).alias("paranoid"),
        ).dropDuplicates(["docid"])
        # only rows that change are written
        path_rows = kinds.select("relpath", "mtime", "size", "docid")
        live = upsert(path, path_rows, ["relpath"]).select("docid").distinct()
        replaced = kinds.where("replaces is not null").select(F.col("replaces").alias("docid"), F.col("docid").alias("by"))
        replaced = materialize(replaced.join(live, "docid", "left_anti").groupBy("docid").agg(F.min("by").alias("by")), "ingest-replaced")
        # a document that was cleared away before comes back as a new one; a content that some path holds again is superseded no more
        others = doc.join(made, "docid", "left_anti").join(replaced, "docid", "left").join(live.withColumn("_live", F.lit(True)), "docid", "left")
        by = F.when(F.col("_live").isNull(), F.coalesce("by", "superseded_by"))
        changed = others.where(~by.eqNullSafe(F.col("superseded_by"))).withColumn("superseded_by", by).select(*doc.columns)
        doc_rows = made.select(*doc.columns).unionByName(changed)

        # only documents without rows are worked on, so their rows are added and no table is rewritten for them
        full_chunk = chunks.join(found.select("chunk_id", "summary", "extraction_failed"), "chunk_id", "left")
        if providers.media_embedder:
            media = materialize(media_vectors(work, providers.media_embedder), "ingest-media")
            vectors = vectors.unionByName(media)
            raw = media.select("chunk_id", "docid", F.lit(0).alias("ordinal"), "modality")
            full_chunk = full_chunk.unionByName(raw, allowMissingColumns=True)
        bits = int(meta.get("vector_bits", options.vector_bits))
        kept = {"vector": vectors} if bits == 32 else {"vector_code": encoded(vectors, "embedding", bits)}
        added = {"path": path_rows, "doc": doc_rows, "chunk": full_chunk, **kept, "posting": posting, "chunk_len": chunk_len, **graph_rows(found)}
        changes = {"meta": store.meta_table(embedding_dim=str(providers.embedder.dim), root=options.root, vector_bits=str(bits))}
        store.commit(changes, added, check=lambda: _whole(store, chunks))
        report["superseded"] = replaced.count()
        report["chunks"] = chunks.count()
        report["failed"] = found.where("extraction_failed").count()
        return report

