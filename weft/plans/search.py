"""Answering a question: vectors and keywords, fused, expanded over the graph, fitted to a budget, answered, verified."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.native import fit_budget, tap_file
from weft.functions.quantize import estimated
from weft.functions.text import BYTES_PER_TOKEN, cited_numbers
from weft.model import SCHEME, Options
from weft.operators.fusion import fuse, media_to_text
from weft.operators.graph import cards, expand, receipts
from weft.operators.keyword import bm25, keyword_hits, query_terms, ranked
from weft.operators.store import Store
from weft.operators.tables import live
from weft.operators.vectors import nearest
from weft.plans.ingest import Providers
from weft.plans.providers import ANSWER_PROMPT
from weft.plans.sparql import term_of
from weft.plans.storage import materialize
from weft.sources.walk import mime_of_path, modality_of_path


class Retrieval:
    """The search API over a database: vectors, keywords, both fused, the graph around chunks."""

    def __init__(self, store: Store, providers: Providers, include_superseded: bool = False):
        self.store, self.providers, self.spark = store, providers, store.spark
        docs = store.read("doc").where("vacuumed = 0")
        self.docs = docs if include_superseded else live(docs)

    def chunks(self) -> DataFrame:
        return self.store.read("chunk").join(self.docs.select("docid"), "docid", "left_semi")

    def _near(self, vector: list[float], k: int, modality: str) -> DataFrame:
        """chunk_id, score, rank among the vectors of live documents; estimated from codes where the database keeps these."""
        bits = int(self.store.meta().get("vector_bits", 32))
        mine = lambda table: self.store.read(table).where(F.col("modality") == modality).join(self.docs.select("docid"), "docid", "left_semi")
        if bits < 32:
            scored = mine("vector_code").select("chunk_id", estimated("code", vector, bits).alias("score"))
            return ranked(scored.orderBy(F.desc("score"), "chunk_id").limit(k), "score", "chunk_id")
        query = self.spark.createDataFrame([(0, vector)], "query_id int, query array<float>")
        return nearest(query, mine("vector"), "chunk_id", k).select("chunk_id", "score", "rank")

    def vector(self, text: str, k: int, modality: str = "text") -> DataFrame:
        return self._near(self.providers.embedder.embed([text])[0], k, modality)

    def keyword(self, text: str, k: int) -> DataFrame:
        query = self.spark.createDataFrame([(0, text)], "query_id int, query string")
        terms = [r["term"] for r in query_terms(query).collect()]  # at most six
        ids = self.chunks().select("chunk_id")
        live_only = lambda df: df.join(ids, "chunk_id", "left_semi")
        return keyword_hits(live_only(self.store.read("posting")), live_only(self.store.read("chunk_len")), terms, k)

    def media(self, vector: list[float], modality: str, k: int) -> DataFrame:
        """Documents whose raw image or sound is near, as their first text chunk."""
        return media_to_text(self._near(vector, k, modality))

    def fused(self, text: str, k: int, keep: int, media: tuple[list[float], str] | None = None) -> DataFrame:
        legs = {"vector": materialize(self.vector(text, k), "leg"), "keyword": materialize(self.keyword(text, k), "leg")}
        if media:
            legs["media"] = materialize(self.media(*media, k), "leg")
        top = fuse({n: df.select("chunk_id", "rank") for n, df in legs.items()}, keep)
        near = [df.select("chunk_id", "score") for n, df in legs.items() if n != "keyword"]
        cosine = near[0] if len(near) == 1 else near[0].unionByName(near[1])
        return top.join(cosine.groupBy("chunk_id").agg(F.max("score").alias("cosine")), "chunk_id", "left")

    def candidates(self, text: str, k: int) -> DataFrame:
        """All chunks that either leg finds."""
        return self.vector(text, k).select("chunk_id").unionByName(self.keyword(text, k).select("chunk_id")).distinct()

    def word_search(self) -> Callable[[str, bool], DataFrame]:
        """Full-text patterns of the graph language."""
        def find(word: str, beginning: bool) -> DataFrame:
            posting = self.store.read("posting")
            hits = bm25(posting if beginning else posting.where(F.col("term") == word), self.store.read("chunk_len"), [word])
            text = term_of(F.col("text"), F.lit("literal"), F.lit(None).cast("string"))
            return hits.join(self.store.read("chunk").select("chunk_id", "text"), "chunk_id").select(
                F.concat(F.lit(f"<{SCHEME}chunk/"), "chunk_id", F.lit(">")).alias("chunk"), text.alias("text"), "score"
            )

        return find

    def about(self, ids: DataFrame) -> DataFrame:
        return cards(ids, self.store.read("chunk"), self.store.read("path"))

    def neighbors(self, seeds: DataFrame, hops: int, known: DataFrame | None = None) -> DataFrame:
        chunks = self.chunks()
        mention = self.store.read("mention").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        return expand(seeds, mention, chunks, chunks.where("ordinal > 0").count(), hops, known)

    def receipts(self, ids: DataFrame) -> list[str]:
        return [r["receipt"] for r in receipts(ids, self.store.read("relation")).orderBy("chunk_id", "seq").collect()]


def search(spark: SparkSession, options: Options, providers: Providers | None = None) -> dict:
    """query, answer, candidates, sources, verification, relations; answer None if nothing is found."""
    providers = providers or Providers.default()
    store = Store(spark, options.db)
    r = Retrieval(store, providers, options.include_superseded)
    media = None
    if options.query_file:
        options.query, media = question_of(options.query_file, providers)
    top = materialize(r.fused(options.query, options.k, options.keep, media).select("chunk_id", "fused", "cosine"), "search-top")
    # at most ``keep`` and a few hundred rows come to the driver from here on
    best = r.about(top).join(top, "chunk_id").orderBy(F.desc("fused"), "chunk_id").collect()
    if not best:
        return {"query": options.query, "answer": None, "reason": "no candidates"}
    more, relations = [], []
    if options.hops > 0:
        found = r.neighbors(top.select("chunk_id"), options.hops, r.candidates(options.query, options.k))
        more = r.about(found).join(found, "chunk_id").orderBy("distance", F.desc("shared"), "chunk_id").collect()
        relations = r.receipts(top.select("chunk_id"))
    read = [*best, *more]
    kept = fit_budget([len(x["text"].encode()) for x in read], options.ctx_budget * BYTES_PER_TOKEN)
    sources = [{"n": n, "chunk_id": read[i]["chunk_id"], "docid": read[i]["docid"], "path": read[i]["path"], "ordinal": read[i]["ordinal"], "text": read[i]["text"]} for n, i in enumerate(kept, 1)]
    context = "\n".join(f"[{s['n']}] ({s['path']}#{s['ordinal']})\n{s['text']}" for s in sources)
    if relations:
        context += "\nRelations:\n" + "\n".join(relations)
    answer = providers.llm.chat(ANSWER_PROMPT, f"{options.query}\n\n{context}", 0.7, 1024) or ""
    cited = spark.createDataFrame([(answer, len(sources))], "answer string, n int").select(cited_numbers(F.col("answer"), F.col("n")).alias("c")).first()["c"] if sources else []
    verdicts = verify_sources(spark, store, [s for s in sources if s["n"] in set(cited)])
    return {
        "query": options.query, "answer": answer, "candidates": [{"chunk_id": x["chunk_id"], "fused": x["fused"], "cosine": x["cosine"]} for x in best],
        "sources": [{k: s[k] for k in ("n", "chunk_id", "path", "ordinal")} for s in sources], "verification": verdicts, "relations": relations,
    }


def question_of(path: str, providers: Providers) -> tuple[str, tuple[list[float], str] | None]:
    """A file as a question: its text, or what a provider derives from an image or sound, and the vector of the raw media."""
    modality = modality_of_path(path)
    with open(path, "rb") as f:
        content = f.read()
    if modality == "text":
        return content.decode("utf-8", "replace"), None
    mime = mime_of_path(path)
    text = providers.media.derive(content, mime, modality) if providers.media else ""
    vector = providers.media_embedder.embed_media(content, mime) if providers.media_embedder else None
    return text or "", (vector, modality) if vector else None


def verify_sources(spark: SparkSession, store: Store, cited: list[dict]) -> list[dict]:
    """verified, drifted or missing for each cited source, by the kind of hash that its document was stored with."""
    if not cited:
        return []
    root = store.meta().get("root", "")
    ids = spark.createDataFrame([(s["docid"],) for s in cited], "docid string").distinct()
    docs = {r["docid"]: r for r in store.read("doc").join(F.broadcast(ids), "docid").collect()}
    out = []
    for s in cited:
        d = docs[s["docid"]]
        now = tap_file(os.path.join(root, s["path"]), d["paranoid"])
        stored = d["full_hash"] if d["paranoid"] else d["tap_hash"]
        out.append({"n": s["n"], "path": s["path"], "verdict": "missing" if now is None else "verified" if now == stored else "drifted"})
    return out
