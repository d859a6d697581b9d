"""The engine as an object: retrieve, graph, content, provenance and llm over one database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.model import Options
from weft.operators.store import Store
from weft.plans import maintain, sparql
from weft.plans.ingest import Providers, ingest
from weft.plans.providers import ANSWER_PROMPT, extract
from weft.plans.search import Retrieval, search, verify_sources


class _Graph:
    def __init__(self, engine: Engine):
        self._e = engine

    def about(self, ids: DataFrame) -> DataFrame:
        return self._e.retrieve.about(ids)

    def neighbors(self, seeds: DataFrame, hops: int = 1) -> DataFrame:
        return self._e.retrieve.neighbors(seeds, hops)

    def triples(self) -> DataFrame:
        return maintain.triples(self._e.store)

    def sparql(self, text: str) -> DataFrame:
        return sparql.run(self.triples(), text, self._e.retrieve.word_search())

    def update(self, text: str) -> dict:
        return maintain.graph_update(self._e.spark, Options(db=self._e.db, query=text))


class _Content:
    def __init__(self, engine: Engine):
        self._e = engine

    def text(self, ids: DataFrame) -> DataFrame:
        return self._e.store.read("chunk").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "text")


class _Provenance:
    def __init__(self, engine: Engine):
        self._e = engine

    def verify(self, sources: list[dict]) -> list[dict]:
        """sources: n, docid, path."""
        return verify_sources(self._e.spark, self._e.store, sources)


class _Model:
    def __init__(self, engine: Engine):
        self._e = engine

    def extract(self, text: str) -> dict | None:
        return extract(self._e.providers.llm, text)

    def synthesize(self, question: str, context: str) -> str | None:
        return self._e.providers.llm.chat(ANSWER_PROMPT, f"{question}\n\n{context}", 0.7, 1024)


class Engine:
    def __init__(self, spark: SparkSession, db: str, providers: Providers | None = None, include_superseded: bool = False):
        self.spark, self.db, self.providers = spark, db, providers or Providers.default()
        self.store = Store(spark, db)
        self.include_superseded = include_superseded
        self.graph, self.content, self.provenance, self.llm = _Graph(self), _Content(self), _Provenance(self), _Model(self)

    @property
    def retrieve(self) -> Retrieval:
        """vector, keyword, media, fused over the present snapshot."""
        return Retrieval(self.store, self.providers, self.include_superseded)

    def ingest(self, root: str, **options) -> dict:
        return ingest(self.spark, Options(db=self.db, root=root, **options), self.providers)

    def search(self, question: str, **options) -> dict:
        return search(self.spark, Options(db=self.db, query=question, **options), self.providers)

    def status(self) -> dict:
        return maintain.status(self.spark, Options(db=self.db))

    def vacuum(self) -> dict:
        return maintain.vacuum(self.spark, Options(db=self.db))
