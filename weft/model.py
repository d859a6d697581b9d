"""Schemas of the engine's tables and the options of its pipelines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Scheme of all identifiers in the graph.
SCHEME = "kb://"

STAGES = {"new": 0, "derived": 1, "chunked": 2, "embedded": 3, "extracted": 4, "graphed": 5, "committed": 6}
COMMITTED = STAGES["committed"]


_KINDS = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "binary": T.BinaryType(), "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


TABLES: dict[str, T.StructType] = {
    "doc": _schema(
        "docid string, bytes long, mime string, modality string, stage int, ingested_at timestamp, superseded_by string, "
        "vacuumed int, tap_hash string, full_hash string, paranoid boolean"
    ),
    "path": _schema("relpath string, mtime long, size long, docid string"),
    "chunk": _schema(
        "chunk_id string, docid string, ordinal int, byte_start long, byte_end long, modality string, text string, summary string, "
        "extraction_failed boolean"
    ),
    "vector": _schema("chunk_id string, docid string, modality string, embedding array<float>"),
    "vector_code": _schema("chunk_id string, docid string, modality string, code binary"),  # instead of vector, in a database of few bits
    "mention": _schema("chunk_id string, slug string"),
    "entity": _schema("chunk_id string, slug string, label string, type string"),
    "tagged": _schema("chunk_id string, slug string, label string"),
    "relation": _schema("chunk_id string, seq int, s string, p string, o string, confidence double"),
    "posting": _schema("term string, chunk_id string, tf long"),
    "chunk_len": _schema("chunk_id string, dl long"),
    "meta": _schema("key string, value string"),
    # triples that updates state or take back, beside those that follow from the other tables
    "stated": _schema("s string, p string, o string, o_kind string, o_datatype string"),
    "withdrawn": _schema("s string, p string, o string, o_kind string, o_datatype string"),
}

TRIPLE = _schema("s string, p string, o string, o_kind string, o_datatype string")


@dataclass
class Options:
    """Every option of the command line, with its default."""

    db: str = ""
    root: str = ""
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    query: str = ""
    query_file: str = ""
    k: int = 24
    keep: int = 12
    hops: int = 1
    ctx_budget: int = 8192
    paranoid: bool = False
    fix: bool = False
    json: bool = False
    include_superseded: bool = False
    #: Bits that a component of a vector is kept with: 32, or 2 to 4. Set by the first ingest of a database.
    vector_bits: int = 32
