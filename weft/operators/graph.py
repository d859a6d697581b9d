"""The knowledge graph: its triples as a view of the typed tables, and the steps that expand a search over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import confidence_text, iri, iso8601, receipt, rel_slug, slugify, ttl_escape
from weft.model import SCHEME
from weft.plans.storage import materialize

ONTOLOGY = f"{SCHEME}ontology#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"

HUB_SHARE, HUB_LEAST = 0.05, 2.0
MAX_COMENTIONS = 200
# the names of classes and predicates below, the scheme and these three numbers are fixed values


# --- triples ---------------------------------------------------------------------------------------------------------


def _triple(s: Column, p: str | Column, o: Column, kind: str = "literal", datatype: str = "string") -> list[Column]:
    return [
        s.alias("s"), (F.lit(ONTOLOGY + p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"), (F.lit(XSD + datatype) if kind == "literal" else F.lit(None).cast("string")).alias("o_datatype"),
    ]


def _a(s: Column, cls: str) -> list[Column]:
    return _triple(s, F.lit(RDF_TYPE), F.lit(ONTOLOGY + cls), "iri")


def _rows(df: DataFrame, *triples: list[Column]) -> DataFrame:
    """One projection per kind of triple: a filter on a predicate folds to false in all others, which then drop out of the plan."""
    return reduce(DataFrame.unionByName, (df.select(*t).where("s is not null and o is not null") for t in triples))


def doc_triples(doc: DataFrame, path: DataFrame, chunk: DataFrame) -> DataFrame:
    """One row per docid, per relpath and per chunk_id."""
    d = iri("doc", F.col("docid"))
    own = _rows(
        doc, _a(d, "Document"), _triple(d, "checksum", F.col("docid")), _triple(d, "bytes", F.col("bytes"), datatype="integer"),
        _triple(d, "mime", F.col("mime")), _triple(d, "ingestedAt", iso8601(F.col("ingested_at")), datatype="dateTime"),
        _triple(d, "supersededBy", iri("doc", F.col("superseded_by")), "iri"),
    )
    at = _rows(path, _triple(d, "locatedAt", F.col("relpath")))
    has = _rows(chunk.where("ordinal > 0"), _triple(d, "hasChunk", iri("chunk", F.col("chunk_id")), "iri"))
    return own.unionByName(at).unionByName(has)


def chunk_triples(chunk: DataFrame) -> DataFrame:
    """chunk: chunk_id (one row each), docid, ordinal, byte_start, byte_end, text, summary, extraction_failed, has_next."""
    c, following = iri("chunk", F.col("chunk_id")), F.format_string("%s:%04d", F.col("docid"), F.col("ordinal") + 1)
    return _rows(
        chunk, _a(c, "Chunk"), _triple(c, "partOf", iri("doc", F.col("docid")), "iri"), _triple(c, "ordinal", F.col("ordinal"), datatype="integer"),
        _triple(c, "byteStart", F.col("byte_start"), datatype="integer"), _triple(c, "byteEnd", F.col("byte_end"), datatype="integer"),
        _triple(c, "text", F.col("text")), _triple(c, "summary", F.when(F.col("summary") != "", F.col("summary"))),
        _triple(c, "extractionFailed", F.when(F.col("extraction_failed"), F.lit("true")), datatype="boolean"),
        _triple(c, "nextChunk", F.when(F.col("has_next"), iri("chunk", following)), "iri"),
    )


def tag_triples(tags: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """tags: chunk_id, label. Labels without a letter or digit are left out. linked: those that chunks link to, if not all."""
    slugs = lambda df: df.withColumn("slug", slugify(F.col("label"))).where("slug <> ''")
    linked, tags = slugs(tags if linked is None else linked), slugs(tags)
    t = iri("tag", F.col("slug"))
    return (
        _rows(linked.select("chunk_id", "slug").distinct(), _triple(iri("chunk", F.col("chunk_id")), "taggedWith", t, "iri"))
        .unionByName(_rows(tags.select("slug").distinct(), _a(t, "Tag")))
        .unionByName(_rows(tags.select("slug", "label").distinct(), _triple(t, "label", F.col("label"))))
    )


def entity_triples(entities: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """entities: chunk_id, name, type. linked: those that chunks mention, if not all."""
    slugs = lambda df: df.withColumn("slug", slugify(F.col("name"))).where("slug <> ''")
    linked, entities = slugs(entities if linked is None else linked), slugs(entities)
    e = iri("entity", F.col("slug"))
    return (
        _rows(linked.select("chunk_id", "slug").distinct(), _triple(iri("chunk", F.col("chunk_id")), "mentions", e, "iri"))
        .unionByName(_rows(entities.select("slug").distinct(), _a(e, "Entity")))
        .unionByName(_rows(entities.select("slug", "name").distinct(), _triple(e, "label", F.col("name"))))
        .unionByName(_rows(entities.select("slug", "type").distinct(), _triple(e, "entityType", F.col("type"))))
    )


def relation_triples(relations: DataFrame, proven: DataFrame | None = None) -> DataFrame:
    """relations: chunk_id, seq (one row each), subject, predicate, object, confidence. The receipt of a relation is named by chunk and number. proven: those with a receipt, if not all."""
    slugs = lambda df: df.withColumns({"ss": slugify(F.col("subject")), "os": slugify(F.col("object"))}).where("ss <> '' and os <> ''")
    r, all_relations = slugs(relations if proven is None else proven), slugs(relations)
    node = F.concat(F.lit("_:rel_"), F.replace(F.col("chunk_id"), F.lit(":"), F.lit("_")), F.lit("_"), F.col("seq").cast("string"))
    s, p, o = iri("entity", F.col("ss")), iri("rel", rel_slug(F.col("predicate"))), iri("entity", F.col("os"))
    return _rows(
        r, _a(node, "Relation"), _triple(node, "subject", s, "iri"), _triple(node, "predicate", p, "iri"), _triple(node, "object", o, "iri"),
        _triple(node, "evidencedBy", iri("chunk", F.col("chunk_id")), "iri"),
        _triple(node, "confidence", confidence_text(F.col("confidence")), datatype="decimal"),
    ).unionByName(_rows(all_relations.select("ss", "predicate", "os").distinct(), _triple(s, p, o, "iri")).distinct())


def triple_view(*parts: DataFrame) -> DataFrame:
    """All parts as one set. Each part is a set already: what rests on a key is stated once, only names and classes are made distinct, and no text is compared."""
    return reduce(DataFrame.unionByName, parts)


def live_tables(doc: DataFrame, **by_document: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tables without superseded documents, decided on ids before any triple is made: doc, and each table with ``docid`` or ``chunk_id``.

    A table with ``chunk_id`` alone follows the table ``chunk_text``, which has both.
    Names and classes of entities and tags, and direct relations, stay as they are
    in a vacuum; only what chunks link to and what proves relations goes.
    """
    old = doc.where("superseded_by is not null").select("docid").distinct()
    chunks = by_document["chunk_text"].join(old, "docid", "left_semi").select("chunk_id").distinct()
    out = {}
    for name, df in by_document.items():
        key, gone = ("docid", old) if "docid" in df.columns else ("chunk_id", chunks)
        out[name] = df.join(gone, key, "left_anti")
    return doc.where("superseded_by is null"), out


def turtle_lines(triples: DataFrame) -> DataFrame:
    """One statement per triple."""
    datatype = F.col("o_datatype")
    literal = F.concat(F.lit('"'), ttl_escape(F.col("o")), F.lit('"'))
    o = (
        F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).when(F.col("o_kind") == "bnode", F.col("o"))
        .when(datatype.isNull() | (datatype == XSD + "string"), literal).otherwise(F.concat(literal, F.lit("^^<"), datatype, F.lit(">")))
    )
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))
    return triples.select(F.concat(s, F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def live_triples(triples: DataFrame) -> DataFrame:
    """Triples without those of superseded documents, of their chunks, and of the receipts that rest on these."""
    of = lambda p, s, o: triples.where(F.col("p") == ONTOLOGY + p).select(F.col("s").alias(s), F.col("o").alias(o)).distinct()
    old = of("supersededBy", "d", "by").select("d").distinct()
    parts = of("partOf", "c", "d").join(old, "d", "left_semi")
    proofs = of("evidencedBy", "r", "c").join(parts.select("c"), "c", "left_semi")
    gone = old.select(F.col("d").alias("s")).unionByName(parts.select(F.col("c").alias("s"))).unionByName(proofs.select(F.col("r").alias("s")))
    return triples.join(gone.distinct(), "s", "left_anti").select(*triples.columns)


# --- search expansion ------------------------------------------------------------------------------------------------


def mentions(entities: DataFrame) -> DataFrame:
    """entities: chunk_id, name -> distinct chunk_id, slug."""
    return entities.select("chunk_id", slugify(F.col("name")).alias("slug")).where("slug <> ''").distinct()


def entity_df(mention: DataFrame) -> DataFrame:
    return mention.groupBy("slug").agg(F.countDistinct("chunk_id").alias("n"))


def hubs(mention: DataFrame, total: int) -> DataFrame:
    """Entities in so many chunks that they say nothing: fewer than 1 / HUB_SHARE of them per entity of a chunk."""
    return entity_df(mention).where(F.col("n") > F.greatest(F.lit(HUB_LEAST), F.lit(HUB_SHARE) * F.lit(float(total))))


def comentions(seeds: DataFrame, mention: DataFrame, total: int) -> DataFrame:
    """chunk_id, shared: chunks that share entities with a seed, hubs aside, and how many. Seeds are not among them."""
    seeds = seeds.select("chunk_id").distinct()
    own = mention.join(seeds, "chunk_id", "left_semi").select("slug").distinct().join(hubs(mention, total), "slug", "left_anti")
    others = mention.join(own, "slug", "left_semi").join(seeds, "chunk_id", "left_anti")
    return others.groupBy("chunk_id").agg(F.countDistinct("slug").alias("shared"))


def siblings(seeds: DataFrame, chunk: DataFrame) -> DataFrame:
    """chunk_id, seed: the chunks before and after a seed in its document."""
    near = chunk.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "docid", F.col("chunk_id").alias("seed"), F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal")
    )
    return chunk.where("ordinal > 0").select("docid", "ordinal", "chunk_id").join(near, ["docid", "ordinal"]).select("chunk_id", "seed").distinct()


def cards(ids: DataFrame, chunk: DataFrame, path: DataFrame) -> DataFrame:
    """chunk_id, docid, ordinal, path, text, summary of chunks that have a document with a path; of several paths the least."""
    ids = ids.select("chunk_id").distinct()
    mine = chunk.join(ids, "chunk_id", "left_semi").select("chunk_id", "docid", "ordinal", "text", "summary").dropDuplicates(["chunk_id"])
    at = path.join(mine.select("docid"), "docid", "left_semi").groupBy("docid").agg(F.min("relpath").alias("path"))
    return mine.where("text is not null").join(at, "docid").select("chunk_id", "docid", "ordinal", "path", "text", "summary")


def receipts(ids: DataFrame, relation: DataFrame) -> DataFrame:
    """chunk_id, seq, receipt: relations that the chunks prove. relation: chunk_id, seq, s, p, o (slugs), confidence."""
    mine = relation.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return mine.select("chunk_id", "seq", receipt(F.col("s"), F.col("p"), F.col("o"), F.col("confidence")).alias("receipt"))


def expand(seeds: DataFrame, mention: DataFrame, chunk: DataFrame, total: int, hops: int = 1, known: DataFrame | None = None) -> DataFrame:
    """chunk_id, distance, shared: what is reached from the seeds in up to ``hops`` steps, without what is ``known``.

    A step goes to the neighbours in the document and to the MAX_COMENTIONS
    chunks that share most entities. One round of joins per hop, each written out.
    """
    seen = seeds.select("chunk_id").distinct()
    if known is not None:
        seen = seen.unionByName(known.select("chunk_id")).distinct()
    front, found = seeds.select("chunk_id").distinct(), None
    for distance in range(1, hops + 1):
        shared = comentions(front, mention, total).join(seen, "chunk_id", "left_anti").orderBy(F.desc("shared"), "chunk_id").limit(MAX_COMENTIONS)
        beside = siblings(front, chunk).select("chunk_id", F.lit(0).cast("long").alias("shared")).join(seen, "chunk_id", "left_anti")
        step = shared.unionByName(beside).groupBy("chunk_id").agg(F.max("shared").alias("shared")).withColumn("distance", F.lit(distance))
        step = materialize(step.select("chunk_id", "distance", "shared"), "expand-hop")
        found = step if found is None else found.unionByName(step)
        seen, front = seen.unionByName(step.select("chunk_id")), step
    return found if found is not None else seeds.select("chunk_id", F.lit(0).alias("distance"), F.lit(0).cast("long").alias("shared")).limit(0)


def first_chunks(df: DataFrame, per: int) -> DataFrame:
    """The first ``per`` chunks of each document."""
    w = Window.partitionBy("docid").orderBy("ordinal", "chunk_id")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per).drop("_rn")
