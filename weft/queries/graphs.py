"""The knowledge graph over whole tables: triples, expansion steps, and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import iri_tail, rel_slug, slugify
from weft.operators import graph as G
from weft.operators.fusion import budgeted
from weft.operators.keyword import bm25, keyword_hits, keyword_hits_many, postings
from weft.plans import sparql
from weft.plans.storage import materialize
from weft.queries.manifest import _BASE, _chunk, _doc, _path
from weft.queries.scalars import _STOPS, _sql_rel, _sql_slug
from weft.sources.tables import table

TERMS = ["measurement", "pipeline", "harbour"]
SEEDS = 12


def _texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chunk_triples").dropDuplicates(["chunk_id"])
    return t.select("chunk_id", F.col("doc_id").alias("docid"), "ordinal", "byte_start", "byte_end", "text", "summary", "extraction_failed", "has_next", "tags")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_ref").select("chunk_id", "name", "type").distinct()


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relation_ref").select("chunk_id", "seq", "subject", F.coalesce("predicate", F.lit("")).alias("predicate"), "object", "confidence").dropDuplicates(["chunk_id", "seq"])


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = _texts(spark, d)
    return {
        "path": _path(spark, d), "chunk": _chunk(spark, d).where("docid is not null").select(F.col("chunkid").alias("chunk_id"), "docid", "ordinal"), "chunk_text": t,
        "tag": t.select("chunk_id", F.explode("tags").alias("label")), "entity": _entities(spark, d), "relation": _relations(spark, d),
    }


def _view(doc: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    return G.triple_view(
        G.doc_triples(doc, t["path"], t["chunk"]), G.chunk_triples(t["chunk_text"]), G.tag_triples(t["tag"]), G.entity_triples(t["entity"]),
        G.relation_triples(t["relation"]),
    )


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return _view(_doc(spark, d).where("vacuumed = 0"), _tables(spark, d))


def triples_by_predicate(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d).where(F.col("p").startswith(G.ONTOLOGY) | (F.col("p") == G.RDF_TYPE))
    return t.groupBy("p").agg(F.count(F.lit(1)).alias("triples"))


def triples_written(spark: SparkSession, d: str) -> DataFrame:
    """Every triple as a line of text."""
    return G.turtle_lines(_triples(spark, d))


def vacuum_live(spark: SparkSession, d: str) -> DataFrame:
    """Triples that are left without superseded documents, by predicate: what rests on their chunks goes with them."""
    t = _tables(spark, d)
    doc, live = G.live_tables(_doc(spark, d).where("vacuumed = 0"), **t)
    left = G.triple_view(
        G.doc_triples(doc, live["path"], live["chunk"]), G.chunk_triples(live["chunk_text"]), G.tag_triples(t["tag"], live["tag"]),
        G.entity_triples(t["entity"], live["entity"]), G.relation_triples(t["relation"], live["relation"]),
    )
    return left.where(F.col("p").startswith(G.ONTOLOGY)).groupBy("p").agg(F.count(F.lit(1)).alias("triples"))


def graph_vacuum(spark: SparkSession, d: str) -> DataFrame:
    """The same on the triples alone, as for a graph that has no tables: the three tests, and what is left of the nodes, by predicate."""
    t = materialize(_triples(spark, d), "triples")
    left = G.live_triples(t).where(F.col("p").isin([G.ONTOLOGY + x for x in ("checksum", "partOf", "text", "mentions", "evidencedBy", "locatedAt")]))
    return left.groupBy("p").agg(F.count(F.lit(1)).alias("triples"))


def entity_df(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_df(G.mentions(_entities(spark, d)))


def hub_entities(spark: SparkSession, d: str) -> DataFrame:
    total = _texts(spark, d).where("ordinal > 0").count()
    return G.hubs(G.mentions(_entities(spark, d)), total)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that a keyword search finds first."""
    posting, lengths = postings(_texts(spark, d), begins=TERMS)
    hits = keyword_hits(materialize(posting, "postings"), materialize(lengths, "lengths"), TERMS, SEEDS)
    return materialize(hits.where(F.col("rank") <= SEEDS).select("chunk_id"), "seeds")


def comention(spark: SparkSession, d: str) -> DataFrame:
    total = _texts(spark, d).where("ordinal > 0").count()
    return G.comentions(_seeds(spark, d), materialize(G.mentions(_entities(spark, d)), "mentions"), total)


def siblings(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every chunk."""
    t = _texts(spark, d)
    return G.siblings(t, t)


def candidate_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all chunks that have a document with a path."""
    t = _texts(spark, d)
    return G.cards(t, t, _path(spark, d)).select("chunk_id", "docid", "ordinal", "path", F.md5("text").alias("text"), "summary")


def relation_receipts(spark: SparkSession, d: str) -> DataFrame:
    r = _relations(spark, d).where("object is not null and confidence is not null").select(
        "chunk_id", "seq", slugify(F.col("subject")).alias("s"), rel_slug(F.col("predicate")).alias("p"), slugify(F.col("object")).alias("o"), "confidence"
    )
    return G.receipts(_seeds(spark, d), r)


def graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    """What the found chunks lead to in two hops."""
    t = _texts(spark, d)
    total = t.where("ordinal > 0").count()
    return G.expand(_seeds(spark, d), materialize(G.mentions(_entities(spark, d)), "mentions"), t, total, hops=2)


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """For the gloss of every canonical entry as a question: the found chunks that fit a context of 1024 tokens."""
    t = _texts(spark, d)
    posting, lengths = postings(t)
    questions = table(spark, d, "canon").select(F.col("canon_id").alias("query_id"), F.col("gloss").alias("query"))
    hits = keyword_hits_many(materialize(posting, "postings"), materialize(lengths, "lengths"), questions, 24)
    return budgeted(hits.join(t.select("chunk_id", F.octet_length("text").alias("size")), "chunk_id"), 1024 * 4)


def _sparql(text: str, kinds: dict[str, str] | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        def words(word: str, beginning: bool) -> DataFrame:
            posting, lengths = postings(_texts(spark, d), begins=[word])
            hits = bm25(posting if beginning else posting.where(F.col("term") == word), lengths, [word])
            said = sparql.term_of(F.col("text"), F.lit("literal"), F.lit(None).cast("string"))
            return hits.join(_texts(spark, d).select("chunk_id", "text"), "chunk_id").select(
                F.concat(F.lit("<kb://chunk/"), "chunk_id", F.lit(">")).alias("chunk"), said.alias("text"), "score"
            )

        out = sparql.run(_triples(spark, d), "PREFIX ch: <kb://ontology#> " + text, words)
        said = lambda c: F.round(F.col(c).cast("double"), 6) if kinds[c] == "double" and c.startswith("ql_score") else F.col(c).cast(kinds[c])
        return out.select(*[said(c).alias(c) if kinds and c in kinds else F.col(c) for c in out.columns])

    return run


_SPARQL = {
    "sparql_bgp": (
        "SELECT ?chunk ?path WHERE { ?chunk a ch:Chunk ; ch:partOf ?doc . ?doc ch:locatedAt ?path }", None,
        f"with {_BASE} select distinct 'kb://chunk/' || chunk_id chunk, relpath path from chunk_triples t join p on p.docid = t.doc_id",
    ),
    "sparql_optional": (
        "SELECT ?chunk ?next WHERE { ?chunk a ch:Chunk . OPTIONAL { ?chunk ch:nextChunk ?next } }", None,
        "select distinct 'kb://chunk/' || chunk_id chunk, case when has_next then 'kb://chunk/' || doc_id || ':' || format('{:04d}', ordinal + 1) end \"next\" from chunk_triples",
    ),
    "sparql_not_exists": (
        "SELECT ?chunk WHERE { ?chunk a ch:Chunk . FILTER NOT EXISTS { ?chunk ch:mentions ?e } }", None,
        f"select distinct 'kb://chunk/' || chunk_id chunk from chunk_triples where chunk_id not in (select chunk_id from entity_ref where {_sql_slug('name')} <> '')",
    ),
    "sparql_group_count": (
        "SELECT ?ent (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c ch:mentions ?ent } GROUP BY ?ent", {"n": "long"},
        f"select 'kb://entity/' || {_sql_slug('name')} ent, count(distinct chunk_id) n from entity_ref where {_sql_slug('name')} <> '' group by 1",
    ),
    "sparql_values_filter": (
        'SELECT ?c ?e WHERE { VALUES ?e { <kb://entity/aldermoor-archive> <kb://entity/solar-policy> } ?c ch:mentions ?e ; ch:ordinal ?o . FILTER(?o >= 2 && ?e != <kb://entity/none>) }',
        None,
        f"select distinct 'kb://chunk/' || e.chunk_id c, 'kb://entity/' || {_sql_slug('name')} e from entity_ref e join chunk_triples t using (chunk_id) where {_sql_slug('name')} in ('aldermoor-archive', 'solar-policy') and t.ordinal >= 2",
    ),
    "sparql_union_minus": (
        'SELECT DISTINCT ?s WHERE { { ?s ch:entityType "person" } UNION { ?s ch:entityType "org" } MINUS { ?s ch:entityType "place" } }', None,
        f"""
with e as (select distinct {_sql_slug('name')} s, type from entity_ref where {_sql_slug('name')} <> '')
select distinct 'kb://entity/' || s s from e where type in ('person', 'org') and s not in (select s from e where type = 'place')""",
    ),
    "sparql_having_order": (
        "SELECT ?ent (COUNT(?c) AS ?n) WHERE { ?c ch:mentions ?ent } GROUP BY ?ent HAVING (COUNT(?c) >= 5) ORDER BY DESC(?n) ?ent LIMIT 20 OFFSET 3", {"n": "long"},
        f"select 'kb://entity/' || {_sql_slug('name')} ent, count(distinct chunk_id) n from entity_ref where {_sql_slug('name')} <> '' group by 1 having count(distinct chunk_id) >= 5 order by n desc, ent limit 20 offset 3",
    ),
    "sparql_aggregates": (
        "SELECT ?doc (SUM(?b) AS ?bytes) (MIN(?o) AS ?first) (MAX(?o) AS ?last) (AVG(?o) AS ?mean) WHERE { ?c ch:partOf ?doc ; ch:ordinal ?o ; ch:byteStart ?a ; ch:byteEnd ?z . BIND(?z - ?a AS ?b) } GROUP BY ?doc",
        {"bytes": "double", "first": "int", "last": "int", "mean": "double"},
        """
select 'kb://doc/' || doc_id doc, sum(byte_end - byte_start)::double bytes, min(ordinal)::int "first", max(ordinal)::int "last", avg(ordinal)::double mean
from (select distinct chunk_id, doc_id, byte_start, byte_end, ordinal from chunk_triples) where byte_end is not null group by 1""",
    ),
    "sparql_path": (
        "SELECT ?old ?new WHERE { ?old ch:supersededBy+ ?new }", None,
        f"""
with recursive {_BASE.lstrip()}, e as (select docid a, superseded_by b from d where vacuumed = 0 and superseded_by is not null),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select 'kb://doc/' || a "old", 'kb://doc/' || b "new" from r""",
    ),
    "sparql_inverse_sequence": (
        "SELECT DISTINCT ?path ?tag WHERE { ?path ^ch:locatedAt/ch:hasChunk/ch:taggedWith ?tag }", None,
        f"""
with {_BASE}, live as (select docid from d where vacuumed = 0), g as (select distinct chunk_id, {_sql_slug('tag')} tag from (select chunk_id, unnest(tags) tag from chunk_triples))
select distinct relpath path, 'kb://tag/' || tag tag from p join c on c.docid = p.docid and c.ordinal > 0 join g on g.chunk_id = c.chunkid where tag <> ''""",
    ),
    "sparql_construct": (
        "CONSTRUCT { ?a ch:near ?b } WHERE { ?r ch:subject ?a ; ch:object ?b ; ch:evidencedBy ?c . FILTER(?a != ?b) }", None,
        f"""
with r as (select {_sql_slug('subject')} s, {_sql_slug('object')} o from relation_ref where {_sql_slug('subject')} <> '' and {_sql_slug('object')} <> '')
select distinct 'kb://entity/' || s s, 'kb://ontology#near' p, 'kb://entity/' || o o from r where s <> o""",
    ),
    "sparql_ask": ('ASK { ?e ch:label "Aldermoor Archive" }', None, "select count(*) > 0 ask from entity_ref where name = 'Aldermoor Archive'"),
    "sparql_count_star": (
        "SELECT ?type (COUNT(*) AS ?n) WHERE { ?e ch:entityType ?type } GROUP BY ?type", {"n": "long"},
        f"select type, count(distinct {_sql_slug('name')}) n from entity_ref where {_sql_slug('name')} <> '' and type is not null group by 1",
    ),
    "sparql_text_score": (
        'SELECT ?chunk ?ql_score_t_var_text WHERE { ?t ql:contains-word "measur*" . ?t ql:contains-entity ?text . ?chunk ch:text ?text }', {"ql_score_t_var_text": "double"},
        f"""
with t as (select chunk_id, any_value(text) text from chunk_triples group by 1),
tok as (select chunk_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) term from t),
dl as (select chunk_id, count(*) dl from tok group by 1), hit as (select chunk_id, count(*)::double tf from tok where starts_with(term, 'measur') group by 1),
st as (select (select count(*)::double from dl) n, (select avg(dl) from dl) avgdl, (select count(*)::double from hit) df),
score as (select chunk_id, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) score from hit join dl using (chunk_id) cross join st)
select 'kb://chunk/' || y.chunk_id chunk, round(score, 6) ql_score_t_var_text from score join t x using (chunk_id) join t y on y.text = x.text""",
    ),
    "sparql_strings": (
        'SELECT ?e (UCASE(?l) AS ?big) (STRLEN(?l) AS ?n) WHERE { ?e a ch:Entity ; ch:label ?l . FILTER(REGEX(?l, "^lake", "i") || CONTAINS(?l, "River")) }', {"n": "int"},
        f"select e, upper(name) big, length(name)::int n from (select distinct 'kb://entity/' || {_sql_slug('name')} e, name from entity_ref where {_sql_slug('name')} <> '' and (regexp_matches(name, '(?i)^lake') or contains(name, 'River')))",
    ),
    "sparql_text_search": (
        'SELECT ?chunk WHERE { ?t ql:contains-word "measur*" . ?t ql:contains-entity ?text . ?chunk ch:text ?text }', None,
        """
with w as (select chunk_id, text from (select chunk_id, any_value(text) text from chunk_triples group by 1) where regexp_matches(lower(text), '(^|[^a-z0-9])measur'))
select 'kb://chunk/' || y.chunk_id chunk from w x join w y using (text)""",
    ),
}

QUERIES = {
    f.__name__: f
    for f in (
        triples_by_predicate, triples_written, vacuum_live, graph_vacuum, entity_df, hub_entities, comention, siblings, candidate_cards, relation_receipts, graph_expansion, context_budget,
    )
} | {name: _sparql(text, kinds) for name, (text, kinds, _) in _SPARQL.items()}

_M = f"m as (select distinct chunk_id, {_sql_slug('name')} slug from entity_ref where {_sql_slug('name')} <> '')"
_T = "t as (select chunk_id, any_value(doc_id) doc_id, any_value(ordinal) ordinal, any_value(text) text, any_value(summary) summary, bool_or(extraction_failed) failed, bool_or(has_next) has_next from chunk_triples group by 1)"
_SEED = f"""{_T}, {_M},
tok as (select chunk_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) term from t),
posting as (select term, chunk_id, count(*) tf from tok group by 1, 2), dl as (select chunk_id, count(*) dl from tok group by 1),
q as (select unnest([{', '.join(repr(x) for x in TERMS)}]) q),
hit as (select q, chunk_id, sum(tf)::double tf from posting join q on starts_with(term, q) group by 1, 2),
df as (select q, count(*)::double df from hit group by 1), st as (select count(*)::double n, avg(dl) avgdl from dl),
score as (select q, chunk_id, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) score
  from hit join df using (q) join dl using (chunk_id) cross join st),
kw as (select chunk_id, max(score) score from (select *, row_number() over (partition by q order by score desc, chunk_id) r from score) where r <= {SEEDS} group by 1),
seed as (select chunk_id from kw order by score desc, chunk_id limit {SEEDS}),
hub as (select slug from m group by 1 having count(*) > greatest(2.0, 0.05 * (select count(*) from t where ordinal > 0)))"""
_R = f"(select distinct on (chunk_id, seq) chunk_id, seq, {_sql_slug('subject')} s, coalesce({_sql_rel('predicate')}, 'related_to') p, {_sql_slug('object')} o, confidence from relation_ref)"



def _sql_hop(n: int, front: str, seen: str) -> str:
    return f"""
own{n} as (select distinct slug from m where chunk_id in (select chunk_id from {front}) and slug not in (select slug from hub)),
co{n} as (select chunk_id, count(distinct slug) shared from m where slug in (select slug from own{n}) and chunk_id not in (select chunk_id from {front})
  and chunk_id not in (select chunk_id from {seen}) group by 1 order by shared desc, chunk_id limit {G.MAX_COMENTIONS}),
beside{n} as (select distinct a.chunk_id from t a join t b on a.doc_id = b.doc_id and abs(a.ordinal - b.ordinal) = 1 and a.ordinal > 0
  where b.chunk_id in (select chunk_id from {front}) and a.chunk_id not in (select chunk_id from {seen})),
step{n} as (select chunk_id, {n}::int distance, max(shared)::bigint shared from (select * from co{n} union all select chunk_id, 0 from beside{n}) group by 1)"""


_ESC = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""


def _sql_line(s: str, p: str, o: str, kind: str = "string") -> str:
    """A statement as SQL text: s an IRI's tail or a node, p a predicate's name, o a value."""
    subject = s if s.startswith("'_:") else f"'<kb://' || {s} || '>'"
    if kind == "iri":
        said = f"'<' || {o} || '>'"
    elif kind == "string":
        said = f"'\"' || {_ESC.format(o)} || '\"'"
    else:
        said = f"'\"' || {o} || '\"^^<{G.XSD}{kind}>'"
    return f"{subject} || ' <{p if p.startswith('http') else G.ONTOLOGY + p}> ' || {said} || ' .'"


def _sql_lines() -> str:
    def lines(source: str, *triples: tuple) -> list[str]:
        return [f"select {_sql_line(*t)} from {source} where {w}" for *t, w in triples]

    d, c, tag, e, node = "'doc/' || docid", "'chunk/' || chunk_id", "'tag/' || slug", "'entity/' || slug", "'_:rel_' || replace(chunk_id, ':', '_') || '_' || seq"
    a = G.RDF_TYPE
    of = lambda kind, name: f"'kb://{kind}/' || {name}"
    cls = lambda name: f"'{G.ONTOLOGY}{name}'"
    parts = [
        *lines("live", (d, a, cls("Document"), "iri", "true"), (d, "checksum", "docid", "string", "true"), (d, "bytes", "bytes", "integer", "true"), (d, "mime", "mime", "string", "true"),
               (d, "ingestedAt", "strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ')", "dateTime", "true"), (d, "supersededBy", of("doc", "superseded_by"), "iri", "true")),
        *lines("p", (d, "locatedAt", "relpath", "string", "true")), *lines("c", (d, "hasChunk", of("chunk", "chunkid"), "iri", "ordinal > 0 and docid is not null")),
        *lines("t", (c, a, cls("Chunk"), "iri", "true"), (c, "partOf", of("doc", "doc_id"), "iri", "true"), (c, "ordinal", "ordinal", "integer", "true"), (c, "text", "text", "string", "true"),
               (c, "summary", "summary", "string", "summary <> ''"), (c, "extractionFailed", "'true'", "boolean", "failed"),
               (c, "nextChunk", of("chunk", "doc_id || ':' || format('{:04d}', ordinal + 1)"), "iri", "has_next")),
        *lines("b", (c, "byteStart", "byte_start", "integer", "true"), (c, "byteEnd", "byte_end", "integer", "true")),
        *lines("(select distinct chunk_id, slug from gt)", (c, "taggedWith", of("tag", "slug"), "iri", "true")), *lines("(select distinct slug from gt)", (tag, a, cls("Tag"), "iri", "true")),
        *lines("(select distinct slug, tag from gt)", (tag, "label", "tag", "string", "true")), *lines("m", (c, "mentions", of("entity", "slug"), "iri", "true")),
        *lines("(select distinct slug from m)", (e, a, cls("Entity"), "iri", "true")), *lines("(select distinct slug, name from e)", (e, "label", "name", "string", "true")),
        *lines("(select distinct slug, type from e)", (e, "entityType", "type", "string", "true")),
        *lines("r", (node, a, cls("Relation"), "iri", "true"), (node, "subject", of("entity", "s"), "iri", "true"), (node, "predicate", of("rel", "p"), "iri", "true"),
               (node, "object", of("entity", "o"), "iri", "true"), (node, "evidencedBy", of("chunk", "chunk_id"), "iri", "true"), (node, "confidence", "format('{:.2f}', confidence)", "decimal", "true")),
        "select distinct '<kb://entity/' || s || '> <kb://rel/' || p || '> <kb://entity/' || o || '> .' from r",
    ]
    return f"""
with {_BASE}, {_T}, {_M}, live as (select * from d where vacuumed = 0), b as (select distinct chunk_id, byte_start, byte_end from chunk_triples),
g as (select chunk_id, tag, {_sql_slug('tag')} slug from (select chunk_id, unnest(tags) tag from chunk_triples)), gt as (select * from g where slug <> ''),
e as (select distinct {_sql_slug('name')} slug, name, type from entity_ref where {_sql_slug('name')} <> ''), r as (select * from {_R} where s <> '' and o <> '')
select "value" from ({' union all '.join(parts)}) x("value") where "value" is not null"""


_SAID = "list_filter(string_split(lower(regexp_replace(gloss, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_BUDGET = f"""
with recursive {_T},
tok as (select chunk_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) term from t),
posting as (select term, chunk_id, count(*) tf from tok group by 1, 2), dl as (select chunk_id, count(*) dl from tok group by 1),
qt as (select canon_id query_id, unnest(list_transform(list_sort(list_transform(
    list_filter(list_distinct({_SAID}), lambda w: length(w) >= 3 and w not in ({_STOPS})),
    lambda w: struct_pack(n := -length(w), i := list_position({_SAID}, w), w := w)))[1:6], lambda x: x.w)) q from canon),
hit as (select q, chunk_id, sum(tf)::double tf from posting join (select distinct q from qt) on starts_with(term, q) group by 1, 2),
df as (select q, count(*)::double df from hit group by 1), st as (select count(*)::double n, avg(dl) avgdl from dl),
score as (select q, chunk_id, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) score
  from hit join df using (q) join dl using (chunk_id) cross join st),
top as (select * from (select *, row_number() over (partition by q order by score desc, chunk_id) r from score) where r <= 24),
best as (select query_id, chunk_id, max(score) score from qt join top using (q) group by 1, 2),
ranked as (select query_id, chunk_id, octet_length(encode(text)) size, row_number() over (partition by query_id order by score desc, chunk_id) rank from best join t using (chunk_id)),
go as (
  select distinct query_id, 0::bigint rank, 4096::bigint room, '' chunk_id, false taken from ranked
  union all select r.query_id, r.rank, go.room - case when r.size <= go.room then r.size else 0 end, r.chunk_id, r.size <= go.room
  from go join ranked r on r.query_id = go.query_id and r.rank = go.rank + 1)
select query_id, chunk_id, (row_number() over (partition by query_id order by rank))::int n from go where taken"""

ORACLES = {
    "graph_expansion": f"""
with {_SEED}, {_sql_hop(1, 'seed', 'seed')}, seen1 as (select chunk_id from seed union select chunk_id from step1), {_sql_hop(2, 'step1', 'seen1')}
select * from step1 union all select * from step2""",
    "context_budget": _BUDGET,
    "triples_written": _sql_lines(),
    "triples_by_predicate": f"""
with {_BASE}, {_T}, {_M}, live as (select * from d where vacuumed = 0),
g as (select distinct chunk_id, tag, {_sql_slug('tag')} slug from (select chunk_id, unnest(tags) tag from chunk_triples)), gt as (select * from g where slug <> ''),
e as (select distinct {_sql_slug('name')} slug, name, type from entity_ref where {_sql_slug('name')} <> ''),
r as (select * from {_R} where s <> '' and o <> ''), o as (select 'kb://ontology#' x)
select x || k p, n triples from o, (
  select 'checksum' k, count(*) n from live union all select 'bytes', count(bytes) from live union all select 'mime', count(mime) from live
  union all select 'ingestedAt', count(ingested_at) from live union all select 'supersededBy', count(superseded_by) from live
  union all select 'locatedAt', count(*) from p union all select 'hasChunk', count(*) from c where ordinal > 0 and docid is not null
  union all select 'partOf', count(*) from t union all select 'ordinal', count(*) from t
  union all select 'byteStart', count(byte_start) from (select distinct chunk_id, byte_start from chunk_triples)
  union all select 'byteEnd', count(byte_end) from (select distinct chunk_id, byte_end from chunk_triples)
  union all select 'text', count(text) from t union all select 'summary', count(nullif(summary, '')) from t
  union all select 'extractionFailed', count(*) from t where failed union all select 'nextChunk', count(*) from t where has_next
  union all select 'taggedWith', count(distinct (chunk_id, slug)) from gt
  union all select 'label', (select count(distinct (slug, tag)) from gt) + (select count(distinct (slug, name)) from e)
  union all select 'mentions', count(*) from m union all select 'entityType', count(distinct (slug, type)) from e where type is not null
  union all select 'subject', count(*) from r union all select 'predicate', count(*) from r union all select 'object', count(*) from r
  union all select 'evidencedBy', count(*) from r union all select 'confidence', count(confidence) from r) where n > 0
union all select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (select count(*) from live) + (select count(*) from t) + (select count(distinct slug) from gt) + (select count(distinct slug) from e) + (select count(*) from r)""",
    "vacuum_live": f"""
with {_BASE}, {_T}, {_M}, live as (select * from d where vacuumed = 0), old as (select docid from live where superseded_by is not null),
oc as (select chunk_id from t where doc_id in (select docid from old)),
g as (select distinct chunk_id, tag, {_sql_slug('tag')} slug from (select chunk_id, unnest(tags) tag from chunk_triples)), gt as (select * from g where slug <> ''),
e as (select distinct {_sql_slug('name')} slug, name, type from entity_ref where {_sql_slug('name')} <> ''),
r as (select * from {_R} where s <> '' and o <> '' and chunk_id not in (select chunk_id from oc)),
ld as (select * from live where superseded_by is null), lt as (select * from t where chunk_id not in (select chunk_id from oc)), o as (select 'kb://ontology#' x)
select x || k p, n triples from o, (
  select 'checksum' k, count(*) n from ld union all select 'bytes', count(bytes) from ld union all select 'mime', count(mime) from ld
  union all select 'ingestedAt', count(ingested_at) from ld
  union all select 'locatedAt', count(*) from p where docid not in (select docid from old)
  union all select 'hasChunk', count(*) from c where ordinal > 0 and docid not in (select docid from old)
  union all select 'partOf', count(*) from lt union all select 'ordinal', count(*) from lt
  union all select 'byteStart', count(byte_start) from (select distinct chunk_id, byte_start from chunk_triples where chunk_id not in (select chunk_id from oc))
  union all select 'byteEnd', count(byte_end) from (select distinct chunk_id, byte_end from chunk_triples where chunk_id not in (select chunk_id from oc))
  union all select 'text', count(text) from lt union all select 'summary', count(nullif(summary, '')) from lt
  union all select 'extractionFailed', count(*) from lt where failed union all select 'nextChunk', count(*) from lt where has_next
  union all select 'taggedWith', count(distinct (chunk_id, slug)) from gt where chunk_id not in (select chunk_id from oc)
  union all select 'label', (select count(distinct (slug, tag)) from gt) + (select count(distinct (slug, name)) from e)
  union all select 'mentions', count(*) from m where chunk_id not in (select chunk_id from oc)
  union all select 'entityType', count(distinct (slug, type)) from e where type is not null
  union all select 'subject', count(*) from r union all select 'predicate', count(*) from r union all select 'object', count(*) from r
  union all select 'evidencedBy', count(*) from r union all select 'confidence', count(confidence) from r) where n > 0""",
    "graph_vacuum": f"""
with {_BASE}, {_T}, {_M}, live as (select * from d where vacuumed = 0), old as (select docid from live where superseded_by is not null),
oc as (select chunk_id from t where doc_id in (select docid from old)),
r as (select * from {_R} where s <> '' and o <> '' and chunk_id not in (select chunk_id from oc)),
ld as (select * from live where superseded_by is null), lt as (select * from t where chunk_id not in (select chunk_id from oc)), o as (select 'kb://ontology#' x)
select x || k p, n triples from o, (
  select 'checksum' k, count(*) n from ld union all select 'locatedAt', count(*) from p where docid not in (select docid from old)
  union all select 'partOf', count(*) from lt union all select 'text', count(text) from lt
  union all select 'mentions', count(*) from m where chunk_id not in (select chunk_id from oc) union all select 'evidencedBy', count(*) from r) where n > 0""",
    "entity_df": f"with {_M} select slug, count(*) n from m group by 1",
    "hub_entities": f"with {_T}, {_M} select slug, count(*) n from m group by 1 having count(*) > greatest(2.0, 0.05 * (select count(*) from t where ordinal > 0))",
    "comention": f"""
with {_SEED}, own as (select distinct slug from m where chunk_id in (select chunk_id from seed) and slug not in (select slug from hub))
select chunk_id, count(distinct slug) shared from m where slug in (select slug from own) and chunk_id not in (select chunk_id from seed) group by 1""",
    "siblings": f"with {_T} select distinct a.chunk_id, b.chunk_id seed from t a join t b on a.doc_id = b.doc_id and abs(a.ordinal - b.ordinal) = 1 and a.ordinal > 0",
    "candidate_cards": f"""
with {_BASE}, {_T} select chunk_id, doc_id docid, ordinal, (select min(relpath) from p where p.docid = t.doc_id) path, md5(text) text, summary
from t where text is not null and doc_id in (select docid from p)""",
    "relation_receipts": f"""
with {_SEED} select chunk_id, seq, s || ' —' || p || '→ ' || o || ' (conf ' || format('{{:.2f}}', confidence) || ')' receipt
from {_R} where chunk_id in (select chunk_id from seed) and o is not null and confidence is not null""",
} | {name: sql for name, (_, _, sql) in _SPARQL.items() if sql}
