"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import native
from weft.functions import text as X
from weft.sources.tables import table


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_ref").select("ref_id", X.slugify(F.col("name")).alias("slug"))


def rel_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relation_ref").select("ref_id", X.rel_slug(F.coalesce("predicate", F.lit(""))).alias("slug"))


def chunk_id_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("veckey", X.chunk_id(F.lower(F.trim("docid")), F.col("ordinal")).alias("chunk_id"))


def iri_round_trip(spark: SparkSession, d: str) -> DataFrame:
    iri = X.iri("entity", X.slugify(F.col("name")))
    return table(spark, d, "entity_ref").where("name is not null").select("ref_id", iri.alias("iri"), X.iri_tail(iri).alias("tail"))


def ttl_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_triples").select("chunk_id", F.md5(X.ttl_escape(F.col("text"))).alias("escaped"))


def hex_base64(spark: SparkSession, d: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return table(spark, d, "chunk_triples").select("chunk_id", F.md5(X.to_hex(data)).alias("hex"), F.md5(X.base64_line(data)).alias("base64"))


def iso_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc").select("docid", X.iso8601(F.col("ingested_at")).alias("written"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_triples").select("chunk_id", X.token_estimate(F.col("text")).alias("tokens"))


def entity_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_ref").select("ref_id", X.entity_type(F.col("type")).alias("kind"))


def receipts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relation_ref").where("object is not null and confidence is not null")
    text = X.receipt(X.slugify(F.col("subject")), X.rel_slug(F.coalesce("predicate", F.lit(""))), X.slugify(F.col("object")), F.col("confidence"))
    return r.select("ref_id", text.alias("receipt"))


def mime_modality(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relpath")
    return table(spark, d, "path").select("relpath", X.extension(p).alias("ext"), X.mime_of(p).alias("mime"), X.modality_of(p).alias("modality"))


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    keep = X.admitted(F.col("relpath"), ["*.md", "**/report*", "*-src/*/*.py"], ["*_v2*", "**draft**"])
    return table(spark, d, "path").where(keep).select("relpath").distinct()


def strip_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of every chunk text, with a script that holds a closing tag in a string."""
    page = F.concat(F.lit('<html><script>var t="</p>";</script><h1 class="x">'), F.regexp_replace("text", "[<>]", ""), F.lit("</h1>&lt;b&gt; &amp;amp; &quot;q&quot;&nbsp;<br/></html>"))
    return table(spark, d, "chunk_triples").where("text is not null").select("chunk_id", F.md5(native.strip_html_udf(page)).alias("text"))


def html_entities(spark: SparkSession, d: str) -> DataFrame:
    coded = F.concat(F.lit("&amp;lt; "), F.coalesce("summary", F.lit("")), F.lit(" &lt;&gt;&quot;&#39;&nbsp;&amp;"))
    return table(spark, d, "chunk_triples").select("chunk_id", X.decode_entities(coded).alias("text"))


def chunk_tiling(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every document tile it: their spans sum to its bytes, from 0 to the end."""
    c = _chunks(spark, d)
    return c.groupBy("doc_id").agg(
        F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"), F.min("byte_start").alias("first"), F.max("byte_end").alias("last")
    )


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(native.chunk_udf()("text", "mime")).alias("c")).select("doc_id", "c.ordinal", "c.byte_start", "c.byte_end", "c.text")


def content_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", native.content_id("text").alias("docid"))


def vec_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("chunkid", native.vec_key("chunkid").alias("key"))


def binary_sniff(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring(F.encode("text", "UTF-8"), 1, native.SNIFFED)
    return table(spark, d, "documents").select("doc_id", native.looks_binary_udf(head).alias("is_binary"))


def salient_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", X.salient_terms(F.col("text"))).alias("terms"))


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    w = X.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words"))


def cited_markers(spark: SparkSession, d: str) -> DataFrame:
    """Citation markers in texts made of every relation's row."""
    answer = F.concat(F.lit("It is so ["), (F.col("seq") + 1).cast("string"), F.lit(", 2] and [99] but not [x]."))
    return table(spark, d, "relation_ref").select("ref_id", F.concat_ws(",", X.cited_numbers(answer, F.lit(5))).alias("cited"))


QUERIES = {
    f.__name__: f
    for f in (
        slugify, rel_slug, chunk_id_format, iri_round_trip, ttl_escape, hex_base64, iso_time, token_estimate, entity_type, receipts, mime_modality,
        glob_filter, strip_html, html_entities, chunk_tiling, chunk_rows, content_identity, vec_keys, binary_sniff, salient_terms, tokenize_stats,
        cited_markers,
    )
}


def _sql_slug(column: str, mark: str = "-") -> str:
    return f"lower(regexp_replace(regexp_replace({column}, '[^A-Za-z0-9]+', '{mark}', 'g'), '^{mark}|{mark}$', '', 'g'))"


def _sql_rel(column: str) -> str:
    return f"coalesce(nullif({_sql_slug(column, '_')}, ''), 'related_to')"


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_WORDS = "list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_EXT = "lower(regexp_extract(relpath, '\\.([^./]*)$', 1))"
_MIMES = " ".join(f"when '{e}' then '{m}'" for e, m in X.MIME.items())

ORACLES = {
    "slugify": f"select ref_id, {_sql_slug('name')} slug from entity_ref",
    "rel_slug": f"select ref_id, {_sql_rel('predicate')} slug from relation_ref",
    "chunk_id_format": "select veckey, lower(trim(docid)) || ':' || format('{:04d}', ordinal) chunk_id from chunk",
    "iri_round_trip": f"select ref_id, 'kb://entity/' || {_sql_slug('name')} iri, {_sql_slug('name')} tail from entity_ref where name is not null",
    "ttl_escape": r"""
select chunk_id, md5(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) escaped
from chunk_triples""",
    "hex_base64": "select chunk_id, md5(lower(hex(encode(text)))) hex, md5(base64(encode(text))) base64 from chunk_triples",
    "iso_time": "select docid, strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ') written from doc",
    "token_estimate": "select chunk_id, (octet_length(encode(text)) // 4)::bigint tokens from chunk_triples",
    "entity_type": "select ref_id, case when type in ('person', 'org', 'place', 'concept', 'artifact', 'event') then type else 'concept' end kind from entity_ref",
    "receipts": f"""
select ref_id, {_sql_slug('subject')} || ' —' || {_sql_rel('predicate')} || '→ ' || {_sql_slug('object')} || ' (conf ' || format('{{:.2f}}', confidence) || ')' receipt
from relation_ref where object is not null and confidence is not null""",
    "mime_modality": f"""
select relpath, {_EXT} ext, case {_EXT} {_MIMES} else 'text/plain' end mime,
  case when {_EXT} in ('png', 'jpg', 'jpeg') then 'image' when {_EXT} in ('wav', 'mp3') then 'audio' else 'text' end modality from path""",
    "glob_filter": r"""
select distinct relpath from path
where (regexp_matches(relpath, '(^|/)[^/]*\.md(/|$)') or regexp_matches(relpath, '^.*/report.*$') and not regexp_matches(relpath, '/report[^/]*/')
   or regexp_matches(relpath, '^[^/]*-src/[^/]*/[^/]*\.py$'))
  and not regexp_matches(relpath, '_v2') and not contains(relpath, 'draft')""",
    "strip_html": r"""
select chunk_id, md5('   ";  ' || regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '[<>]', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '', '') || ' <b> &amp; "q"   ') text
from chunk_triples where text is not null""",
    "html_entities": """
select chunk_id, '&lt; ' || replace(replace(replace(replace(replace(replace(coalesce(summary, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') || ' <>"'' &' as text
from chunk_triples""",
    "chunk_tiling": "select doc_id, octet_length(encode(text))::bigint bytes, 0::bigint first, octet_length(encode(text))::bigint last from documents where text <> ''",
    "salient_terms": f"""
select doc_id, coalesce(list_aggregate(list_transform(list_sort(list_transform(
    list_filter(list_distinct({_WORDS}), lambda w: length(w) >= 3 and w not in ({_STOPS})),
    lambda w: struct_pack(n := -length(w), i := list_position({_WORDS}, w), w := w)))[1:6], lambda x: x.w), 'string_agg', ' '), '') terms
from documents""",
    "tokenize_stats": f"select doc_id, len({_WORDS})::int words, len(list_distinct({_WORDS}))::int distinct_words from documents",
    "cited_markers": """
select ref_id, case when seq + 1 in (1) then '1,2' when seq + 1 = 2 then '2' when seq + 1 <= 5 then '2,' || (seq + 1) else '2' end cited from relation_ref""",
    "binary_sniff": "select doc_id, contains(text, chr(0)) is_binary from documents",
}
