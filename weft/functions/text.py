"""Scalar functions as Column expressions, so that they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.model import SCHEME

# --- fixed values that must equal those of the data's producer -------------------------------------------------------

#: Words that a query is not searched for.
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "with", "this", "that", "from", "have", "has", "was", "were", "will", "would", "could",
    "should", "what", "when", "where", "which", "who", "how", "why", "does", "did", "their", "there", "about", "into", "than", "then",
    "them", "they", "its", "his", "her", "you", "your", "can", "all", "any", "one", "out", "use", "used",
]
MIN_TERM = 3
MAX_TERMS = 6

#: Mime of a file by its extension; everything else is text/plain.
MIME = {
    "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv",
    "json": "application/json", "txt": "text/plain", "py": "text/x-python", "c": "text/x-c", "h": "text/x-c", "cpp": "text/x-c++",
    "hpp": "text/x-c++", "cc": "text/x-c++", "rs": "text/x-rust", "go": "text/x-go", "js": "text/x-javascript",
    "ts": "text/x-typescript", "java": "text/x-java", "sh": "text/x-shellscript", "toml": "text/x-toml", "yaml": "text/x-yaml",
    "yml": "text/x-yaml", "xml": "text/xml", "sql": "text/x-sql", "rb": "text/x-ruby", "tex": "text/x-tex", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "wav": "audio/wav", "mp3": "audio/mpeg",
}
IMAGE = ["png", "jpg", "jpeg"]
AUDIO = ["wav", "mp3"]

#: Character entities that are decoded, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

ENTITY_TYPES = ["person", "org", "place", "concept", "artifact", "event"]
BYTES_PER_TOKEN = 4

# ---------------------------------------------------------------------------------------------------------------------


def _slug(text: Column, mark: str) -> Column:
    # replaced before lowering: lower case of a few letters outside ASCII is an ASCII letter
    runs = F.regexp_replace(text, "[^A-Za-z0-9]+", mark)
    return F.lower(F.regexp_replace(runs, f"^{mark}|{mark}$", ""))


def slugify(text: Column) -> Column:
    return _slug(text, "-")


def rel_slug(predicate: Column) -> Column:
    return F.coalesce(F.nullif(_slug(predicate, "_"), F.lit("")), F.lit("related_to"))


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s:%04d", doc_id, ordinal)


def iri(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}{kind}/"), name)


def iri_tail(text: Column) -> Column:
    return F.substring_index(text, "/", -1)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def base64_line(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ttl_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, said in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(said))
    others = [c for c in range(1, 0x20) if chr(c) not in "\n\r\t"]
    with_controls = reduce(lambda col, c: F.replace(col, F.lit(chr(c)), F.lit(f"\\u{c:04x}")), others, out)
    return F.when(out.rlike("[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]"), with_controls).otherwise(out)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def mime_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text/plain"))


def modality_of(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(IMAGE), "image").when(ext.isin(AUDIO), "audio").otherwise("text")


def _glob_body(pattern: str, inside: bool) -> str:
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append("[^/]*" if inside else ".*")
            i += 1
        elif pattern[i] == "*":
            out.append("[^/]*")
        elif pattern[i] == "?":
            out.append("[^/]" if inside else ".")
        else:
            out.append(pattern[i] if pattern[i].isalnum() or pattern[i] in "_/" else "\\" + pattern[i])
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """``*`` stays within a path component, ``**`` does not, ``?`` is any one character; without a slash any one component may match."""
    body = _glob_body(pattern, inside=False)
    if "/" not in pattern:
        body += f"|(?:.*/)?{_glob_body(pattern, inside=True)}(?:/.*)?"
    return rf"(?s)\A(?:{body})\z"


def glob_match(pattern: str, path: Column) -> Column:
    return path.rlike(glob_regex(pattern))


def admitted(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether no exclude pattern matches and, if there are include patterns, one of them does."""
    drop = reduce(lambda a, b: a | b, (glob_match(p, path) for p in exclude), F.lit(False))
    keep = reduce(lambda a, b: a | b, (glob_match(p, path) for p in include), F.lit(not include))
    return ~drop & keep


def words(text: Column) -> Column:
    """ASCII letter and digit runs in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def unicode_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def salient_terms(query: Column) -> Column:
    """Distinct query words worth searching: the longest first, then the earliest, at most MAX_TERMS."""
    good = F.array_distinct(F.filter(words(query), lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(STOP_WORDS)))
    placed = F.transform(good, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(placed), 1, MAX_TERMS), lambda x: x["w"])


def decode_entities(text: Column) -> Column:
    return reduce(lambda col, e: F.replace(col, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def strip_html_simple(html: Column) -> Column:
    """Text of a page whose script bodies hold no tags of their own and whose tags all end; see functions.native for all others."""
    no_script = F.regexp_replace(html, "(?i)<(script|style)[^>]*>[^<]*", " ")
    return decode_entities(F.regexp_replace(no_script, "<[^>]*>", " "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def entity_type(kind: Column) -> Column:
    return F.when(kind.isin(ENTITY_TYPES), kind).otherwise("concept")


def confidence_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f", x))


def receipt(s: Column, p: Column, o: Column, conf: Column) -> Column:
    return F.concat(s, F.lit(" —"), p, F.lit("→ "), o, F.lit(" (conf "), confidence_text(conf), F.lit(")"))


def cited_numbers(answer: Column, sources: Column) -> Column:
    """Distinct source numbers of markers such as [1] or [1, 2] that exist; all sources if there is no marker."""
    lists = F.regexp_extract_all(answer, F.lit(r"\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]"), 1)
    numbers = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(x).cast("long"))
    good = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= sources))))
    return F.when(F.size(good) > 0, good).otherwise(F.sequence(F.lit(1), sources))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit vector; an all-zero vector stays as it is."""
    return F.transform(v, lambda x: (x / F.when(norm(v) > 0, norm(v)).otherwise(F.lit(1.0))).cast("float"))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
