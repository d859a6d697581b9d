"""Functions on bytes that Column expressions cannot give: chunking, page text, content identity, binary sniffing."""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import xxhash
except ImportError:  # everything but identity works without it
    xxhash = None

# --- fixed values ----------------------------------------------------------------------------------------------------

#: Beginnings of lines that open a definition in code.
DEFINITIONS = (
    "def ", "class ", "fn ", "func ", "function ", "impl ", "struct ", "enum ", "trait ", "pub ", "static ", "void ", "int ", "bool ",
    "double ", "const ", "template", "namespace ", "export ", "async ",
)
SMALL_FILE = 196_608
TAP = 65_536
SNIFFED = 8192

# ---------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChunkOptions:
    target_tokens: int = 768
    max_tokens: int = 1024
    overlap: float = 0.15


_LINE = re.compile(rb"[^\n]*\n|[^\n]+\Z")
_BREAK = re.compile(rb"[.!?\n](?=\s|\Z)")
_DEFINITION = re.compile(rb"^(?=" + b"|".join(re.escape(d.encode()) for d in DEFINITIONS) + rb")", re.M)


def _structure(data: bytes, code: bool) -> list[int]:
    """Sorted offsets at which a structural unit ends, the end of the text last."""
    if code:
        cuts = {m.start() for m in _DEFINITION.finditer(data)}
    else:
        cuts = set()
        for m in _LINE.finditer(data):
            if data[m.start()] == 0x23:
                cuts.add(m.start())
            if not m[0].strip(b" \t\n\r\v\f"):
                cuts.add(m.end())
    return sorted((cuts | {len(data)}) - {0})


def chunk_spans(data: bytes, mime: str, options: ChunkOptions = ChunkOptions()) -> list[tuple[int, int, int]]:
    """(text start, start, end) of each chunk: [start, end) tiles the text, [text start, start) is the overlap."""
    target, most = options.target_tokens * 4, options.max_tokens * 4
    overlap = int(target * options.overlap)
    code = mime.startswith("text/x-") or mime == "application/json"
    breaks = [m.end() for m in _BREAK.finditer(data)]
    # structural units, those above the maximum cut at the last sentence end within it
    ends, begin = [], 0
    for end in _structure(data, code):
        while end - begin > most:
            k = bisect_right(breaks, begin + most) - 1
            cut = breaks[k] if k >= 0 and breaks[k] > begin + 1 else begin + most
            ends.append(cut)
            begin = cut
        if end > begin:
            ends.append(end)
            begin = end
    spans, start, last = [], 0, 0
    for end in ends:
        held = last - start
        if held and held >= target // 2 and held + end - last > target:
            spans.append((start, last))
            start = last
        last = end
        if last - start >= most:
            spans.append((start, last))
            start = last
    if last > start:
        spans.append((start, last))
    out = []
    for i, (a, b) in enumerate(spans):
        lead = max(0, a - overlap) if i else a
        while lead < a and data[lead] & 0xC0 == 0x80:
            lead += 1
        out.append((lead, a, b))
    return out


CHUNKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("byte_start", T.LongType()),
            T.StructField("byte_end", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )
)


def chunk_udf(options: ChunkOptions = ChunkOptions()):
    """(text, mime) -> array of chunks; null and empty texts give an empty array."""

    @F.pandas_udf(CHUNKS)
    def chunks(texts: pd.Series, mimes: pd.Series) -> pd.Series:
        out = []
        for text, mime in zip(texts, mimes):
            data = (text or "").encode("utf-8", "surrogatepass")
            out.append(
                [
                    {"ordinal": i, "byte_start": a, "byte_end": b, "text": data[lead:b].decode("utf-8", "replace")}
                    for i, (lead, a, b) in enumerate(chunk_spans(data, mime or "text/plain", options), 1)
                ]
            )
        return pd.Series(out)

    return chunks


_MARKUP = re.compile(r"<(?P<tag>[^>]*)(?P<end>>)?|(?P<text>[^<]+)", re.S)
_HIDING = re.compile(r"(?:script|style)", re.I)
_ENTITY = re.compile("&(amp|lt|gt|quot|#39|nbsp);")
_SIGNS = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " "}


def strip_html(html: str) -> str:
    """Text of a page. A tag is a space; what follows a script or style tag is hidden until a closing tag of any name."""
    out, hidden = [], False
    for m in _MARKUP.finditer(html):
        if m["text"] is not None:
            if not hidden:
                out.append(_ENTITY.sub(lambda e: _SIGNS[e[1]], m["text"]))
            continue
        rest = html[m.start() + 1 :][:7]
        name = _HIDING.match(rest)
        if name and len(html) - m.start() > name.end() + 1:
            hidden = True
        if rest.startswith("/"):
            hidden = False
        if m["end"]:
            out.append(" ")
    return "".join(out)


@F.pandas_udf(T.StringType())
def strip_html_udf(pages: pd.Series) -> pd.Series:
    return pages.map(strip_html, na_action="ignore")


def looks_binary(data: bytes) -> bool:
    """Whether the bytes hold a NUL or are no UTF-8; a sequence cut off at the end is fine."""
    if b"\0" in data:
        return True
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.reason != "unexpected end of data"
    return False


@F.pandas_udf(T.BooleanType())
def looks_binary_udf(heads: pd.Series) -> pd.Series:
    return heads.map(lambda x: looks_binary(bytes(x[:SNIFFED])), na_action="ignore")


def _hashes():
    """One kind of hash on all machines: another on one of them would give the same content two identities."""
    if xxhash is None:
        raise RuntimeError("content identity needs the package xxhash on the driver and on every executor")
    return xxhash


def _hash16(data: bytes) -> str:
    return _hashes().xxh3_128_hexdigest(data)[:16]


def tap_bytes(data: bytes) -> str:
    """Sampled identity: size, and the whole content or three stretches of a large one."""
    n = len(data)
    if n > SMALL_FILE:
        data = data[:TAP] + data[n // 2 - TAP // 2 : n // 2 + TAP // 2] + data[n - TAP :]
    return _hash16(struct.pack("<Q", n) + data)


def full_hash(data: bytes) -> str:
    """Identity by the whole content."""
    return hashlib.blake2b(data, digest_size=8).hexdigest()


def tap_file(path: str, paranoid: bool = False) -> str | None:
    """Identity of a file, None if it cannot be read. The sampled one reads at most three stretches."""
    try:
        with open(path, "rb") as f:
            if paranoid:
                return full_hash(f.read())
            n = f.seek(0, 2)
            at = [(0, n)] if n <= SMALL_FILE else [(0, TAP), (n // 2 - TAP // 2, TAP), (n - TAP, TAP)]
            parts = []
            for offset, size in at:
                f.seek(offset)
                parts.append(f.read(size))
            return _hash16(struct.pack("<Q", n) + b"".join(parts))
    except OSError:
        return None


@F.pandas_udf(T.StringType())
def content_id(contents: pd.Series) -> pd.Series:
    return contents.map(lambda x: tap_bytes(bytes(x) if not isinstance(x, str) else x.encode("utf-8", "surrogatepass")), na_action="ignore")


def vec_key_of(chunk: str) -> int:
    """64-bit key of a chunk, as a signed number."""
    h = _hashes().xxh3_64_intdigest(chunk)
    return h - (1 << 64) if h >= 1 << 63 else h


@F.pandas_udf(T.LongType())
def vec_key(chunks: pd.Series) -> pd.Series:
    return chunks.map(vec_key_of, na_action="ignore").astype("Int64")


def byte_prefix(text: str, limit: int) -> str:
    """Longest beginning of at most ``limit`` bytes that ends with a whole character."""
    data = text.encode("utf-8", "surrogatepass")
    return text if len(data) <= limit else data[:limit].decode("utf-8", "ignore")


def fit_budget(sizes: list[int], budget: int) -> list[int]:
    """Indexes that a greedy reader takes in order, skipping what does not fit any more."""
    taken, left = [], budget
    for i, size in enumerate(sizes):
        if size <= left:
            taken.append(i)
            left -= size
    return taken

