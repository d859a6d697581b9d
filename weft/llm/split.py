"""Cutting oversized texts into pieces within a byte limit, at natural boundaries.

A text gets the prefix sums of its characters' UTF-8 lengths and, per kind of
boundary, a sorted array of the byte offsets where one lies. The end of a piece
is the last boundary within the limit, found by binary search: a paragraph end
if one lies in the second half of its new text, else a sentence or line end, else a
word end, else the last whole character. The next piece steps back by the
overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
SENTENCE = re.compile(r"[.!?…][\"')\]]*\s+|[。！？।]+\s*|\n+")
WORD = re.compile(r"\s+|[、，；]")
#: Bytes of the widest character in UTF-8.
WIDEST = 4


def offsets(text: str) -> np.ndarray:
    """Byte offset of every character, and of the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(width)))


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(from, start, end) byte offsets of each piece: [start, end) tiles the text, [from, start) is the overlap.

    Every piece has at most ``limit`` bytes, overlap included, except that a
    single character longer than the limit stays whole. The overlap never begins
    inside a character; one that leaves no room for WIDEST bytes of new text,
    which no character exceeds, is as long as that room allows.
    """
    at = offsets(text)
    total = int(at[-1])
    if total <= limit:
        return [(0, 0, total)] if total else []
    overlap = max(0, min(overlap, limit - WIDEST))
    levels = [at[[m.end() for m in kind.finditer(text)]] for kind in (PARAGRAPH, SENTENCE, WORD)]
    found, begin, start = [], 0, 0
    while total - begin > limit:
        reach, cut = begin + limit, 0
        for k, bounds in enumerate(levels):
            i = int(np.searchsorted(bounds, reach, side="right")) - 1
            least = start + (reach - start) // 2 if k < 2 else start + 1
            if i >= 0 and bounds[i] > start and bounds[i] >= least:
                cut = int(bounds[i])
                break
        if not cut:
            cut = int(at[np.searchsorted(at, reach, side="right") - 1])
            if cut <= start:
                cut = int(at[np.searchsorted(at, start, side="right")])
        found.append((begin, start, cut))
        start = cut
        begin = int(at[np.searchsorted(at, cut - overlap, side="left")])
    found.append((begin, start, total))
    return found


PIECES = "piece int, byte_start long, byte_end long, text_start long, text string"


def split_oversized(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of every text of more than ``limit`` bytes: the keys, then piece (from 1), byte_start, byte_end, text_start, text.

    texts: the keys, text string, limit int, overlap int (bytes), base long
    (offset of the text's first byte; null counts as 0). byte_start and byte_end
    bound the piece without its leading overlap, which reaches back to
    text_start; all count from the beginning of the document. Texts within the
    limit, null and empty texts and rows with a null or non-positive limit give
    no row; a null overlap counts as 0; repeated rows are split each; other
    columns are left out. Row order plays no part.
    """
    big = texts.where((F.col("limit") > 0) & (F.octet_length("text") > F.col("limit"))).select(
        *keys, "text", F.col("limit").cast("int"), F.coalesce(F.col("overlap").cast("int"), F.lit(0)).alias("overlap"),
        F.coalesce(F.col("base").cast("long"), F.lit(0)).alias("base"),
    )
    types = dict(big.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + PIECES

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, whole = [], batch[keys].itertuples(index=False, name=None)
            for key, text, limit, overlap, base in zip(whole, batch["text"], batch["limit"], batch["overlap"], batch["base"]):
                data = text.encode("utf-8", "surrogatepass")
                for n, (begin, start, end) in enumerate(pieces(text, int(limit), int(overlap)), 1):
                    rows.append((*key, n, base + start, base + end, base + begin, data[begin:end].decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=[*keys, "piece", "byte_start", "byte_end", "text_start", "text"])

    return big.mapInPandas(cut, schema)
