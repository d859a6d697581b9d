"""Sizes of texts in tokens of a public byte-level BPE tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; pass another path where they lie elsewhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which this family of tokenizers cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_made: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary in "base64 rank" lines; made once per process."""
    key = hash(vocabulary)
    if key not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _made.clear()
        _made[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[key]


def count_tokens(encode, text: str | None) -> int:
    if not text:
        return 0
    try:
        return len(encode(text))
    except UnicodeEncodeError:  # lone surrogates
        return len(encode(text.encode("utf-8", "replace").decode()))


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens`` long: the size of the whole text; 0 for null and empty texts.

    The file is read by the driver and sent to the executors once. Special
    tokens in a text are ordinary text. Texts and words are encoded whole, however
    long (a word of six million letters takes some seconds).
    """
    with open(vocabulary, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    types = dict(df.dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(data.value).encode_ordinary
        for batch in batches:
            yield batch[keep].assign(tokens=[count_tokens(encode, t) for t in batch["_text"]])

    source = df.select(*keep, F.col(text).alias("_text"))
    return source.mapInPandas(count, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", tokens long")
