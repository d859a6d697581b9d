"""Pigeonhole segment join: pairs of strings within k edits, without comparing all pairs.

An edit is an insertion, deletion, substitution or swap of neighbours. A string
is cut into k + 1 segments. An edit inside a segment damages one; a swap across
the border of two segments damages both. If b of the k edits are such swaps, the
others spare b + 1 segments, and the b swaps touch these 2b times at most: one
segment is touched by one of them at most. So one segment of the shorter string
appears in the longer one, at most k places off, as it is or with its first or
last letter swapped across the border. Segments are the keys of an inverted
index, position-shifted substrings and their two swapped variants look them up,
and a banded edit distance verifies what meets.

The index and the lookups are always shuffled: the planner takes an exploded
table for as large as what it was exploded from, and would have the driver
broadcast some 50 rows for each key of a table that it finds small.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def banded_distance(a: str, b: str, k: int) -> int:
    """Edits between ``a`` and ``b`` (neighbour swaps count one); k + 1 if there are more than ``k``."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    far = k + 1
    before: list[int] = []
    last = [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= k:
            row[0] = i
        best = row[0]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            x = last[j - 1] + (a[i - 1] != b[j - 1])
            if last[j] + 1 < x:
                x = last[j] + 1
            if row[j - 1] + 1 < x:
                x = row[j - 1] + 1
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < x:
                x = before[j - 2] + 1
            row[j] = x if x < far else far
            if row[j] < best:
                best = row[j]
        if best > k:
            return far
        before, last = last, row
    return last[m]


def distance_udf(k: int):
    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([banded_distance(x, y, k) for x, y in zip(a, b)], dtype="int32")

    return distance


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` of an even cut; later segments are the longer ones."""
    base = F.floor(length / parts).cast("int")
    short = F.lit(parts) - length % parts
    return i * base + F.greatest(F.lit(0), i - short) + 1, base + (i >= short).cast("int")


class SegmentIndex:
    """The same search in the memory of one process, for a vocabulary of bounded size."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self._posted: dict[int, dict[tuple[int, int, str], list[str]]] = {}

    def _index(self, k: int) -> dict[tuple[int, int, str], list[str]]:
        if k not in self._posted:
            index = self._posted[k] = {}
            for w in self.words:
                for i, (start, size) in enumerate(_cuts(len(w), k + 1)):
                    index.setdefault((len(w), i, w[start : start + size]), []).append(w)
        return self._posted[k]

    def near(self, word: str, k: int) -> list[tuple[int, str]]:
        """(edits, word) of all words within ``k`` edits that have more than k letters."""
        index, met = self._index(k), set()
        for length in range(max(k + 1, len(word) - k), len(word) + k + 1):
            for i, (start, size) in enumerate(_cuts(length, k + 1)):
                for at in range(max(0, start - k), min(len(word) - size, start + k) + 1):
                    if abs(at - start) + abs(len(word) - length - at + start) > k:
                        continue
                    found = [word[at : at + size]]
                    if i < k and at + size < len(word):
                        found.append(word[at : at + size - 1] + word[at + size])
                    if i and at:
                        found.append(word[at - 1] + word[at + 1 : at + size])
                    for x in found:
                        met.update(index.get((length, i, x), ()))
        return [(d, x) for x in met if (d := banded_distance(word, x, k)) <= k]


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    base, long = divmod(length, parts)
    sizes = [base + (i >= parts - long) for i in range(parts)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(parts)]


def _posted(strings: DataFrame, k: int, names: tuple[str, str]) -> DataFrame:
    """The inverted index: one row per segment of every string."""
    parts = k + 1
    df = strings.withColumn("_l", F.length("key")).where(F.col("_l") >= parts)
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    start, size = _segment(F.col("_l"), F.col("_i"), parts)
    return df.select(
        F.xxhash64("ns", "_l", "_i", F.substring(F.col("key"), start, size)).alias("_post"),
        F.col("ns").alias(names[0]),
        F.col("key").alias(names[1]),
    )


def _looked_up(strings: DataFrame, k: int, both_ways: bool) -> DataFrame:
    """Every substring that may equal a segment of an indexed string of a length from l - k to l (or l + k)."""
    parts = k + 1
    df = strings.withColumn("_s", F.length("key"))
    lengths = F.sequence(F.greatest(F.lit(parts), F.col("_s") - k), F.col("_s") + (k if both_ways else 0))
    df = df.where(F.col("_s") >= parts - (k if both_ways else 0)).withColumn("_l", F.explode(lengths))
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    start, size = _segment(F.col("_l"), F.col("_i"), parts)
    df = df.withColumn("_p", start).withColumn("_n", size)
    df = df.withColumn("_at", F.explode(F.sequence(F.col("_p") - k, F.col("_p") + k)))
    df = df.where((F.col("_at") >= 1) & (F.col("_at") + F.col("_n") - 1 <= F.col("_s")))
    # the shift before a segment and what is left of the difference in length behind it take an edit each
    shift = F.col("_at") - F.col("_p")
    df = df.where(F.abs(shift) + F.abs(F.col("_s") - F.col("_l") - shift) <= k)
    part = lambda at, n: F.substring(F.col("key"), at, n)
    at, n, last = F.col("_at"), F.col("_n"), F.col("_at") + F.col("_n")
    found = F.array(
        part(at, n),
        F.when((F.col("_i") < k) & (last <= F.col("_s")), F.concat(part(at, n - 1), part(last, F.lit(1)))),
        F.when((F.col("_i") > 0) & (at > 1), F.concat(part(at - 1, F.lit(1)), part(at + 1, n - 1))),
    )
    df = df.withColumn("_found", F.explode(F.array_distinct(F.array_compact(found))))
    return df.select(F.xxhash64("ns", "_l", "_i", "_found").alias("_post"), "ns", "key")


def similar_pairs(strings: DataFrame, k: int = 2) -> DataFrame:
    """All pairs of different keys of one ``ns`` that are within ``k`` edits: ns, key_a < key_b, edits.

    strings: ns string, key string, in any number of rows; null keys are left
    out, keys of fewer than k + 1 characters have no partner. An empty input
    gives no pair; other columns are ignored.
    """
    s = strings.select("ns", "key").where("ns is not null and key is not null").distinct()
    met = (
        _looked_up(s, k, both_ways=False)
        .join(_posted(s, k, ("_ns", "_key")).hint("merge"), "_post")
        .where((F.col("ns") == F.col("_ns")) & (F.col("key") != F.col("_key")))
        .select("ns", F.least("key", "_key").alias("key_a"), F.greatest("key", "_key").alias("key_b"))
        .where(F.levenshtein("key_a", "key_b", 2 * k) >= 0)  # a swap counts two there; keeps most pairs from Python
        .distinct()
    )
    return met.withColumn("edits", distance_udf(k)("key_a", "key_b")).where(F.col("edits") <= k)


def similar_to(strings: DataFrame, reference: DataFrame, k: int = 2) -> DataFrame:
    """Keys of ``strings`` within ``k`` edits of a key of ``reference`` of the same ``ns``: ns, key, ref, edits.

    Equal keys are included at any length; others need references of at least
    k + 1 characters. Null keys are left out on both sides.
    """
    return near_to(strings, reference, k).unionByName(equal_to(strings, reference))


def near_to(strings: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """The pairs of :func:`similar_to` that are not equal."""
    s = strings.select("ns", "key").where("ns is not null and key is not null").distinct()
    r = reference.select("ns", "key").where("ns is not null and key is not null").distinct()
    met = (
        _looked_up(s, k, both_ways=True)
        .join(_posted(r, k, ("_ns", "ref")).hint("merge"), "_post")
        .where((F.col("ns") == F.col("_ns")) & (F.col("key") != F.col("ref")))
        .select("ns", "key", "ref")
        .where(F.levenshtein("key", "ref", 2 * k) >= 0)
        .distinct()
    )
    return met.withColumn("edits", distance_udf(k)("key", "ref")).where(F.col("edits") <= k)


def equal_to(strings: DataFrame, reference: DataFrame) -> DataFrame:
    """The equal pairs of :func:`similar_to`."""
    s = strings.select("ns", "key").where("ns is not null and key is not null").distinct()
    return s.join(reference.select("ns", "key"), ["ns", "key"], "left_semi").select("ns", "key", F.col("key").alias("ref"), F.lit(0).alias("edits"))
