"""Near-duplicate texts: sets of word shingles whose Jaccard similarity reaches a threshold, by pigeonring filtering.

Similarity t of sets A and B means that they differ in at most
H = (1 - t) / (1 + t) * (|A| + |B|) shingles. Four steps, all exact:

1. Scan: each text becomes a fingerprint of its set (equal sets are one class
   from here on), its size, and a ring of SEGMENTS parity words, one per class
   of shingle hashes. A table of counters takes the frequency of all
   shingles; its size is bounded, a collision only makes a shingle look commoner.
2. Index: every set posts its rarest (1 - t) * |A| + MEET shingles. Similar
   sets meet at least MEET times there, and early enough in both (positions).
   Postings travel packed, and pairs are counted, not listed per shingle. The
   sets of a shingle that more than HOT texts have are dealt into groups, and
   each pair of groups meets in a place of its own.
3. Pigeonring: parity words give a lower bound of the difference in each
   segment. If the differences sum to at most H, some segment starts a chain
   around the ring in which every prefix of l segments sums to at most
   l * H / SEGMENTS; pairs without such a chain are dropped as soon as no start
   is left. Followed all around the ring this drops exactly the pairs whose
   differences sum to more than H, most of them after a few segments.
4. Full Hamming check of the remaining pairs on their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shingles import WordHashes, fingerprints, mixed, shingle_sets
from weft.plans.storage import materialize

SEGMENTS = 16
#: Bits of a parity word.
BITS = 32
#: Counters: one for so many bytes of the input's files, a power of two between these bounds.
BYTES_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 128, 1 << 20, 1 << 24
BLOCKS = 64
MEET = 3
#: Postings that one task of the index takes.
POSTINGS_A_TASK = 1_000_000
#: A shingle that so many texts have, about, is compared in several places.
HOT = 20_000
MAX_GROUPS = 1000
#: A posting's place in 14 bits (an earlier place than the true one only makes more candidates) and its side of a pair of groups in 2.
PLACE_BITS, MOST_PLACE, BOTH = 14, (1 << 14) - 1, 2
#: The filter that keeps texts without a candidate pair from being read again has this many bits a candidate, between these bounds (128 KB to 128 MB).
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
FILTER_TASKS = 8
EPS = 1e-9


def _owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def _rings(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Parity words of each text, as (texts, SEGMENTS) uint32: a bit says whether an odd number of shingles falls on it."""
    cells = SEGMENTS * BITS
    cell = owner * cells + (mixed(h) >> np.uint64(64 - 9)).astype(np.int64)
    odd = (np.bincount(cell, minlength=texts * cells) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(texts, SEGMENTS, BITS), axis=2, bitorder="little").view("<u4").reshape(texts, SEGMENTS)


def _counters(texts: DataFrame) -> int:
    """By the planner's size of the input; the least for an input of unknown size, which is no table of files."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 1 << 60 else 0
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << int(size / BYTES_A_COUNTER).bit_length()))


def _cells(h: np.ndarray, counters: int) -> np.ndarray:
    return (h >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _scan(texts: DataFrame, width: int, counters: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = WordHashes(), np.zeros(counters, dtype=np.int64)
        for batch in batches:
            h, owner, n = shingle_sets(batch["text"].tolist(), width, known)
            if not len(h):
                continue
            counts += np.bincount(_cells(h, counters), minlength=counters)
            some = np.flatnonzero(n)
            rings = _rings(h, owner, len(n))
            yield pd.DataFrame(
                {
                    "id": batch["id"].to_numpy()[some], "fp": fingerprints(h, n).view(np.int64)[some], "n": n[some].astype(np.int32),
                    "ring": [r.tobytes() for r in rings[some]], "block": np.int32(-1), "counts": None, "task": None,
                }
            )
        task = TaskContext.get().partitionId()
        for b, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                kind = np.min_scalar_type(int(part.max()))
                yield pd.DataFrame({"id": [None], "fp": [0], "n": [0], "ring": [None], "block": [b], "counts": [part.astype(kind).tobytes()], "task": [task]})

    return texts.mapInPandas(scan, "id string, fp long, n int, ring binary, block int, counts binary, task int")


def _frequencies(scanned: DataFrame, tasks: int, counters: int) -> np.ndarray:
    """The counters of all texts, added in two rounds of about sqrt(tasks) tables each."""
    cells = counters // BLOCKS

    def add(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cells, dtype=np.int64)
        for data in batch["counts"]:
            total += np.frombuffer(data, dtype=f"<u{len(data) // cells}").astype(np.int64)
        return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    fan = math.isqrt(tasks) + 1
    some = scanned.where("block >= 0").groupBy("block", F.pmod("task", F.lit(fan))).applyInPandas(add, "block int, counts binary")
    out = np.zeros(counters, dtype=np.int64)
    for r in some.groupBy("block").applyInPandas(add, "block int, counts binary").toLocalIterator():
        out[r["block"] * cells : (r["block"] + 1) * cells] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def _prefix_sizes(n: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(t * n - EPS).astype(np.int64) + MEET)


def _labels(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` partitions a number that is hashed into it, so that every task of the index gets one part."""
    place = F.pmod(F.hash("n"), F.lit(parts)).alias("place")
    found = spark.range(parts * 40).select(F.col("id").cast("int").alias("n")).groupBy(place).agg(F.min("n").alias("n")).collect()
    labels = np.arange(parts, dtype=np.int64)
    for r in found:
        labels[r["place"]] = r["n"]
    return labels


def _dealt(h, owner, at, fp, groups):
    """Postings of hot shingles once for each pair of groups that theirs is in, with the side of the pair they stand on."""
    out = [(h[groups == 1], owner[groups == 1], at[groups == 1], np.full(int((groups == 1).sum()), BOTH))]
    mine = (mixed(fp.view(np.uint64)) % groups.astype(np.uint64)).astype(np.int64)
    for other in range(int(groups.max())):
        some = np.flatnonzero((groups > 1) & (groups > other))
        a, b = np.minimum(mine[some], other), np.maximum(mine[some], other)
        cell = (a * MAX_GROUPS + b + 1).astype(np.uint64)
        out.append((mixed(h[some] + cell), owner[some], at[some], np.where(a == b, BOTH, (mine[some] == b).astype(np.int64))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _post(texts: DataFrame, width: int, t: float, frequency, labels: np.ndarray, hot: int) -> DataFrame:
    """Postings of the rarest shingles, packed per task of the index."""
    parts = len(labels)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rare = WordHashes(), frequency.value
        load = int(np.median(rare))
        whole = (batch["text"].tolist() for batch in batches)
        for texts in (x[at : at + 65_536] for x in whole for at in range(0, len(x), 65_536)):  # sets are numbered in 16 bits
            h, owner, n = shingle_sets(texts, width, known)
            if not len(h):
                continue
            fp = fingerprints(h, n)
            fp, keep = np.unique(fp[n > 0], return_index=True)  # a set posts once a batch
            keep = np.flatnonzero(n > 0)[keep]
            new = np.full(len(n), -1)
            new[keep] = np.arange(len(keep))
            mine = new[owner] >= 0
            h, owner, n = h[mine], new[owner[mine]], n[keep]
            order = np.lexsort((rare[_cells(h, len(rare))], owner))  # stable: ties stay in order of the hash
            h, owner = h[order], owner[order]
            n = np.bincount(owner, minlength=len(fp))
            at = np.arange(len(h)) - (np.cumsum(n) - n)[owner]
            use = at < _prefix_sizes(n, t)[owner]
            h, owner, at = h[use], owner[use], at[use]
            # what a counter has beyond the usual load, which other shingles brought
            groups = np.minimum(np.maximum(rare[_cells(h, len(rare))].astype(np.int64) - load, 0) // hot + 1, MAX_GROUPS)
            at, h, side = np.minimum(at, MOST_PLACE), mixed(h), np.full(len(h), BOTH)
            if (groups > 1).any():
                h, owner, at, side = _dealt(h, owner, at, fp[owner], groups)
            at = at | (side << PLACE_BITS)
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((owner, part))
            h, owner, at, part = h[order], owner[order], at[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            rows = []
            for p, hs, os, ps in zip(part[np.concatenate(([0], cuts))], np.split(h, cuts), np.split(owner, cuts), np.split(at, cuts)):
                docs, local = np.unique(os, return_inverse=True)
                rows.append(
                    (
                        int(labels[p]), hs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), local.astype("<u2").tobytes(),
                        ps.astype("<u2").tobytes(), fp[docs].tobytes(), n[docs].astype("<u4").tobytes(),
                    )
                )
            yield pd.DataFrame(rows, columns=["part", "keys", "docs", "places", "fps", "sizes"])

    schema = "part int, keys binary, docs binary, places binary, fps binary, sizes binary"
    return texts.mapInPandas(post, schema)


def _meet(t: float):
    share = t / (1 + t)

    def unpack(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for keys, docs, places, fps, sizes in zip(*(batch[c] for c in ("keys", "docs", "places", "fps", "sizes"))):
                local = np.frombuffer(docs, "<u2")
                wide = np.zeros((len(local), 8), np.uint8)
                wide[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
                yield wide.view("<u8").ravel(), np.frombuffer(fps, np.int64)[local], np.frombuffer(sizes, "<u4")[local], np.frombuffer(places, "<u2")

    def counted(a, b, na, nb) -> pd.DataFrame:
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(a)))
        return pd.DataFrame({"a": a[at], "b": b[at], "na": na[at].astype(np.int32), "nb": nb[at].astype(np.int32), "times": times.astype(np.int32)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(unpack(batches))
        if not got:
            return
        key, fp, n, at = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((fp, key))
        key, fp, n, at = key[order], fp[order], n[order].astype(np.int64), at[order].astype(np.int64)
        side, at = at >> PLACE_BITS, at & MOST_PLACE
        one = np.ones(len(key), dtype=bool)
        one[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])  # copies post the same
        key, fp, n, at, side = key[one], fp[one], n[one], at[one], side[one]
        held, kept = [], 0
        live, step = np.arange(len(key)), 1
        while len(live):
            live = live[live + step < len(key)]
            live = live[key[live] == key[live + step]]
            for x in np.array_split(live, max(1, len(live) // 2_000_000)):
                y = x + step
                need = np.ceil(share * (n[x] + n[y]) - EPS)
                good = np.minimum(n[x] - at[x], n[y] - at[y]) + np.minimum(MEET, need) - 1 >= need
                good &= (side[x] != side[y]) | (side[x] == BOTH)
                x, y = x[good], y[good]
                if len(x):
                    held.append((fp[x], fp[y], n[x], n[y]))  # sorted by fp within a key
                    kept += len(x)
                if kept > 4_000_000:
                    yield counted(*(np.concatenate(v) for v in zip(*held)))
                    held, kept = [], 0
            step += 1
        if held:
            yield counted(*(np.concatenate(v) for v in zip(*held)))

    return meet


def ring_holds(a: np.ndarray, b: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Whether a chain around the ring stays within its proportional budgets; a, b: (pairs, SEGMENTS) parity words."""
    alive = np.ones(len(a), dtype=bool)
    quota = budget / a.shape[1]
    starts = np.ones(a.shape, dtype=bool)
    total = np.zeros(a.shape, dtype=np.float64)
    differ = np.bitwise_count(a ^ b).astype(np.float64)
    for length in range(1, a.shape[1] + 1):
        total[alive] += np.roll(differ[alive], 1 - length, axis=1)
        starts[alive] &= total[alive] <= length * quota[alive, None] + EPS
        alive &= starts.any(axis=1)
        if not alive.any():
            break
    return alive


def _pigeonring(t: float):
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), "<u4").reshape(-1, SEGMENTS) for c in ("ring_a", "ring_b"))
                budget = np.floor((1 - t) / (1 + t) * (batch["na"] + batch["nb"]).to_numpy() + EPS)
                yield batch.loc[ring_holds(a, b, budget), ["a", "b"]]

    return prune


def _filter_places(x: np.ndarray, bits: int) -> np.ndarray:
    y = mixed(x.view(np.uint64) if x.dtype == np.int64 else x)
    return np.concatenate((y % np.uint64(bits), (y >> np.uint64(32)) % np.uint64(bits))).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``id``, built on the executors; its size grows with their number up to MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * ids.count()).bit_length()))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = _filter_places(batch["id"].to_numpy(), bits)
            np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for b, part in enumerate(np.split(packed, BLOCKS)):
            if part.any():
                yield pd.DataFrame({"block": [b], "bits": [part.tobytes()]})

    size = bits // 8 // BLOCKS

    def unite(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.uint8)
        for data in batch["bits"]:
            out |= np.frombuffer(data, np.uint8)
        return pd.DataFrame({"block": [key[0]], "bits": [out.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    few = ids.repartition(FILTER_TASKS)  # each of them sends a whole filter
    for r in few.mapInPandas(build, "block int, bits binary").groupBy("block").applyInPandas(unite, "block int, bits binary").toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _sets(texts: DataFrame, width: int, wanted) -> DataFrame:
    """fp and the whole set (40 bits a shingle) of the texts whose id the filter lets pass."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, packed = WordHashes(), wanted.value
        for batch in batches:
            at = _filter_places(batch["hash"].to_numpy(), 8 * len(packed))
            hit = ((packed[at >> 3] >> (at & 7)) & 1).astype(bool).reshape(2, -1).all(axis=0)
            h, _, n = shingle_sets(batch["text"][hit].tolist(), width, known)
            if not len(h):
                continue
            fp, ends, rows = fingerprints(h, n), np.cumsum(n), []
            for i in np.flatnonzero(n):
                part = np.sort(mixed(h[ends[i] - n[i] : ends[i]]) >> np.uint64(24))
                rows.append((int(fp[i].view(np.int64)), part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()))
            yield pd.DataFrame(rows, columns=["fp", "shingles"])

    return texts.select(F.xxhash64("id").alias("hash"), "text").mapInPandas(sets, "fp long, shingles binary")


def _hamming(t: float):
    def unpack(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) // 5 for x in column])
        wide = np.zeros((int(n.sum()), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(column), np.uint8).reshape(-1, 5)
        return wide.view("<u8").ravel() | (_owners(n).astype(np.uint64) << np.uint64(40)), n

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                (a, na), (b, nb) = unpack(batch["shingles_a"]), unpack(batch["shingles_b"])
                both = np.sort(np.concatenate((a, b)), kind="stable")
                twice = both[1:][both[1:] == both[:-1]]
                common = np.bincount((twice >> np.uint64(40)).astype(np.int64), minlength=len(batch))
                alike = common / (na + nb - common)
                out = batch[["a", "b"]].assign(similarity=alike)
                yield out[alike >= t - EPS]

    return check


def near_duplicates(
    texts: DataFrame, id: str, text: str, threshold: float = 0.8, width: int = 5, hot: int = HOT, stages: dict[str, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal shingle sets, and the pairs of similar classes.

    Returns (members: id string, fp long, n int; pairs: a < b, similarity), where a and b
    are the fp of two different sets of which at least ``threshold`` of the
    shingles of either are in both. Words are runs of letters and digits in lower
    case, shingles are ``width`` consecutive words. hot: see HOT. ``stages``, if
    given, gets the pairs that met in the index, those that the ring left, and
    those that are similar.

    Defined cases: null and empty texts and those of fewer than ``width`` words
    are in no class; repeated rows give one member; an id with several texts is
    a member of several classes; no texts give no rows; other columns of the
    input are ignored. Row order plays no part.
    """
    spark = texts.sparkSession
    source = texts.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text <> ''")
    counters = _counters(source)
    scanned = materialize(_scan(source, width, counters), "near-scan")
    members = scanned.where("block < 0").select("id", "fp", "n").distinct()
    total, last = scanned.agg(F.sum("n"), F.max("task")).first()
    total = total or 0
    frequency = spark.sparkContext.broadcast(_frequencies(scanned, (last or 0) + 1, counters))
    parts = max(spark.sparkContext.defaultParallelism, int(total * (1 - threshold) / POSTINGS_A_TASK) + 1)
    met = (
        _post(source, width, threshold, frequency, _labels(spark, parts), hot)
        .repartition(parts, "part")
        .mapInPandas(_meet(threshold), "a long, b long, na int, nb int, times int")
        .groupBy("a", "b")
        .agg(F.sum("times").alias("times"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    )
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - EPS)
    candidates = materialize(met.where(F.col("times") >= F.least(F.lit(MEET), need)).select("a", "b", "na", "nb"), "near-candidates")

    rings = scanned.where("block < 0").select("fp", "ring").groupBy("fp").agg(F.first("ring").alias("ring"))
    ringed = candidates.join(rings.select(F.col("fp").alias("a"), F.col("ring").alias("ring_a")), "a").join(
        rings.select(F.col("fp").alias("b"), F.col("ring").alias("ring_b")), "b"
    )
    alive = materialize(ringed.mapInPandas(_pigeonring(threshold), "a long, b long"), "near-ring")
    # of each class that is left one text is read again
    needed = alive.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    speakers = members.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id"))
    wanted = spark.sparkContext.broadcast(_filter(speakers.select(F.xxhash64("id").alias("id"))))
    sets = _sets(source, width, wanted).join(needed, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "near-sets")
    pairs = (
        alive.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("shingles_a")), "a")
        .join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("shingles_b")), "b")
        .mapInPandas(_hamming(threshold), "a long, b long, similarity double")
    )
    pairs = materialize(pairs, "near-pairs")
    if stages is not None:
        stages |= {"met": candidates, "ring": alive, "similar": pairs}
    return members, pairs
