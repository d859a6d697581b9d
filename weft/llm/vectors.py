"""The k most similar vectors of every vector, by a permutation index.

A vector is represented by its PREFIX nearest pivots in order of nearness.
Pivots are a bounded sample of the vectors; every vector is posted in the
inverted files of its first ``posted`` pivots. Within a file vectors are ranked
for each other by the footrule distance of their pivot orders (a pivot beyond
the prefix counts as place PREFIX), exact cosines are computed for the best of
them only, ties at the last place included, and the results of all files are
merged. A file that a sample shows to be long is cut into parts, and each pair of
parts is a file of its own.

The footrule distance of two prefixes is a constant less twice the sum of
min(PREFIX - place_a, PREFIX - place_b) over common pivots. That sum is a count
of common bits when each vector has one bit set per number of leading pivots, so
a machine word compares 64 pivots at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.plans.lookup import lookup
from weft.plans.storage import materialize

PREFIX = 8
WORDS = 2
#: Most pivots: a bound of the sample and of what is broadcast (64 MB at 64 dimensions); enough for 10^10 vectors.
MAX_PIVOTS = 262_144
#: Best by footrule that are reranked, in each inverted file.
RERANKED = 64
#: Rows of a file compared at once, and pairs whose cosines are computed at once.
BLOCK = 256
PAIRS = 1 << 15
DENSE = 3
#: Vectors that one task of the index holds, about.
ROWS_A_TASK = 30_000
#: Vectors of a file, or of a part of a long one, about.
FILE_ROWS = 20_000
#: Sampled vectors that the lengths of the files are estimated from, and the most parts that a file is cut into.
MEASURED, MAX_PARTS = 20_000, 1000


def pivots_for(rows: int, density: float = 2.6) -> int:
    """Number of pivots: grows with the square root, so files grow no faster."""
    return max(8, min(MAX_PIVOTS, 1 << round(math.log2(max(density * math.sqrt(max(rows, 1)), 1)))))


def latest(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows without those that a later row of their id replaces; exact copies stay."""
    place = F.struct(*(F.coalesce(F.col(c).cast("long"), F.lit(-(2**63))).alias(c) for c in order))
    rows = rows.where("id is not null").withColumn("_place", place)
    ids = rows.groupBy("id").agg(F.max("_place").alias("_last"), F.min("_place").alias("_first"))
    replaced = materialize(ids.where("_first <> _last").select("id", "_last"), "vectors-replaced")
    return lookup(rows, replaced, ["id"], "left").where("_last is null or _last = _place").select("id", "vector")


def _valid(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors and unit vectors of the rows that hold a usable vector."""
    vector, ids = batch.column("vector"), batch.column("id")
    mask = pc.fill_null(pc.equal(pc.list_value_length(vector), dim), False)
    x = vector.filter(mask).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    ids = ids.filter(mask).to_numpy(zero_copy_only=False)
    wide = x.astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((wide * wide).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
    return ids[good], x[good], wide[good] / norm[good, None]


def _classes(unit: np.ndarray) -> np.ndarray:
    """One hash for all vectors of the same direction."""
    rounded = (unit + 0.0).astype(np.float32)
    return np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in rounded], dtype=np.uint64).view(np.int64)


def _binary(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    ends = np.arange(len(x) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    size = min(size, len(pivots))
    out = np.zeros((len(unit), size), dtype=np.int32)
    for at in range(0, len(unit), 2048):
        near = unit[at : at + 2048].astype(np.float32) @ pivots.T
        some = np.argpartition(-near, size - 1, axis=1)[:, :size]
        order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
        out[at : at + 2048] = np.take_along_axis(some, order, 1)
    return out


def file_parts(units: np.ndarray, pivots: np.ndarray, posted: int, count: int, file_rows: int) -> np.ndarray:
    """Parts of every pivot's file, from the share of a sample that is posted there."""
    parts = np.ones(len(pivots), dtype=np.int64)
    if count * posted > file_rows and len(units):
        files = nearest_pivots(units[:MEASURED], pivots, posted)
        held = np.bincount(files.ravel(), minlength=len(pivots)) / min(len(units), MEASURED) * count
        parts = np.clip(np.ceil(held / file_rows), 1, MAX_PARTS).astype(np.int64)
    return parts


def place_kind(pivots: int) -> type:
    """The narrowest number that names a pivot; orders travel with every posting."""
    return np.uint16 if pivots <= 1 << 16 else np.uint32


def _index(rows: DataFrame, dim: int, pivots, parts, posted: int) -> DataFrame:
    """file: the pivot, and for a file in parts also the pair of parts that meet."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = parts.value
        for batch in batches:
            _, x, unit = _valid(batch, dim)
            if not len(x):
                continue
            names, first = np.unique(_classes(unit), return_index=True)  # equal vectors post once a batch
            x, unit = x[first], unit[first]
            prefix = nearest_pivots(unit, pivots.value, PREFIX)
            for j in range(min(posted, prefix.shape[1])):
                into = cut[prefix[:, j]]
                mine = (names.view(np.uint64) % into.astype(np.uint64)).astype(np.int64)
                for other in range(int(into.max())):
                    some = np.flatnonzero(into > other)
                    cell = np.minimum(mine, other) * MAX_PARTS + np.maximum(mine, other)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((prefix[:, j].astype(np.int64) * MAX_PARTS**2 + cell)[some]), pa.array(names[some]), _binary(x[some]), _binary(prefix[some].astype(place_kind(len(pivots.value))))],
                        ["file", "class", "vector", "prefix"],
                    )

    return rows.mapInArrow(post, "file long, class long, vector binary, prefix binary")


def footrule_bits(prefix: np.ndarray) -> np.ndarray:
    """(rows, PREFIX, WORDS) words: level t has the bits of the first PREFIX - t pivots; pivots of one row only have none."""
    names, local, times = np.unique(prefix, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    slot = np.empty(len(names), dtype=np.int64)
    slot[order] = np.arange(len(names)) % (64 * WORDS)
    slot = slot[local.reshape(prefix.shape)]
    bit = np.where(times[local.reshape(prefix.shape)] > 1, np.uint64(1) << (slot % 64).astype(np.uint64), np.uint64(0))
    out = np.zeros((len(prefix), prefix.shape[1], WORDS), dtype=np.uint64)
    for place in range(prefix.shape[1]):
        for w in range(WORDS):
            out[:, : prefix.shape[1] - place, w] |= np.where(slot[:, place] // 64 == w, bit[:, place], np.uint64(0))[:, None]
    return out


def _rank(k: int, least: float, dim: int, reranked: int, share: float, kind: type):
    def one(names: np.ndarray, x: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        names, first = np.unique(names, return_index=True)
        n = len(names)
        if n < 2:
            return
        wide = x[first].astype(np.float64)
        wide /= np.sqrt((wide * wide).sum(axis=1))[:, None]
        unit, bits = wide.astype(np.float32), footrule_bits(prefix[first])
        block = max(16, min(BLOCK, 4_000_000 // n))
        best, tried = min(k + 3, n - 1), max(reranked, int(share * n))
        for at in range(0, n, block):
            rows = slice(at, min(at + block, n))
            size = rows.stop - at
            common = np.zeros((size, n), dtype=np.uint8)
            for t in range(bits.shape[1]):
                for w in range(WORDS):
                    common += np.bitwise_count(bits[rows, t, w][:, None] & bits[None, :, t, w])
            common[np.arange(size), np.arange(rows.start, rows.stop)] = 0
            least_common = np.ones(size, dtype=np.uint8)  # vectors of one file have its pivot in common
            if n > tried + 1:
                least_common = np.maximum(1, np.partition(common, n - tried, axis=1)[:, n - tried])
            i, j = np.nonzero(common >= least_common[:, None])
            cosine = np.empty(len(i), dtype=np.float32)
            if len(i) * DENSE > size * n:  # so many are reranked that one product of the whole block costs less
                cosine[:] = (unit[rows] @ unit.T)[i, j]
            for c in range(0, len(i) if len(i) * DENSE <= size * n else 0, PAIRS):
                cosine[c : c + PAIRS] = np.einsum("ij,ij->i", unit[i[c : c + PAIRS] + at], unit[j[c : c + PAIRS]])
            good = cosine >= least - 1e-5
            i, j, cosine = i[good], j[good], cosine[good]
            order = np.lexsort((-cosine, i))
            i, j = i[order], j[order]
            good = np.arange(len(i)) - np.searchsorted(i, i) < best
            i, j = i[good], j[good]
            cosine = np.einsum("ij,ij->i", wide[i + at], wide[j])
            good = cosine >= least
            yield names[i + at][good], names[j][good], cosine[good]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), np.float32), _matrix(b.column(3), kind)) for b in batches if b.num_rows]
        if not got:
            return
        file, names, x, prefix = (np.concatenate(v) for v in zip(*got))
        del got
        order = np.argsort(file, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(file[order])) + 1):
            for a, b, cosine in one(names[part], x[part], prefix[part]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cosine)], ["a", "b", "cosine"])

    return rank


def _matrix(column: pa.Array, kind) -> np.ndarray:
    n = len(column)
    _, ends, data = column.buffers()
    width = 8 if pa.types.is_large_binary(column.type) else 4
    ends = np.frombuffer(ends, dtype=f"<i{width}")[column.offset : column.offset + n + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(n, -1)


def most_similar(
    rows: DataFrame, dim: int, k: int = 5, least: float = -1.0, posted: int = 3, reranked: int = RERANKED, share: float = 0.0, density: float = 2.6,
    file_rows: int = FILE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(members: id, class; lists: class, near array<struct<id, cosine>>).

    posted: files that a vector is posted in. reranked, share: how many of a file,
    or which share of it if that is more, are reranked. density: pivots per
    square root of the rows; fewer pivots make longer files. file_rows: vectors
    of a file beyond which it is cut into parts. The defaults suit neighbours of
    high cosine; distant ones share fewer pivots.

    rows: id long, vector array<float>. Vectors of one direction are one class.
    ``near`` has, best first, up to k + 1 ids for the class with a cosine of at
    least ``least``, its own ids among them: the first k without the id itself
    are an id's most similar ones. See :func:`neighbours`.

    Defined cases: null ids, null vectors, those of another length than ``dim``,
    with a null, NaN or infinite component, and all-zero ones are left out; an
    id with several vectors has the one of the least class; ties go to the
    smaller id; fewer than two vectors give no neighbours; no rows give no rows;
    other columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select("id", F.col("vector").cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") == dim))
    count = rows.count()
    wanted = pivots_for(count, density)
    # a sample by hash, somewhat more than the pivots: no task sends more than its part of it
    within = min(1.0, (1.2 * wanted + 100) / max(count, 1))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(within * (1 << 30)) + 1).dropDuplicates(["id"])
    sampled = sample.toArrow().cast(pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float32()))])).combine_chunks().to_batches()
    units = _valid(sampled[0], dim)[2].astype(np.float32) if sampled else np.zeros((0, dim), np.float32)
    pivots = np.unique(units, axis=0)
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))[:wanted]]
    if not len(pivots):
        pivots = np.eye(1, dim, dtype=np.float32)
    parts = file_parts(units, pivots, posted, count, file_rows)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, unit = _valid(batch, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_classes(unit), pa.int64())], ["id", "class"])

    members = rows.mapInArrow(classify, "id long, class long").groupBy("id").agg(F.min("class").alias("class"))
    members = materialize(members, "vectors-members")
    tasks = max(spark.sparkContext.defaultParallelism, posted * count // ROWS_A_TASK)
    met = (
        _index(rows, dim, spark.sparkContext.broadcast(pivots), spark.sparkContext.broadcast(parts), posted)
        .repartition(tasks, "file")
        .mapInArrow(_rank(k, least, dim, reranked, share, place_kind(len(pivots))), "a long, b long, cosine double")
    )
    # a class speaks through its k + 1 least ids
    speakers = members.withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("_r") <= k + 1)
    speakers = materialize(speakers.groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors-speakers")
    near = met.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    near = near.join(speakers.select(F.col("class").alias("b"), "ids"), "b").select(F.col("a").alias("class"), "cosine", F.explode("ids").alias("id"))
    near = near.unionByName(speakers.select("class", F.lit(1.0).alias("cosine"), F.explode("ids").alias("id")))
    best = Window.partitionBy("class").orderBy(F.desc(F.round("cosine", 9)), "id")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    lists = near.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "cosine"))).alias("near"))
    lists = lists.select("class", F.transform("near", lambda x: F.struct(x["id"].alias("id"), x["cosine"].alias("cosine"))).alias("near"))
    return members, materialize(lists, "vectors-lists")


def neighbours(members: DataFrame, lists: DataFrame, k: int = 5) -> DataFrame:
    """id, other, cosine, rank: the up to k most similar others of every id."""
    own = lookup(members, lists, ["class"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return own.select("id", F.posexplode(others).alias("_at", "_x")).select(
        "id", F.col("_x.id").alias("other"), F.col("_x.cosine").alias("cosine"), (F.col("_at") + 1).alias("rank")
    )


def exact_neighbours(rows: DataFrame, queries: DataFrame, dim: int, k: int = 5, block: int = 4096) -> DataFrame:
    """id, other, cosine of the k most similar rows of each query id by brute force, a block of queries at a time."""
    parts = []
    queries = materialize(queries.select("id", "vector").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, queries.count() // block)))), "vectors-queries")
    for r in queries.select("_b").distinct().toLocalIterator():
        got = queries.where(F.col("_b") == r["_b"]).select("id", "vector").toArrow().combine_chunks().to_batches()
        if not got:
            continue
        qid, _, qunit = _valid(got[0].cast(pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float32()))])), dim)

        def scan(batches: Iterator[pa.RecordBatch], qid=qid, qunit=qunit) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, _, unit = _valid(batch, dim)
                if len(ids) and len(qid):
                    near = qunit @ unit.T
                    near[qid[:, None] == ids[None, :]] = -2
                    top = min(k, len(ids))
                    j = np.argpartition(-near, top - 1, axis=1)[:, :top]
                    value = np.take_along_axis(near, j, 1).ravel()
                    good = value > -1.5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qid, top)[good]), pa.array(ids[j.ravel()][good]), pa.array(value[good])], ["id", "other", "cosine"]
                    )

        parts.append(rows.select("id", "vector").mapInArrow(scan, "id long, other long, cosine double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "id long, other long, cosine double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other")
    return found.distinct().withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
