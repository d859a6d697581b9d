import math

import numpy as np
import pytest

from weft.llm import vectors as V

DIM = 8


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, DIM))
    return np.concatenate([base, *(base + rng.normal(scale=0.15, size=base.shape) for _ in range(3))]).astype(np.float32)


def brute(x, k, least):
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = np.round(unit @ unit.T, 9)
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-near[i, j], j))[:k]
        out |= {(i, j) for j in order if near[i, j] >= least}
    return out


def found(spark, rows, k, least):
    df = spark.createDataFrame(rows, "id long, vector array<float>, cosine int, near int")
    return {(r.id, r.other) for r in V.neighbours(*V.most_similar(df, DIM, k, least), k).where(f"cosine >= {least}").collect()}


def test_recall_and_order(spark):
    x = data(800)
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)]
    wanted, got = brute(x, 5, 0.9), found(spark, rows, 5, 0.9)
    assert got <= wanted | {(b, a) for a, b in wanted} or len(got - wanted) < 0.05 * len(got)
    assert len(got & wanted) / len(wanted) >= 0.9


def test_long_files_are_cut(spark):
    x = data(400, 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    whole, cut = (
        {(r.id, r.other) for r in V.neighbours(*V.most_similar(df, DIM, 5, 0.9, reranked=400, file_rows=rows), 5).collect()} for rows in (10**9, 15)
    )
    assert whole == cut and len(cut & brute(x, 5, 0.9)) >= 0.9 * len(brute(x, 5, 0.9))
    units = x / np.linalg.norm(x, axis=1)[:, None]
    assert V.file_parts(units, units[:8], 3, 400, 15).max() > 2 and set(V.file_parts(units, units[:8], 3, 400, 10**9)) == {1}


def test_copies_ties_and_dirt(spark):
    x = data(40, 3)
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)]
    rows += [(100 + i, (x[0] * 2.0 ** (i % 5)).tolist(), 1, 1) for i in range(60)]  # one direction in many lengths
    rows += [(100, (x[0]).tolist(), 1, 1), (500, None, 1, 1), (501, [0.0] * DIM, 1, 1), (502, [math.nan] * DIM, 1, 1), (503, [1.0] * 3, 1, 1), (None, x[1].tolist(), 1, 1), (504, [None] * DIM, 1, 1), (505, [math.inf] * DIM, 1, 1)]
    got = found(spark, rows, 5, 0.99)
    for i in [0, *range(100, 160)]:
        assert sorted(b for a, b in got if a == i) == [j for j in [0, *range(100, 160)] if j != i][:5]
    assert not {a for a, _ in got} & {500, 501, 502, 503, 504, 505}


def test_few_rows(spark):
    assert found(spark, [], 5, 0.5) == set()
    assert found(spark, [(1, [1.0] * DIM, 1, 1)], 5, 0.5) == set()
    assert found(spark, [(1, [1.0] * DIM, 1, 1), (2, [2.0] * DIM, 1, 1)], 5, 0.5) == {(1, 2), (2, 1)}


def test_latest(spark):
    rows = [(1, 1, 7, [1.0]), (1, 2, 7, [2.0]), (2, 1, 7, [3.0]), (2, 1, 7, [3.0]), (1, 1, 8, [4.0]), (None, 9, 8, [5.0]), (3, 1, None, [6.0]), (1, 9, None, [7.0])]
    df = spark.createDataFrame(rows, "req_id int, pos int, id long, vector array<float>")
    got = sorted((r.id, r.vector[0]) for r in V.latest(df, ["req_id", "pos"]).collect())
    assert got == [(7, 3.0), (7, 3.0), (8, 4.0)]


def test_footrule_bits_count_the_distance():
    rng = np.random.default_rng(5)
    prefix = np.array([rng.choice(20, V.PREFIX, replace=False) for _ in range(60)])
    bits = V.footrule_bits(prefix)
    for a in range(0, 60, 7):
        for b in range(60):
            common = int(np.bitwise_count(bits[a] & bits[b]).sum())
            places = [{p: i for i, p in enumerate(prefix[r])} for r in (a, b)]
            distance = sum(abs(places[0].get(p, V.PREFIX) - places[1].get(p, V.PREFIX)) for p in {*places[0], *places[1]})
            if a != b:
                assert distance == V.PREFIX * (V.PREFIX + 1) - 2 * common


def test_exact(spark):
    x = data(200, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    got = {(r.id, r.other) for r in V.exact_neighbours(df, df.where("id % 10 = 0"), DIM, 5, block=7).collect()}
    assert got == {(a, b) for a, b in brute(x, 5, -2) if a % 10 == 0}
    assert V.exact_neighbours(df, df.limit(0), DIM).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 100, 10**6, 10**12])
def test_pivots(rows):
    assert 8 <= V.pivots_for(rows) <= V.MAX_PIVOTS
