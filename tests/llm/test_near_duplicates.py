import random

import numpy as np
import pytest

from weft.llm import near_duplicates as N
from weft.llm.q_near import written_pairs
from weft.llm.shingles import WORD


def shingles(text, width):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((3, 4, 6, 20, 60, 150)))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            for _ in range(rng.randrange(1, 6)):
                i = rng.randrange(len(copy))
                kind = rng.randrange(3)
                copy[i : i + (kind != 1)] = [] if kind == 0 and len(copy) > 3 else [rng.choice(vocabulary)]
            out.append("  ".join(copy).upper() + ".")
    boiler = " ".join(vocabulary[:30])
    out += [boiler + " " + x for x in out[:15]]  # a beginning that many share
    return out


@pytest.mark.parametrize(("threshold", "width"), [(0.6, 3), (0.8, 5)])
def test_against_all_pairs(spark, threshold, width):
    texts = corpus(width, 60)
    rows = [(f"d{i:03d}", t, 1) for i, t in enumerate(texts)]
    extra = [("d000", texts[0], 1), ("copy", texts[5].replace(" ", "\r\n"), 1), ("none", None, 1), ("empty", "", 1), ("two", "just two", 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows + extra, "chunk string, body string, fp int")
    members, pairs = N.near_duplicates(df, "chunk", "body", threshold, width)
    fp = {r.id: r.fp for r in members.collect()}
    sets = {i: s for i, t in {**{r[0]: r[1] for r in rows}, "copy": texts[5]}.items() if (s := shingles(t, width))}
    assert set(fp) == set(sets)
    found = {(r.a, r.b): r.similarity for r in pairs.collect()}
    by_fp = {}
    for i, s in sets.items():
        assert by_fp.setdefault(fp[i], s) == s
    assert len(by_fp) == len({frozenset(s) for s in sets.values()})
    wanted = {}
    keys = sorted(by_fp)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            j = len(by_fp[a] & by_fp[b]) / len(by_fp[a] | by_fp[b])
            if j >= threshold - 1e-9:
                wanted[a, b] = j
    assert wanted and found == pytest.approx(wanted)


def test_long_text_and_empty(spark):
    long = " ".join(f"v{i % 5000}x{i}" for i in range(70_000))
    df = spark.createDataFrame([("a", long), ("b", long + " end"), ("c", "x " * 1000)], "id string, text string")
    members, pairs = N.near_duplicates(df, "id", "text")
    assert members.count() == 3 and pairs.count() == 1
    members, pairs = N.near_duplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert members.count() == 0 and pairs.count() == 0


def test_hot_shingles_are_dealt_into_groups(spark):
    rng = random.Random(11)
    boiler = " ".join(f"b{i}" for i in range(40))
    texts = [boiler + " " + " ".join(rng.choice("xyzuvw") + str(rng.randrange(50)) for _ in range(rng.choice((4, 12, 30)))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = []
    for hot in (N.HOT, 7):
        members, pairs = N.near_duplicates(df, "id", "text", 0.6, 3, hot=hot)
        found.append({(r.a, r.b, round(r.similarity, 9)) for r in pairs.collect()})
    assert found[0] == found[1] and len(found[0]) > 100


def test_copies(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(f"c{i:03d}", " ".join(words)) for i in range(300)] + [("other", " ".join(words + ["end"])), ("far", "nothing like it at all")]
    stages = {}
    near = N.near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", 0.6, 3, stages=stages)
    ids = [r[0] for r in rows[:300]]
    assert {k: v.count() for k, v in stages.items()} == {"met": 1, "ring": 1, "similar": 1}
    star = {(r.chunk_a, r.chunk_b) for r in written_pairs(*near, 200).collect()}
    assert star == {("c000", x) for x in ids[1:]} | {("c000", "other")}
    whole = {(r.chunk_a, r.chunk_b) for r in written_pairs(*near, 300).collect()}
    assert whole == {(a, b) for a in ids for b in ids if a < b} | {(a, "other") for a in ids}


def test_counters_grow_with_the_input(spark, monkeypatch, tmp_path):
    texts = corpus(4, 30)
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.parquet(f"{tmp_path}/t")
    df, found = spark.read.parquet(f"{tmp_path}/t"), []
    for bytes_a_counter, least in ((128, 1 << 20), (128, 1 << 6), (0.001, 1 << 6)):
        monkeypatch.setattr(N, "BYTES_A_COUNTER", bytes_a_counter)
        monkeypatch.setattr(N, "LEAST_COUNTERS", least)
        found.append(N._counters(df))
        assert {(r.a, r.b) for r in N.near_duplicates(df, "id", "text", 0.6, 3)[1].collect()} == {(r.a, r.b) for r in N.near_duplicates(df, "id", "text", 0.6, 3, hot=5)[1].collect()}
    assert found[0] == 1 << 20 and found[1] < 1 << 12 and found[2] == N.MOST_COUNTERS


def test_ring_is_exact_on_sums():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (500, N.SEGMENTS), dtype=np.uint64).astype(np.uint32)
    b = a ^ (rng.integers(0, 2**32, a.shape, dtype=np.uint64).astype(np.uint32) & rng.integers(0, 2**32, a.shape, dtype=np.uint64).astype(np.uint32))
    budget = rng.integers(100, 160, 500)
    total = np.bitwise_count(a ^ b).sum(axis=1)
    assert (N.ring_holds(a, b, budget) == (total <= budget)).all()
