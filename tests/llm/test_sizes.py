import random

import pytest

from weft.llm import packing
from weft.llm.mixing import mix
from weft.llm.packing import fill, pack
from weft.llm.tokens import count_tokens, encoder, with_tokens, VOCABULARY

ITEMS = "doc_id long, source string, tokens long, container int, place int"
OPTIONS = "option_name string, capacity_tokens int"


def items(n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["big", "mid", "small", None], [70, 20, 9, 1])[0], int(rng.lognormvariate(4.5, 1)), 0, 0) for i in range(n)]
    return rows + [(n, "big", 0, 0, 0), (n + 1, "mid", 100, 0, 0), (n + 2, "mid", 5000, 0, 0), (n + 3, "empty", 0, 0, 0), (n + 4, "mid", None, 0, 0), (n + 5, None, -5, 0, 0)]


def check(rows, out, capacity):
    size = {i: max(t or 0, 0) for i, _, t, *_ in rows if i is not None}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(size)
    for i, pieces in by.items():
        assert sum(p.tokens for p in pieces) == size[i]
        assert sorted(p.piece for p in pieces) == list(range(len(pieces)))
        assert len(pieces) == max(1, -(-size[i] // capacity))
        assert all(p.tokens == capacity for p in pieces if p.piece < len(pieces) - 1)
    containers = {}
    for r in out:
        containers.setdefault(r.container, []).append(r)
    for c in containers.values():
        at = 0
        for r in sorted(c, key=lambda r: (r.place, r.tokens)):
            assert r.place == at
            at += r.tokens
        assert at <= capacity and {r.unused for r in c} == {capacity - at}
    return containers


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 100_000)
    rows = items()
    df = spark.createDataFrame(rows + rows[:50] + [(None, "big", 5, 0, 0)], ITEMS)
    options = spark.createDataFrame([("a", 512), ("b", 100), ("bad", 0), ("none", None)], OPTIONS)
    out = pack(df, options).collect()
    assert {r.option_name for r in out} == {"a", "b"}
    source = {r[0]: r[1] for r in rows}
    for name, capacity in (("a", 512), ("b", 100)):
        containers = check(rows, [r for r in out if r.option_name == name], capacity)
        assert sum(c[0].unused for c in containers.values()) < 0.03 * capacity * len(containers)
    # every half of the containers holds the sources in their shares
    mine = [r for r in out if r.option_name == "a" and r.tokens]
    total = sum(r.tokens for r in mine)
    half = sorted({r.container for r in mine})
    half = set(half[: len(half) // 2])
    for s in ("big", "mid"):
        share = sum(r.tokens for r in mine if source[r.doc_id] == s) / total
        assert sum(r.tokens for r in mine if source[r.doc_id] == s and r.container in half) / sum(r.tokens for r in mine if r.container in half) == pytest.approx(share, abs=0.05)


def test_pack_to_given_shares(spark):
    rows = items(600)
    shares = spark.createDataFrame([("big", 0.5), ("mid", 0.5)], "source string, share double")
    check(rows, pack(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("a", 512)], OPTIONS), shares=shares).collect(), 512)


def test_schedule():
    phases = packing.schedule({"a": 60, "b": 30, "c": 10, "d": 0}, {"a": 1, "b": 1})
    assert phases == {"a": [(0, 30, 0, 2), (30, 60, 60, 1)], "b": [(0, 30, 0, 2)], "c": [(0, 10, 90, 1)], "d": []}
    assert packing.schedule({"a": 60, "b": 30}, {}) == {"a": [(0, 60, 0, 1.5)], "b": [(0, 30, 0, 3)]}
    assert packing.schedule({}, {"a": 1}) == {}


def test_windows_hold_the_given_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 20_000)
    rng = random.Random(8)
    rows = [(i, rng.choices(["big", "mid", "tiny"], [70, 20, 10])[0], rng.randrange(1, 60), 0, 0) for i in range(8000)]
    shares = spark.createDataFrame([("big", 0.4), ("mid", 0.4), ("tiny", 0.2), ("none", 0.3), (None, 0.5), ("mid", None)], "source string, share double")
    out = pack(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("a", 512)], OPTIONS), shares=shares.where("source is not null")).collect()
    check(rows, out, 512)
    source, totals, held = {r[0]: r[1] for r in rows}, {}, {}
    for r in out:
        held.setdefault(r.container, dict.fromkeys(("big", "mid", "tiny"), 0))[source[r.doc_id]] += r.tokens
    for r in rows:
        totals[r[1]] = totals.get(r[1], 0) + r[2]
    windows = [held[c] for c in sorted(held)]
    # until the scarcest source is used up every window holds 0.4, 0.4, 0.2
    until = int(0.95 * min(totals["mid"] / 0.4, totals["tiny"] / 0.2) / 512)
    assert until > 50
    off = [max(abs(w[s] / sum(w.values()) - t) for s, t in (("big", 0.4), ("mid", 0.4), ("tiny", 0.2))) for w in windows[:until]]
    assert sum(off) / len(off) < 0.06
    first = {s: sum(w[s] for w in windows[:until]) for s in totals}
    for s, t in (("big", 0.4), ("mid", 0.4), ("tiny", 0.2)):
        assert first[s] / sum(first.values()) == pytest.approx(t, abs=0.01)


def test_pack_nothing(spark):
    none, options = spark.createDataFrame([], ITEMS), spark.createDataFrame([("a", 5)], OPTIONS)
    assert pack(none, options).count() == 0
    assert pack(spark.createDataFrame(items(5), ITEMS), options.limit(0)).count() == 0
    zeros = spark.createDataFrame([(i, "s", 0, 0, 0) for i in range(9)], ITEMS)
    assert pack(zeros, options).select("doc_id").distinct().count() == 9


def test_fill_carries_deficits():
    deficits = {}
    fill([10] * 60 + [10] * 20, ["a"] * 60 + ["b"] * 20, 40, {"a": 0.75, "b": 0.25}, deficits)
    assert deficits == pytest.approx({"a": 0, "b": 0})


def test_tokens(spark):
    texts = ["hello world", "", None, "naïve <|endoftext|> 東京", "a" * 250_000, "word " * 60_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, tokens int")
    got = {r.id: r.tokens for r in with_tokens(df, ["id"]).collect()}
    encode = encoder(open(VOCABULARY, "rb").read()).encode_ordinary
    assert got[0] == 2 and got[1] == got[2] == 0
    assert got[3] == len(encode(texts[3])) and got[5] == len(encode(texts[5]))
    assert got[4] == len(encode(texts[4]))
    assert count_tokens(encode, "\ud800x") > 0


TARGETS = "source string, weight double, max_repeats int, cap int"


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices("abcx", [60, 30, 3, 7])[0], int(rng.lognormvariate(5, 1)) + 1, 0, 0) for i in range(4000)]
    targets = [("a", 0.4, 1, 0), ("b", 0.3, 2, 0), ("c", 0.2, 4, 0), ("none", 0.1, 9, 0), (None, 0.1, 9, 0), ("a", 0.1, 9, 0)]
    items_df = spark.createDataFrame(rows + rows[:9] + [(None, "a", 5, 0, 0), (9999, "a", 0, 0, 0), (9998, None, 5, 0, 0), (9997, "a", None, 0, 0)], ITEMS)
    chosen, shares = mix(items_df, spark.createDataFrame(targets, TARGETS))
    got = {r.doc_id: r for r in chosen.collect()}
    cap, own = {"a": 1, "b": 2, "c": 4}, {r[0]: r for r in rows}
    for i, r in got.items():
        assert 1 <= r.copies <= cap[r.source] and own[i][1] == r.source and own[i][2] == r.tokens
        assert abs(r.copies - r.rate) <= 2
    total = sum(r.copies * r.tokens for r in got.values())
    said = {r.source: r for r in shares.collect()}
    assert set(said) == {"a", "b", "c", "none"} and said["none"].share == said["none"].wanted_share == 0
    for s, w in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        tokens = sum(r.copies * r.tokens for r in got.values() if r.source == s)
        assert tokens == said[s].tokens and said[s].wanted_share == pytest.approx(w / 0.9)
        assert tokens / total == pytest.approx(w / 0.9, abs=0.002)
    assert all(0 < r.newton_steps < 60 and r.rate_miss < 1e-6 for r in said.values())
    # the scarcest source is used up
    assert sum(r.copies for r in got.values() if r.source == "c") == 4 * sum(r[1] == "c" for r in rows)


def test_mix_nothing(spark):
    none, targets = spark.createDataFrame([], ITEMS), spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)
    chosen, shares = mix(none, targets)
    assert chosen.count() == 0 and [r.share for r in shares.collect()] == [0]
    chosen, shares = mix(spark.createDataFrame([(1, "a", 5, 0, 0)], ITEMS), targets.limit(0))
    assert chosen.count() == shares.count() == 0
    chosen, _ = mix(spark.createDataFrame([(1, "a", 5, 0, 0), (2, "b", 5, 0, 0)], ITEMS), spark.createDataFrame([("a", 1.0, 0, 0), ("b", None, 2, 0)], TARGETS))
    assert chosen.count() == 0
