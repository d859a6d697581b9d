import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.edit_join import SegmentIndex, banded_distance, near_to, similar_pairs, similar_to
from weft.plans.storage import materialize


def full_distance(a, b):
    """Optimal string alignment, whole table."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert banded_distance(a, b, k) == min(full_distance(a, b), k + 1)


def mutated(word, rng):
    i = rng.randrange(len(word) - 1)
    kind = rng.randrange(4)
    if kind == 0:
        return word[:i] + word[i + 1 :]
    if kind == 1:
        return word[:i] + rng.choice("abcd") + word[i:]
    if kind == 2:
        return word[:i] + rng.choice("abcd") + word[i + 1 :]
    return word[:i] + word[i + 1] + word[i] + word[i + 2 :]


def words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(5, 13))) for _ in range(n)]
    return sorted({*base, *(mutated(w, rng) for w in base), *(mutated(mutated(w, rng), rng) for w in base)})


def test_no_pair_is_lost(spark):
    for k in (1, 2):
        all_words = [w for w in words(k, 60) if len(w) > k]
        df = spark.createDataFrame([("x", w) for w in all_words] * 2 + [(None, "abcde"), ("x", None)], "ns string, key string")
        found = {(r.key_a, r.key_b): r.edits for r in similar_pairs(df, k).collect()}
        wanted = {(a, b): d for a in all_words for b in all_words if a < b and (d := full_distance(a, b)) <= k}
        assert found == wanted


def test_against_a_reference(spark):
    left, right = words(5, 40), [w for w in words(5, 40)[::3] if len(w) >= 5]
    found = {
        (r.key, r.ref): r.edits
        for r in similar_to(
            spark.createDataFrame([("x", w) for w in left], "ns string, key string"),
            spark.createDataFrame([("x", w) for w in right] + [("y", left[0])], "ns string, key string"),
            2,
        ).collect()
    }
    assert found == {(a, b): d for a in left for b in right if (d := full_distance(a, b)) <= 2}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), max_size=12), st.text("abc", max_size=9), st.integers(0, 2))
def test_vocabulary(words, word, k):
    wanted = {(d, w) for w in words if len(w) > k and (d := full_distance(word, w)) <= k}
    assert set(SegmentIndex(words).near(word, k)) == wanted


def test_empty(spark):
    none = spark.createDataFrame([], "ns string, key string")
    assert similar_pairs(none).count() == 0
    assert similar_to(none, none).count() == 0


def test_exploded_tables_are_not_broadcast(spark):
    words = materialize(spark.createDataFrame([("a", f"word{i:04}") for i in range(200)], "ns string, key string"))
    for found in (similar_pairs(words, 2), near_to(words, words, 2)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
