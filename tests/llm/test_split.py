from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.split import pieces, split_oversized

TEXTS = st.text(st.sampled_from("ab \n.。é😀\r!"), max_size=300)


def check(text, limit, overlap):
    data = text.encode()
    found = pieces(text, limit, overlap)
    if not data:
        assert found == []
        return
    assert found[0][:2] == (0, 0) and found[-1][2] == len(data)
    for i, (begin, start, end) in enumerate(found):
        data[begin:end].decode(), data[start:end].decode()
        assert begin <= start < end
        assert end - begin <= max(limit, 4)
        assert start - begin <= min(overlap, limit - 4)
        if i:
            assert start == found[i - 1][2]
            assert start - begin > min(overlap, limit - 4) - 4 or begin == found[i - 1][1] or start < overlap + 4


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(8, 60), st.integers(0, 70))
def test_pieces(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries():
    text = "First part here.\n\nSecond one. Third one goes on and on without an end"
    cut = [text.encode()[a:b].decode() for _, a, b in pieces(text, 30, 0)]
    assert cut[0] == "First part here.\n\n" and cut[1] == "Second one. "[:12] + "Third one goes on "[: len(cut[1]) - 12]
    assert pieces("x" * 100, 30, 0) == [(0, 0, 30), (30, 30, 60), (60, 60, 90), (90, 90, 100)]
    check("word " * 200_000, 2000, 300)
    check("é" * 50_000, 1000, 101)


def test_rows(spark):
    rows = [("a", "one two three four five", 10, 2, 100, 1), ("b", "short", 10, 2, 0, 1), ("c", None, 10, 2, 0, 1), ("d", "", 10, 2, 0, 1), ("e", "x" * 25, 10, None, None, 1), ("f", "x" * 25, None, 1, 1, 1), (None, "y" * 11, 10, 0, 0, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, limit int, overlap int, base int, piece int")
    out = split_oversized(df, ["chunk_id"]).collect()
    assert {r.chunk_id for r in out} == {"a", "e", None}
    for key, text, _, _, base, _ in (rows[0], rows[4], rows[6]):
        mine = sorted((r.piece, r.byte_start - (base or 0), r.byte_end - (base or 0)) for r in out if r.chunk_id == key)
        assert [p for p, *_ in mine] == list(range(1, len(mine) + 1))
        assert "".join(text[a:b] for _, a, b in mine) == text
    assert split_oversized(df.limit(0), ["chunk_id"]).count() == 0
