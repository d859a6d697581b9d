from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import native as N
from weft.functions import text as X
from weft.sources.walk import glob, parse_ignore


def one(spark, col, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_slugs(spark):
    assert one(spark, X.slugify, "Acme Corp", "  The   Internet!! ", "foo_bar.baz", "ALL-CAPS", "", "---", None, "KKg") == ["acme-corp", "the-internet", "foo-bar-baz", "all-caps", "", "", None, "k-g"]
    assert one(spark, X.rel_slug, "Acquired By!", "", "?!") == ["acquired_by", "related_to", "related_to"]


def test_ids(spark):
    row = spark.range(1).select(X.chunk_id(F.lit("x"), F.lit(7)), X.chunk_id(F.lit("x"), F.lit(12345)), X.iri_tail(F.lit("kb://entity/a-b"))).first()
    assert tuple(row) == ("x:0007", "x:12345", "a-b")
    assert N.vec_key_of("abc:0001") == N.vec_key_of("abc:0001") != N.vec_key_of("abc:0002")


def test_escapes(spark):
    assert one(spark, X.ttl_escape, 'a"b\\c\nd\re\tf', "\x01\x1f", "é", None) == ['a\\"b\\\\c\\nd\\re\\tf', "\\u0001\\u001f", "é", None]
    assert one(spark, lambda c: X.base64_line(F.encode(c, "UTF-8")), "x" * 180)[0] == "eHh4" * 60
    assert one(spark, X.decode_entities, "a &amp;lt; b &lt;c&gt;") == ["a &lt; b <c>"]


GLOBS = [
    ("*.md", "readme.md", True), ("*.md", "docs/readme.md", True), ("docs/*.md", "docs/readme.md", True), ("docs/**", "docs/sub/readme.md", True),
    ("?at.txt", "cat.txt", True), ("node_modules", "a/node_modules/b", True), ("*.md", "readme.txt", False), ("docs/*.md", "docs/sub/readme.md", False),
    ("a+(b)[c].x", "a+(b)[c].x", True), ("a.x", "abx", False), ("", "", True),
]


def test_globs(spark):
    for pattern, path, wanted in GLOBS:
        assert glob(pattern, path) is wanted, (pattern, path)
        assert one(spark, lambda c, p=pattern: X.glob_match(p, c), path) == [wanted], (pattern, path)
    assert parse_ignore("*.log # logs\n\n # all\n secret/ \n") == [("*.log", False), ("secret", True)]


def test_terms(spark):
    said = one(spark, lambda c: F.concat_ws(" ", X.salient_terms(c)), "What about the turbines, turbines and X-ray harbours of Zürich?", "", None)
    assert said == ["turbines harbours rich ray", "", ""]


def test_citations(spark):
    df = spark.createDataFrame([("So [1], and [2, 4] but [9] [x].",), ("Nothing",), ("[ 3 ]",)], "a string")
    assert [r[0] for r in df.select(X.cited_numbers(F.col("a"), F.lit(4))).collect()] == [[1, 2, 4], [1, 2, 3, 4], [3]]


def test_mime(spark):
    assert one(spark, X.mime_of, "a/b.PY", "c", "d.x/e", "f.tar.gz", "g.jpeg") == ["text/x-python", "text/plain", "text/plain", "text/plain", "image/jpeg"]
    assert one(spark, X.modality_of, "a.wav", "b.png", "c.md") == ["audio", "image", "text"]


PAGE = st.text(st.sampled_from("<>/sScript amp;&lt\"p"), max_size=60)


def state_machine(html):
    """The rules of strip_html one character at a time."""
    out, i, in_tag, hidden = [], 0, False, False
    signs = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}
    while i < len(html):
        c = html[i]
        if in_tag:
            if c == ">":
                in_tag = False
                out.append(" ")
        elif c == "<":
            if any(html[i + 1 :].lower().startswith(n) and len(html) - i > len(n) + 1 for n in ("script", "style")):
                hidden = True
            if html[i + 1 : i + 2] == "/":
                hidden = False
            in_tag = True
        elif not hidden:
            e = next((e for e in signs if html.startswith(e, i)), None)
            out.append(signs[e] if e else c)
            i += len(e) - 1 if e else 0
        i += 1
    return "".join(out)


@settings(max_examples=500, deadline=None)
@given(PAGE)
def test_strip_html(page):
    assert N.strip_html(page) == state_machine(page)


def test_binary():
    assert N.looks_binary(b"a\0b") and N.looks_binary(b"\xff\xfe")
    assert not N.looks_binary(b"plain") and not N.looks_binary("café".encode()) and not N.looks_binary("é".encode()[:1])


def test_identity(tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    big = bytearray(b"a" * 400 * 1024)
    mid, blind = bytearray(big), bytearray(big)
    mid[200 * 1024], blind[100 * 1024] = 98, 98
    a, b, c = put("a", b"hello world!\n"), put("b", b"hello world!\n"), put("c", b"hello world?\n")
    assert N.tap_file(a) == N.tap_file(b) != N.tap_file(c) and len(N.tap_file(a)) == 16
    assert N.tap_file(put("x", big)) != N.tap_file(put("y", mid))
    assert N.tap_file(str(tmp_path / "x")) == N.tap_file(put("z", blind))  # the stretch between the taps
    assert N.tap_file(str(tmp_path / "x"), True) != N.tap_file(str(tmp_path / "z"), True)
    assert N.tap_file(str(tmp_path / "none")) is None
    assert N.tap_bytes(bytes(big)) == N.tap_file(str(tmp_path / "x"))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n#é!"), max_size=400), st.sampled_from(["text/plain", "text/x-python"]))
def test_chunks_tile(text, mime):
    data = text.encode()
    spans = N.chunk_spans(data, mime, N.ChunkOptions(8, 12, 0.25))
    assert [s[1] for s in spans[1:]] == [s[2] for s in spans[:-1]]
    if data:
        assert spans[0][:2] == (0, 0) and spans[-1][2] == len(data)
    for lead, start, _ in spans[1:]:
        assert start - 8 <= lead <= start and (lead == start or data[lead] & 0xC0 != 0x80)


def test_chunk_corpora():
    one = b"# Title\n\nFirst paragraph.\n\nSecond paragraph.\n"
    assert N.chunk_spans(one, "text/markdown") == [(0, 0, len(one))]
    prose = b"".join(b"Sentence one of %d is here. Another follows it closely. A third one ends the paragraph.\n\n" % i for i in range(200))
    spans = N.chunk_spans(prose, "text/markdown")
    assert len(spans) > 1 and spans[1][0] < spans[1][1]
    code = b"".join(b"def fn_%d():\n    x = %d\n    return x * 2 + 1  # some words to make it longer\n" % (i, i) for i in range(120))
    spans = N.chunk_spans(code, "text/x-python")
    assert len(spans) > 1 and all(code[a:].startswith(b"def ") for _, a, _ in spans)
    assert N.chunk_spans(b"", "text/plain") == []
    assert N.fit_budget([5, 9, 4, 1], 10) == [0, 2, 3]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(X.dot(F.col("a"), F.col("b")), X.norm(F.col("a")), X.normalized(F.col("a"))).collect()
    assert [(r[0], r[1]) for r in rows] == [(24.0, 5.0), (0.0, 0.0)] and rows[1][2] == [0.0, 0.0]


def test_budget_and_media(spark):
    from weft.operators.fusion import budgeted, fuse, media_to_text

    df = spark.createDataFrame([(1, "a", 1, 60), (1, "b", 2, 50), (1, "c", 3, 40), (2, "a", 1, 101)], "query_id int, chunk_id string, rank int, size int")
    assert sorted(map(tuple, budgeted(df, 100).collect())) == [(1, "a", 1), (1, "c", 2)]
    hits = spark.createDataFrame([("d:0000", 0.9, 1), ("d:0001", 0.5, 2), ("e:0003", 0.4, 3)], "chunk_id string, score double, rank int")
    moved = media_to_text(hits)
    assert {(r.chunk_id, r.rank) for r in moved.collect()} == {("d:0001", 1), ("e:0003", 3)}
    top = fuse({"x": moved, "y": hits.where("rank = 2").withColumn("rank", F.lit(1))}, 1).first()
    assert top.chunk_id == "d:0001" and abs(top.fused - 2 / 61) < 1e-12
