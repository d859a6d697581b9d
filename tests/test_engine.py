import json
import os
import time

import pytest

from weft.functions.native import looks_binary
from weft.model import Options
from weft.operators.store import Locked, Store
from weft.plans import maintain
from weft.plans.ingest import Providers, ingest
from weft.plans.providers import ExtractionError, HashEmbedder, RuleLLM, extract, parse_extraction
from weft.plans.search import search
from weft.sources.turtle import read_turtle, write_turtle
from weft.sources.walk import walk
from weft.streaming.incremental import ingest_arrivals


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_walk(spark, tmp_path):
    put(
        tmp_path, a_dot_md="# A", code__x_dot_py="x = 1", _dot_git__config="no", node_modules__y_dot_js="no", _dot_weft__z_dot_txt="no", img_dot_png=b"\x89PNG\0",
        raw_dot_bin="no", noext=b"a\0b", logs__x_dot_log="no", secret__s_dot_txt="no", _dot_weftignore="*.log\n# words\nsecret/\n",
    )
    (tmp_path / "_under.py").write_text("y = 2")
    assert {(r.relpath, r.modality) for r in walk(spark, str(tmp_path)).collect()} == {("a.md", "text"), ("code/x.py", "text"), ("img.png", "image"), ("_under.py", "text")}
    assert [r.relpath for r in walk(spark, str(tmp_path), include=["*.py"], exclude=["_*"]).collect()] == ["code/x.py"]
    assert walk(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture
def tree(tmp_path):
    put(
        tmp_path / "t", a_dot_md="# Radium\n\nMarie Curie founded Radium Institute in March.\n", b_dot_txt="The harbour turbine was measured by Pierre Curie.",
        empty_dot_txt="", c_dot_html="<p>Page on <b>harbours</b></p>", **{f"d__{i}_dot_txt": "one identical line" for i in range(8)},
    )
    return tmp_path


def options(tree, **more):
    return Options(db=str(tree / "db"), root=str(tree / "t"), **more)


def test_life_of_a_database(spark, tree):
    o = options(tree)
    report = ingest(spark, o)
    assert report == {"new": 5, "skipped": 7, "superseded": 0, "chunks": 4, "failed": 0}
    version = Store(spark, o.db).version
    assert ingest(spark, o) == {"new": 0, "skipped": 12, "superseded": 0, "chunks": 0, "failed": 0}
    assert Store(spark, o.db).version == version

    before = (tree / "t/a.md").read_text()
    put(tree / "t", a_dot_md=before.replace("March", "April"))
    assert ingest(spark, o)["superseded"] == 1
    assert maintain.status(spark, o)["superseded"] == 1
    found = search(spark, options(tree, query="Who founded Radium Institute?"))
    assert "April" in found["answer"] and found["verification"][0]["verdict"] == "verified" and len(found["candidates"]) <= 12
    assert not any("March" in s["path"] for s in found["sources"])

    # back to the first content: it is live again, the other one is superseded
    put(tree / "t", a_dot_md=before)
    os.utime(tree / "t/a.md", (1, 1))
    ingest(spark, o)
    assert "March" in search(spark, options(tree, query="Who founded Radium Institute?"))["answer"]

    (tree / "t/b.txt").unlink()
    assert maintain.verify(spark, o) == {"ok": 11, "drifted": 0, "missing": 1, "unreadable": 0, "unknown": 0}
    gone = search(spark, options(tree, query="harbour turbine measured"))
    assert any(v["verdict"] == "missing" for v in gone["verification"])

    stat = (tree / "t/c.html").stat()
    put(tree / "t", c_dot_html="<p>Page in <b>harbours</b></p>")
    os.utime(tree / "t/c.html", (stat.st_atime, stat.st_mtime))
    assert ingest(spark, o)["new"] == 0  # same time and size
    assert maintain.verify(spark, options(tree, fix=True))["fixed"] == 1
    assert maintain.verify(spark, o)["drifted"] == 0

    triples = maintain.triples(Store(spark, o.db))
    write_turtle(triples, str(tree / "ttl"))
    back = read_turtle(spark, str(tree / "ttl"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, triples.collect()))
    rows = maintain.graph_query(spark, options(tree, query='SELECT ?c { ?t ql:contains-word "harb*" . ?t ql:contains-entity ?x . ?c ch:text ?x }'))
    assert rows.count() >= 2

    assert maintain.vacuum(spark, o)["vacuumed"] == 2
    assert maintain.status(spark, o)["superseded"] == 0 and maintain.vacuum(spark, o)["vacuumed"] == 0


def test_paranoid_and_dimensions(spark, tree):
    o = options(tree, paranoid=True)
    assert ingest(spark, o)["new"] == 5
    assert maintain.verify(spark, o)["ok"] == 12
    put(tree / "t", new_dot_txt="something new")
    with pytest.raises(ValueError, match="dimension"):
        ingest(spark, o, Providers(HashEmbedder(16), RuleLLM()))
    assert ingest(spark, o)["new"] == 1  # nothing of the failed run was kept


def test_lock_and_failed_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    with store, pytest.raises(Locked):
        store.__enter__()
    with store:
        store.commit({"meta": store.meta_table(a="1")})
        bad = spark.createDataFrame([("k", "v")], "key string, value string").selectExpr("key", "raise_error('no') value")
        with pytest.raises(Exception, match="no"):
            store.commit({"meta": bad})
    assert store.meta() == {"a": "1"} and store.version == 1
    assert json.loads((tmp_path / "db/CURRENT").read_text())["version"] == 1


def test_arrivals(spark, tree):
    o = options(tree)
    first = ingest_arrivals(spark, o.root, o, str(tree / "state"))
    assert sum(r["new"] for r in first) == 4
    time.sleep(1)
    put(tree / "t", late_dot_txt="A late arrival about turbines.")
    assert [r["new"] for r in ingest_arrivals(spark, o.root, o, str(tree / "state"))] == [1]
    assert ingest(spark, o)["new"] == 1  # the empty file, which a stream does not list
    assert ingest(spark, o)["new"] == 0


class Model:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def chat(self, system, user, temperature=0.0, max_tokens=0):
        self.asked.append(user)
        return self.answers.pop(0)


def test_extraction():
    text = '```json\n{"summary": "%s", "tags": ["a", "?!", 5, %s], "entities": [{"name": "Ann", "type": "robot"}, {"name": "--"}, {"name": "Bob", "type": "person"}], ' % ("é" * 300, ", ".join(f'"t{i}"' for i in range(12)))
    text += '"relations": [{"subject": "ann", "predicate": "knows", "object": "Bob", "confidence": 1}, {"subject": "Ann", "predicate": "x", "object": "Zoe"}, {"subject": "Ann", "predicate": "", "object": "Bob"}]}\n``` done'
    found = parse_extraction("Sure! " + text)
    assert len(found["summary"].encode()) == 400 and len(found["tags"]) == 8 and found["tags"][0] == "a"
    assert found["entities"] == [{"name": "Ann", "type": "concept"}, {"name": "Bob", "type": "person"}]
    assert [r["predicate"] for r in found["relations"]] == ["knows"]
    for bad in ("no json", "[1]", '{"summary": 5}', '{"entities": [{"name": 5}]}', '{"relations": [{"subject": "a", "confidence": "high"}]}'):
        with pytest.raises(ExtractionError):
            parse_extraction(bad)
    model = Model("bad", '{"summary": "ok"}')
    assert extract(model, "text")["summary"] == "ok" and "not valid" in model.asked[1]
    assert extract(Model("bad", None), "text") is None
    assert not looks_binary(b"ok")


def test_media_and_api(spark, tmp_path):
    put(tmp_path / "t", a_dot_png=b"\x09PNG one", b_dot_png=b"\xf0PNG two", c_dot_txt="Nothing about towers here.")
    from weft.api import Engine

    class Media:  # here, so that it is sent to the workers as it is
        def derive(self, content, mime, modality):
            return f"A {modality} of a lighthouse. " + content.decode("latin-1")[:20]

        def embed_media(self, content, mime):
            return [float(content[0]), 1.0] + [0.0] * 62

    m = Media()
    e = Engine(spark, str(tmp_path / "db"), Providers(HashEmbedder(), RuleLLM(), m, m))
    assert e.ingest(str(tmp_path / "t"))["new"] == 3
    assert e.store.read("vector").where("modality = 'image'").count() == 2
    put(tmp_path, q_dot_png=b"\xf0PNG two")
    found = e.search("", query_file=str(tmp_path / "q.png"))
    assert found["sources"][0]["path"] == "b.png" and found["candidates"][0]["chunk_id"].endswith(":0001")
    ids = e.store.read("chunk").where("ordinal > 0").select("chunk_id")
    assert e.content.text(ids).count() == 3 and e.graph.about(ids).count() == 3
    assert e.graph.sparql("SELECT ?c { ?c a ch:Chunk }").count() == e.store.read("chunk").count()
    assert e.llm.extract("Ann Bell knows Bob Cole.")["relations"][0]["predicate"] == "knows"
    assert e.graph.neighbors(ids.limit(1)).columns == ["chunk_id", "distance", "shared"]
    for i in range(3):  # later runs add folders, a vacuum makes one of them
        put(tmp_path / "t", **{f"n{i}_dot_txt": f"number {i} of towers"})
        e.ingest(str(tmp_path / "t"))
    assert len(e.store.parts("posting")) == 4 and len(e.retrieve.keyword("towers", 9).collect()) == 4
    put(tmp_path / "t", n1_dot_txt="changed")
    e.ingest(str(tmp_path / "t"))
    assert e.vacuum()["vacuumed"] == 1 and len(e.store.parts("posting")) == 1
    assert len(e.retrieve.keyword("towers", 9).collect()) == 3


def test_quantized(spark):
    import numpy as np

    from weft.functions.quantize import decode, encode, encoded, estimated

    x = np.random.default_rng(1).normal(size=(200, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for bits, least in ((2, 0.9), (3, 0.96), (4, 0.98)):
        code = encode(x, bits)
        assert code.shape == (200, 64 * bits // 8)
        assert (decode(code, 64, bits) * unit).sum(axis=1).mean() > least
    with pytest.raises(ValueError):
        encode(x[:, :7], 4)
    df = encoded(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>"), "v")
    top = df.select("id", estimated("code", x[7].tolist()).alias("s")).orderBy("s", ascending=False).first()
    assert top.id == 7


def test_graph_updates_are_kept(spark, tree):
    from weft.api import Engine

    e = Engine(spark, str(tree / "db"))
    e.ingest(str(tree / "t"))
    names = lambda: sorted(r.o for r in e.graph.sparql('SELECT ?o { <kb://entity/x> ch:label ?o }').collect())
    new = 'INSERT DATA { <kb://entity/x> ch:label "Ex" , "Why" . <kb://entity/x> ch:label "Ex" }'
    assert e.graph.update(new) == {"insert": 2} and e.graph.update(new) == {"insert": 0}
    assert names() == ["Ex", "Why"]
    assert e.graph.update('DELETE DATA { <kb://entity/x> ch:label "Why" . <kb://entity/x> ch:label "none" }') == {"delete": 1}
    assert names() == ["Ex"]
    # a triple that follows from the tables is taken back, and follows again
    chunks = e.graph.sparql("SELECT ?c { ?c a ch:Chunk }").count()
    assert e.graph.update("DELETE WHERE { ?c a ch:Chunk }") == {"delete": chunks} and e.graph.sparql("SELECT ?c { ?c a ch:Chunk }").count() == 0
    back = "INSERT { ?c a ch:Chunk } WHERE { ?c ch:partOf ?d }"
    assert e.graph.update(back) == {"insert": chunks} and e.graph.sparql("SELECT ?c { ?c a ch:Chunk }").count() == chunks
    assert e.store.read("withdrawn").count() == 0
    # an ingest keeps what was stated
    put(tree / "t", more_dot_txt="One more about the harbour.")
    e.ingest(str(tree / "t"))
    assert names() == ["Ex"]
    o = options(tree)
    maintain.graph_export(spark, o, str(tree / "out"))
    assert maintain.graph_load(spark, o, str(tree / "out")) == {"loaded": 0}
    put(tree, more_dot_ttl='<kb://entity/x> <kb://ontology#label> "Zed" .\n')
    assert maintain.graph_load(spark, o, str(tree / "more.ttl")) == {"loaded": 1} and names() == ["Ex", "Zed"]


def test_a_commit_that_lacks_rows_is_dropped(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))

    def lacking():
        assert store.read("meta").count() == 1
        raise RuntimeError("too few")

    with pytest.raises(RuntimeError):
        store.commit({"meta": store.meta_table(a="b")}, check=lacking)
    assert store.version == 0 and store.read("meta").count() == 0


def test_few_bits(spark, tree):
    from weft.api import Engine

    e = Engine(spark, str(tree / "db"))
    e.ingest(str(tree / "t"), vector_bits=4)
    assert e.store.read("vector").count() == 0 and e.store.read("vector_code").count() == 4 and e.status()["vector_bits"] == "4"
    put(tree / "t", more_dot_txt="The lighthouse keeper of the northern island.")
    e.ingest(str(tree / "t"))  # stays at its bits
    assert e.store.read("vector_code").count() == 5
    assert e.search("Who founded Radium Institute?")["verification"][0]["verdict"] == "verified"
    best = e.retrieve.vector("The lighthouse keeper of the northern island.", 3).orderBy("rank").collect()
    assert len(best) == 3 and best[0].score > 0.9


def test_nearest_in_blocks(spark):
    import numpy as np

    from weft.operators.vectors import nearest

    x = np.random.default_rng(3).normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None), (62, [0.0] * 8), (63, [1.0]), (64, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = df.where("id < 9 or id > 60").selectExpr("id query_id", "embedding query")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    wanted = {}
    for q in range(9):
        score = np.round(unit[q] @ np.vstack([unit, unit[:1]]).T, 9)
        wanted[q] = [int(i) for i in np.lexsort((np.arange(61), -score))[:5]]
    for block in (4, 100):
        got = {}
        for r in nearest(asked, df, "id", 5, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert {q: got[q] for q in wanted} == wanted and set(got) == {*wanted, 63}  # 63 has one component, and only itself beside it
    assert nearest(asked.limit(0), df, "id", 5).count() == 0 and nearest(asked, df, "id", 5, allowed=df.limit(0)).count() == 0
