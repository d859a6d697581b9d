import pytest

from weft.plans.sparql import SparqlError, parse, run, update

DATA = [
    ("kb://e/a", "kb://ontology#knows", "kb://e/b", "iri", None), ("kb://e/b", "kb://ontology#knows", "kb://e/c", "iri", None),
    ("kb://e/c", "kb://ontology#knows", "kb://e/a", "iri", None), ("kb://e/d", "kb://ontology#knows", "kb://e/d", "iri", None),
    ("kb://e/a", "kb://ontology#age", "30", "literal", "http://www.w3.org/2001/XMLSchema#integer"),
    ("kb://e/b", "kb://ontology#age", "4", "literal", "http://www.w3.org/2001/XMLSchema#integer"),
    ("kb://e/a", "kb://ontology#name", 'Ann "A"\nX', "literal", None), ("kb://e/b", "kb://ontology#name", "Bob", "literal", None),
    ("_:n1", "kb://ontology#name", "Node", "literal", None),
]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(DATA, "s string, p string, o string, o_kind string, o_datatype string")


def ask(g, text):
    return sorted(tuple(r) for r in run(g, text).collect())


def e(*names):
    return tuple(f"kb://e/{n}" for n in names)


def test_patterns(g):
    assert ask(g, "SELECT ?x ?z WHERE { ?x ch:knows ?y . ?y ch:knows ?z }") == sorted([e("a", "c"), e("b", "a"), e("c", "b"), e("d", "d")])
    assert ask(g, "SELECT ?x { ?x ch:knows ?x }") == [e("d")]
    assert ask(g, "SELECT ?x ?n { ?x ch:knows <kb://e/b> ; ch:name ?n . }") == [("kb://e/a", 'Ann "A"\nX')]
    assert ask(g, 'SELECT ?x { ?x ch:name "Ann \\"A\\"\\nX" }') == [e("a")]
    assert ask(g, "SELECT ?x { ?x ch:age 4 }") == [e("b")] and ask(g, "SELECT ?x { ?x ch:age ?y FILTER(?y > 9) }") == [e("a")]
    assert ask(g, "SELECT ?x { ?x ch:name ?n FILTER(isBlank(?x)) }") == [("_:n1",)]
    assert ask(g, "SELECT (COUNT(*) AS ?n) { ?x ch:knows ?y }") == [("4",)]
    assert ask(g, "ASK { <kb://e/a> ch:knows <kb://e/b> }") == [(True,)] and ask(g, "ASK { <kb://e/a> ch:knows <kb://e/d> }") == [(False,)]


def test_optional_and_unbound(g):
    got = run(g, "SELECT ?x ?a { ?x ch:knows ?y OPTIONAL { ?x ch:age ?a FILTER(?a > 9) } } ORDER BY ?x").collect()
    assert [tuple(r) for r in got] == [("kb://e/a", "30"), ("kb://e/b", None), ("kb://e/c", None), ("kb://e/d", None)]
    # an unbound variable is compatible with any value
    got = run(g, "SELECT ?x ?a ?z { ?x ch:name ?n OPTIONAL { ?x ch:age ?a } ?z ch:age ?a }").collect()
    assert sorted((r.x, r.z) for r in got) == sorted([e("a", "a"), e("b", "b"), ("_:n1", "kb://e/a"), ("_:n1", "kb://e/b")])
    assert ask(g, "SELECT ?x { ?x ch:knows ?y OPTIONAL { ?x ch:age ?a } FILTER(!BOUND(?a)) }") == [e("c"), e("d")]


def test_minus_is_not_not_exists(g):
    assert ask(g, "SELECT ?x { ?x ch:age ?a MINUS { ?q ch:name ?r } }") == [e("a"), e("b")]
    assert ask(g, "SELECT ?x { ?x ch:age ?a FILTER NOT EXISTS { ?q ch:name ?r } }") == []
    assert ask(g, "SELECT ?x { ?x ch:knows ?y MINUS { ?x ch:age ?a } }") == [e("c"), e("d")]
    assert ask(g, "SELECT ?x { ?x ch:knows ?y FILTER EXISTS { ?x ch:age ?a } }") == [e("a"), e("b")]


def test_paths(g):
    assert ask(g, "SELECT ?y { <kb://e/a> ch:knows+ ?y }") == [e("a"), e("b"), e("c")]
    assert ask(g, "SELECT ?y { <kb://e/d> ch:knows* ?y }") == [e("d")]
    assert ask(g, "SELECT ?y { <kb://e/a> ^ch:knows ?y }") == [e("c")] and ask(g, "SELECT ?y { <kb://e/a> ch:knows/ch:knows ?y }") == [e("c")]
    assert ask(g, "SELECT ?y { <kb://e/a> ch:knows? ?y }") == [e("a"), e("b")] and ask(g, "SELECT DISTINCT ?y { <kb://e/a> (ch:knows|^ch:knows) ?y }") == [e("b"), e("c")]


def test_rest(g):
    assert ask(g, 'SELECT ?x ?v { VALUES (?x ?v) { (<kb://e/a> "p") (<kb://e/z> "q") (UNDEF "r") } ?x ch:age ?a }') == sorted([("kb://e/a", "p"), ("kb://e/a", "r"), ("kb://e/b", "r")])
    assert ask(g, "SELECT ?x ?b { ?x ch:age ?a BIND(?a * 2 + 1 AS ?b) }") == [("kb://e/a", "61"), ("kb://e/b", "9")]
    assert ask(g, "SELECT ?x { { SELECT ?x (MAX(?a) AS ?m) { ?x ch:age ?a } GROUP BY ?x HAVING (MAX(?a) > 9) } ?x ch:knows ?y }") == [e("a")]
    assert ask(g, 'SELECT (GROUP_CONCAT(?n; SEPARATOR="|") AS ?all) { ?x ch:name ?n FILTER(STRLEN(?n) < 5) }') == [("Bob|Node",)]
    assert ask(g, 'SELECT (IF(?a > 9, "old", "young") AS ?k) (STRAFTER(STR(?x), "e/") AS ?t) { ?x ch:age ?a }') == [("old", "a"), ("young", "b")]
    assert [r.x for r in run(g, "SELECT ?x { ?x ch:knows ?y } ORDER BY DESC(?x) LIMIT 2 OFFSET 1").collect()] == ["kb://e/c", "kb://e/b"]
    assert len(ask(g, "CONSTRUCT { ?y ch:knownBy ?x . ?x ch:aged ?a } WHERE { ?x ch:knows ?y OPTIONAL { ?x ch:age ?a } }")) == 6


def test_updates(g):
    more = update(g, 'INSERT DATA { <kb://e/z> a ch:Person ; ch:name "Zed" . <kb://e/a> ch:knows <kb://e/b> }')
    assert more.count() == len(DATA) + 2
    assert update(g, "DELETE DATA { <kb://e/a> ch:knows <kb://e/b> }").count() == len(DATA) - 1
    assert update(g, "DELETE WHERE { ?x ch:knows ?x }").count() == len(DATA) - 1
    assert update(g, "INSERT { ?y ch:knownBy ?x } WHERE { ?x ch:knows ?y }").count() == len(DATA) + 4


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?x { ?x nope:p ?y }", "SELECT ?x { ?x ch:p", "SELECT ?x { FILTER(FOO(?x)) }", "DROP ALL", "SELECT ?x {} trailing"])
def test_errors(g, text):
    with pytest.raises(SparqlError):
        q = parse(text)
        run(g, text) if q else None


def test_text_needs_an_index(g):
    with pytest.raises(SparqlError):
        run(g, 'SELECT ?t { ?t ql:contains-word "x*" }')


def test_exists_inside_expressions(g):
    assert ask(g, "SELECT ?x { ?x ch:knows ?y FILTER(EXISTS { ?x ch:age ?a } && ?y != <kb://e/c>) }") == [e("a")]
    assert ask(g, "SELECT ?x { ?x ch:knows ?y FILTER(NOT EXISTS { ?x ch:age ?a } || EXISTS { ?x ch:name 'Bob' }) }") == [e("b"), e("c"), e("d")]
    assert ask(g, "SELECT ?x { ?x ch:knows ?y FILTER(!EXISTS { ?x ch:age ?a }) }") == [e("c"), e("d")]
    with pytest.raises(SparqlError):
        run(g, "SELECT (EXISTS { ?x ch:age ?a } AS ?b) { ?x ch:knows ?y }")


def test_describe(g):
    own = [t for t in DATA if t[0] == "kb://e/b"]
    assert ask(g, "DESCRIBE <kb://e/b>") == sorted(t[:3] for t in own)
    assert {r[0] for r in ask(g, "DESCRIBE ?x WHERE { ?x ch:age ?a }")} == {"kb://e/a", "kb://e/b"}
    assert {r[0] for r in ask(g, "DESCRIBE * { <kb://e/c> ch:knows ?x }")} == {"kb://e/a"}
    assert ask(g, "DESCRIBE <kb://e/none>") == []
    with pytest.raises(SparqlError):
        run(g, "DESCRIBE")


def test_relative_iris(g):
    assert ask(g, "BASE <kb://e/x> SELECT ?y { <a> ch:knows ?y }") == [e("b")]
    assert ask(g, "BASE <kb://ontology/> PREFIX o: <../ontology#> SELECT ?y { <kb://e/a> o:knows ?y }") == []
    assert ask(g, "BASE <kb://e/deep/er> SELECT ?y { <../a> <kb://ontology#knows> ?y }") == [e("b")]


def test_paths_from_either_end(g):
    assert ask(g, "SELECT ?x { ?x ch:knows+ <kb://e/a> }") == [e("a"), e("b"), e("c")]
    assert ask(g, "SELECT ?x { ?x ch:knows* <kb://e/none> }") == [e("none")]
    assert ask(g, "ASK { <kb://e/a> ch:knows+ <kb://e/c> }") == [(True,)] and ask(g, "ASK { <kb://e/a> ch:knows+ <kb://e/d> }") == [(False,)]
    assert ask(g, "SELECT ?x { <kb://e/a> (^ch:knows)+ ?x }") == [e("a"), e("b"), e("c")]
