from pyspark.sql import functions as F

from weft.llm.canonical import gloss_phrases, learned_aliases, map_to_canon, reference_phrases

CANON = [
    (1, "type", "person", "an individual human being; people, staff"), (2, "type", "org", "a company, agency, firm, institution or other body"),
    (105, "predicate", "acquired", "bought or took over the object"), (106, "predicate", "acquired_by", "was bought or taken over by the object"),
    (103, "predicate", "leads", "heads, directs or is in charge of the object"), (104, "predicate", "led_by", None), (132, "predicate", "child_of", ""),
    (112, "predicate", "owns", "possesses the object"), (126, "predicate", "uses", "applies or makes use of the object"), (None, None, None, None),
]
SCHEMA = "canon_id int, field string, entry string, gloss string"

CASES = {
    ("type", "Person"): 1, ("type", " peolpe?"): 1, ("type", "type: person"): 1, ("type", "org (institution)"): 2, ("type", "n/a"): 0, ("type", ""): 0,
    ("type", "???"): 0, ("type", "colour"): 0, ("predicate", "acuqired"): 105, ("predicate", "acquired-By"): 106, ("predicate", "taken over by"): 106,
    ("predicate", "Bought by"): 106, ("predicate", "bought"): 105, ("predicate", "is in charge of"): 103,
    ("predicate", "ledBy"): 104, ("predicate", "le by"): 104, ("predicate", "rel:leads"): 103, ("predicate", "chil dof"): 132, ("predicate", "owos"): 112,
    ("predicate", "has_uses"): 126, ("predicate", "of the"): 0, ("predicate", "has"): 0, ("other", "person"): 0, ("predicate", "x" * 5000): 0,
}


def canon(spark, rows=CANON):
    return spark.createDataFrame(rows, SCHEMA)


def test_values(spark):
    values = spark.createDataFrame([(*k, 7) for k in CASES] * 2 + [("type", None, 1), (None, "person", 1)], "field string, value string, score int")
    found = {(r.field, r.value): r.canon_id for r in map_to_canon(values, reference_phrases(canon(spark))).collect()}
    assert found.pop((None, "person"), 0) == 0
    assert found == CASES


def test_glosses():
    assert gloss_phrases(None) == gloss_phrases("") == gloss_phrases("is the object") == []
    assert gloss_phrases("was bought or taken over by the object") == ["bought by", "taken over by"]
    assert gloss_phrases("needs or relies on the object") == ["needs", "relies on"]
    assert gloss_phrases("held or organised the object, an event") == ["held", "organised"]


def test_aliases_are_learned(spark):
    said = [("type", t, f"name {i}", 0) for i in range(40) for t in (("person", "Homo") if i % 2 else ("org", "outfit"))]
    said += [("type", "url", f"name {i}", 0) for i in range(40)]  # said of anything
    said += [("type", "homo", "name 1", 0), ("type", "person", None, 0), ("type", None, "name 3", 0), ("type", "once", "name 5", 0)]
    said += [("type", "person", "hot", i) for i in range(500)] + [("type", "url", "hot", i) for i in range(500)]
    statements = spark.createDataFrame(said, "field string, value string, context string, votes int")
    learned = learned_aliases(statements, canon(spark))
    assert {(r.phrase, r.canon_id, r.votes) for r in learned.collect()} == {("homo", 1, 20.0), ("outfit", 2, 20.0)}
    given = spark.createDataFrame([("predicate", 112, "has in hand")], "field string, canon_id int, phrase string")
    phrases = reference_phrases(canon(spark), learned.unionByName(given, allowMissingColumns=True))
    values = spark.createDataFrame([("type", "homoo"), ("type", "Outfit?"), ("predicate", "has in hand")], "field string, value string")
    assert {r.value: r.canon_id for r in map_to_canon(values, phrases).collect()} == {"homoo": 1, "Outfit?": 2, "has in hand": 112}


def test_an_alias_counts_however_many_others_vote(spark):
    many = spark.range(80_000).select(F.lit("type").alias("field"), F.explode(F.array(F.lit("person"), F.lit("filler"))).alias("value"), F.concat(F.lit("x"), "id").alias("context"))
    few = spark.createDataFrame([("type", t, f"name {i}") for i in range(3) for t in ("org", "outfit")], "field string, value string, context string")
    learned = learned_aliases(many.unionByName(few), canon(spark))
    assert {(r.phrase, r.canon_id, r.votes) for r in learned.collect()} == {("outfit", 2, 3.0)}


def test_empty(spark):
    none = spark.createDataFrame([], "field string, value string")
    assert map_to_canon(none, reference_phrases(canon(spark))).count() == 0
    one = spark.createDataFrame([("type", "person")], "field string, value string")
    assert [r.canon_id for r in map_to_canon(one, reference_phrases(canon(spark, CANON[-1:]))).collect()] == [0]
    stated = spark.createDataFrame([], "field string, value string, context string")
    assert learned_aliases(stated, canon(spark)).count() == 0
    assert learned_aliases(stated, canon(spark, CANON[-1:])).count() == 0
