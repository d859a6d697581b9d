import random
from itertools import combinations

from pyspark.sql import functions as F

from weft.llm.name_words import NameWords, content, if_few, learn_words, settled, shortens
from weft.llm.names import Reader, _read, _read_by_tables, link_names

WORDS = NameWords(
    {w: "org" for w in ("dairy", "association", "tidal", "institute")} | {"lake": "given", "katherine": "given", "conference": "event"},
    {"kate": "katherine", "lk": "lake", "dai": "dairy", "assoc": "association", "inst": "institute", "conf": "conference"},
)

ENTITIES = [
    ["Marit Jorabrulark", " Marit Jorabrulark", "Jorabrulark, Marit", "Mr Marit Jorabrulark", "Marit Jorabrrulark", "MARIT JORABRULARK"],
    ["Katherine Roliprosent", "Kate Roliprosent", "Roliprosent, Katherine", "K. Roliprosent", "Roliprosent Katherine", "Katherine Q. Roliprosent"],
    ["Dagny Jorabrulark", "Dagny  Jorabrulark"],
    ["Podrikerark Dairy Association", "Dairy Association of Podrikerark", "Podrikerark Dai. Assoc.", "Podrikerark DA", "The Podrikerark Dairy Asociation Ltd"],
    ["Podrikerark Tidal Institute", "Podrikerark Tid. Inst."],
    ["Lake Nilidokyn", "Nilidokyn, Lake", "Lk. Nilidokyn", "Lake Nílidokyn"],
    ["Furagrumin TR-130", "TR-130 Furagrumin", "Furagrumin TR 130", "Fuagrumin TR-130"],
    ["Furagrumin TR-430"],
    ["Molidronan Conference 2022", "Molidronan Conference '22", "Molidronan Conf. 2022", "2022 Molidronan Conference"],
    ["Molidronan Conference 2001"],
]


def test_spellings(spark):
    names = [n for e in ENTITIES for n in e]
    # given names are known by the families that share them
    more = [f"{g} {s}" for g in ("Marit", "Dagny", "Katherine") for s in ("Badrogrerark", "Huradurield", "Fonubekin", "Denudrekent")]
    df = spark.createDataFrame([(n, 1) for n in [*names, *more, "Marit Jorabrulark"]] + [(None, 1), ("", 1), ("?!", 1)], "name string, entity int")
    of = {r.name: r.entity for r in link_names(df, WORDS).collect()}
    assert set(of) == {*names, *more}
    wanted = {frozenset(p) for e in ENTITIES for p in combinations(e, 2)}
    found = {frozenset(p) for p in combinations(names, 2) if of[p[0]] == of[p[1]]}
    assert found == wanted
    assert len({of[n] for n in more}) == len(more)


def test_readings():
    read_name = Reader(WORDS).read
    assert read_name("") is None and read_name("--- ???") is None
    assert read_name("x" * 20_000).core == "x" * 20_000
    assert read_name("Prof. Ada B. Lovelacean")[:3] == ("person", "lovelacean", "ada")
    assert read_name("Symposium") is not None


def test_empty(spark):
    assert link_names(spark.createDataFrame([], "name string")).count() == 0


def coined(rng):
    return "".join(rng.choice("bdgklmnprt") + rng.choice("aeiou") for _ in range(5)).capitalize()


def test_words_are_learned(spark):
    rng = random.Random(3)
    names = []
    for _ in range(12):
        for given, nick in (("Robert", "Bob"), ("Josephine", "Josie"), ("Ulf", None), ("Vesna", None)):
            surname = coined(rng)
            names += [f"{given} {surname}", f"Mr {given} {surname}"] + ([f"{nick} {surname}"] if nick else [])
        for first, second, short in (("Copper", "Union", "Cop. Un."), ("Alpine", "Bureau", "Alp. Bur."), ("Copper", "Bureau", "Cop. Bur."), ("Alpine", "Union", "Alp. Un.")):
            core = coined(rng)
            names += [f"{core} {first} {second}", f"{core} {first} {second} Ltd", f"{core} {short}"]
        event = coined(rng)
        names += [f"{event} Gala 2011", f"{event} Moot 2012", f"{event} Gala '13"]
    names += [f"{a} {b}" for a in ("fiscal", "budget", "vector", "graph", "keyword") for b in ("drift", "audit", "policy", "storage", "ranking")]
    for surname in ("Zumatoge", "Zarikemi"):  # some families without a nickname
        names += [f"{g} {surname}" for g in ("Robert", "Josephine", "Vesna")]
    names += ["word " * 3000, "\u0301\u0302", "7 8 9", "A"]
    learned = learn_words(spark.createDataFrame([(n,) for n in sorted(set(names))], "name string"))
    of = learned.roles
    assert {w for w in of if of[w] == "org"} == {"copper", "alpine", "union", "bureau"} and {w for w in of if of[w] == "event"} == {"gala", "moot"}
    assert {"robert", "josephine", "ulf", "vesna"} <= {w for w in of if of[w] == "given"}
    assert learned.shorts == {"bob": "robert", "josie": "josephine", "cop": "copper", "alp": "alpine", "un": "union", "bur": "bureau"}


def test_contents():
    assert content("Dr. Ana Bo-Ri, 2001", frozenset({"dr"})) == (["ana", "bo", "ri"], True)
    assert content("Zed TR-130 DA", frozenset()) == (["zed"], False)
    assert shortens("mfg", "manufacturing") and not shortens("bob", "robert") and not shortens("lake", "lake")


def test_nothing_to_learn(spark):
    for names in ([], ["Ada"], ["Ada Lovelace", "Bob Lovelace"]):
        assert learn_words(spark.createDataFrame([(n,) for n in names], "name string")) == NameWords()


def test_a_long_chain_of_spellings_is_one_entity(spark):
    core = list("bcdfghjklmnpqrstvwxz" * 3)
    chain, rows = [], []
    for i in range(40):
        core[i] = "a"
        chain.append("".join(core))
        rows += [(chain[-1],)] * (i + 1)
    found = link_names(spark.createDataFrame(rows, "name string"))
    assert {r.rows for r in found.collect()} == set(range(1, 41)) and found.select("entity").distinct().count() == 1


def test_words_are_common_however_many_names_there_are(spark):
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    many = spark.range(230_000).select(F.concat(letters, F.lit("x "), letters, F.lit("y")).alias("name"))
    few = spark.createDataFrame([(f"Zorblat {core}",) for core in ("Midun", "Karop", "Tesil", "Bogar")], "name string")
    assert learn_words(many.unionByName(few)).roles == {"zorblat": "given"}


def test_chains_of_short_forms_in_tables(spark):
    short = {"a": "b", "b": "c", "c": "d", "x": "y", "y": "x", "t": "s", "s": "x", "one": "two"} | {f"n{i}": f"n{i + 1}" for i in range(40)}
    common = spark.createDataFrame([(w, "given") for w in ("d", "x", "two", "n3", "n40", "free")], "word string, role string")
    shorts = spark.createDataFrame(list(short.items()), "word string, full string")
    roles, ends = settled(common, shorts)
    known = if_few(common, shorts, 100)
    assert if_few(common, shorts, 5) is None and if_few(common, shorts, 40) is None
    assert {r.word: r.role for r in roles.collect()} == known.roles == {w: "given" for w in ("d", "two", "n40", "free")}
    assert {r.word: r.full for r in ends.collect()} == known.shorts and known.shorts["t"] == known.shorts["s"] == "x" and known.shorts["n0"] == "n40"


def test_reading_by_tables_is_reading_in_memory(spark):
    rng = random.Random(5)
    words = [*WORDS.roles, *WORDS.shorts, *WORDS.titles, *WORDS.legal, "the", "of", "Conférence", "assoz", "tid", "kat"]

    def typed(word):
        at = rng.randrange(len(word))
        word = rng.choice([word, word, word.title(), word.upper(), word[:at] + word[at + 1 :], word[:at] + "q" + word[at:], word[: at + 1] + "."])
        return word + rng.choice(["", "", "", ",", "."])

    names = [n for e in ENTITIES for n in e] + ["?!", "word " * 300, "A"]
    names += [" ".join(typed(rng.choice([*words, coined(rng)])) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", " 2001", " '14", " TR-10"]) for _ in range(600)]
    df = spark.createDataFrame([(n, 1) for n in sorted(set(names))], "name string, rows long")
    roles = spark.createDataFrame(list(WORDS.roles.items()), "word string, role string")
    shorts = spark.createDataFrame(list(WORDS.shorts.items()), "word string, full string")
    wanted = {tuple(r) for r in _read(df, WORDS).collect()}
    found = {tuple(r) for r in _read_by_tables(df, roles, shorts).collect()}
    assert found == wanted and len(wanted) > 500


def test_more_words_than_are_held(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"{g} {s}" for s in (coined(rng) for _ in range(8)) for g in ("Robert", "Vesna", "Mr Robert", "Bob", "Robret")]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    wanted = {tuple(r) for r in link_names(df).collect()}
    monkeypatch.setattr("weft.llm.names.MAX_IN_MEMORY", 1)
    assert {tuple(r) for r in link_names(df).collect()} == wanted
