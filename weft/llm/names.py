"""Linking the spellings of one entity among names typed by people.

Each distinct string is read once: accents, case, titles, legal forms, articles
and word order are set aside, short forms are written out, and what is left is a
name space (what must agree: the kind of thing, its line of work, its year or
number) and a core (what may hold typos: the surname or the coined word). Cores
of one name space meet in the pigeonhole segment join; a rare spelling joins the
commonest one within the allowed edits. Initials and acronyms then join the one
entity that they can stand for, and stay apart if there are several.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.edit_join import SegmentIndex, distance_udf, equal_to, near_to, similar_pairs
from weft.llm.name_words import LEGAL, MAX_IN_MEMORY, SMALL, TITLES, TOKEN, NameWords, if_few, learned_tables, plain, settled
from weft.plans.lookup import lookup
from weft.plans.storage import materialize

K = 2


class Name(NamedTuple):
    """ns and core: see above. given: of a person. short: the name space of its short form. partial: it is a short form."""

    ns: str
    core: str
    given: str
    short: str
    partial: bool
    swap: bool


class Reader:
    """Reads names with the help of some word knowledge."""

    def __init__(self, words: NameWords | None = None):
        self.words = words = words or NameWords()
        self._roles: dict[tuple[str, bool], tuple[str, str]] = {}
        full = {w: (r, w) for w, r in words.roles.items()} | {s: (words.roles.get(w, "given"), w) for s, w in words.shorts.items()}
        self.given = {w for w, (r, _) in full.items() if r == "given"}
        self.lexicon = {w: x for w, x in full.items() if x[0] != "given"}
        self.lexicon |= {w: ("legal", w) for w in words.legal} | {w: ("title", w) for w in words.titles} | {w: ("small", w) for w in SMALL}
        self.long = SegmentIndex(w for w in self.lexicon if len(w) >= 4 and self.lexicon[w][0] != "title")
        self.long_given = SegmentIndex(w for w in self.given if len(w) >= 4)
        self.kinds = sorted(w for w, r in words.roles.items() if r != "given")

    def _role(self, word: str, dotted: bool) -> tuple[str, str]:
        """What a word is: legal, title, small, org, event or word; and the word written out."""
        key = word, dotted
        if key not in self._roles:
            if len(self._roles) > 100_000:
                self._roles.clear()
            self._roles[key] = self._find_role(word, dotted)
        return self._roles[key]

    def _find_role(self, word: str, dotted: bool) -> tuple[str, str]:
        if word in self.lexicon:
            return self.lexicon[word]
        if word in self.given:
            return "word", word
        if dotted and len(word) >= 3:
            at = bisect_left(self.kinds, word)
            meant = [w for w in self.kinds[at : at + 2] if w.startswith(word)]
            if len(meant) == 1:
                return self.lexicon[meant[0]]
        near = self._near(word, self.long)
        return self.lexicon[near] if near else ("word", word)

    def _near(self, word: str, known: SegmentIndex) -> str | None:
        """The known word that ``word`` is most likely a misspelling of."""
        if len(word) < 4:
            return None
        near = [(d, x) for d, x in known.near(word, 2 if len(word) >= 8 else 1) if d * 4 <= len(x)]
        return min(near)[1] if near else None

    def is_given(self, word: str) -> bool:
        return word in self.given or self._near(word, self.long_given) is not None

    def read(self, text: str) -> Name | None:
        """None if the string holds no word."""
        said = plain(text)
        tokens = TOKEN.findall(said)
        words: list[tuple[str, str, str]] = []  # role, written out, as typed
        comma, year, digits, code = None, "", "", ""
        for i, typed in enumerate(tokens):
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if typed == ",":
                comma = len(words) if comma is None and words else comma
            elif typed in ".'’":
                continue
            elif typed.isdigit():
                if len(typed) == 4 and typed[:2] in ("19", "20"):
                    year = typed
                elif len(typed) == 2 and i and tokens[i - 1] in "'’":
                    year = ("20" if typed < "50" else "19") + typed
                else:
                    digits += typed
            elif (m := re.fullmatch(r"([A-Za-z]{1,3})(\d{2,4})", typed)) or (len(typed) in (2, 3) and after.isdigit() and len(after) != 4):
                code = m[1].lower() + m[2] if m else typed.lower()
            elif len(typed) == 2 and typed.isupper() and not said.isupper():
                words.append(("word", typed.lower(), typed))  # an acronym, though it may look like "of" or "Ms"
            else:
                words.append((*self._role(typed.lower(), after == "."), typed))
        generic = [w for r, w, _ in words if r in ("org", "event")]
        roles = {r for r, *_ in words}
        core = " ".join(w for r, w, _ in words if r == "word")
        if code and (digits or code[-1].isdigit()) and core:
            return Name(f"product|{code}{digits}", core, "", "", False, False)
        if "event" in roles and year and core:
            return Name(f"event|{' '.join(generic)}|{year}", core, "", "", False, False)
        if "org" in roles or "event" in roles:
            tail = f"|{year}{digits}" if year or digits else ""
            if not core:
                return Name("org|" + tail, " ".join(generic), "", "", False, False)
            return Name(f"org|{' '.join(generic)}{tail}", core, "", f"acronym|{''.join(w[0] for w in generic)}", False, False)
        if year or digits:
            return Name(f"other|{year}{digits}", core or " ".join(generic), "", "", False, False) if core or generic else None
        if not core:
            rest = " ".join(w for _, w, _ in words)
            return Name("other|", rest, "", "", False, False) if rest else None
        return self._person(words, comma, said)

    def _person(self, words: list[tuple[str, str, str]], comma: int | None, said: str) -> Name | None:
        named = [(w, typed, k) for k, (r, w, typed) in enumerate(words) if r == "word"]
        full = [x for x in named if len(x[0]) > 1]
        initials = [x for x in named if len(x[0]) == 1]
        if not full:
            return Name("other|", "".join(w for w, *_ in initials), "", "", False, False)
        capital = [x for x in full if 2 <= len(x[0]) <= 4 and x[1].isupper()]
        if len(full) == 2 and len(capital) == 1 and not said.isupper():
            core = next(w for w, typed, _ in full if typed != capital[0][1])
            return Name(f"acronym|{capital[0][0]}", core, "", "", True, False)
        if len(full) == 1:
            if not initials:
                return Name("other|", full[0][0], "", "", False, False)
            return Name(f"initial|{initials[0][0]}", full[0][0], "", "", True, False)
        if comma is not None:
            surname = " ".join(w for w, _, k in full if k < comma)
            given = next((w for w, _, k in full if k >= comma), "")
            if surname and given:
                given = self.words.shorts.get(given, given)
                return Name("person", surname, given, f"initial|{given[0]}", False, False)
        given, surname = full[0][0], full[-1][0]
        if given not in self.given and (surname in self.given or (self.is_given(surname) and not self.is_given(given))):
            given, surname = surname, given
        given = self.words.shorts.get(given, given)
        return Name("person", surname, given, f"initial|{given[0]}", False, len(full) == 2 and given not in self.given)


class TableReader(Reader):
    """Reads names of which :func:`_word_facts` says what is known about their words."""

    def know(self, facts: Iterable[dict]) -> None:
        self._facts = {x["word"]: x for x in facts}
        self.given = {w for w, x in self._facts.items() if x["given"]} | {x["short"] for x in self._facts.values() if x["short_given"]}
        self.words = NameWords({}, {w: x["short"] for w, x in self._facts.items() if x["short"]})

    def _role(self, word: str, dotted: bool) -> tuple[str, str]:
        meant = self._facts[word]["dotted" if dotted else "plain"] if word in self._facts else None
        return (meant["role"], meant["full"]) if meant else ("word", word)

    def is_given(self, word: str) -> bool:
        return word in self._facts and self._facts[word]["near_given"]


def _word_facts(tokens: DataFrame, roles: DataFrame, shorts: DataFrame) -> DataFrame:
    """What a :class:`Reader` finds out about each of ``tokens`` (word, distinct), by joins; words that say nothing are left out.

    roles, shorts: see :func:`weft.llm.name_words.settled`.
    """
    given = roles.where("role = 'given'").select("word")
    fixed = [(w, r, w) for r, known in (("small", SMALL), ("title", TITLES - SMALL), ("legal", LEGAL - TITLES - SMALL)) for w in sorted(known)]
    fixed = tokens.sparkSession.createDataFrame(fixed, "word string, role string, full string")
    full = shorts.join(roles.select(F.col("word").alias("full"), "role"), "full", "left").select("word", F.coalesce("role", F.lit("given")).alias("role"), "full")
    full = full.unionByName(roles.select("word", "role", F.col("word").alias("full"))).join(fixed.select("word"), "word", "left_anti")
    full = materialize(full.unionByName(fixed), "names-words")
    meant = F.struct("role", "full")

    starts = (
        roles.where("role <> 'given'").join(full, ["word", "role"]).where(F.length("word") >= 3)
        .select("word", "role", "full", F.explode(F.sequence(F.lit(3), F.length("word"))).alias("n"))
        .groupBy(F.substring("word", F.lit(1), F.col("n")).alias("word")).agg(F.count(F.lit(1)).alias("several"), F.first(meant).alias("begun"))
        .where("several = 1").select("word", "begun")
    )
    kind = F.when(F.col("role") == "given", "given").otherwise("other")
    long = full.where((F.length("word") >= 4) & (F.col("role") != "title"))
    refs = materialize(long.select(kind.alias("ns"), F.col("word").alias("key")), "names-long")
    keys = tokens.where(F.length("word") >= 4).select(F.explode(F.array(F.lit("given"), F.lit("other"))).alias("ns"), F.col("word").alias("key"))
    keys = materialize(keys, "names-tokens")
    near = near_to(keys.where(F.length("key") < 8), refs, 1).unionByName(near_to(keys.where(F.length("key") >= 8), refs, 2))
    near = near.where(F.col("edits") * 4 <= F.length("ref"))
    near = near.join(full.select(F.col("word").alias("ref"), "role", "full"), "ref")
    near = near.groupBy(F.col("key").alias("word")).agg(
        F.min(F.when(F.col("ns") == "other", F.struct("edits", "ref", "role", "full"))).alias("near"), F.max(F.col("ns") == "given").alias("near_given")
    )
    short = shorts.join(given.select(F.col("word").alias("full"), F.lit(True).alias("short_given")), "full", "left")
    facts = (
        tokens.join(full, "word", "left").join(starts, "word", "left").join(near, "word", "left")
        .join(short.select("word", F.col("full").alias("short"), "short_given"), "word", "left")
        .withColumn("given", F.coalesce(F.col("role") == "given", F.lit(False)))
        .withColumn("exact", F.when(F.col("role") != "given", meant))
        .withColumn("near", F.when(~F.col("given"), F.struct("near.role", "near.full")))
        .withColumn("near", F.when(F.col("near.role").isNotNull(), F.col("near")))
        .withColumn("begun", F.when(~F.col("given"), F.col("begun")))
        .select(
            "word", F.coalesce("exact", "near").alias("plain"), F.coalesce("exact", "begun", "near").alias("dotted"), "given",
            (F.col("given") | F.coalesce("near_given", F.lit(False))).alias("near_given"), "short", F.coalesce("short_given", F.lit(False)).alias("short_given"),
        )
        .where("plain is not null or dotted is not null or near_given or short is not null")
    )
    return materialize(facts, "names-facts")


def _read_by_tables(names: DataFrame, roles: DataFrame, shorts: DataFrame) -> DataFrame:
    """:func:`_read` for any number of known words: each name comes with the facts about its own."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "words": [list({x.lower(): 1 for x in TOKEN.findall(plain(n))}) for n in batch["name"]]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TableReader()
        for batch in batches:
            rows = []
            for name, n, facts in zip(batch["name"], batch["rows"], batch["facts"]):
                reader.know(facts if facts is not None else ())
                if found := reader.read(name):
                    rows.append((name, n, *found))
            yield pd.DataFrame(rows, columns=["name", "rows", *Name._fields])

    said = materialize(names.select("name").mapInPandas(split, "name string, words array<string>").select("name", F.explode("words").alias("word")), "names-said")
    facts = _word_facts(said.select("word").distinct(), roles, shorts)
    known = lookup(said, facts, ["word"]).groupBy("name").agg(F.collect_list(F.struct("word", "plain", "dotted", "given", "near_given", "short", "short_given")).alias("facts"))
    return names.join(known, "name", "left").select("name", "rows", "facts").mapInPandas(read, READ)


READ = "name string, rows long, ns string, core string, given string, short string, partial boolean, swap boolean"


def _read(names: DataFrame, words: NameWords) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(words)
        for batch in batches:
            rows = [(name, n, *found) for name, n in zip(batch["name"], batch["rows"]) if (found := reader.read(name))]
            yield pd.DataFrame(rows, columns=["name", "rows", *Name._fields])

    return names.mapInPandas(read, READ)


def link_names(names: DataFrame, words: NameWords | None = None) -> DataFrame:
    """The entity of every distinct name: name, rows, entity long.

    names: name string, in any number of rows. Null and empty strings are left
    out, and so are strings without a letter or digit. Strings are kept exactly
    as they are, blanks and case included. Repeated rows only make a spelling
    commoner; ties go to the lesser spelling. No names give no rows; other
    columns are ignored. What is known about words is learned from the names
    unless ``words`` says it.
    """
    distinct = names.select("name").where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    distinct = materialize(distinct, "names-distinct")
    if words is None:
        learned = learned_tables(distinct)
        words = if_few(*learned, MAX_IN_MEMORY)
    parsed = _read(distinct, words) if words is not None else _read_by_tables(distinct, *settled(*learned))
    parsed = materialize(parsed, "names-read")

    # "Surname Given": turn names round whose last word is a given name of many and whose first is not
    people = parsed.where("ns = 'person'")
    givens = people.groupBy("given").agg(F.countDistinct("core").alias("families"))
    doubtful = (
        people.where("swap").join(givens, "given", "left")
        .join(givens.select(F.col("given").alias("core"), F.col("families").alias("_other")), "core", "left")
        .where((F.col("_other") >= 2) & (F.col("_other") > 2 * F.coalesce("families", F.lit(0))))
        .select("name", F.lit(True).alias("turn"))
    )
    parsed = parsed.join(doubtful, "name", "left").select(
        "name", "rows", "ns",
        F.when(F.col("turn"), F.col("given")).otherwise(F.col("core")).alias("core"),
        F.when(F.col("turn"), F.col("core")).otherwise(F.col("given")).alias("given"),
        F.when(F.col("turn"), F.concat(F.lit("initial|"), F.substring("core", 1, 1))).otherwise(F.col("short")).alias("short"),
        "partial",
    )
    parsed = materialize(parsed.withColumn("node", F.xxhash64("ns", "core", "given")), "names-turned")
    known = parsed.where("ns = 'person'").groupBy("given").agg((F.countDistinct("core") >= 3).alias("known"))
    nodes = parsed.groupBy("node", "ns", "core", "given", "short", "partial").agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("rows").alias("rows")
    )
    nodes = materialize(nodes.join(known, "given", "left").withColumn("known", F.coalesce("known", F.lit(False))), "names-nodes")
    whole = nodes.where("not partial")

    root = _roots(whole)
    found = parsed.join(root, "node", "left").join(_stand_for(nodes, root).withColumnRenamed("root", "short_root"), "node", "left")
    return found.select("name", "rows", F.coalesce("root", "short_root", "node").alias("entity"))


def _roots(whole: DataFrame) -> DataFrame:
    """node, root: the commonest node that a node may be a misspelling of, through others if need be."""
    keys = whole.select("ns", F.col("core").alias("key"))
    # shorter cores may differ in one letter only
    near = similar_pairs(keys.where(F.length("key") >= 7), K).unionByName(
        similar_pairs(keys.where(F.length("key").between(5, 7)), 1).where(F.least(F.length("key_a"), F.length("key_b")) < 7)
    )
    near = near.unionByName(near.select("ns", F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "edits")).unionByName(
        whole.where("ns = 'person'").select("ns", F.col("core").alias("key_a"), F.col("core").alias("key_b"), F.lit(0).alias("edits")).distinct()
    )
    near = materialize(near, "names-near")
    rank = F.struct("spellings", "rows", "core", "given", "node")
    a = whole.select("ns", F.col("core").alias("key_a"), F.col("given").alias("given_a"), F.col("known").alias("known_a"), F.col("node").alias("a"), F.col("spellings").alias("spellings_a"), rank.alias("rank_a"))
    b = whole.select("ns", F.col("core").alias("key_b"), F.col("given").alias("given_b"), F.col("known").alias("known_b"), F.col("node").alias("b"), rank.alias("rank_b"))
    met = (
        near.join(a, ["ns", "key_a"]).join(b, ["ns", "key_b"])
        .where((F.col("rank_b") > F.col("rank_a")) & (~F.col("known_a") | ~F.col("known_b") | (F.col("given_a") == F.col("given_b"))))
        .where((F.col("spellings_a") <= 2) | (F.col("rank_b.spellings") >= 2 * F.col("spellings_a")))
        .where(F.levenshtein("given_a", "given_b", 2 * K) >= 0)  # a swap counts two there; keeps most pairs from Python
        .withColumn("given_edits", distance_udf(K)("given_a", "given_b"))
    )
    size = F.least(F.length("key_a"), F.length("key_b"))
    given_size = F.least(F.length("given_a"), F.length("given_b"))
    met = met.where(
        (F.col("edits") + F.col("given_edits") <= K)
        & (F.col("edits") <= F.when(size >= 7, 2).when(size >= 5, 1).otherwise(0))
        & (F.col("given_edits") <= F.when(given_size >= 8, 2).when(given_size >= 4, 1).otherwise(0))
    )
    best = met.groupBy("a").agg(F.max(F.struct((-F.col("edits") - F.col("given_edits")).alias("close"), "rank_b")).alias("best"))
    up = whole.select("node").join(best.select(F.col("a").alias("node"), F.col("best.rank_b.node").alias("up")), "node", "left")
    up = materialize(up.select("node", F.coalesce("up", "node").alias("root")), "names-up")
    while True:  # each round doubles the length of the paths that are followed
        up = materialize(
            up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "names-up"
        )
        if not up.where("moved").limit(1).count():
            return up.select("node", "root")


def _stand_for(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """node, root of the short forms: the one entity that fits best, or else a node of their own."""
    short = nodes.where("partial").select("node", "ns", "core")
    whole = nodes.where("short <> '' and not partial").join(root, "node").select(F.col("short").alias("ns"), F.col("core").alias("ref"), "root")
    whole = materialize(whole.distinct(), "names-whole")
    keys, refs = short.select("ns", F.col("core").alias("key")), whole.select("ns", F.col("ref").alias("key"))
    long = F.length("key") >= 7
    met = near_to(keys, refs.where(long), K).unionByName(near_to(keys, refs.where(~long), 1)).unionByName(equal_to(keys, refs))
    met = materialize(met, "names-short")
    size = F.least(F.length("key"), F.length("ref"))
    met = met.where(F.col("edits") <= F.when(size >= 7, 2).when(size >= 5, 1).otherwise(0))
    fits = (
        short.join(met.withColumnRenamed("key", "core"), ["ns", "core"]).join(whole, ["ns", "ref"])
        .groupBy("node", "ns", "edits").agg(F.collect_set("root").alias("roots"), F.min("ref").alias("ref"))
        .groupBy("node", "ns").agg(F.min(F.struct("edits", "roots", "ref")).alias("best"))
    )
    return fits.select(
        "node",
        F.when(F.size("best.roots") == 1, F.col("best.roots")[0]).otherwise(F.xxhash64("ns", "best.ref")).alias("root"),
    )
