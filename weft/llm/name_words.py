"""Word knowledge about names, learned from the names themselves.

A name is a rare word (its core) among common ones. A word is common if many
different rarer words stand beside it; what else stands there tells its role: a
year (events), other common words (organisations), or the core alone (given
names and kinds of places). A short form or nickname stands with the same cores
as the word that it is short for: most of its cores are cores of that word, which
for unrelated words is a coincidence of one family in many.

Titles and legal forms, which are few and closed classes, are given.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weft.plans.lookup import lookup
from weft.plans.storage import materialize

TITLES = frozenset("mr mrs ms miss dr prof professor sir madam".split())
#: Legal forms say nothing about which organisation is meant.
LEGAL = frozenset("ltd limited inc incorporated co company corp corporation gmbh plc llc".split())
SMALL = frozenset(("the", "of"))

#: A common word stands beside at least so many different rarer words.
LEAST_FAMILIES = 4
#: Words that the driver and the readers may hold; if more are learned, they stay in tables.
MAX_IN_MEMORY = 20_000
#: Share of the names of a common word that have different cores, at least; of a core most names have no rarer word.
LEAST_SPREAD = 0.4
#: Share of a nickname's cores that are cores of the full word, and of a short form's, whose letters speak for it too.
CONTAINED, CONTAINED_ALIKE = 0.5, 0.25

TOKEN = re.compile(r"[^\W_]+|[,.'’]")


@dataclass(frozen=True)
class NameWords:
    """What :func:`weft.llm.names.link_names` knows about the words of names."""

    #: word: "org", "event" or "given" (given names and kinds of places).
    roles: dict[str, str] = field(default_factory=dict)
    #: short form or nickname: the word it stands for.
    shorts: dict[str, str] = field(default_factory=dict)
    titles: frozenset[str] = TITLES
    legal: frozenset[str] = LEGAL


def plain(text: str) -> str:
    marks = unicodedata.normalize("NFKD", text)
    return "".join(c for c in marks if not unicodedata.combining(c))


def content(text: str, skip: frozenset[str]) -> tuple[list[str], bool]:
    """Distinct words of a name that may be a core, a common word or a short form, and whether it has a year."""
    said = plain(text)
    tokens, words, year = TOKEN.findall(said), [], False
    for i, typed in enumerate(tokens):
        if typed.isdigit():
            year = year or (len(typed) == 4 and typed[:2] in ("19", "20")) or (len(typed) == 2 and i > 0 and tokens[i - 1] in "'’")
            continue
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        code = any(c.isdigit() for c in typed) or (len(typed) <= 3 and after.isdigit() and len(after) != 4)
        acronym = 2 <= len(typed) <= 4 and typed.isupper() and not said.isupper()
        word = typed.lower()
        if len(word) > 1 and typed.isalpha() and not code and not acronym and word not in skip:
            words.append(word)
    return list(dict.fromkeys(words)), year


def shortens(short: str, word: str) -> bool:
    """Whether the letters of ``short`` come in ``word`` in this order, the first one first."""
    rest = iter(word)
    return len(short) < len(word) and short[0] == word[0] and all(c in rest for c in short)


def learn_words(names: DataFrame, titles: frozenset[str] = TITLES, legal: frozenset[str] = LEGAL) -> NameWords:
    """Roles and short forms of the words of ``names`` (name string, distinct).

    Every name counts, and every word that has the families of a common word is
    one. Few names teach nothing, and then none of them is taken for common. All
    words come to the driver; see :func:`learned_tables` for more than it holds.
    """
    common, short = learned_tables(names, titles, legal)
    return _in_memory(common.collect(), short.collect(), titles, legal)


def if_few(common: DataFrame, short: DataFrame, most: int, titles: frozenset[str] = TITLES, legal: frozenset[str] = LEGAL) -> NameWords | None:
    """The :func:`learned_tables` in memory, unless one of them has more than ``most`` rows."""
    roles = common.limit(most + 1).collect()
    shorts = short.limit(most + 1).collect() if len(roles) <= most else []
    return _in_memory(roles, shorts, titles, legal) if max(len(roles), len(shorts)) <= most else None


def _in_memory(common: list[Row], short: list[Row], titles: frozenset[str], legal: frozenset[str]) -> NameWords:
    shorts, ends = {r["word"]: r["full"] for r in short}, {}
    for first in shorts:
        word, seen = first, set()
        while word in shorts and word not in seen:
            seen.add(word)
            word = shorts[word]
        ends[first] = word
    return NameWords({r["word"]: r["role"] for r in common if r["word"] not in ends}, {a: b for a, b in ends.items() if a != b}, titles, legal)


def settled(common: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as tables, for any number of words: word, role; word, full (the last word of a chain of short forms)."""
    short = materialize(short, "words-short")
    ends = _followed(short)
    loops = materialize(ends.select(F.col("full").alias("word")).distinct().join(short.select("word"), "word", "left_semi"), "words-loops")
    if loops.limit(1).count():  # words that stand for each other: a chain ends at the first of them
        ends = _followed(materialize(short.join(loops, "word", "left_anti"), "words-short"))
    return materialize(common.select("word", "role").join(short.select("word"), "word", "left_anti"), "words-roles"), ends


def _followed(short: DataFrame) -> DataFrame:
    """Each round doubles the length of the chains that are followed; loops don't settle, but are met in so many rounds."""
    for _ in range(short.count().bit_length() + 1):
        onward = short.select(F.col("word").alias("full"), F.col("full").alias("next"))
        moved = short.join(onward, "full", "left").select("word", F.coalesce("next", "full").alias("full"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "words-short")
        short = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return short


def learned_tables(names: DataFrame, titles: frozenset[str] = TITLES, legal: frozenset[str] = LEGAL) -> tuple[DataFrame, DataFrame]:
    """What :func:`learn_words` learns, as found: word, role of the common words; word, full of the short forms, which may be common too or have one themselves."""
    skip = titles | legal | SMALL

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*content(name, skip), name) for name in batch["name"]]
            yield pd.DataFrame(rows, columns=["words", "year", "name"])

    said = names.select("name").mapInPandas(read, "words array<string>, year boolean, name string").where(F.size("words") > 1)
    said = materialize(said.select(F.xxhash64("name").alias("id"), "words", "year"), "words-said")
    each = said.select("id", "year", F.size("words").alias("size"), F.explode("words").alias("word"))
    df = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "words-df")
    rarest = (
        lookup(each, df, ["word"]).groupBy("id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "word"))), 1, 2).alias("two"), F.first("year").alias("year"), F.first("size").alias("size"))
        .select("id", "year", "size", F.col("two.word").alias("two"))
    )
    rarest = materialize(rarest, "words-rarest")
    words = said.select("id", F.explode("words").alias("word")).join(rarest, "id")
    # of each word: its cores (the rarest other word), and how it is used
    used = words.withColumn("core", F.when(F.col("two")[0] != F.col("word"), F.col("two")[0]))
    stats = used.groupBy("word").agg(F.countDistinct("core").alias("families"), F.avg(F.col("year").cast("double")).alias("years"), F.avg("size").alias("size"), F.count(F.lit(1)).alias("df"))
    stats = materialize(stats, "words-stats")
    spread = F.col("families") > LEAST_SPREAD * F.col("df")
    common = stats.where((F.col("families") >= LEAST_FAMILIES) & spread).select(
        "word", "families", F.when(F.col("years") > 0.5, "event").when(F.col("size") >= 2.5, "org").otherwise("given").alias("role")
    )
    common = materialize(common, "words-common")

    pairs = words.select("word", F.explode("two").alias("core")).where("word <> core").distinct()
    pairs = materialize(pairs.join(common.select(F.col("word").alias("core")), "core", "left_anti"), "words-pairs")
    whole = pairs.join(common.select("word", "role"), "word").select("core", F.col("word").alias("full"), "role")
    own = materialize(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("own")).where("own >= 2"), "words-own")
    @F.pandas_udf("boolean")
    def alike(short: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([shortens(x, y) for x, y in zip(short, word)], dtype="bool")

    met = (
        pairs.join(own, "word").join(whole, "core").where("word <> full").groupBy("word", "full", "role", "own").agg(F.count(F.lit(1)).alias("both"))
        .where((F.col("both") >= 2) & (F.col("both") >= CONTAINED_ALIKE * F.col("own")))
        .join(own.select(F.col("word").alias("full"), F.col("own").alias("whole")), "full")
        .join(stats.select("word", F.col("size").alias("words")), "word")
        .withColumn("alike", alike("word", "full"))
        .where(F.col("alike") | ((F.col("role") == "given") & (F.col("own") < F.col("whole")) & (F.col("words") < 2.5) & (F.col("both") >= F.greatest(F.lit(3.0), CONTAINED * F.col("own")))))
    )
    # other letters, and several words that it may stand for: it stands beside whatever they do
    best = met.groupBy("word").agg(F.max(F.struct("alike", "both", "full")).alias("best"), F.count(F.lit(1)).alias("several"))
    best = best.where("best.alike or several = 1").select("word", F.col("best.full").alias("full"))
    return common, best
