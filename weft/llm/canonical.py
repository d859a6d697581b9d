"""Mapping free-entered values to a canonical list: token repair, then soft TF-IDF over complete phrases.

Every distinct token of the values joins the tokens of the reference phrases by
edit distance; the repaired tokens are then weighed together (soft TF-IDF) to
rank the phrases, and the best phrase names the entry. Values are reduced to
their distinct ones first, so a value that fills a third of the rows costs one
row. Spaces typed in the wrong place are caught by one more token: the value
written together.

No spelling distance leads from "penned" to ``wrote``. Reference phrases are the
entries, the alternatives of their glosses, and the aliases that the data teach:
what people write where others wrote an entry about the same thing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.edit_join import equal_to, near_to
from weft.plans.lookup import small
from weft.plans.storage import materialize

ARTICLES = ["a", "an", "the"]
#: Words that only help a verb; at the beginning of a phrase they say nothing.
AUXILIARIES = ["is", "are", "was", "were", "be", "been", "has", "have", "had"]
PREPOSITIONS = ["of", "by", "to", "in", "at", "on", "from", "with", "for"]

#: An alias is learned from at least so many contexts, this far beyond chance, and well ahead of the next entry.
LEAST_VOTES = 3.0
LEAST_Z = 5.0
RUNNER_UP = 0.6


def gloss_phrases(gloss: str | None) -> list[str]:
    """The alternatives that a gloss names: parts between commas and "or", up to its object, without articles and helping verbs.

    A preposition that ends the gloss belongs to each alternative of a passive
    ("was bought or taken over by"). An empty gloss has none.
    """
    head = re.split(r"\bthe object\b", (gloss or "").lower())[0]
    parts = [re.findall(r"[^\W_]+", x) for x in re.split(r"[;:,]|\bor\b", head)]
    passive = bool(parts and parts[0] and parts[0][0] in AUXILIARIES)
    parts = [[w for w in x if w not in ARTICLES] for x in parts]
    for x in parts:
        while x and x[0] in AUXILIARIES:
            x.pop(0)
    parts = [x for x in parts if x]
    if passive and parts and parts[-1][-1] in PREPOSITIONS:
        parts = [x if x[-1] in PREPOSITIONS else [*x, parts[-1][-1]] for x in parts]
    return [" ".join(x) for x in parts if any(w not in PREPOSITIONS for w in x)]


def reference_phrases(canon: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """field, canon_id, phrase: each entry, the alternatives of its gloss, and ``aliases`` (field, canon_id, phrase) if there are any."""
    base = canon.select("canon_id", "field", "entry", "gloss").where("entry is not null").distinct()

    @F.pandas_udf("array<string>")
    def said(gloss: pd.Series) -> pd.Series:
        return gloss.map(gloss_phrases)

    phrases = base.select("field", "canon_id", _spoken(F.col("entry")).alias("phrase")).unionByName(
        base.select("field", "canon_id", F.explode(said("gloss")).alias("phrase"))
    )
    if aliases is not None:
        phrases = phrases.unionByName(aliases.select("field", "canon_id", "phrase"))
    return phrases.where("phrase <> ''").distinct()


def _words(text: Column) -> Column:
    """Words in lower case without articles and without leading helping verbs, unless nothing else is there."""
    spaced = F.regexp_replace(text, "(\\p{Ll})(\\p{Lu})", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^\\p{L}\\p{N}]+", " ")), " "), lambda w: w != "")
    bare = F.filter(words, lambda w: ~w.isin(ARTICLES))
    helping = F.aggregate(bare, F.lit(0), lambda n, w: F.when((n >= 0) & w.isin(AUXILIARIES), n + 1).when(n >= 0, -n - 1).otherwise(n))
    bare = F.when(helping < 0, F.slice(bare, -helping, F.greatest(F.size(bare), F.lit(1)))).otherwise(bare)
    return F.when((F.size(bare) > 0) & (helping < 0), bare).otherwise(words)


def _spoken(text: Column) -> Column:
    return F.concat_ws(" ", _words(text))


def readings(values: DataFrame) -> DataFrame:
    """field, value, words: a value as a whole, without its bracket, its bracket, and what follows a colon."""
    read = values.withColumn(
        "words",
        F.explode(
            F.array_distinct(
                F.array(
                    _words(F.col("value")),
                    _words(F.regexp_replace("value", "\\([^)]*\\)?", " ")),
                    _words(F.regexp_extract("value", "\\(([^)]*)", 1)),
                    _words(F.regexp_extract("value", ":(.*)", 1)),
                )
            )
        ),
    )
    return read.where(F.size("words") > 0)


def learned_aliases(statements: DataFrame, canon: DataFrame) -> DataFrame:
    """What people write for an entry, learned from what is stated twice: field, canon_id, phrase, votes.

    statements: field, value, context. Two values of one context are said of the
    same thing. Each context in which a reading stands beside entries gives
    those one vote in all; an entry that takes far more of a reading's votes than
    its share of all of them, and clearly more than the next one, is what the
    reading means. The parts of a value with a bracket count as one context.

    Contexts are reduced to distinct readings before they meet, so one that holds
    a third of the rows is one row per reading. Null contexts and values and
    empty tables teach nothing.
    """
    entries = canon.where("entry is not null").select("field", _spoken(F.col("entry")).alias("reading"), "canon_id").groupBy("field", "reading").agg(F.min("canon_id").alias("canon_id"))
    stated = statements.select("field", "value", F.xxhash64("context").alias("context")).where("value is not null and context is not null").distinct()
    stated = materialize(stated, "canon-stated")
    values = readings(stated.select("field", "value").distinct()).select("field", "value", F.concat_ws(" ", "words").alias("reading")).distinct()
    values = materialize(values.join(entries, ["field", "reading"], "left"), "canon-said")
    several = values.where(F.instr("value", "(") > 0).select("field", F.xxhash64(F.lit("()"), "value").alias("context"), "reading", "canon_id")
    told = materialize(
        stated.join(values, ["field", "value"]).select("field", "context", "reading", "canon_id").unionByName(several).distinct(), "canon-told"
    )
    known = told.where("canon_id is not null").groupBy("field", "context", "canon_id").agg(F.lit(1).alias("one"))
    shares = known.withColumn("share", 1 / F.count(F.lit(1)).over(Window.partitionBy("field", "context"))).select("field", "context", "canon_id", "share")
    votes = (
        told.where("canon_id is null").select("field", "context", "reading").join(shares, ["field", "context"])
        .groupBy("field", "reading", "canon_id").agg(F.sum("share").alias("votes"))
    )
    votes = materialize(votes, "canon-votes")
    overall = votes.groupBy("field", "canon_id").agg(F.sum("votes").alias("mine"))
    overall = overall.select("field", "canon_id", (F.col("mine") / F.sum("mine").over(Window.partitionBy("field"))).alias("chance"))
    ranked = votes.groupBy("field", "reading").agg(
        F.sum("votes").alias("all"), F.max(F.struct("votes", (-F.col("canon_id")).alias("neg"))).alias("top"), F.get(F.sort_array(F.collect_list("votes"), asc=False), F.lit(1)).alias("next")
    ).select("field", "reading", "all", F.col("top.votes").alias("votes"), (-F.col("top.neg")).alias("canon_id"), F.coalesce("next", F.lit(0.0)).alias("next"))
    z = (F.col("votes") - F.col("all") * F.col("chance")) / F.sqrt(F.col("all") * F.col("chance") * (1 - F.col("chance")) + 1e-9)
    sure = (z >= LEAST_Z) | ((F.col("votes") >= 5) & (F.col("votes") >= 0.8 * F.col("all")) & (z >= LEAST_Z / 2))
    return (
        ranked.join(overall, ["field", "canon_id"])
        .where((F.col("votes") >= LEAST_VOTES) & sure & (F.col("next") <= RUNNER_UP * F.col("votes")))
        .select("field", "canon_id", F.col("reading").alias("phrase"), "votes")
    )


def _allowed(size: Column) -> Column:
    return F.when(size >= 6, 2).when(size >= 3, 1).otherwise(0)


def map_to_canon(values: DataFrame, phrases: DataFrame, least: float = 0.74) -> DataFrame:
    """The entry that each distinct value means: field, value, canon_id (0: none does), score.

    values: field string, value string. phrases: see :func:`reference_phrases`.
    The best of a value's :func:`readings` counts. A token may
    be one edit away from three letters on and two edits from six letters on.
    Ties go to the smaller canon_id. Null values are left out; an empty value or
    one without letters and digits means no entry; no phrases give 0 throughout.
    """
    distinct = values.select("field", "value").where("value is not null").distinct()
    read = readings(distinct).select("field", "value", F.concat_ws(" ", "words").alias("reading"), "words").distinct()
    read = materialize(read, "canon-readings")

    vocabulary = phrases.withColumn("words", _words(F.col("phrase"))).withColumn("joined", F.concat_ws("", "words"))
    tokens = lambda df: df.select(
        F.col("field").alias("ns"), F.explode(F.array_distinct(F.concat("words", F.array(F.concat_ws("", "words"))))).alias("key")
    ).distinct()
    pairs = similar_to_short(tokens(read), tokens(vocabulary))
    pairs = materialize(pairs, "canon-tokens")

    # words of the phrases and their weights
    per_phrase = vocabulary.select("field", "canon_id", "phrase", F.explode(F.array_distinct("words")).alias("ref"))
    totals = vocabulary.groupBy("field").agg(F.countDistinct("phrase").alias("total"))
    weights = (
        per_phrase.groupBy("field", "ref").agg(F.countDistinct("phrase").alias("df")).join(totals, "field")
        .select("field", "ref", F.log(1 + F.col("total") / F.col("df")).alias("w"))
    )
    weights, totals = materialize(weights, "canon-weights"), materialize(totals, "canon-totals")
    per_phrase = materialize(per_phrase.join(weights, ["field", "ref"]), "canon-phrases")
    phrase_norm = per_phrase.groupBy("field", "canon_id", "phrase").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    if small(per_phrase):  # as is what is derived from it
        per_phrase, phrase_norm = F.broadcast(per_phrase), F.broadcast(phrase_norm)

    said = read.select("field", "value", "reading", F.explode(F.array_distinct("words")).alias("token"))
    repaired = pairs.select(F.col("ns").alias("field"), F.col("key").alias("token"), "ref", "sim")
    # a token that no reference word is near weighs as a rare one
    best = Window.partitionBy("field", "token").orderBy(F.desc("sim"), F.desc("w"))
    token_weight = (
        repaired.join(weights, ["field", "ref"]).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("field", "token", "w")
    )
    rare = totals.select("field", F.log(1 + F.col("total") / 2).alias("rare"))
    weighed = (
        said.join(token_weight, ["field", "token"], "left").join(rare, "field")
        .withColumn("w", F.coalesce("w", "rare"))
    )
    value_norm = weighed.groupBy("field", "value", "reading").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("vnorm"))
    met = (
        weighed.select("field", "value", "reading", "token", F.col("w").alias("vw"))
        .join(repaired, ["field", "token"])
        .join(per_phrase, ["field", "ref"])
        .groupBy("field", "value", "reading", "canon_id", "phrase", "token")
        .agg(F.max(F.col("sim") * F.col("vw") * F.col("w")).alias("part"))
        .groupBy("field", "value", "reading", "canon_id", "phrase")
        .agg(F.sum("part").alias("dot"))
        .join(value_norm, ["field", "value", "reading"])
        .join(phrase_norm, ["field", "canon_id", "phrase"])
        .select("field", "value", "canon_id", (F.col("dot") / F.col("norm") / F.col("vnorm")).alias("score"))
    )
    whole = (
        read.select("field", "value", F.concat_ws("", "words").alias("token"))
        .join(repaired, ["field", "token"])
        .join(vocabulary.select("field", "canon_id", F.col("joined").alias("ref")).distinct(), ["field", "ref"])
        .select("field", "value", "canon_id", F.col("sim").alias("score"))
    )
    ranked = (
        met.unionByName(whole).where(F.col("score") >= least)
        .groupBy("field", "value", "canon_id").agg(F.max("score").alias("score"))
        .groupBy("field", "value")
        .agg(F.max(F.struct("score", (-F.col("canon_id")).alias("neg"))).alias("top"))
        .select("field", "value", (-F.col("top.neg")).alias("canon_id"), F.col("top.score").alias("score"))
    )
    return distinct.join(ranked, ["field", "value"], "left").select(
        "field", "value", F.coalesce("canon_id", F.lit(0)).cast("int").alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def similar_to_short(strings: DataFrame, reference: DataFrame) -> DataFrame:
    """Token pairs with their similarity: ns, key, ref, sim. Short words are cut for one edit, longer ones for two."""
    size = F.length("key")
    strings, reference = materialize(strings, "canon-strings"), materialize(reference, "canon-vocabulary")
    one = near_to(strings.where(size < 9), reference.where((size >= 3) & (size < 6)), k=1)
    two = near_to(strings.where(size >= 4), reference.where(size >= 6), k=2)
    pairs = one.unionByName(two).unionByName(equal_to(strings, reference))
    longer = F.greatest(F.length("key"), F.length("ref"))
    return pairs.where(F.col("edits") <= _allowed(F.length("ref"))).select("ns", "key", "ref", (1 - F.col("edits") / longer).alias("sim"))
