"""Queries of problem 6: free-entered types and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.canonical import learned_aliases, map_to_canon, reference_phrases
from weft.plans.lookup import lookup
from weft.plans.storage import materialize
from weft.sources.tables import table


def _values(spark: SparkSession, d: str) -> DataFrame:
    def of(tab: str, field: str) -> DataFrame:
        return table(spark, d, tab).select(
            F.lit(tab).alias("tab"), "ref_id", F.lit(field).alias("field"), F.col(field).alias("value")
        )

    rows = of("entity_ref", "type").unionByName(of("relation_ref", "predicate")).where("value is not null")
    entries = table(spark, d, "canon").select("field", F.col("entry").alias("value"), F.lit(True).alias("entry")).where("entry is not null").distinct()
    return lookup(rows, entries, ["field", "value"], "left").where("entry is null").drop("entry")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """field, value, context: types are said of a name, predicates of a subject and an object."""
    types = table(spark, d, "entity_ref").where("name <> ''").select(F.lit("type").alias("field"), F.col("type").alias("value"), F.xxhash64("name").alias("context"))
    pair = F.xxhash64("subject", "object")
    facts = table(spark, d, "relation_ref").where("subject <> '' and object <> ''")
    return types.unionByName(facts.select(F.lit("predicate").alias("field"), F.col("predicate").alias("value"), pair.alias("context")))


def _mapping(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    canon = table(spark, d, "canon")
    aliases = materialize(learned_aliases(_statements(spark, d), canon), "canon-aliases")
    phrases = materialize(reference_phrases(canon, aliases), "canon-reference")
    return materialize(map_to_canon(rows, phrases), "canon-map")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, d)
    mapping = _mapping(spark, d, rows).select("field", "value", "canon_id")
    return lookup(rows, mapping, ["field", "value"]).select("tab", "ref_id", "canon_id").distinct()


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry, with the number of rows that hold them."""
    rows = _values(spark, d)
    mapping = _mapping(spark, d, rows).where("canon_id = 0").select("field", "value")
    counts = rows.select("tab", "ref_id", "field", "value").distinct().groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(mapping, ["field", "value"])


def p6_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The phrases that the data teach for an entry, and the contexts that vote for it."""
    return learned_aliases(_statements(spark, d), table(spark, d, "canon")).withColumn("votes", F.round("votes", 6))


QUERIES = {"p6_aliases": p6_aliases, "p6_found": p6_found, "p6_unmatched": p6_unmatched}
ORACLES: dict[str, str] = {}
