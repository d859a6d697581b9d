"""Queries of problem 1: the spellings in entity_ref.name, relation_ref.subject and relation_ref.object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.names import link_names
from weft.plans.storage import materialize
from weft.sources.tables import table


def _names(spark: SparkSession, d: str) -> DataFrame:
    relation = table(spark, d, "relation_ref")
    return (
        table(spark, d, "entity_ref").select("name")
        .unionByName(relation.select(F.col("subject").alias("name")))
        .unionByName(relation.select(F.col("object").alias("name")))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    linked = materialize(link_names(_names(spark, d)), "names-linked")
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per spelling: the commonest spelling of its entity, and how many spellings that has."""
    linked = materialize(link_names(_names(spark, d)), "names-linked")
    heads = linked.groupBy("entity").agg(
        F.max(F.struct("rows", "name")).getField("name").alias("main_name"), F.count(F.lit(1)).alias("spellings")
    )
    return linked.join(heads, "entity").select("name", "rows", "main_name", "spellings")


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
ORACLES: dict[str, str] = {}
