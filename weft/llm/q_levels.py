"""Queries of problem 9: the reading level of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.levels import CUTS, familiar_words, fit, labelled_rows, measured, reading_levels, scored
from weft.plans.storage import materialize
from weft.sources.tables import table

#: The one familiar list of the plain formula.
ONE_LIST = (0.2,)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_label"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("level >= 4").select("doc_id")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and mean sentence length per language and level."""
    return _levels(spark, d).groupBy("lang", "level").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"), F.round(F.avg("sentence_length"), 3).alias("sentence_length")
    )


def p9_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Fit on the labels of half of the labelled documents, held against those of the other half: with all lists, and with one."""
    docs = table(spark, d, "documents").where("text <> ''")
    lists = familiar_words(docs)
    found = materialize(measured(docs, lists, "doc_id"), "level-measures")
    rows: pd.DataFrame = labelled_rows(found, table(spark, d, "level_label"), "doc_id").toPandas().sort_values("doc_id")
    held = rows["doc_id"] % 2 == 1
    said = rows[held][["doc_id", "level"]].rename(columns={"level": "said"})
    said = materialize(spark.createDataFrame(said, "doc_id long, said double"), "level-said")
    mine = materialize(found.join(said.select("doc_id"), "doc_id", "left_semi"), "level-held")
    out = []
    for cuts in (CUTS, ONE_LIST):
        both = scored(mine, fit(rows[~held], lists.languages, cuts=cuts), "doc_id").join(said, "doc_id")
        hard, truly = F.col("level") >= 4, F.col("said") >= 3.5
        out.append(
            both.agg(
                F.lit(len(cuts)).alias("lists"), F.count(F.lit(1)).alias("documents"),
                F.avg((F.abs(F.col("level") - F.col("said")) <= 0.5).cast("double")).alias("same_level"),
                F.avg((hard == truly).cast("double")).alias("same_side"),
                (F.sum((hard & truly).cast("double")) / F.sum(hard.cast("double"))).alias("precision"),
                (F.sum((hard & truly).cast("double")) / F.sum(truly.cast("double"))).alias("recall"),
            )
        )
    return out[0].unionByName(out[1])


QUERIES = {"p9_found": p9_found, "p9_profile": p9_profile, "p9_accuracy": p9_accuracy}
ORACLES: dict[str, str] = {}
