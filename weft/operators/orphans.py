"""References to records that do not exist.

References are first reduced to one row per (table, key, period) with a
map-side combine, so a key that holds a third of all references costs one row
per period. Keys above a share of all references (at most ``MAX_HEAVY`` keys by
counting) are checked by broadcast, the others by a shuffle join; both results
are united. A group is an orphan as a whole, not at all, or (when its record
arrived inside the group's time range) has to be looked at row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.plans.storage import materialize

#: A key is heavy if it has more than 1/MAX_HEAVY of all references, so there are fewer than MAX_HEAVY heavy keys.
MAX_HEAVY = 1000


def tidy_key(key: Column) -> Column:
    """Blanks around a key and upper case do not matter; an empty key is no key."""
    tidy = F.lower(F.trim(key))
    return F.when(F.length(tidy) > 0, tidy)


def references(df: DataFrame, tab: str, row_key: str, ref: str, loaded_at: str, late: bool) -> DataFrame:
    """One input of :func:`find_orphans`: the references that a table makes.

    Null, empty and blank references are no references and are left out.
    ``late`` says whether a record that arrives after the grace counts as missing.
    """
    return df.select(
        F.lit(tab).alias("tab"),
        F.col(row_key).alias("row_key"),
        tidy_key(F.col(ref)).alias("ref_key"),
        F.col(loaded_at).alias("loaded_at"),
        F.lit(late).alias("late"),
    ).where(F.col("ref_key").isNotNull())


@dataclass
class Orphans:
    """``rows``: tab, row_key, ref_key, loaded_at, period, reason; ``counts``: tab, period, reason, orphans."""

    rows: DataFrame
    counts: DataFrame


def find_orphans(
    refs: DataFrame,
    records: DataFrame,
    key: str,
    loaded_at: str,
    deleted: Column,
    grace: str = "24 hours",
    period_format: str = "yyyy-MM",
) -> Orphans:
    """Orphan references with their reason, and their number per table and period.

    refs: union of :func:`references`. records: the referred table; several rows
    of a key (deliveries) count as one record that exists from its first
    ``loaded_at`` and is deleted if any of its rows is.
    Reasons: ``absent``, ``deleted``, ``late``.

    Defined cases: exact copies of a reference count once; a reference without
    ``loaded_at`` has the period null and is never late; a record without any
    ``loaded_at`` is never late; records with a null key are ignored; either
    side may be empty; other columns of the inputs are ignored.
    """
    refs = refs.select("tab", "row_key", "ref_key", "loaded_at", "late").distinct().withColumn(
        "period", F.date_format("loaded_at", period_format)
    )
    refs = materialize(refs, "orphan-refs")  # read three times below
    known = materialize(
        records.select(tidy_key(F.col(key)).alias("ref_key"), F.col(loaded_at).alias("_at"), deleted.alias("_del"))
        .where(F.col("ref_key").isNotNull())
        .groupBy("ref_key")
        .agg(F.min("_at").alias("first_at"), F.max(F.coalesce("_del", F.lit(False))).alias("is_deleted")),
        "orphan-records",
    )
    groups = materialize(
        refs.groupBy("ref_key", "tab", "period").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("loaded_at").alias("min_at"),
            F.max("loaded_at").alias("max_at"),
            F.count("loaded_at").alias("dated"),
            F.max("late").alias("late"),
        ),
        "orphan-groups",
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    heavy = groups.groupBy("ref_key").agg(F.sum("n").alias("_n")).where(F.col("_n") * MAX_HEAVY > total).select("ref_key")

    # heavy keys: fewer than MAX_HEAVY, so they and their records are small by counting
    heavy_known = known.join(F.broadcast(heavy), "ref_key", "left_semi")
    heavy_groups = groups.join(F.broadcast(heavy), "ref_key", "left_semi").join(F.broadcast(heavy_known), "ref_key", "left")
    light_groups = groups.join(F.broadcast(heavy), "ref_key", "left_anti").join(
        known.withColumn("_known", F.lit(True)), "ref_key", "left"
    )
    bound = F.col("first_at") - F.expr(f"interval {grace}")
    verdict = (
        F.when(F.col("is_deleted").isNull(), "absent")
        .when(F.col("is_deleted"), "deleted")
        .when(~F.col("late") | F.col("min_at").isNull() | F.col("first_at").isNull(), None)
        .when((F.col("max_at") < bound) & (F.col("dated") == F.col("n")), "late")
        .when(F.col("min_at") < bound, "mixed")
    )
    cols = ["ref_key", "tab", "period", "n", "verdict", "bound"]

    def judged(df: DataFrame) -> DataFrame:
        return df.withColumn("bound", bound).withColumn("verdict", verdict).select(*cols).where(F.col("verdict").isNotNull())

    heavy_judged, light_judged = judged(heavy_groups), judged(light_groups)

    def pick(part: DataFrame, verdicts: DataFrame, small: bool = False) -> DataFrame:
        v = verdicts.select(
            F.col("ref_key").alias("_key"), F.col("tab").alias("_tab"), F.col("period").alias("_period"), "verdict", "bound"
        )
        if small:
            v = F.broadcast(v)
        on = (F.col("ref_key") == F.col("_key")) & (F.col("tab") == F.col("_tab")) & F.col("period").eqNullSafe(F.col("_period"))
        return (
            part.join(v, on)
            .where((F.col("verdict") != "mixed") | (F.col("loaded_at") < F.col("bound")))
            .select(
                "tab", "row_key", "ref_key", "loaded_at", "period",
                F.when(F.col("verdict") == "mixed", "late").otherwise(F.col("verdict")).alias("reason"),
            )
        )

    heavy_rows = refs.join(F.broadcast(heavy), "ref_key", "left_semi")
    light_rows = refs.join(F.broadcast(heavy), "ref_key", "left_anti")
    rows = pick(heavy_rows, heavy_judged, small=True).unionByName(pick(light_rows, light_judged))

    whole = (
        heavy_judged.unionByName(light_judged).where("verdict <> 'mixed'")
        .select("tab", "period", F.col("verdict").alias("reason"), "n")
    )
    mixed = pick(heavy_rows, heavy_judged.where("verdict = 'mixed'"), small=True).unionByName(
        pick(light_rows, light_judged.where("verdict = 'mixed'"))
    )
    counts = (
        whole.unionByName(mixed.select("tab", "period", "reason", F.lit(1).cast("long").alias("n")))
        .groupBy("tab", "period", "reason")
        .agg(F.sum("n").alias("orphans"))
    )
    return Orphans(rows, counts)
