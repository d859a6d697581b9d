"""Queries of problems 7 and 8: documents packed into containers, and mixed to target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.mixing import mix
from weft.llm.packing import pack
from weft.llm.tokens import with_tokens
from weft.plans.storage import materialize
from weft.sources.tables import table


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(with_tokens(table(spark, d, "documents"), ["doc_id", "source"]), "token-sizes")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), table(spark, d, "pack_option"))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """Packed to the weights of mix_target: for each option the windows that are filled before a source runs out, and how far they are from the weights.

    The shares of the first windows are compared with the wanted ones, source by
    source; off is half the sum of the differences (0: equal, 1: nothing in common).
    """
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_target").where("weight > 0").select("source", F.col("weight").alias("share"))
    own = materialize(targets.join(sizes.groupBy("source").agg(F.sum("tokens").alias("mine")), "source").where("mine > 0"), "pack-own")  # one row a source
    all_weight = own.agg(F.sum("share")).first()[0] or 1.0
    until = own.agg(F.min(F.col("mine") * all_weight / F.col("share"))).first()[0] or 0.0
    placed = pack(sizes, table(spark, d, "pack_option"), shares=own.select("source", "share"))
    windows = placed.join(sizes.select("doc_id", "source"), "doc_id").groupBy("option_name", "container", "source").agg(F.sum("tokens").alias("tokens"))
    windows = materialize(windows, "pack-windows")
    each = windows.groupBy("option_name", "container").agg(F.sum("tokens").alias("all"))
    # a window's place in the output by prefix sums over blocks, then inside a block
    each = each.withColumn("block", F.shiftright("container", 32))
    sums = each.groupBy("option_name", "block").agg(F.sum("all").alias("sum"))
    ahead = Window.partitionBy("option_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("option_name", "block", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("option_name", "block").orderBy("container")
    first = each.join(sums, ["option_name", "block"]).withColumn("end", F.col("before") + F.sum("all").over(inside)).where(F.col("end") <= until)
    grid = first.select("option_name", "container", "all").join(own.select("source", (F.col("share") / all_weight).alias("share")))  # sources of each window
    met = grid.join(windows, ["option_name", "container", "source"], "left").withColumn("got", F.coalesce("tokens", F.lit(0)) / F.col("all"))
    off = met.groupBy("option_name", "container").agg(
        ((F.sum(F.abs(F.col("got") - F.col("share"))) + 1 - F.sum("got")) / 2).alias("off"), F.first("all").alias("all")
    )
    return off.groupBy("option_name").agg(F.count(F.lit(1)).alias("windows"), F.avg("off").alias("mean_off"), F.percentile_approx("off", 0.95).alias("off_95"), F.sum("all").alias("tokens"))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    """Per option: containers, tokens, and the share of all space that is left unused."""
    placed = p7_pack(spark, d).groupBy("option_name", "container").agg(F.sum("tokens").alias("tokens"), F.max("unused").alias("unused"))
    return placed.groupBy("option_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"),
        (F.sum("unused") / F.sum(F.col("tokens") + F.col("unused"))).alias("unused_share"),
    )


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per option: documents placed, and what must not be: containers over the capacity, places that overlap or leave holes, documents cut without need or into wrong pieces."""
    placed = materialize(p7_pack(spark, d), "pack-placed")
    sizes = materialize(_sizes(spark, d).select("doc_id", F.col("tokens").alias("size")), "pack-sizes")
    options = table(spark, d, "pack_option")
    before = Window.partitionBy("option_name", "container").orderBy("place", "tokens", "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    gaps = placed.withColumn("gap", F.col("place") != F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    held = gaps.groupBy("option_name", "container").agg(F.sum("tokens").alias("held"), F.max("unused").alias("unused"), F.sum(F.col("gap").cast("long")).alias("gaps"))
    held = held.join(options, "option_name").groupBy("option_name").agg(
        F.sum((F.col("held") > F.col("capacity_tokens")).cast("long")).alias("overfull"), F.sum((F.col("held") + F.col("unused") != F.col("capacity_tokens")).cast("long")).alias("miscounted"),
        F.sum("gaps").alias("gaps"),
    )
    docs = placed.groupBy("option_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens")).join(sizes, "doc_id").join(options, "option_name")
    good = (F.col("tokens") == F.col("size")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens"))))
    docs = docs.groupBy("option_name").agg(F.count(F.lit(1)).alias("documents"), F.sum((~good).cast("long")).alias("badly_cut"))
    return docs.join(held, "option_name")


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: the share it was to give, whether the mix gives it but for less than one document, and whether no record is used too often."""
    chosen, shares = mix(_sizes(spark, d), table(spark, d, "mix_target"))
    total, largest = chosen.agg(F.sum(F.col("tokens") * F.col("copies")), F.max("tokens")).first()
    return shares.select(
        "source", F.round("wanted_share", 9).alias("wanted_share"), (F.abs(F.col("tokens") - F.col("wanted_share") * (total or 0)) <= (largest or 0)).alias("given"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"),
    )


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_target"))[1]


QUERIES = {"p7_pack": p7_pack, "p7_windows": p7_windows, "p7_unused": p7_unused, "p8_mix": p8_mix, "p8_shares": p8_shares, "p7_whole": p7_whole, "p8_kept": p8_kept}
ORACLES = {
    "p7_whole": """
select option_name, (select count(distinct doc_id) from documents) documents, 0::bigint badly_cut, 0::bigint overfull, 0::bigint miscounted, 0::bigint gaps
from pack_option where (select count(*) from documents) > 0""",
    "p8_kept": """
with own as (select source from mix_target where source in (select source from documents where text <> ''))
select source, round(case when source in (select * from own) then weight / (select sum(weight) from mix_target where source in (select * from own)) else 0 end, 9) wanted_share,
  true given, true within_cap from mix_target""",
}
