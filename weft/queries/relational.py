"""Relational and event-time features that come with the platform, over the star schema and the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.plans.storage import work_dir
from weft.sources.tables import table
from weft.streaming.incremental import run_to_table, windowed


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    cost = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(cost), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
    )


def segment_cube(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.cube("c_mktsegment", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))


def top_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Nations with customers but no suppliers, and those with both."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    both, only = c.intersect(s).withColumn("kind", F.lit("both")), c.subtract(s).withColumn("kind", F.lit("customers only"))
    return both.unionByName(only)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windowed(table(spark, d, "events"), "ts", "1 hour", "10 minutes", ["event_type"], "value")
    return out.withColumn("total", F.round("total", 4))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Distinct events by a file stream, drained into a table and counted by hour: the rows of a batch count."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    at = f"{work_dir(spark)}/weft/stream-{uuid.uuid4().hex}"
    run_to_table(stream.select("event_id", "ts", "event_type", "value"), f"{at}/rows", f"{at}/state")
    rows = spark.read.parquet(f"{at}/rows").dropDuplicates(["event_id"])
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def event_window_stream(spark: SparkSession, d: str) -> DataFrame:
    """The windows of event_windows by a stream with a watermark, in append mode: those that the watermark has passed come out, once."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    at = f"{work_dir(spark)}/weft/stream-{uuid.uuid4().hex}"
    run_to_table(windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", ["event_type"], "value"), f"{at}/rows", f"{at}/state")
    return spark.read.parquet(f"{at}/rows").withColumn("total", F.round("total", 4))


QUERIES = {f.__name__: f for f in (pricing_summary, segment_cube, top_orders_per_customer, set_operations, event_windows, event_stream, event_window_stream)}
ORACLES = {
    "pricing_summary": """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc_price, round(avg(l_discount), 6) avg_disc, count(*) n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
    "segment_cube": """
select c_mktsegment, o_orderpriority, round(sum(o_totalprice), 2) total, grouping_id(c_mktsegment, o_orderpriority)::bigint as level
from orders join customer on o_custkey = c_custkey group by cube (c_mktsegment, o_orderpriority)""",
    "top_orders_per_customer": "select o_custkey, o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rank from orders) where rank <= 3",
    "set_operations": """
select nation, 'both' kind from (select c_nationkey nation from customer intersect select s_nationkey from supplier)
union all select nation, 'customers only' from (select c_nationkey nation from customer except select s_nationkey from supplier)""",
    "event_windows": "select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all",
    "event_window_stream": """
select * from (select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all)
where window_start + interval 1 hour <= (select max(ts) - interval 10 minutes from events)""",
    "event_stream": "select date_trunc('hour', ts) as hour, count(distinct event_id) n from events group by 1",
}
