import random

from pyspark.sql import functions as F

from weft.plans import lookup as L
from weft.plans.components import connected_components
from weft.plans.storage import materialize, work_dir


def test_lookup_is_the_same_by_every_way(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)] + [(999, "none"), (998, None)], "id int, k string")
    table = materialize(spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int"))
    for how in ("inner", "left"):
        wanted = sorted(map(str, rows.join(table, ["k"], how).select("id", "k", "v").collect()))
        for bound, heavy in ((100_000, 1000), (0, 1000), (0, 3)):
            monkeypatch.setattr(L, "MAX_BROADCAST_ROWS", bound)
            monkeypatch.setattr(L, "MAX_HEAVY", heavy)
            assert sorted(map(str, L.lookup(rows, table, ["k"], how).select("id", "k", "v").collect())) == wanted, (how, bound, heavy)
    assert L.lookup(rows.limit(0), table, ["k"]).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 7), (2000, 2000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges * 2, "a int, b int")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == {x: root(x) for x in list(parent)}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_materialize(spark):
    df = spark.range(10).select(F.col("id"), F.lit(None).cast("string").alias("x"))
    out = materialize(df, "t")
    assert out.schema.names == ["id", "x"] and out.count() == 10
    assert all(work_dir(spark) in f for f in out.inputFiles())
    assert spark.conf.get("spark.checkpoint.dir") == work_dir(spark)


def test_late_rows_of_a_stream(spark, tmp_path):
    from weft.streaming.incremental import run_to_table, windowed

    schema = "ts timestamp, kind string, value double"
    batches = [
        [("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:55:00", "a", 2.0)], [("2024-01-01 12:30:00", "a", 4.0)], [("2024-01-01 12:31:00", "a", 64.0)],
        [("2024-01-01 10:10:00", "a", 8.0), ("2024-01-01 12:25:00", "a", 16.0)], [("2024-01-01 15:00:00", "b", 32.0)],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/batch={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/batch=*")
    run_to_table(windowed(stream, "ts", "1 hour", "10 minutes", ["kind"], "value"), f"{tmp_path}/rows", f"{tmp_path}/state")
    got = {(str(r.window_start), r.kind): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    # the row of 10:10 came after its window was closed; that of 12:25 in time; the last window is still open
    assert got == {("2024-01-01 10:00:00", "a"): (2, 3.0), ("2024-01-01 12:00:00", "a"): (3, 84.0)}
