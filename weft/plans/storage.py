"""Where intermediate tables live, and how lineage is cut.

Intermediate results are written as Parquet into the folder that the cluster
names in ``spark.checkpoint.dir`` (shared by all executors), so a lost executor
never loses them and the planner sees real sizes afterwards. Only when the
setting is absent and driver and executors are one process, as in tests, a folder
of this machine is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor loss.

    The folder is deleted when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)
