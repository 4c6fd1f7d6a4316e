"""Tables between two steps, in the folder that driver and executors share, and numbers that need no single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session may have none set and gets a temporary folder; a cluster must."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ConfigurationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str = "lodestone") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back: its lineage ends here, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds each row's number within `by`, in an order by values: rows are placed by ranges, and a range's first number is the sum of the counts
    before it. So a group of any size is numbered by many tasks. by and order together should tell rows apart."""
    spark = df.sparkSession
    placed = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).withColumn("_part", F.spark_partition_id())
    placed = stash(placed, "numbered")
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    base = placed.groupBy("_part", *by).agg(F.count("*").alias("_n")).select("_part", *(F.col(c).alias(f"_by_{c}") for c in by), before.alias("_base"))
    same = F.col("_part") == F.col("_own")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    x = placed.join(base.withColumnRenamed("_part", "_own"), same)
    return x.withColumn(name, F.col("_base") + F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1 + start).drop("_part", "_own", "_base", *(f"_by_{c}" for c in by))
