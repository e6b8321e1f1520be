"""Dense positions and running totals over a whole table without one task seeing all of it.

The table is range-partitioned and sorted, so a row's position is its place in its partition plus
the sizes of the partitions before, and only one row per partition is summed in order. The sorted
table is checkpointed to the folder the session names, since both steps must see the same cut.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session on one machine names none (tests), a folder of its own is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()


def _before(ranged: DataFrame, value: str) -> DataFrame:
    """Sum of `value` over the partitions before each: one row per partition."""
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_own"))
    return parts.select("_part", (F.sum("_own").over(Window.orderBy("_part")) - F.col("_own")).alias("_before"))


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Adds the 0-based position of each row in the order of the given columns, which must tell rows apart."""
    ranged = _ranged(df, order).withColumn("_one", F.lit(1).cast("bigint"))
    placed = ranged.join(_before(ranged, "_one"), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_one", "_before")


def running_total(df: DataFrame, order: list[str], value: str, name: str = "running") -> DataFrame:
    """Adds the sum of `value` over the rows up to and including each, in the order of the given columns."""
    ranged = _ranged(df, order)
    inner = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_inner", inner).join(_before(ranged, value), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_at", "_inner", "_before")
