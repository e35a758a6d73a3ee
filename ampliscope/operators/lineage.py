"""Tables that are worked out once: checkpoints in the shared folder, and places in an order over the whole table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine serves only where all runs in one process."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if not found:
        found = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that a query works on."""
    return f"{shared_folder(spark)}/ampliscope/{name}-{uuid.uuid4().hex}"


def frozen(rows: DataFrame) -> DataFrame:
    """The rows behind a checkpoint in the shared folder."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return rows.checkpoint()


def placed(rows: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """rows with their place from 0 in the whole order, as longs; the order must tell all rows apart.

    Rows are dealt by range, so no task holds more than its part. The dealing is frozen first, as its bounds come from a sample
    that another run may draw anew; then places within a part and the sizes of the parts before it add up."""
    parts = frozen(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, starts = 0, {}
    for r in sorted(parts.groupBy("_part").count().collect()):  # a row a partition
        starts[r["_part"]], before = before, before + r["count"]
    if not starts:
        return parts.withColumn(name, F.lit(0).cast("long")).drop("_part")
    start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))[F.col("_part")]
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, (start + here - 1).cast("long")).drop("_part")
