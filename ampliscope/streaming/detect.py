"""Incremental detection: a stream of images, of which only unknown labels are computed and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pools import misses


#: Folders that labels are dealt into by image; a micro-batch reads those of its own images.
BUCKETS = 64


def detect_stream(images: DataFrame, attrs: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Label a stream of images (image_id, ...) and append (image_id, attr, g) to the table at path.

    The attributes are listed once, when the stream starts. Each micro-batch is one idempotent folder of its batch number, so a batch
    that runs again replaces itself; what is known already is looked up in the buckets that the batch's images fall into."""
    spark = images.sparkSession
    known_schema = "image_id string, attr string, g int"
    listed = spark.createDataFrame([(r["attr"],) for r in attrs.select("attr").distinct().collect()], "attr string")  # a pool
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.select(F.col("image_id").cast("string").alias("image_id"), *[c for c in rows.columns if c != "image_id"]).dropDuplicates(["image_id"])
        if number:
            touched = [r["bucket"] for r in own.select(bucket).distinct().collect()]
            known = spark.read.schema(known_schema + ", batch long, bucket int").parquet(path).where((F.col("batch") != number) & F.col("bucket").isin(touched))
        else:
            known = spark.createDataFrame([], known_schema)
        todo = misses(own, listed, known).join(own, "image_id")
        found = detect(todo).select("image_id", "attr", F.col("g").cast("int").alias("g"))
        found.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return images.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_touch(events: DataFrame) -> DataFrame:
    """cache_key, op, payload of cache events: a put wins over any touch, else the last one. events: cache_key, op, at, payload."""
    return events.groupBy("cache_key").agg(F.max_by(F.struct("op", "payload", "at"), F.struct((F.col("op") == "put").cast("int"), "at")).alias("e")).select("cache_key", "e.*")
