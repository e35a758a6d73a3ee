"""Writers. Each writes a new folder through Spark's committer and puts it in place by renaming: a job that fails leaves the old folder as it was.

Between the two renames there is a moment without the folder; tables that are read meanwhile are versions.KeyedTable."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug


def replaced(df: DataFrame, path: str, write: Callable[[str], None]) -> None:
    """What write(folder) writes, at path, in place of what was there."""
    spark, path = df.sparkSession, path.rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, here = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}", path))
    fs = here.getFileSystem(conf)
    try:
        write(new.toString())
        if fs.exists(here) and not fs.rename(here, old) or not fs.rename(new, here):
            raise OSError(f"{path} could not be put in place")
    finally:
        for gone in (new, old) if fs.exists(here) else (new,):
            fs.delete(gone, True)


def json_rows(df: DataFrame, path: str, *by: str) -> None:
    """JSON lines, partitioned by columns if given. Null fields are left out."""
    w = df.write
    replaced(df, path, (w.partitionBy(*by) if by else w).json)


def csv_rows(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    replaced(df, path, lambda folder: df.write.csv(folder, header=header, sep=sep))


def json_documents(df: DataFrame, path: str) -> None:
    """A JSON file for each row, as the readers of run artifacts take them."""
    replaced(df, path, df.write.option("maxRecordsPerFile", 1).json)


def weight_documents(weights: DataFrame, r2: DataFrame) -> DataFrame:
    """A row for each topic and step: attrs in order, per_prompt_W and per_prompt_r2. weights: topic_id, step_idx, prompt, k, attr, w; r2: topic_id, step_idx, prompt, r2."""
    key = ["topic_id", "step_idx"]
    attrs = weights.groupBy(*key).agg(F.transform(F.array_sort(F.collect_set(F.struct("k", "attr"))), lambda z: z["attr"]).alias("attrs"))
    per = weights.groupBy(*key, "prompt").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda z: z["w"]).alias("w"))
    maps = per.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("prompt").cast("string"), "w")))).alias("per_prompt_W"))
    fits = r2.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("prompt").cast("string"), "r2")))).alias("per_prompt_r2"))
    return attrs.join(maps, key).join(fits, key, "left")


def history_documents(r2: DataFrame) -> DataFrame:
    """A row for each topic: the list of its steps, each a map from `step` and the prompts to numbers. r2: topic_id, step_idx, prompt, r2."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("prompt").cast("string"), F.col("r2").cast("double"))))
    step = F.create_map(F.lit("step"), F.col("step_idx").cast("double"))
    steps = r2.groupBy("topic_id", "step_idx").agg(F.map_from_entries(entries).alias("m")).withColumn("m", F.map_concat(step, "m"))
    ordered = F.array_sort(F.collect_list(F.struct("step_idx", F.map_entries("m").alias("m"))))
    return steps.groupBy("topic_id").agg(F.transform(ordered, lambda z: F.map_from_entries(z["m"])).alias("history"))


def final_table(results: DataFrame) -> DataFrame:
    """The table of a run's attributes, scores rounded to four digits, the most amplified first (place)."""
    four = {c: F.round(c, 4) for c in ("delta_rm", "delta_j", "amplification_score")}
    w = Window.orderBy(F.desc("amplification_score"), "topic_id", "attribute")  # a run's attributes: some hundreds
    rows = results.select("attribute", "delta_rm", "delta_j", "amplification_score", "step_found", "step_last_survived", "topic_id")
    return rows.withColumn("place", F.row_number().over(w)).withColumns(four)


def attr_index(attrs: DataFrame, path: str) -> None:
    """A file of `slug<tab>attribute` lines in order of the slugs. attrs: attr."""
    rows = attrs.select(slug("attr").alias("slug"), "attr").distinct().orderBy("slug", "attr")
    csv_rows(rows.coalesce(1), path, "\t", header=False)  # a pool of attributes


def appended(df: DataFrame, path: str, *by: str) -> None:
    """Metrics, call logs and edit logs: new files beside the old."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def upserted(df: DataFrame, path: str, *keys: str) -> None:
    """Append a version of rows; latest() reads the last version of each key."""
    appended(df.withColumn("_version", F.unix_micros(F.current_timestamp())), path)


def latest(df: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("_version"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_version")


def pairs_document(pairs: DataFrame) -> DataFrame:
    """One row per attr: prompts mapped to their ranked pairs, with the reward difference."""
    one = F.struct("rank", "pos_id", "neg_id", F.col("h").alias("hamming_other"), "pos_reward", "neg_reward", (F.col("pos_reward") - F.col("neg_reward")).alias("reward_delta"))
    per = pairs.groupBy("attr", "prompt").agg(F.array_sort(F.collect_list(one)).alias("pairs"))
    return per.groupBy("attr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("prompt").cast("string"), "pairs")))).alias("by_prompt"))


def curve_documents(curves: DataFrame, run_id: str) -> DataFrame:
    """One row per topic: n values and prevalence by attribute. curves: topic_id, attr, n, prev."""
    per = curves.groupBy("topic_id", "attr").agg(F.array_sort(F.collect_list(F.struct("n", "prev"))).alias("z"))
    return per.groupBy("topic_id").agg(F.lit(run_id).alias("run_id"), F.first(F.transform("z", lambda x: x["n"])).alias("n_values"), F.map_from_entries(F.collect_list(F.struct("attr", F.transform("z", lambda x: x["prev"])))).alias("prevalence"))
