"""Readers of run artifacts. Keys of JSON objects are data here, so schemas are explicit maps and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import resolved, step_and_topic

MANIFEST = "metadata STRUCT<model_id STRING, image_width INT, image_height INT, images_per_prompt INT, random_seed INT, topic_ids ARRAY<INT>>, baselines MAP<STRING, ARRAY<STRUCT<image_path STRING, image_id STRING, prompt STRING, policy_model STRING, reward_scores MAP<STRING, DOUBLE>>>>"
CLUSTER = "category STRING, prompts ARRAY<STRING>, summary STRING"
STEP = "step_idx INT, topic_id INT, acc_pool ARRAY<STRING>, W MAP<STRING, DOUBLE>, W_mode STRING, reg_var_explained DOUBLE, n_residual_images INT, raw_candidates ARRAY<STRING>, humanness_rejected ARRAY<STRING>, validated ARRAY<STRING>, candidate_ahat MAP<STRING, DOUBLE>, candidate_partial_ahat MAP<STRING, DOUBLE>, tau DOUBLE, per_prompt_r2 MAP<STRING, DOUBLE>"
WEIGHTS = "step_idx INT, topic_id INT, attrs ARRAY<STRING>, per_prompt_W MAP<STRING, ARRAY<DOUBLE>>, per_prompt_r2 MAP<STRING, DOUBLE>"
HISTORY = "topic_id INT, history ARRAY<MAP<STRING, DOUBLE>>"
RESULTS = "run_id STRING, config_snapshot STRING, top_attributes ARRAY<STRUCT<attribute STRING, delta_rm DOUBLE, delta_j DOUBLE, amplification_score DOUBLE, step_found INT, step_last_survived INT, topic_id INT, is_undesirable BOOLEAN>>, n_steps_completed INT, cost_usd DOUBLE, wall_time_seconds DOUBLE"
CURVES = "run_id STRING, search_results_path STRING, topic_id INT, attributes ARRAY<STRING>, n_values ARRAY<INT>, n_trials INT, n_val_prompts INT, prevalence MAP<STRING, ARRAY<DOUBLE>>"
CLEANUP = "initial_pool ARRAY<STRING>, initial_loo_scores MAP<STRING, DOUBLE>, removed ARRAY<STRUCT<removal_rank INT, attribute STRING, loo_score DOUBLE, pool_size_before INT>>, kept_pool ARRAY<STRING>, kept_loo_scores MAP<STRING, DOUBLE>"
PAIRS = "by_attr MAP<STRING, MAP<STRING, ARRAY<STRUCT<pos_image_id STRING, neg_image_id STRING, pos_image_path STRING, neg_image_path STRING, hamming_other INT, n_others INT, pos_reward DOUBLE, neg_reward DOUBLE, rank INT>>>>"
META = "MAP<STRING, STRUCT<prompt STRING, category STRING>>"


def documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A row per JSON file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def prompts(spark: SparkSession, path: str, val: int = 40, seed: int = 42) -> DataFrame:
    """topic_id, pos, prompt, split, category, summary of cluster files: the last `val` prompts of a fixed hash order are the validation split."""
    from pyspark.sql import Window

    rows = documents(spark, path, CLUSTER).withColumn("topic_id", F.regexp_extract("path", r"cluster_(\d+)", 1).cast("int"))
    rows = rows.select("topic_id", "category", "summary", F.explode("prompts").alias("prompt")).withColumn("prompt", F.trim("prompt")).where("prompt <> ''")
    w = Window.partitionBy("topic_id")
    pos = F.row_number().over(w.orderBy(F.xxhash64("prompt", F.lit(seed)), "prompt")) - 1
    rows = rows.withColumns({"pos": pos, "_n": F.count(F.lit(1)).over(w)})
    return rows.withColumn("split", F.when(F.col("pos") >= F.col("_n") - val, "val").otherwise("train")).drop("_n")


def manifest(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """prompt, image_id, image_path, policy_model, reward_scores of every entry; relative paths are resolved against root."""
    rows = documents(spark, path, MANIFEST).select(F.explode("baselines").alias("prompt", "entries")).select("prompt", F.explode("entries").alias("e"))
    return rows.select("prompt", "e.image_id", (resolved("e.image_path", root) if root else F.col("e.image_path")).alias("image_path"), "e.policy_model", "e.reward_scores")


def rewards(entries: DataFrame, model: str) -> DataFrame:
    """image_id, reward for one reward model; NaN (a failed score) counts as missing."""
    r = F.col("reward_scores")[model]
    return entries.select("prompt", "image_id", r.alias("reward")).where(r.isNotNull() & ~F.isnan(r))


def detections(spark: SparkSession, path: str, model_key: str) -> DataFrame:
    """image_id, attr, g under one key of a detection cache, whose other keys may hold lists."""
    cache = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("key", "body")).where(F.col("key") == model_key)
    return cache.select(F.explode(F.from_json("body", "MAP<STRING, MAP<STRING, INT>>")).alias("image_id", "labels")).select("image_id", F.explode("labels").alias("attr", "g"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """model_key, topic_id, attr of the rejected lists of a detection cache."""
    cache = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("key", "body")).where("key like '\\\\_rejected::%'")
    name = F.regexp_extract("key", r"^_rejected::(.*)::([^:]*)$", 1)
    return cache.select(name.alias("model_key"), F.regexp_extract("key", r"::([^:]*)$", 1).alias("topic_id"), F.explode(F.from_json("body", "ARRAY<STRING>")).alias("attr"))


def steps(spark: SparkSession, path: str) -> DataFrame:
    """Step artifacts; step and topic come from the file name where the body lacks them."""
    rows = documents(spark, path, STEP)
    step, topic = step_and_topic("path")
    return rows.withColumns({"step_idx": F.coalesce("step_idx", step), "topic_id": F.coalesce("topic_id", topic)})


def weights(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, step_idx, prompt, k, attr, w."""
    rows = documents(spark, path, WEIGHTS).select("topic_id", "step_idx", "attrs", F.explode("per_prompt_W").alias("prompt", "w"))
    return rows.select("topic_id", "step_idx", "prompt", F.posexplode(F.arrays_zip("attrs", "w")).alias("k", "z")).select("topic_id", "step_idx", "prompt", "k", F.col("z.attrs").alias("attr"), "z.w")


def r2_history(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, step_idx, prompt, r2."""
    rows = documents(spark, path, HISTORY).select("topic_id", F.explode("history").alias("h"))
    return rows.select("topic_id", F.col("h")["step"].cast("int").alias("step_idx"), F.explode(F.map_filter("h", lambda k, _: k != "step")).alias("prompt", "r2"))


def results(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, RESULTS).select("run_id", F.explode("top_attributes").alias("a")).select("run_id", "a.*")


def curves(spark: SparkSession, path: str) -> DataFrame:
    """run_id, topic_id, attr, n, prev."""
    rows = documents(spark, path, CURVES).select("run_id", "topic_id", "n_values", F.explode("prevalence").alias("attr", "p"))
    return rows.select("run_id", "topic_id", "attr", F.explode(F.arrays_zip("n_values", "p")).alias("z")).select("run_id", "topic_id", "attr", F.col("z.n_values").alias("n"), F.col("z.p").alias("prev"))


def cleanup(spark: SparkSession, path: str) -> DataFrame:
    """attr, loo of the kept pool, in pool order (pos)."""
    rows = documents(spark, path, CLEANUP).select(F.posexplode("kept_pool").alias("pos", "attr"), "kept_loo_scores")
    return rows.select("pos", "attr", F.col("kept_loo_scores")[F.col("attr")].alias("loo"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = documents(spark, path, PAIRS).select(F.explode("by_attr").alias("attr", "m")).select("attr", F.explode("m").alias("prompt", "ps"))
    return rows.select("attr", "prompt", F.explode("ps").alias("p")).select("attr", "prompt", "p.*")


def corpus_meta(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", META)).alias("id", "m"))
    return rows.select("id", "m.prompt", "m.category")


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """pos, attr of a line file: blank lines and # comments are skipped, repeats too."""
    from ..operators.pools import ordered_distinct

    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "attr")).withColumn("attr", F.trim("attr"))
    return ordered_distinct(rows.where("attr <> '' and not startswith(attr, '#')"), "attr")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, mime, data_url of image files."""
    from ..functions.scalars import data_url

    mime = F.when(F.lower("path").endswith(".png"), "image/png").when(F.lower("path").rlike(r"\.jpe?g$"), "image/jpeg").otherwise("application/octet-stream")
    return spark.read.format("binaryFile").load(path).select("path", mime.alias("mime"), data_url("content", mime).alias("data_url"))
