"""Choosing attributes, prompts and files of a run, and the shape of what is written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected(attrs: DataFrame, wanted: list[str | int]) -> DataFrame:
    """pos, attr, place: attributes named by a part of their text (any case) or by place, in the order of the wishes, each once.

    attrs: pos, attr. A wish that fits nothing is an error."""
    spark = attrs.sparkSession
    wishes = spark.createDataFrame([(i, str(w).lower(), isinstance(w, int)) for i, w in enumerate(wanted)], "wish int, text string, by_pos boolean")
    fits = F.when(F.col("by_pos"), F.col("pos").cast("string") == F.col("text")).otherwise(F.contains(F.lower("attr"), F.col("text")))
    found = attrs.join(F.broadcast(wishes), fits)  # a command line's wishes
    missing = [wanted[r["wish"]] for r in wishes.join(found.select("wish").distinct(), "wish", "left_anti").collect()]
    if missing:
        raise ValueError(f"no attribute fits {missing}")
    first = found.groupBy("pos", "attr").agg(F.min("wish").alias("wish"))
    return first.select("pos", "attr", (F.row_number().over(Window.orderBy("wish", "pos")) - 1).alias("place"))


def first_attrs(rows: DataFrame, n: int, pos: str = "k") -> DataFrame:
    """The rows of the first n attributes by place."""
    return rows.where(F.col(pos) < n)


def containing(attrs: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """pos, attr of the attributes with a part in their text, the first `most` by place."""
    rows = attrs.where(F.contains(F.lower("attr"), F.lit(part.lower())))
    return rows if most is None else rows.orderBy("pos").limit(most)


def only_values(curve: DataFrame, wanted: list[int], column: str = "n") -> DataFrame:
    """The rows of the wanted values; a value that is not there is an error."""
    found = {r[0] for r in curve.where(F.col(column).isin(wanted)).select(column).distinct().collect()}
    if set(wanted) - found:
        raise ValueError(f"unknown values {sorted(set(wanted) - found)}")
    return curve.where(F.col(column).isin(wanted))


def with_missing(prompts: DataFrame, manifest: DataFrame) -> DataFrame:
    """topic_id, n_prompts, n_missing: prompts that the manifest has no image of."""
    own = manifest.select("prompt").distinct().withColumn("there", F.lit(True))
    return prompts.join(own, "prompt", "left").groupBy("topic_id").agg(F.count("*").alias("n_prompts"), F.count_if(F.col("there").isNull()).alias("n_missing"))


def scored_pool(kept: DataFrame, scores: DataFrame, known: DataFrame) -> DataFrame:
    """attr, score, found, place: the kept attributes by (-score, attr), those without a score last; found: whether results know it."""
    rows = kept.join(scores, "attr", "left").join(known.select("attr").distinct().withColumn("found", F.lit(True)), "attr", "left")
    rows = rows.select("attr", F.coalesce("score", F.lit(float("-inf"))).alias("score"), F.coalesce("found", F.lit(False)).alias("found"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "attr")))


def with_sources(selections: DataFrame, sources: DataFrame) -> DataFrame:
    """prompt, attr, images: the source images of each selection in order; an empty list without any."""
    lists = sources.groupBy("prompt", "attr").agg(F.array_sort(F.collect_list("image_id")).alias("images"))
    return selections.join(lists, ["prompt", "attr"], "left").withColumn("images", F.coalesce("images", F.array().cast(lists.schema["images"].dataType)))


def curve_or_zeros(attrs: DataFrame, curve: DataFrame, n_values: list[int]) -> DataFrame:
    """attr, n, prevalence for every attribute and value; zero where the curve has none, as without validation prompts."""
    grid = attrs.select("attr", F.explode(F.array(*map(F.lit, n_values))).alias("n"))
    return grid.join(curve, ["attr", "n"], "left").select("attr", "n", F.coalesce("prevalence", F.lit(0.0)).alias("prevalence"))


def latest_file(files: DataFrame, topics: list[int] | None = None) -> DataFrame:
    """topic_id, step_idx, path of each topic's last step. Two files for one topic and step are an error, as is a wanted topic without one."""
    best = files.groupBy("topic_id").agg(F.max("step_idx").alias("step_idx"))
    rows = files.join(best, ["topic_id", "step_idx"])
    twice = rows.groupBy("topic_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"topic {twice[0]['topic_id']} has several files for its last step")
    if topics is not None and rows.where(F.col("topic_id").isin(topics)).count() < len(set(topics)):
        raise ValueError("a wanted topic has no file")
    return rows


def newest_run(runs: DataFrame, target: str) -> DataFrame:
    """The newest run whose resolved search path is the target. runs: path, search_path, modified."""
    return runs.where(F.col("search_path") == target).orderBy(F.desc("modified"), "path").limit(1)


def pool_of(files: DataFrame, topic: str) -> DataFrame:
    """path, pos, attr: a pool from JSON in any of its forms: a list, a list by topic, or a list under kept, passed, attributes or acc_pool."""
    j = lambda p: F.from_json(F.get_json_object("json", p), "array<string>")
    forms = [F.when(F.trim("json").startswith("["), F.from_json("json", "array<string>")), j(f"$['{topic}']"), *(j(f"$.{k}") for k in ("kept", "passed", "attributes", "acc_pool"))]
    return files.select("path", F.posexplode(F.coalesce(*forms)).alias("pos", "attr"))


def seeded_pool(pool: DataFrame, topic: int) -> DataFrame:
    """A loaded pool as step 0: topic_id, step_idx, pos, attr, without scores."""
    return pool.select(F.lit(topic).alias("topic_id"), F.lit(0).alias("step_idx"), "pos", "attr", F.lit(None).cast("double").alias("score"))


def trimmed(steps: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of a step whose attribute stays."""
    return steps.join(keep.select("attr").distinct(), "attr", "left_semi")


def dropped_prompts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Prompts with weights that a refit has lost."""
    return before.select("prompt").distinct().join(after.select("prompt").distinct(), "prompt", "left_anti")


def running(rows: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """Rows with `rank`, their place from 0 within their prompt in the order of output; the first `most` of each prompt."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("prompt").orderBy(*order)) - 1)
    return out if most is None else out.where(F.col("rank") < most)


def context(images: DataFrame, n: int, rising: bool = True) -> DataFrame:
    """The n images of a prompt that come first by reward (then image), rising or falling, with their place as `rank`."""
    order = [F.asc("reward"), F.asc("image_id")] if rising else [F.desc("reward"), F.desc("image_id")]
    return images.withColumn("rank", F.row_number().over(Window.partitionBy("prompt").orderBy(*order))).where(F.col("rank") <= n)


def expanded(samples: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """attr, image_id, label, place: both images of each pair, shuffled by hash within the attribute, the first `most`."""
    both = samples.select("attr", F.explode(F.array(F.struct(F.col("pos_id").alias("image_id"), F.lit(1).alias("label")), F.struct(F.col("neg_id").alias("image_id"), F.lit(0).alias("label")))).alias("x")).select("attr", "x.*").distinct()
    order = F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), "attr", F.col("image_id").cast("string"), F.col("label").cast("string")), 256)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("attr").orderBy(order))).where(F.col("place") <= most)


def largest_groups(rows: DataFrame, by: str, most: int) -> DataFrame:
    """by, size of the `most` largest groups; ties by name."""
    return rows.groupBy(by).agg(F.count("*").alias("size")).orderBy(F.desc("size"), by).limit(most)


def snapshot(steps: DataFrame) -> DataFrame:
    """topic_id, step_idx, n, n_kept, mean, best, attrs: the written record of a step, scores to 6 places, attributes by (-score, attr)."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "attr")))
    return steps.groupBy("topic_id", "step_idx").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("best"), F.array_join(F.transform(rows, lambda x: x["attr"]), "|").alias("attrs"))
