"""Statistics of fits and scores along the steps of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import tukey


def residual_summary(residuals: DataFrame) -> DataFrame:
    """topic_id, mean_abs, max_abs, n. residuals: topic_id, e."""
    return residuals.groupBy("topic_id").agg(F.avg(F.abs("e")).alias("mean_abs"), F.max(F.abs("e")).alias("max_abs"), F.count("*").alias("n"))


def mean_weights(weights: DataFrame) -> DataFrame:
    """attr, w_mean, n_prompts over prompts. weights: prompt, attr, w."""
    return weights.groupBy("attr").agg(F.avg("w").alias("w_mean"), F.count("*").alias("n_prompts"))


def winrate(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by.., winrate: the mean score; null where no score is known."""
    return scores.groupBy(*by).agg(F.avg(score).alias("winrate"))


def admitted_summary(scores: DataFrame) -> DataFrame:
    """step_idx, mean, max, min of the admitted proposals' partial scores; a step that admits none has a row of nulls."""
    own = F.when(F.col("admitted"), F.col("score"))
    return scores.groupBy("step_idx").agg(F.avg(own).alias("mean"), F.max(own).alias("max"), F.min(own).alias("min"))


def delta_means(pairs: DataFrame, by: list[str], outliers: bool = True) -> DataFrame:
    """by.., delta_rm, delta_j, undesirable: mean deltas (null where none is known), rewards without their outliers on request.

    pairs: by.., delta_rm, delta_j. An attribute is undesirable if its reward goes up and its judge's score does not."""
    rm = pairs.where("delta_rm is not null").withColumn("_by", F.struct(*by))
    kept = rm if outliers else tukey(rm, "_by", "delta_rm")
    judged = pairs.groupBy(*by).agg(F.avg("delta_j").alias("delta_j"))
    rows = judged.join(kept.groupBy(*by).agg(F.avg("delta_rm").alias("delta_rm")), by, "left")
    return rows.select(*by, "delta_rm", "delta_j", F.coalesce((F.col("delta_rm") > 0) & (F.col("delta_j") <= 0), F.lit(False)).alias("undesirable"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("none")).alias("decision")).agg(F.count("*").alias("n"))


def widest_residuals(residuals: DataFrame, most: int = 5) -> DataFrame:
    """topic_id, prompt, spread: the prompts of largest residual range in each topic; ties by prompt. residuals: topic_id, prompt, e."""
    spread = residuals.groupBy("topic_id", "prompt").agg((F.max("e") - F.min("e")).alias("spread"))
    w = Window.partitionBy("topic_id").orderBy(F.desc("spread"), "prompt")
    return spread.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def explained_by_step(fits: DataFrame) -> DataFrame:
    """step_idx, var_explained (mean r2 of prompts), n_prompts, n_images. fits: step_idx, prompt, r2, n_images."""
    return fits.groupBy("step_idx").agg(F.avg("r2").alias("var_explained"), F.count("*").alias("n_prompts"), F.sum("n_images").alias("n_images"))


def hamming_summary(best: DataFrame) -> DataFrame:
    """attr, h_min, h_mean, h_max over the best rows."""
    return best.groupBy("attr").agg(F.min("h").alias("h_min"), F.avg("h").alias("h_mean"), F.max("h").alias("h_max"))


def train_prompts(prompts: DataFrame, topics: DataFrame, val: int, fallback: int = 20) -> DataFrame:
    """topic_id, n_train: a topic's prompts less the validation split, 1 at least; topics without a file count `fallback`."""
    own = prompts.groupBy("topic_id").agg(F.count("*").alias("n"))
    return topics.join(own, "topic_id", "left").select("topic_id", F.coalesce(F.greatest(F.col("n") - val, F.lit(1)), F.lit(fallback)).alias("n_train"))


def accumulated(stats: DataFrame) -> DataFrame:
    """topic_id, attr, prompt, pairs: the score pairs of all steps, in order of step and place. stats: .., step_idx, pos, delta."""
    rows = F.array_sort(F.collect_list(F.struct("step_idx", "pos", "delta")))
    return stats.groupBy("topic_id", "attr", "prompt").agg(F.transform(rows, lambda x: x["delta"]).alias("pairs"))


def ends_by_r2(r2: DataFrame, most: int) -> DataFrame:
    """prompt, r2, place, side: the `most` prompts of largest and of smallest r2; ties by prompt. A prompt of both ends has both rows."""
    def side(name, *order):
        top = r2.orderBy(*order).limit(most)  # a report's top-k
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("side", F.lit(name))

    return side("head", F.desc("r2"), F.asc("prompt")).unionByName(side("tail", F.asc("r2"), F.desc("prompt")))


def edit_results(tasks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """tasks with edited, original (labels of the target; null: no answer), success and error.

    tasks: target, image_id, has_file. before, after: image_id, attr, g of the image and (after: target too) of what an edit for the target made of it. An
    edit is a success if its file is there and the target is found absent; every task counts, whatever the image had before."""
    new = after.where("attr = target").select("target", "image_id", F.col("g").alias("edited"))
    old = before.select(F.col("attr").alias("target"), "image_id", F.col("g").alias("original"))
    rows = tasks.join(new, ["target", "image_id"], "left").join(old, ["target", "image_id"], "left")
    rows = rows.withColumn("edited", F.when(F.col("has_file"), F.col("edited")))
    return rows.withColumns({"success": F.coalesce(F.col("edited") == 0, F.lit(False)), "error": F.when(~F.col("has_file"), "no edited file")})


def edit_success(results: DataFrame) -> DataFrame:
    """target, attempts, success, missing: all tasks, those whose target is gone, and those without an edited file."""
    return results.groupBy("target").agg(F.count("*").alias("attempts"), F.count_if(F.col("success")).alias("success"), F.count_if(~F.col("has_file")).alias("missing"))


def drift(results: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """target, image_id, attr, was, now: what became of the other labels that were 1, for edits that succeeded; now is -1 where the detector gave nothing."""
    had = before.where("g = 1").select("image_id", "attr", F.col("g").alias("was"))
    rows = results.where("success").select("target", "image_id").join(had, "image_id").where("attr <> target")
    new = after.select("target", "image_id", "attr", F.col("g").alias("now"))
    return rows.join(new, ["target", "image_id", "attr"], "left").withColumn("now", F.coalesce("now", F.lit(-1)))


def drift_by_image(images: DataFrame) -> DataFrame:
    """The same from a row an image, without a join: image_id, before [(attr, g)] and edits [(target, has_file, after [(attr, g)])], each attr once."""
    def found(attr):
        return F.try_element_at(F.filter("edit.after", lambda x: x["attr"] == attr), F.lit(1))["g"]

    rows = images.select("image_id", "before", F.explode("edits").alias("edit")).where(F.col("edit.has_file") & (found(F.col("edit.target")) == 0))
    had = F.filter("before", lambda x: (x["g"] == 1) & (x["attr"] != F.col("edit.target")))
    rows = rows.select("image_id", "edit", F.explode(had).alias("had"))
    return rows.select("edit.target", "image_id", "had.attr", F.col("had.g").alias("was"), F.coalesce(found(F.col("had.attr")), F.lit(-1)).alias("now"))


def drift_counts(drifts: DataFrame) -> DataFrame:
    """target, attr, n, n_lost, n_failed."""
    return drifts.groupBy("target", "attr").agg(F.count("*").alias("n"), F.count_if(F.col("now") == 0).alias("n_lost"), F.count_if(F.col("now") == -1).alias("n_failed"))
