"""Image files as a table: a listing, read without contents, joined to the manifest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (relative to folder), length, modified of all files below folder; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(relative(F.col("path"), folder).alias("path"), "length", F.col("modificationTime").alias("modified"))


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)"


def relative(path: Column, folder: str) -> Column:
    """A path from folder on, whatever the scheme of either; other paths stay. Steps of `.` go."""
    root = re.sub(_SCHEME, "", folder).rstrip("/") + "/"
    bare = F.regexp_replace(path, _SCHEME, "")
    inside = F.when(bare.startswith(root), F.substring(bare, len(root) + 1, 1 << 30)).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(inside, r"^(\./)+", ""), r"/(\./)+", "/")


def with_files(manifest: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """manifest (.., image_path) with length of the file, null where there is none; paths may be relative to folder or whole."""
    own = files.select(F.col("path").alias("_path"), "length")
    return manifest.withColumn("_path", relative(F.col("image_path"), folder)).join(own, "_path", "left").drop("_path")


def usable_images(manifest: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The manifest's images whose file is there."""
    return with_files(manifest, files, folder).where("length is not null").drop("length")


def image_counts(prompts: DataFrame, manifest: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """prompt, n_listed, n_files, missing: for every asked prompt the images of the manifest and those with a file; missing where it has none."""
    per = with_files(manifest, files, folder).groupBy("prompt").agg(F.count("*").alias("n_listed"), F.count("length").alias("n_files"))
    rows = prompts.select("prompt").distinct().join(per, "prompt", "left").fillna(0, ["n_listed", "n_files"])
    return rows.withColumn("missing", F.col("n_files") == 0)


def scored_prompts(manifest: DataFrame, score: str, least: int = 2) -> DataFrame:
    """The images that have the named score, of prompts with at least `least` of them; score as `reward`. manifest: prompt, image_id, reward_scores.

    A count is joined back, so a prompt of very many images is never one task's."""
    rows = manifest.withColumn("reward", F.col("reward_scores")[score]).where(F.col("reward").isNotNull() & ~F.isnan("reward")).drop("reward_scores")
    enough = rows.groupBy("prompt").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("prompt")
    return rows.join(enough, "prompt", "left_semi")


def id_paths(manifest: DataFrame, folder: str) -> DataFrame:
    """image_id, path relative to folder; an id that is listed twice keeps the least path."""
    return manifest.groupBy("image_id").agg(F.min(relative(F.col("image_path"), folder)).alias("path"))
