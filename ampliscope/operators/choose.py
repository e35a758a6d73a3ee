"""Choices within prompts: top labels, residual extremes, labels of scores, bands, hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import placed


def hash_order(*columns: str, seed: int = 0) -> Column:
    """A fixed pseudo-random order."""
    return F.xxhash64(*columns, F.lit(seed))


def sampled(rows: DataFrame, by: list[str], n: int, *ident: str, seed: int = 0) -> DataFrame:
    """At most n rows of each group, by hash order."""
    w = Window.partitionBy(*by).orderBy(hash_order(*by, *ident, seed=seed), *ident)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def top_per_prompt(weights: DataFrame, n: int, tau: float | None = None) -> DataFrame:
    """prompt, attr, w, rank (from 0): the n largest weights of a prompt, those above tau only."""
    rows = weights if tau is None else weights.where(F.col("w") > tau)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("w"), "attr")) - 1).where(F.col("rank") < n)


def extremes(residuals: DataFrame, n: int) -> DataFrame:
    """prompt, image_id, e, side, rank: the n largest positive and n least negative residuals of prompts that have both signs."""
    rows = residuals.where("e <> 0").withColumn("side", F.when(F.col("e") > 0, "plus").otherwise("minus"))
    both = Window.partitionBy("prompt")
    rows = rows.withColumn("sides", F.size(F.collect_set("side").over(both))).where("sides = 2").drop("sides")
    w = Window.partitionBy("prompt", "side").orderBy(F.desc(F.abs("e")), "image_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def random_sides(residuals: DataFrame, n: int, seed: int = 0) -> DataFrame:
    rows = residuals.where("e <> 0").withColumn("side", F.when(F.col("e") > 0, "plus").otherwise("minus"))
    return sampled(rows, ["prompt", "side"], n, "image_id", seed=seed)


def score_labels(images: DataFrame, mode: str = "zscore") -> DataFrame:
    """images with label: the reward as text, relative to the prompt: none, zscore, minmax or quantile (percent, halves to even)."""
    w = Window.partitionBy("prompt")
    mean, std, low, high = (f("reward").over(w) for f in (F.avg, F.stddev_pop, F.min, F.max))
    ecdf = F.cume_dist().over(w.orderBy("reward"))
    if mode == "none":
        label = F.format_string("%.2f", "reward")
    elif mode == "zscore":
        label = F.format_string("%+.2f", (F.col("reward") - mean) / F.when(std > 0, std).otherwise(1.0))
    elif mode == "minmax":
        label = F.format_string("%.2f", (F.col("reward") - low) / F.when(high > low, high - low).otherwise(1.0))
    elif mode == "quantile":
        label = F.bround(100 * ecdf).cast("int").cast("string")
    else:
        raise ValueError(f"mode {mode!r}")
    return images.withColumn("label", label)


def stratified(images: DataFrame, n: int) -> DataFrame:
    """Of each prompt the n // 2 lowest and n - n // 2 highest rewards, without repeats, with rank by reward."""
    w = Window.partitionBy("prompt")
    up, down = w.orderBy("reward", "image_id"), w.orderBy(F.desc("reward"), F.desc("image_id"))
    rows = images.withColumns({"rank": F.row_number().over(up), "_d": F.row_number().over(down)})
    return rows.where((F.col("rank") <= n // 2) | (F.col("_d") <= n - n // 2)).drop("_d")


def middle_band(r2: DataFrame, low: float, high: float, pick: int, turn: int = 0) -> DataFrame:
    """prompt, r2, idx: prompts by r2 (then prompt); of places floor(n low) to floor(n high) take `pick`, turned by turn x pick, around the end."""
    rows = placed(r2, F.col("r2"), F.col("prompt"))
    n = rows.count()
    first, last = int(n * low), max(int(n * low) + 1, int(n * high))
    size = max(1, min(last, n) - first)
    rows = rows.where((F.col("idx") >= first) & (F.col("idx") < last)).withColumn("idx", F.col("idx").cast("int"))
    return rows.where(F.pmod(F.col("idx") - first - turn * pick, F.lit(size)) < pick)


def reliable(intervals: DataFrame) -> DataFrame:
    """(prompt, attr) whose weight is above zero with its whole interval."""
    return intervals.where("ci_low > 0")
