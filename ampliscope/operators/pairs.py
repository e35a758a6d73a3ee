"""Matched pairs of images of one prompt that differ in a label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sides
from .choose import reliable


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _by_attr(images: DataFrame, attrs: tuple[str, ...], targets: tuple[str, ...] | None, only: DataFrame | None = None) -> DataFrame:
    """The rows once for each target: attr, k (its place) and y (its label); `only` keeps its (prompt, attr)."""
    at = [attrs.index(a) for a in targets or attrs]
    each = F.explode(F.array(*(F.struct(F.lit(attrs[i]).alias("attr"), F.lit(i).alias("k")) for i in at)))
    rows = images.withColumn("z", each).select(*images.columns, "z.attr", "z.k", F.col("g")[F.col("z.k")].alias("y"))
    return rows if only is None else rows.join(only.select("prompt", "attr"), ["prompt", "attr"], "left_semi")


def _side(rows: DataFrame, name: str, y: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One side of pairs under names of its own: <name>_id, <name>_reward, <name>_score (with one), <first letter>g for the labels."""
    rows = rows if y is None else rows.where(F.col("y") == y)
    score = [F.col("score").alias(f"{name}_score")] if "score" in rows.columns else []
    mine = [F.col("image_id").alias(f"{name}_id"), F.col("reward").alias(f"{name}_reward"), F.col("g").alias(f"{name[0]}g")]
    return rows.select(F.col("prompt").alias("prompt"), *(F.col(c).alias(c) for c in keep), *mine, *score)


def crossed(images: DataFrame, attrs: tuple[str, ...], targets: tuple[str, ...] | None = None, max_h: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """prompt, attr, pos_id, neg_id, h, pos_reward, neg_reward: images with the label against images with 0, per prompt.

    h counts the other labels that differ; images may carry a second `score`, which gives pos_score and neg_score. The result
    itself grows with the square of a prompt's images. With max_h, label patterns are paired first, and images join the pairs of
    patterns that are near enough. `only` holds the (prompt, attr) that count."""
    if max_h is None:
        rows = _by_attr(images, attrs, targets, only)
        found = _side(rows, "pos", 1, ("attr",)).join(_side(rows, "neg", 0, ("attr",)), ["prompt", "attr"]).withColumn("h", hamming("pg", "ng") - 1)
    else:
        near = pattern_pairs(images, attrs, targets, only).where(F.col("h") <= max_h).select("prompt", "attr", "pg", "ng", "h")
        found = near.join(_side(images, "pos"), ["prompt", "pg"]).join(_side(images, "neg"), ["prompt", "ng"])
    ends = [f"{side}_{c}" for c in ("reward", "score") if c in images.columns for side in ("pos", "neg")]
    return found.select("prompt", "attr", "pos_id", "neg_id", "h", *ends)


def pattern_pairs(images: DataFrame, attrs: tuple[str, ...], targets: tuple[str, ...] | None = None, only: DataFrame | None = None) -> DataFrame:
    """prompt, attr, pg, ng, h and for either side n, low, high, total, rated (of rewards): label patterns of a prompt that differ in attr.

    Images are first added up by pattern, with partial sums, so a prompt of very many images is as wide as its distinct patterns."""
    seen = images.groupBy("prompt", "g").agg(F.count("*").alias("n"), F.min("reward").alias("low"), F.max("reward").alias("high"), F.sum("reward").alias("total"), F.count("reward").alias("rated"))
    rows = _by_attr(seen, attrs, targets, only)

    def side(name, y):
        return rows.where(F.col("y") == y).select(F.col("prompt").alias("prompt"), F.col("attr").alias("attr"), F.col("g").alias(f"{name[0]}g"), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "low", "high", "total", "rated")))

    return side("pos", 1).join(side("neg", 0), ["prompt", "attr"]).withColumn("h", hamming("pg", "ng") - 1)


def _first(rows: DataFrame, by: list[str], order: list, k: int, name: str = "_r") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def closest(images: DataFrame, attrs: tuple[str, ...], k: int, higher_reward: bool = False, targets: tuple[str, ...] | None = None) -> DataFrame:
    """The k pairs of least (h, pos_id, neg_id) per (prompt, attr), ranked from 1; with higher_reward only pairs where the label's image wins.

    Pairs of patterns by h come first: each holds a pair at least, so those beyond the k-th h (ties included) are out. Of a pair
    of patterns the k least images that have a partner are enough, as each gives a pair that goes before those of later images."""
    both = pattern_pairs(images, attrs, targets)
    if higher_reward:
        both = both.where("pos_high > neg_low")
    both = both.withColumn("_r", F.rank().over(Window.partitionBy("prompt", "attr").orderBy("h"))).where(F.col("_r") <= k)
    rows = both.select("prompt", "attr", "pg", "ng", "h", "neg_low").join(_side(images.drop("score"), "pos"), ["prompt", "pg"])
    if higher_reward:
        rows = rows.where("pos_reward > neg_low")
    rows = _first(rows, ["prompt", "pg", "attr", "ng"], ["pos_id"], k).drop("_r", "neg_low").join(_side(images.drop("score"), "neg"), ["prompt", "ng"])
    if higher_reward:
        rows = rows.where("pos_reward > neg_reward")
    return _first(rows, ["prompt", "attr"], ["h", "pos_id", "neg_id"], k, "rank").select("prompt", "attr", "pos_id", "neg_id", "h", "pos_reward", "neg_reward", "rank")


def identical(images: DataFrame, attrs: tuple[str, ...], k: int, targets: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs that differ in nothing else and have both rewards, by largest reward difference, k per (prompt, attr); ties by ids.

    Sides meet by all other labels. The k highest of one side against the k lowest of the other hold the k best pairs."""
    rest = F.transform("g", lambda x, i: F.when(i == F.col("k"), F.lit(0)).otherwise(x))
    rows = _by_attr(images.drop("score"), attrs, targets).where("reward is not null").withColumn("rest", rest)
    by, keep = ["prompt", "attr", "rest", "y"], ("attr", "rest")
    high, low = (_first(rows, by, [order, "image_id"], k) for order in (F.desc("reward"), F.asc("reward")))

    def met(pos, neg):
        return _side(pos, "pos", 1, keep).drop("pg").join(_side(neg, "neg", 0, keep).drop("ng"), ["prompt", "attr", "rest"])

    both = met(high, low).union(met(low, high)).select("prompt", "attr", "pos_id", "neg_id", "pos_reward", "neg_reward").distinct()
    return _first(both.withColumn("h", F.lit(0)), ["prompt", "attr"], [F.desc(F.abs(F.col("pos_reward") - F.col("neg_reward"))), "pos_id", "neg_id"], k, "rank")


def best_prompts(pairs: DataFrame, most: int) -> DataFrame:
    """attr, prompt, h: for each attr the `most` prompts with the closest pair (of images or patterns); ties by prompt."""
    best = pairs.groupBy("attr", "prompt").agg(F.min("h").alias("h"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("attr").orderBy("h", "prompt"))).where(F.col("r") <= most).drop("r")


def with_gap(pairs: DataFrame, mode: str = "reward") -> DataFrame:
    """Pairs where the label's image wins on reward, with `gap`: of reward, of the second score in size, or of the score where the opposite has no less."""
    gap = {"reward": "pos_reward - neg_reward", "score": "abs(pos_score - neg_score)", "score_up": "neg_score - pos_score"}[mode]
    return pairs.where("pos_reward > neg_reward").withColumn("gap", F.expr(gap)).where("gap is not null and gap >= 0")


#: Share of the ranks that a sketch may be off by.
SKETCH = 1e-4


def gap_cap(pairs: DataFrame, q: float = 0.75) -> DataFrame:
    """attr, cap, n: the interpolated q-quantile of the gap (of reward, if none is given) over pairs where the label's image wins.

    Two passes, none of which moves pairs: a sketch of fixed size brackets the quantile, then what lies below is counted and
    only what lies inside (six SKETCHes of the gaps, or all of up to 1 / SKETCH) is sorted. Equal gaps are held once."""
    gaps = (pairs if "gap" in pairs.columns else with_gap(pairs)).select("attr", "gap")
    ends = [max(0.0, q - 3 * SKETCH), min(1.0, q + 3 * SKETCH)]
    e = gaps.groupBy("attr").agg(F.percentile_approx("gap", ends, int(1 / SKETCH)).alias("e"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n"))
    few = F.col("n") <= int(1 / SKETCH)
    e = e.select("attr", "n", F.when(few, F.col("low")).otherwise(F.col("e")[0]).alias("low"), F.when(few, F.col("high")).otherwise(F.col("e")[1]).alias("high"))
    inside = gaps.join(F.broadcast(e), "attr").where("gap <= high")  # a row an attribute
    sums = inside.groupBy("attr", "n", F.when(F.col("gap") >= F.col("low"), F.col("gap")).alias("gap")).agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("attr").orderBy(F.asc_nulls_first("gap")))
    at = (F.col("n") - 1) * F.lit(q)
    low = F.min(F.when(F.col("upto") > F.floor(at), F.col("gap")))
    high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("gap")))
    return sums.withColumn("upto", before).groupBy("attr", "n").agg(low.alias("l"), high.alias("h")).select("attr", (F.col("l") + (F.col("h") - F.col("l")) * (at - F.floor(at))).alias("cap"), "n")


def pair_weight(h: Column, gap: Column, confidence: Column, h_max: Column, cap: Column) -> Column:
    """The mean of closeness in labels, closeness in reward and clipped confidence."""
    near = 1 - h / F.greatest(h_max, F.lit(1))
    tight = 1 - F.least(gap / F.when(cap > 0, cap).otherwise(1.0), F.lit(1.0))
    sure = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(5.0)) / 5
    return (near + tight + sure) / 3


def matched_by_reward(left: DataFrame, right: DataFrame, tolerance: float | None = None) -> DataFrame:
    """prompt, pos_id, neg_id: each left image in order takes the right image of nearest reward that is still free.

    left, right: prompt, image_id, reward. Rows without a reward are left out; ties go to the lower reward, then image. Taking away
    makes it depend on the order, so a prompt is one task's work: three numbers an image, near linear in time."""
    kind, ident = left.schema["prompt"].dataType.simpleString(), left.schema["image_id"].dataType.simpleString()

    def run(key, a, b):
        a, b = a.sort_values(["reward", "image_id"]), b.sort_values(["r", "i"])
        rewards, out = b["r"].to_numpy(float), []
        n = len(rewards)
        left, right = list(range(n + 1)), list(range(n + 1))  # the next free place below (shifted by one) and above

        def free(link, i):
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return i

        for image, reward in zip(a["image_id"], a["reward"]):
            if len(out) == n or reward != reward:
                break
            at = int(np.searchsorted(rewards, reward))
            low, high = free(left, at) - 1, free(right, at)
            if low >= 0:
                low = free(right, int(np.searchsorted(rewards, rewards[low])))  # the first free one of equal rewards
            if low >= 0 and (high == n or reward - rewards[low] <= rewards[high] - reward):
                high = low
            if high < n and (tolerance is None or abs(rewards[high] - reward) <= tolerance):
                left[high + 1], right[high] = high, high + 1
                out.append((key[0], image, b["i"].iloc[high]))
        return pd.DataFrame(out, columns=["prompt", "pos_id", "neg_id"])

    # Columns of their own on both sides: sides cut from one table share attributes, which column pruning then takes from either.
    left = left.where("reward is not null").select(F.col("prompt").alias("prompt"), F.col("image_id").alias("image_id"), F.col("reward").alias("reward"))
    right = right.where("reward is not null").select(F.col("prompt").alias("p"), F.col("image_id").alias("i"), F.col("reward").alias("r"))
    return left.groupBy("prompt").cogroup(right.groupBy("p")).applyInPandas(run, f"prompt {kind}, pos_id {ident}, neg_id {ident}")


def natural(images: DataFrame, attrs: tuple[str, ...], intervals: DataFrame, max_h: int, q: float = 0.75, per_prompt: int = 5, mode: str = "reward") -> DataFrame:
    """attr, prompt, pos_id, neg_id, h, gap, weight: counterfactual pairs of prompts whose weight of the attr is surely above zero.

    intervals: prompt, attr, w_mean, ci_low, ci_high. The gap cap is the quantile over these prompts' pairs alone, at any distance."""
    sure = reliable(intervals).select("prompt", "attr", "w_mean", "ci_low", "ci_high")
    prompts = sides.kept(sides.by_prompt(images, attrs, sure))
    caps = sides.gap_caps(prompts, attrs, q, mode)
    best = sides.counterfactuals(prompts, attrs, caps, max_h, per_prompt, mode)
    confidence = F.col("w_mean") / F.greatest(F.col("ci_high") - F.col("ci_low"), F.lit(1e-9))
    weight = pair_weight(F.col("h"), F.col("gap"), confidence, F.lit(max_h), F.col("cap"))
    return best.join(sure, ["prompt", "attr"]).join(F.broadcast(caps.select("attr", "cap")), "attr").select("attr", "prompt", "pos_id", "neg_id", "h", "gap", weight.alias("weight"))  # caps: a row an attribute


def summary(pairs: DataFrame) -> DataFrame:
    """attr, n_pairs, n_prompts, mean_h, mean_gap."""
    gap = F.col("pos_reward") - F.col("neg_reward")
    return pairs.groupBy("attr").agg(F.count("*").alias("n_pairs"), F.countDistinct("prompt").alias("n_prompts"), F.avg("h").alias("mean_h"), F.avg(gap).alias("mean_gap"))


def natural_summary(pairs: DataFrame, intervals: DataFrame, attrs: tuple[str, ...]) -> DataFrame:
    """attr, n_pairs, n_prompts, mean_h, mean_gap, mean_weight, min_ci_low of natural(); an attribute without pairs has a row of 0 and nulls."""
    named = pairs.sparkSession.createDataFrame([(a,) for a in attrs], "attr string")
    rows = pairs.join(intervals.select("prompt", "attr", "ci_low"), ["prompt", "attr"], "left")
    per = rows.groupBy("attr").agg(F.count("*").alias("n_pairs"), F.countDistinct("prompt").alias("n_prompts"), F.avg("h").alias("mean_h"), F.avg("gap").alias("mean_gap"), F.avg("weight").alias("mean_weight"), F.min("ci_low").alias("min_ci_low"))
    return named.join(per, "attr", "left").fillna(0, ["n_pairs", "n_prompts"])


def totals(images: DataFrame, attrs: tuple[str, ...], targets: tuple[str, ...] | None = None) -> DataFrame:
    """The summary of all pairs of `crossed`, from pairs of patterns."""
    n, rated = F.col("pos_n") * F.col("neg_n"), F.col("pos_rated") * F.col("neg_rated")
    gap = F.col("pos_total") * F.col("neg_rated") - F.col("neg_total") * F.col("pos_rated")
    return pattern_pairs(images, attrs, targets).groupBy("attr").agg(F.sum(n).alias("n_pairs"), F.countDistinct("prompt").alias("n_prompts"), (F.sum(F.col("h") * n) / F.sum(n)).alias("mean_h"), (F.sum(gap) / F.sum(rated)).alias("mean_gap"))
