"""Within-prompt reward quantiles and amplification scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.banks import Bank


def na(g: Column, policy: str = "absent") -> Column:
    """-1 labels as absent (0), raw (-1) or present (1)."""
    if policy not in ("absent", "raw", "present"):
        raise ValueError(f"na policy {policy!r}")
    return g if policy == "raw" else F.when(g == -1, 0 if policy == "absent" else 1).otherwise(g)


def ecdf(by: list[str], reward: str = "reward") -> Column:
    """Share of a group's rewards that are at most this one; ties share the upper rank."""
    return F.cume_dist().over(Window.partitionBy(*by).orderBy(reward))


def rank_u(by: list[str], reward: str = "reward", tie: str = "image_id") -> Column:
    """Ordinal rank over group size; ties are broken by `tie`."""
    w = Window.partitionBy(*by)
    return F.row_number().over(w.orderBy(reward, tie)) / F.count(F.lit(1)).over(w)


def scored(bank: Bank | DataFrame, n: int = 2, mode: str = "bon") -> DataFrame:
    """Long rows with s: ECDF to the power n - 1 (bon) or the reward (kl).

    A wide bank's images all have all labels, so the quantile is taken once per image before labels are exploded. In a long
    bank labels may be missing, and the quantile is per attribute over the images that have it."""
    if mode not in ("bon", "kl"):
        raise ValueError(f"mode {mode!r}")
    s = lambda by: F.pow(ecdf(by), n - 1) if mode == "bon" else F.col("reward")
    if isinstance(bank, Bank):
        usable = Bank(bank.images.where("reward is not null"), bank.attrs)
        return Bank(usable.images.withColumn("s", s(["prompt"])), bank.attrs).long("s")
    return bank.where("reward is not null and g is not null").withColumn("s", s(["attr", "prompt"]))


def amplification(rows: DataFrame, n: int = 2, mode: str = "bon", policy: str = "absent") -> DataFrame:
    """attr, n_prompts, p1, p0, a_hat from long rows with s: mean over prompts of p1 p0 (E[s|1] - E[s|0]), times n in bon mode.

    Prompts with under two images, or with -1 labels only, do not count; a prompt without both labels counts as 0."""
    g = na(F.col("g"), policy)
    per = rows.withColumn("g", g).groupBy("attr", "prompt").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("g") == 1).alias("n1"),
        F.count_if(F.col("g") == 0).alias("n0"),
        F.avg(F.when(F.col("g") == 1, F.col("s"))).alias("s1"),
        F.avg(F.when(F.col("g") == 0, F.col("s"))).alias("s0"),
    )
    per = per.where("n >= 2 and n1 + n0 > 0").withColumn("c", F.lit(n if mode == "bon" else 1) * F.col("n1") / F.col("n") * F.col("n0") / F.col("n") * F.coalesce(F.col("s1") - F.col("s0"), F.lit(0.0)))
    return per.groupBy("attr").agg(F.count("*").alias("n_prompts"), F.avg(F.col("n1") / F.col("n")).alias("p1"), F.avg(F.col("n0") / F.col("n")).alias("p0"), F.avg("c").alias("a_hat"))


def partial_amplification(rows: DataFrame, n: int = 2, residual: str = "e") -> DataFrame:
    """attr, partial_a_hat: n times the mean over prompts of the covariance of label and residual; prompts with two images or more."""
    per = rows.groupBy("attr", "prompt").agg(F.count("*").alias("m"), F.covar_pop("g", residual).alias("c")).where("m >= 2")
    return per.groupBy("attr").agg((n * F.avg("c")).alias("partial_a_hat"))


def prevalence(rows: DataFrame) -> DataFrame:
    """attr, p1: share of the bank's images with label 1; images without the label count in the denominator."""
    total = rows.agg(F.countDistinct("image_id").alias("total"))
    return rows.groupBy("attr").agg(F.count_if(F.col("g") == 1).alias("n1")).join(F.broadcast(total)).select("attr", (F.col("n1") / F.col("total")).alias("p1"))


def means_by_label(rows: DataFrame) -> DataFrame:
    """attr, n1, n0, mu1, mu0: mean reward with label 1 and with any other label, over all prompts."""
    one = F.col("g") == 1
    return rows.groupBy("attr").agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n0"), F.avg(F.when(one, F.col("reward"))).alias("mu1"), F.avg(F.when(~one, F.col("reward"))).alias("mu0"))


def survivors(scores: DataFrame, tau: float, keep: int, score: str = "a_hat") -> DataFrame:
    """Attributes scored above tau, the best `keep` of them; ties by name."""
    return scores.where(F.col(score) > tau).orderBy(F.desc(score), "attr").limit(keep)
