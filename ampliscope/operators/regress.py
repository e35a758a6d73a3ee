"""Least squares of the reward quantile on labels, per prompt and pooled, from Gram matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .amplify import ecdf

FLAT = 1e-10  # a prompt whose quantiles vary less than this is not fitted
RCOND = 1e-10


def with_u(images: DataFrame, n: int = 2) -> DataFrame:
    """Images with u, the reward's ECDF within the prompt to the power n - 1."""
    return images.where("reward is not null").withColumn("u", F.pow(ecdf(["prompt"]), n - 1))


def fully_labelled(rows: DataFrame, attrs: tuple[str, ...]) -> DataFrame:
    """Images of a long bank that have every label of attrs, as rows with g in that order."""
    wide = rows.where(F.col("attr").isin(*attrs) & F.col("g").isNotNull()).groupBy("topic_id", "prompt", "image_id", "reward").agg(F.map_from_entries(F.collect_set(F.struct("attr", "g"))).alias("z"))
    return wide.where(F.size("z") == len(attrs)).select("topic_id", "prompt", "image_id", "reward", F.array(*(F.col("z")[a] for a in attrs)).alias("g"))


def whole_prompts(images: DataFrame, rows: DataFrame, attrs: tuple[str, ...]) -> DataFrame:
    """Images with g of prompts whose every image has every label of attrs; one gap leaves the whole prompt out.

    images: topic_id, prompt, image_id, reward; rows: the long bank of them."""
    full = fully_labelled(rows, attrs)
    gaps = images.join(full.select("prompt", "image_id"), ["prompt", "image_id"], "left_anti").select("prompt").distinct()
    return full.join(gaps, "prompt", "left_anti")


def centred_u(images: DataFrame, n: int = 2) -> DataFrame:
    """prompt, image_id, e: what an empty pool leaves of u, its difference from the prompt's mean. Scores alone count, no label is asked for; prompts with one image are left out."""
    w = Window.partitionBy("prompt")
    rows = with_u(images, n).withColumn("_m", F.count(F.lit(1)).over(w)).where("_m >= 2")
    return rows.select("prompt", "image_id", (F.col("u") - F.avg("u").over(w)).alias("e"))


def grams(images: DataFrame, k: int) -> DataFrame:
    """prompt, m and the sums that a fit needs, as arrays: sums of g, of g u, of g g (upper triangle by rows), and of u, u u.

    One shuffle on the prompt with partial sums before it; 0/1 labels keep the sums exact."""
    g = [F.col("g")[i].cast("double") for i in range(k)]
    sums = lambda cols, name: F.array(*map(F.sum, cols)).alias(name)
    return images.groupBy("prompt").agg(F.count("*").alias("m"), sums(g, "sg"), sums([x * F.col("u") for x in g], "sgu"), sums([g[i] * g[j] for i in range(k) for j in range(i, k)], "sgg"), F.sum("u").alias("su"), F.sum(F.col("u") * F.col("u")).alias("suu"))


def centred(frame: pd.DataFrame, k: int):
    """m, Gram matrices (n, k, k), g-u products (n, k) and u-u products (n,) of centred columns."""
    m = frame["m"].to_numpy(float)
    sg, sgu, tri = (np.array(frame[c].tolist(), float).reshape(len(frame), -1) for c in ("sg", "sgu", "sgg"))
    su, suu = frame["su"].to_numpy(), frame["suu"].to_numpy()
    gram = np.zeros((len(frame), k, k))
    rows, cols = np.triu_indices(k)
    gram[:, rows, cols] = gram[:, cols, rows] = tri
    gram -= sg[:, :, None] * sg[:, None, :] / m[:, None, None]
    return m, gram, sgu - sg * (su / m)[:, None], suu - su * su / m


def solved(m, gram, gu, uu, clamp: bool = True):
    """Minimum-norm weights and R squared; prompts that are flat or have fewer images than labels get zeros."""
    k = gu.shape[1]
    w = np.einsum("nij,nj->ni", np.linalg.pinv(gram, rcond=RCOND, hermitian=True), gu) if k else np.zeros_like(gu)
    skip = (uu / m < FLAT) | (m < k)
    w[skip] = 0
    rest = uu - 2 * (w * gu).sum(1) + np.einsum("ni,nij,nj->n", w, gram, w)
    r2 = 1 - rest / np.where(uu > 0, uu, 1)
    r2[skip] = 0
    return w, np.maximum(r2, 0) if clamp else r2


def per_prompt(images: DataFrame, k: int, clamp: bool = True) -> DataFrame:
    """prompt, m, w ARRAY<DOUBLE>, r2: a fit per prompt with two images or more. images: prompt, g, u."""
    kind = images.schema["prompt"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            if len(frame):
                w, r2 = solved(*centred(frame, k), clamp)
                yield pd.DataFrame({"prompt": frame["prompt"], "m": frame["m"], "w": list(w), "r2": r2})

    return grams(images, k).where("m >= 2").mapInPandas(run, f"prompt {kind}, m long, w array<double>, r2 double")


def residuals(images: DataFrame, fits: DataFrame) -> DataFrame:
    """prompt, image_id, e: what a fit leaves of the centred quantile. With per-prompt fits the weights come by a join on the prompt."""
    w = Window.partitionBy("prompt")
    k = F.size("w")
    mean = lambda x: F.avg(x).over(w)
    fitted = F.aggregate(F.zip_with("g", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = images.join(fits.select("prompt", "w"), "prompt").withColumn("f", F.when(k > 0, fitted).otherwise(0.0))
    return rows.select("prompt", "image_id", ((F.col("u") - mean("u")) - (F.col("f") - mean("f"))).alias("e"))


def pooled(images: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """Weights and variance explained of one fit to all prompts' centred rows; the driver sees k (k + 3) / 2 + 1 sums."""
    kind = f"gram array<double>, gu array<double>, uu double"

    def run(frames):
        for frame in frames:
            if len(frame):
                _, gram, gu, uu = centred(frame, k)
                yield pd.DataFrame({"gram": [gram.sum(0).ravel()], "gu": [gu.sum(0)], "uu": [uu.sum()]})

    parts = grams(images, k).where("m >= 2").mapInPandas(run, kind)
    total = parts.agg(F.array(*(F.sum(F.col("gram")[i]) for i in range(k * k))).alias("gram"), F.array(*(F.sum(F.col("gu")[i]) for i in range(k))).alias("gu"), F.sum("uu").alias("uu")).first()
    if total["uu"] is None:
        return np.zeros(k), 0.0
    gram, gu, uu = np.array(total["gram"]).reshape(k, k), np.array(total["gu"]), total["uu"]
    w = np.linalg.pinv(gram, rcond=RCOND, hermitian=True) @ gu
    return w, float(max(0, 1 - (uu - 2 * w @ gu + w @ gram @ w) / uu)) if uu > 0 else 0.0


def one_label(images: DataFrame, attr: int) -> DataFrame:
    """prompt, w, r2 for a single label, JVM side only."""
    g = F.col("g")[attr].cast("double")
    per = images.groupBy("prompt").agg(F.count("*").alias("m"), F.covar_pop(g, F.col("u")).alias("gu"), F.var_pop(g).alias("gg"), F.var_pop("u").alias("uu")).where("m >= 2")
    ok = (F.col("uu") >= FLAT) & (F.col("gg") > 0)
    return per.select("prompt", F.when(ok, F.col("gu") / F.col("gg")).otherwise(0.0).alias("w"), F.when(ok, F.col("gu") * F.col("gu") / (F.col("gg") * F.col("uu"))).otherwise(0.0).alias("r2"))


def two_labels(images: DataFrame, first: int, second: int) -> DataFrame:
    """prompt, w1, w2, r2 for two labels by Cramer's rule; collinear or flat prompts get zeros."""
    a, b, u = F.col("g")[first].cast("double"), F.col("g")[second].cast("double"), F.col("u")
    per = images.groupBy("prompt").agg(F.count("*").alias("m"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, u).alias("au"), F.covar_pop(b, u).alias("bu"), F.var_pop(u).alias("uu")).where("m >= 2")
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    ok = (det > 1e-12) & (F.col("uu") >= FLAT)
    w1 = F.when(ok, (F.col("au") * F.col("bb") - F.col("bu") * F.col("ab")) / det).otherwise(0.0)
    w2 = F.when(ok, (F.col("bu") * F.col("aa") - F.col("au") * F.col("ab")) / det).otherwise(0.0)
    per = per.withColumns({"w1": w1, "w2": w2})
    return per.select("prompt", "w1", "w2", F.when(ok, (F.col("w1") * F.col("au") + F.col("w2") * F.col("bu")) / F.col("uu")).otherwise(0.0).alias("r2"))


def r2_distribution(fits: DataFrame) -> DataFrame:
    return fits.agg(F.count("*").alias("n"), F.avg("r2").alias("mean"), F.percentile("r2", 0.5).alias("median"), F.max("r2").alias("max"), *(F.count_if(F.col("r2") > t).alias(f"over_{int(t * 100):02d}") for t in (0.05, 0.1, 0.2)))


def adjusted(r2, n, k):
    """Adjusted R squared as a column; null where n <= k."""
    r2, n, k = (F.col(x) if isinstance(x, str) else x for x in (r2, n, k))
    return F.when(n > k, 1 - (1 - r2) * (n - 1) / (n - k))


def strongest_correlation(images: DataFrame, k: int) -> DataFrame:
    """prompt, active (labels that vary) and max_corr, the largest |corr(label, u)| among them."""
    per = images.groupBy("prompt").agg(F.count("*").alias("m"), *(F.var_pop(F.col("g")[i]).alias(f"v{i}") for i in range(k)), *(F.corr(F.col("g")[i].cast("double"), "u").alias(f"c{i}") for i in range(k)))
    varies = [F.col(f"v{i}") > 1e-12 for i in range(k)]
    best = F.array_max(F.array(*(F.when(v, F.abs(f"c{i}")) for i, v in enumerate(varies))))
    return per.where("m >= 2").select("prompt", sum(v.cast("int") for v in varies).alias("active"), F.coalesce(best, F.lit(0.0)).alias("max_corr"))


def _loo_sums(m, gram, gu, uu) -> np.ndarray:
    """Per prompt and label, the covariance of the label with what the other labels leave of u."""
    n, k = gu.shape
    out = np.zeros((n, k))
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        w, _ = solved(m, gram[:, rest][:, :, rest], gu[:, rest].copy(), uu) if rest else (np.zeros((n, 0)), None)
        out[:, i] = (gu[:, i] - np.einsum("nj,nj->n", gram[:, i][:, rest], w)) / m
    return out


def leave_one_out(sums: DataFrame, attrs: tuple[str, ...], pool: tuple[str, ...], n: int = 2) -> DataFrame:
    """attr, loo: n times the mean over prompts of each pool member's covariance with the residual of the others."""
    at = [attrs.index(a) for a in pool]

    def run(frames):
        for frame in frames:
            if len(frame):
                m, gram, gu, uu = centred(frame, len(attrs))
                c = _loo_sums(m, gram[:, at][:, :, at], gu[:, at], uu)
                yield pd.DataFrame({"attr": pool, "s": c.sum(0), "p": len(frame)})

    parts = sums.where("m >= 2").mapInPandas(run, "attr string, s double, p long")
    return parts.groupBy("attr").agg((n * F.sum("s") / F.sum("p")).alias("loo"))


def pruned(images: DataFrame, attrs: tuple[str, ...], tau: float = 0.0, n: int = 2) -> tuple[list[tuple[int, str, float]], dict[str, float]]:
    """Removes the member of least leave-one-out score while that is at most tau and others remain.

    Returns the removals (rank, attr, score) and the scores of what is kept. The Gram sums are computed once; each round drops
    rows and columns of them."""
    sums = grams(images, len(attrs)).persist()
    pool, removed = tuple(attrs), []
    try:
        while True:
            scores = {r["attr"]: r["loo"] for r in leave_one_out(sums, attrs, pool, n).collect()}
            worst = min(pool, key=lambda a: (scores.get(a, 0.0), pool.index(a)), default=None)
            if worst is None or len(pool) == 1 or scores.get(worst, 0.0) > tau:
                return removed, {a: scores.get(a, 0.0) for a in pool}
            removed.append((len(removed) + 1, worst, scores.get(worst, 0.0)))
            pool = tuple(a for a in pool if a != worst)
    finally:
        sums.unpersist()


DRAWN_CELLS = 1 << 22


def bootstrap(images: DataFrame, attrs: tuple[str, ...], n_boot: int = 500, least_success: float = 0.8, seed: int = 0) -> DataFrame:
    """prompt, attr, w_mean, ci_low, ci_high: 90 % intervals of per-prompt weights over resamples of its images.

    Rows are centred once and resampled as they are; a prompt without spread or with fewer images than labels has infinite
    bounds, as has one with too few fits that succeed. A prompt is resampled in its own task with a seed of its own, in blocks
    of draws that hold DRAWN_CELLS numbers at once."""
    kind = images.schema["prompt"].dataType.simpleString()
    k = len(attrs)

    def run(frame):
        frame = frame.sort_values("image_id")
        g, u = np.array(frame["g"].tolist(), float).reshape(len(frame), k), frame["u"].to_numpy(float)
        rng = np.random.default_rng([seed, int(frame["h"].iloc[0]) & 0x7FFFFFFF])
        m = len(u)
        g, u = g - g.mean(0), u - u.mean()
        fits = [np.zeros((0, k))]
        if m >= k and (u * u).mean() >= FLAT:
            step = max(1, DRAWN_CELLS // (m * (k + 1)))
            for i in range(0, n_boot, step):
                draws = rng.integers(0, m, (min(step, n_boot - i), m))
                gd, ud = g[draws], u[draws]
                gram, right = np.einsum("nmi,nmj->nij", gd, gd), np.einsum("nmi,nm->ni", gd, ud)
                fits.append(np.einsum("nij,nj->ni", np.linalg.pinv(gram, rcond=RCOND, hermitian=True), right))
        w = np.concatenate(fits)
        w = w[np.isfinite(w).all(1)]
        if len(w) < max(1, least_success * n_boot):
            lo, hi, mean = np.full(k, -np.inf), np.full(k, np.inf), np.zeros(k)
        else:
            lo, hi, mean = np.percentile(w, 5, 0), np.percentile(w, 95, 0), w.mean(0)
        return pd.DataFrame({"prompt": frame["prompt"].iloc[0], "attr": list(attrs), "w_mean": mean, "ci_low": lo, "ci_high": hi})

    rows = images.select("prompt", "image_id", "g", "u", F.xxhash64("prompt").alias("h"))
    return rows.groupBy("prompt").applyInPandas(run, f"prompt {kind}, attr string, w_mean double, ci_low double, ci_high double")


def max_difference(saved: DataFrame, again: DataFrame) -> float | None:
    """The largest absolute difference of two tables of weights (prompt, attr, w) on the prompts and labels they share."""
    both = saved.select("prompt", "attr", F.col("w").alias("a")).join(again.select("prompt", "attr", F.col("w").alias("b")), ["prompt", "attr"])
    return both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
