"""Best-of-n prevalence: closed form and Monte Carlo, and what is read off the curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _none_of(over: Column, m: Column, k: Column) -> Column:
    """The chance that k draws of m without replacement all fall among `over` of them."""
    return F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(1.0), lambda acc, j: acc * F.greatest(over - j, F.lit(0)) / (m - j))


def winner_mass(images: DataFrame, n_values: list[int]) -> DataFrame:
    """images x n with mass: the chance that the image has the best reward of min(n, m) draws of its prompt's m; ties share evenly.

    Prompts with under n images only count where no prompt has n."""
    w = Window.partitionBy("prompt")
    le = F.count(F.lit(1)).over(w.orderBy("reward").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    eq = F.count(F.lit(1)).over(Window.partitionBy("prompt", "reward"))
    sized = images.where("reward is not null").withColumns({"m": F.count(F.lit(1)).over(w), "le": le, "eq": eq})
    largest = F.broadcast(sized.agg(F.max("m").alias("most")))
    rows = sized.join(largest).withColumn("n", F.explode(F.array(*map(F.lit, n_values))))
    rows = rows.where((F.col("m") >= F.col("n")) | (F.col("most") < F.col("n")))
    k = F.least("n", "m")
    mass = (_none_of(F.col("le"), F.col("m"), k) - _none_of(F.col("le") - F.col("eq"), F.col("m"), k)) / F.col("eq")
    return rows.withColumn("mass", mass).drop("le", "eq", "most")


def curve(images: DataFrame, attrs: tuple[str, ...], n_values: list[int]) -> DataFrame:
    """attr, n, prev: mean over prompts of the winner's chance to have the label; missing labels count as 0."""
    mass = winner_mass(images, n_values)
    per = mass.groupBy("prompt", "n").agg(*(F.sum(F.col("mass") * (F.coalesce(F.col("g")[i], F.lit(0)) == 1).cast("int")).alias(f"p{i}") for i in range(len(attrs))))
    wide = per.groupBy("n").agg(*(F.avg(f"p{i}").alias(f"p{i}") for i in range(len(attrs))))
    named = F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(f"p{i}").alias("prev")) for i, a in enumerate(attrs)))).alias("z")
    return wide.select("n", named).select("z.attr", "n", "z.prev")


def curve_mc(images: DataFrame, attrs: tuple[str, ...], n_values: list[int], trials: int = 100, seed: int = 0) -> DataFrame:
    """The same by draws: images ordered by a hash of (prompt, image, trial, seed); the best of the first min(n, m) wins.

    Images move once, to their prompt's task; trials are columns there, not rows. A task holds a batch and the images of one prompt that some
    trial may still draw, and sends its sums."""
    sizes = sorted(n for n in set(n_values) if n > 0)
    has = F.array(*(F.coalesce(F.col("g")[i], F.lit(0)) == 1 for i in range(len(attrs))))
    rows = images.where("reward is not null").select("prompt", "image_id", F.col("reward").cast("double").alias("reward"), has.alias("has"))
    order = F.array(*(F.xxhash64("prompt", "image_id", F.lit(t), F.lit(seed)) for t in range(trials)))
    rows = rows.repartition("prompt").sortWithinPartitions("prompt", "image_id").select("prompt", "reward", "has", order.alias("order"))

    def run(batches):
        total, prompts, name, mine = np.zeros((len(sizes), len(attrs)), np.int64), 0, None, None

        def first(part):
            return np.argsort(part[2], axis=0, kind="stable")[: sizes[-1]]

        def won(part):
            drawn = first(part)
            for at, n in enumerate(sizes):
                best = np.argmax(part[0][drawn[:n]], axis=0)  # of equal rewards the one drawn first
                total[at] += part[1][drawn[best, np.arange(trials)]].sum(0)

        for batch in batches:
            if not len(batch):
                continue
            prompt = batch.column("prompt").dictionary_encode(null_encoding="encode")
            code = prompt.indices.to_numpy()
            reward = batch.column("reward").to_numpy()
            has, order = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in ("has", "order"))
            ends = [*(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            start = 0
            for end in ends:
                here, part = prompt.dictionary[int(code[start])].as_py(), (reward[start:end], has[start:end], order[start:end])
                if mine is not None and here == name:
                    part = tuple(np.concatenate(x) for x in zip(mine, part))
                elif mine is not None:
                    won(mine)
                    prompts += 1
                name, mine, start = here, part, end
            kept = np.unique(first(mine))  # what no trial has among its first goes
            mine = tuple(x[kept] for x in mine)
        if mine is not None:
            won(mine)
            columns = [sizes, [(prompts + 1) * trials] * len(sizes), *total.T.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, [pa.int32()] + [pa.int64()] * (1 + len(attrs)))], ["n", "drawn", *(f"p{i}" for i in range(len(attrs)))])

    sums = rows.mapInArrow(run, ", ".join(["n int, drawn long", *(f"p{i} long" for i in range(len(attrs)))]))
    wide = sums.groupBy("n").agg(*((F.sum(f"p{i}") / F.sum("drawn")).alias(f"p{i}") for i in range(len(attrs))))
    named = F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(f"p{i}").alias("prev")) for i, a in enumerate(attrs)))).alias("z")
    return wide.select("n", named).select("z.attr", "n", "z.prev")


def relative(curves: DataFrame) -> DataFrame:
    """With base: the value at the smallest n, and delta against it."""
    base = F.first("prev").over(Window.partitionBy("attr").orderBy("n"))
    return curves.withColumn("base", base).withColumn("delta", F.col("prev") - F.col("base"))


def summary(curves: DataFrame) -> DataFrame:
    """n, mean and population deviation over attributes, of prevalence and of delta."""
    return relative(curves).groupBy("n").agg(F.avg("prev").alias("mean"), F.stddev_pop("prev").alias("std"), F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta"))


def delta(curves: DataFrame, n: int) -> DataFrame:
    """attr, delta: prevalence at n less that at 1; null where either is missing."""
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("prev")))
    return curves.groupBy("attr").agg((at(n) - at(1)).alias("delta"))


def pivot(curves: DataFrame, n_values: list[int]) -> DataFrame:
    """A row per attribute, a column n<k> per value."""
    wide = curves.groupBy("attr").pivot("n", n_values).agg(F.first("prev"))
    return wide.select("attr", *(F.col(str(n)).alias(f"n{n}") for n in n_values))
