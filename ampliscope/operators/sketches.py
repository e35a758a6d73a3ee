"""Samples that merge: the n rows of a group that hash least, kept by every task and merged, without a window or a whole group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .choose import hash_order

#: Rows that a task holds before it drops those that cannot be in a sample.
HELD = 50_000
#: Parts of a group that are merged before the whole group is.
SALTS = 64


def _least(by: list[str], order: list[str], n: int):
    """A mapInPandas function: of each group in the partition the n first rows by order. Holds twice the sample at most, and HELD rows."""

    def cut(frames: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(frames, ignore_index=True).sort_values(order, kind="stable")
        return rows[rows.groupby(by, dropna=False, sort=False).cumcount() < n]

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, room = [], 0, HELD
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size > room:
                held = [cut(held)]
                size = len(held[0])
                room = max(HELD, 2 * size)
        if held:
            yield cut(held)

    return least


def least_rows(rows: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The n first rows of each group by order, which must tell the rows of a group apart; of repeated rows any stay.

    Every task keeps the n first of the groups that it sees, so a group of any size sends n rows a task; these are merged
    in SALTS parts, and then for the group. Null order values come last."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order)))
    cut = _least(by, names, n)
    salt = F.pmod(F.xxhash64(*names), F.lit(SALTS))
    near = keyed.mapInPandas(cut, keyed.schema)
    salted = near.repartition(*by, salt).mapInPandas(cut, keyed.schema)
    return salted.repartition(*by).mapInPandas(cut, keyed.schema).drop(*names)


def bottom_k(rows: DataFrame, by: list[str], n: int, *ident: str, seed: int = 0) -> DataFrame:
    """At most n rows of each group, by hash order, then ident: the same as choose.sampled."""
    return least_rows(rows, by, n, hash_order(*by, *ident, seed=seed), *map(F.col, ident))


def context_images(images: DataFrame, n: int) -> DataFrame:
    """Of each prompt the n // 2 lowest and n - n // 2 highest rewards, without repeats; the same as choose.stratified, unranked.

    images: prompt, image_id (a number or text), reward. Images without a reward are left out."""
    known = images.where("reward is not null")
    low = least_rows(known, ["prompt"], n // 2, F.col("reward"), F.col("image_id"))
    numbers = known.select("prompt", "image_id", "reward")
    high = least_rows(numbers, ["prompt"], n - n // 2, -F.col("reward"), _backwards(known))
    return low.select("prompt", "image_id").union(high.select("prompt", "image_id")).distinct().join(known, ["prompt", "image_id"])


def _backwards(rows: DataFrame) -> Column:
    """image_id in falling order: of text the bytes' complements."""
    if rows.schema["image_id"].dataType.typeName() == "string":
        digits = F.hex(F.col("image_id"))
        return F.concat(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return -F.col("image_id")


def fixed_baselines(images: DataFrame, prompts: int, per_prompt: int, seed: int = 0) -> DataFrame:
    """Two levels: of each topic `prompts` prompts, of each of them `per_prompt` images. images: topic_id, prompt, image_id, ..

    Both levels go by hashes of the ids and the seed, so the configuration alone brings the same sample back."""
    names = images.select("topic_id", "prompt").distinct()
    chosen = bottom_k(names, ["topic_id"], prompts, "prompt", seed=seed)
    return bottom_k(images.join(chosen, ["topic_id", "prompt"], "left_semi"), ["topic_id", "prompt"], per_prompt, "image_id", seed=seed + 1)


def sources_with(images: DataFrame, labels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """prompt, attr, image_id: at most n images of a prompt that have the attribute. labels: image_id, attr, g."""
    own = images.select("prompt", "image_id").join(labels.where("g = 1").select("image_id", "attr"), "image_id")
    return bottom_k(own.select("prompt", "attr", "image_id"), ["prompt", "attr"], n, "image_id", seed=seed)


def per_attr(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows (attr, prompt, ..) of at most n prompts of each attribute."""
    chosen = bottom_k(rows.select("attr", "prompt").distinct(), ["attr"], n, "prompt", seed=seed)
    return rows.join(chosen, ["attr", "prompt"], "left_semi")


class RunSamples:
    """What a run draws, rebuilt from its configuration: seed, split, prompts and images of the fixed baselines, sources of an attribute.

    A run that goes on after a crash, or an analysis long after it, gets the very rows that the run had."""

    def __init__(self, images: DataFrame, seed: int = 42, val: int = 0, prompts: int = 50, per_prompt: int = 128):
        self.images, self.seed, self.val, self.prompts, self.per_prompt = images, seed, val, prompts, per_prompt

    def validation(self) -> DataFrame:
        """topic_id, prompt: the prompts that a topic sets aside, the first by hash."""
        return bottom_k(self.images.select("topic_id", "prompt").distinct(), ["topic_id"], self.val, "prompt", seed=self.seed)

    def training(self) -> DataFrame:
        return self.images.join(self.validation(), ["topic_id", "prompt"], "left_anti") if self.val else self.images

    def baselines(self) -> DataFrame:
        return fixed_baselines(self.training(), self.prompts, self.per_prompt, self.seed + 1)

    def sources(self, labels: DataFrame, n: int) -> DataFrame:
        return sources_with(self.baselines(), labels, n, self.seed + 3)
