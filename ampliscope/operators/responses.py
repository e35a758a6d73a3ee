"""The cache of model responses, and what goes into it and comes out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cacheable(responses: DataFrame) -> DataFrame:
    """Responses that ended by themselves; cut or failed ones are asked for again."""
    return responses.where("finish_reason = 'stop'")


def paired(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the response of the same place in the same call. Both: call, pos; a request without one has nulls."""
    return requests.join(responses, ["call", "pos"], "left")


def chunked(rows: DataFrame, size: int, by: list[str], pos: str = "pos") -> DataFrame:
    """Rows with `chunk`: their list cut into pieces of `size`, by place."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(pos)) - 1
    return rows.withColumn("chunk", F.floor(at / size).cast("long"))


def looked_up(cache: DataFrame, asked: DataFrame, typed: Column | None = None) -> DataFrame:
    """cache_key, payload, hit for every distinct asked key: the newest entry (created_at, then payload), if its payload is valid.

    typed: a test of `payload`; an entry that fails it is a miss, as is a missing or null one. A whole batch of keys is one
    join, so nothing has to be fetched ahead."""
    new = cache.groupBy("cache_key").agg(F.max(F.struct("created_at", "payload"))["payload"].alias("payload"))
    rows = asked.select("cache_key").distinct().join(new, "cache_key", "left")
    ok = F.coalesce(F.col("payload").isNotNull() & (F.lit(True) if typed is None else typed), F.lit(False))
    return rows.select("cache_key", F.when(ok, F.col("payload")).alias("payload"), ok.alias("hit"))


def is_object(payload: str = "payload") -> Column:
    """Whether a payload is a JSON object."""
    parsed = F.try_parse_json(F.col(payload))
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def embedded(cache: DataFrame, texts: DataFrame, provider: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(known, missing): texts with their cached vector, and distinct keys that must be computed. cache: provider, model, text_key, vector."""
    own = cache.where((F.col("provider") == provider) & (F.col("model") == model)).select("text_key", "vector")
    keyed = texts.withColumn("text_key", F.sha2("text", 256))
    return keyed.join(own, "text_key"), keyed.select("text_key", "text").distinct().join(own, "text_key", "left_anti")


def union_of_calls(proposals: DataFrame) -> DataFrame:
    """All calls' proposals in order of call and place, repeats included, with their place in the whole as `pos`."""
    return proposals.withColumn("pos", F.row_number().over(Window.partitionBy("topic_id", "step_idx").orderBy("call", "rank")) - 1)


def detection_prompt(attr: Column, caption: Column, with_caption: bool, allow_na: bool) -> Column:
    """The question put to a detector: with or without the image's caption, with or without "not applicable" as an answer."""
    parts = [F.lit("Attribute: "), attr]
    if with_caption:
        parts += [F.lit("\nCaption: "), caption]
    answers = '"present" or "absent" or "not applicable"' if allow_na else '"present" or "absent"'
    return F.concat(*parts, F.lit(f"\nAnswer with a JSON object whose field is {answers}."))


def numbered_list(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """by.., prompt: the texts of a group as a numbered list, one a line."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    lines = F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"]))
    return rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("prompt"))


def gpu_index(device: str | Column) -> Column:
    """The number in `cuda:3`; null without one."""
    found = F.regexp_extract(device, r"^cuda:([0-9]+)$", 1)
    return F.when(found != "", found).cast("int")
