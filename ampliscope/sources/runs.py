"""A run's folder as tables: settings, topics, planner pools, calls of the proposer, and what it says of attributes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import step_and_topic
from ..operators.pools import memoized, ordered_distinct
from . import formats

#: Where a run's settings may lie, the first that is there counts.
SETTINGS = ("config_effective.yaml", "config_source.yaml", "configs/config_effective.yaml", "configs/config_source.yaml")
CALL = "step_idx INT, topic_id INT, call_idx INT, proposer_model STRING, selected_prompts ARRAY<STRING>, current_pool ARRAY<STRING>, avoid_attrs ARRAY<STRING>, images ARRAY<STRUCT<group: INT, `set`: STRING, prompt_text: STRING, image_id: STRING, image_path: STRING>>, response_text STRING, proposals ARRAY<STRING>, reasoning STRING, usage MAP<STRING, STRING>"
PLAN = "kept ARRAY<STRING>, passed ARRAY<STRING>, parsed_attributes ARRAY<STRING>"


class RunFolder:
    """Files of one run below path, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(conf)

    def _named(self, pattern: str) -> list[str]:
        """The files of a glob, in order of their names."""
        return sorted(s.getPath().toString() for s in self._fs.globStatus(self._at(pattern)) or [])

    def _text(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def settings(self) -> dict:
        """The settings that the run had, in YAML or JSON; empty without a file."""
        text = next((t for t in map(self._text, SETTINGS) if t is not None), None)
        if text is None:
            return {}
        try:
            import yaml
        except ImportError:  # JSON is YAML too
            return json.loads(text)
        return yaml.safe_load(text) or {}

    def write_settings(self, settings: dict, name: str = SETTINGS[2]) -> None:
        """Settings as JSON, which the YAML reader takes; what is there already stays and is an error."""
        stream = self._fs.create(self._at(name), False)
        stream.write(json.dumps(settings, indent=1).encode())
        stream.close()

    def topics(self) -> list[int]:
        """The topics that have step files or weights."""
        names = [*self._named("ba_expand_step*_topic*.json"), *self._named("per_prompt_W_step*_topic*.json")]
        if not names:
            return []
        _, topic = step_and_topic("path")
        rows = self.spark.createDataFrame([(n,) for n in names], "path string").select(topic.alias("t")).distinct()
        return sorted(r["t"] for r in rows.collect() if r["t"] is not None)

    def weights(self, topic: int | None = None, step: int | None = None) -> DataFrame:
        """The per-prompt weights of a topic's step, by default the last; without a topic there must be only one."""
        step_, topic_ = step_and_topic("path")
        names = self._named("per_prompt_W_step*_topic*.json")
        rows = self.spark.createDataFrame([(n,) for n in names], "path string").select("path", step_.alias("s"), topic_.alias("t"))
        found = [r for r in rows.collect() if r["t"] is not None and topic in (None, r["t"]) and step in (None, r["s"])]
        if not found:
            raise FileNotFoundError(f"no weights of topic {topic} and step {step} in {self.path}")
        if len({r["t"] for r in found}) > 1:
            raise ValueError(f"weights of several topics in {self.path}: say which")
        return formats.weights(self.spark, max(found, key=lambda r: r["s"])["path"])

    def planner_pool(self, topic: int) -> DataFrame:
        """pos, attr: a topic's pool before the first step: what clustering kept, else what passed as undesirable, else all that was planned, each once.

        A file that is there counts even if its list is empty."""
        for name, column in ((f"planner/clustering_step0_topic{topic}.json", "kept"), (f"planner/humanness_initial_step0_topic{topic}.json", "passed")):
            if names := self._named(name):
                rows = formats.documents(self.spark, names[0], PLAN).select(F.posexplode(column).alias("pos", "attr"))
                return rows
        names = self._named(f"planner/initial_step0_topic{topic}_call*.json")
        if not names:
            return self.spark.createDataFrame([], "pos int, attr string")
        calls = formats.documents(self.spark, names, PLAN).select(F.col("path").alias("file"), F.posexplode("parsed_attributes").alias("at", "attr"))
        rows = calls.withColumns({"attr": F.trim("attr"), "place": F.struct("file", "at")}).where("attr <> ''")
        first = rows.groupBy("attr").agg(F.min("place").alias("place"))
        ordered = first.agg(F.array_sort(F.collect_list(F.struct("place", "attr"))).alias("z"))  # a pool
        return ordered.select(F.posexplode("z.attr").alias("pos", "attr"))

    def proposer_calls(self) -> DataFrame:
        """A row for each saved call of the proposer, with its place in step, topic and call order; an error without any."""
        names = self._named("planner/proposer_*.json") or self._named("proposer_*.json")
        if not names:
            raise FileNotFoundError(f"no proposer_*.json in {self.path}")
        return formats.documents(self.spark, names, CALL)

    def proposals(self) -> DataFrame:
        """step_idx, topic_id, call_idx, pos, attr of all calls, repeats included."""
        return self.proposer_calls().select("step_idx", "topic_id", "call_idx", F.posexplode("proposals").alias("pos", "attr"))

    def call_images(self) -> DataFrame:
        """step_idx, topic_id, call_idx, group, set, image_id, image_path of what the calls were shown."""
        rows = self.proposer_calls().select("step_idx", "topic_id", "call_idx", F.explode("images").alias("i"))
        return rows.select("step_idx", "topic_id", "call_idx", "i.group", "i.set", "i.image_id", "i.image_path")

    def undesirable(self, topic: int, decide: Callable[[DataFrame], DataFrame] | None = None, cache: DataFrame | None = None) -> DataFrame:
        """pos, attr: the attributes of a topic's last weights, or those of them that a stricter look lets pass.

        decide: rows (attr) to rows (attr, decision); all but NO pass, a null too. Decisions in cache (attr, decision) are not asked for again."""
        rows = self.weights(topic).select(F.col("k").alias("pos"), "attr").distinct()
        if decide is None:
            return rows
        known = cache if cache is not None else self.spark.createDataFrame([], "attr string, decision string")
        seen, _ = memoized(rows, known, "attr", decide)
        return seen.where(F.coalesce(F.col("decision") != "NO", F.lit(True))).select("pos", "attr")


def attribute_source(spark: SparkSession, listed: list[str] | None, results: str | None, only_undesirable: bool = False) -> DataFrame:
    """pos, attr: the listed attributes if there are any, else those of a results file in its order, each once; on request the undesirable ones only."""
    if listed:
        rows = spark.createDataFrame([(i, a) for i, a in enumerate(listed)], "pos int, attr string")
    elif results:
        tops = formats.documents(spark, results, formats.RESULTS).select(F.posexplode("top_attributes").alias("pos", "a"))
        rows = tops.where(F.col("a.is_undesirable") if only_undesirable else F.lit(True)).select("pos", F.col("a.attribute").alias("attr"))
    else:
        raise ValueError("neither attributes nor a results file")
    return ordered_distinct(rows, "attr")
