"""Folders of runs, and the small reports that are made of them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliscope.operators import pairs, regress, reports, selections, trends
from ampliscope.sources import runs, sinks


@pytest.fixture()
def folder(tmp_path):
    def put(name, body):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body if isinstance(body, str) else json.dumps(body))

    return put


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_settings_in_several_places(spark, tmp_path, folder):
    run = runs.RunFolder(spark, str(tmp_path))
    assert run.settings() == {} and run.topics() == []
    for place in reversed(runs.SETTINGS):
        folder(place, f"a:\n  name: {place}\n  n: 2\n")
        assert run.settings() == {"a": {"name": place, "n": 2}}
    other = runs.RunFolder(spark, f"file://{tmp_path}/new/")
    other.write_settings({"x": [1, None, True]})
    assert other.settings() == {"x": [1, None, True]}
    with pytest.raises(Exception):
        other.write_settings({})
    assert other.settings() == {"x": [1, None, True]}


def test_planner_pools(spark, tmp_path, folder):
    run = runs.RunFolder(spark, str(tmp_path))
    assert run.planner_pool(3).count() == 0
    folder("planner/initial_step0_topic3_call2.json", {"parsed_attributes": ["c", " a ", ""]})
    folder("planner/initial_step0_topic3_call1.json", {"parsed_attributes": ["b", "a", "b"]})
    folder("planner/initial_step0_topic3_call3.json", {"parsed_attributes": None})
    folder("planner/initial_step0_topic4_call1.json", {"parsed_attributes": ["z"]})
    assert sorted(rows(run.planner_pool(3), "pos", "attr")) == [(0, "b"), (1, "a"), (2, "c")]
    folder("planner/humanness_initial_step0_topic3.json", {"passed": ["c", "b"]})
    assert sorted(rows(run.planner_pool(3), "pos", "attr")) == [(0, "c"), (1, "b")]
    folder("planner/clustering_step0_topic3.json", {"kept": [], "passed": ["x"]})
    assert run.planner_pool(3).count() == 0 and run.planner_pool(4).count() == 1


def test_proposer_calls(spark, tmp_path, folder):
    run = runs.RunFolder(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        run.proposer_calls()
    for call in (1, 0):
        folder(f"planner/proposer_step2_topic5_call{call:03d}.json", {"step_idx": 2, "topic_id": 5, "call_idx": call, "proposals": ["a", f"b{call}"], "images": [{"group": 1, "set": "A", "prompt_text": "p", "image_id": f"i{call}", "image_path": "x.png"}], "usage": {"cost": 0.5}, "reasoning": None})
    assert sorted(rows(run.proposals(), "call_idx", "pos", "attr")) == [(0, 0, "a"), (0, 1, "b0"), (1, 0, "a"), (1, 1, "b1")]
    assert sorted(rows(run.call_images(), "call_idx", "group", "set", "image_id")) == [(0, 1, "A", "i0"), (1, 1, "A", "i1")]


def test_weights_topics_and_undesirable(spark, tmp_path, folder):
    run = runs.RunFolder(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        run.weights()
    for step in (2, 10):
        folder(f"per_prompt_W_step{step}_topic5.json", {"step_idx": step, "topic_id": 5, "attrs": ["a", "b", "c"], "per_prompt_W": {"p": [0.1, 0.2, float(step)], "q": [1, 2, 3]}})
    assert run.topics() == [5] and ("p", "c", 10.0) in rows(run.weights(), "prompt", "attr", "w") and ("p", "c", 2.0) in rows(run.weights(5, 2), "prompt", "attr", "w")
    folder("ba_expand_step1_topic7.json", {"acc_pool": []})
    assert run.topics() == [5, 7]
    assert sorted(rows(selections.first_attrs(run.weights(), 2), "attr")) == [("a",), ("a",), ("b",), ("b",)]
    assert sorted(rows(run.undesirable(5), "pos", "attr")) == [(0, "a"), (1, "b"), (2, "c")]
    asked = []

    def decide(attrs):
        asked.extend(r["attr"] for r in attrs.collect())
        return attrs.withColumn("decision", F.when(F.col("attr") == "b", "NO"))

    cache = spark.createDataFrame([("c", "YES")], "attr string, decision string")
    assert sorted(rows(run.undesirable(5, decide, cache), "attr")) == [("a",), ("c",)] and sorted(asked) == ["a", "b"]
    folder("per_prompt_W_step1_topic6.json", {"attrs": ["z"], "per_prompt_W": {}})
    with pytest.raises(ValueError):
        run.weights()


def test_attribute_sources(spark, tmp_path, folder):
    folder("r.json", {"run_id": "r", "top_attributes": [{"attribute": "a", "is_undesirable": True}, {"attribute": "b", "is_undesirable": False}, {"attribute": "a"}, {"attribute": "c"}]})
    path = str(tmp_path / "r.json")
    assert sorted(rows(runs.attribute_source(spark, ["x", "y", "x"], path), "pos", "attr")) == [(0, "x"), (1, "y")]
    assert [a for _, a in sorted(rows(runs.attribute_source(spark, None, path), "pos", "attr"))] == ["a", "b", "c"]
    assert rows(runs.attribute_source(spark, [], path, True), "attr") == [("a",)]
    with pytest.raises(ValueError):
        runs.attribute_source(spark, None, None)


def test_small_reports(spark, tmp_path):
    survey = spark.createDataFrame([("b", 3, 0.5), ("a", 3, 0.5), ("c", 9, 0.5), ("d", 1, 1.0)], "attr string, n_attempts long, success_rate double")
    ordered = reports.ranked(survey).orderBy("place")
    assert [r["attr"] for r in ordered.collect()] == ["d", "c", "a", "b"]
    assert reports.markdown(ordered, "attr", "success_rate", digits=1) == "| attr | success_rate |\n| --- | --- |\n| d | 1.0 |\n| c | 0.5 |\n| a | 0.5 |\n| b | 0.5 |\n"
    with pytest.raises(ValueError):
        reports.markdown(ordered, most=3)
    sinks.attr_index(spark.createDataFrame([("Red car!",), ("a b",), ("a b",)], "attr string"), f"{tmp_path}/i")
    assert sorted((r["_c0"], r["_c1"]) for r in spark.read.csv(f"{tmp_path}/i", sep="\t").collect()) == [("a_b", "a b"), ("red_car", "Red car!")]
    deltas = spark.createDataFrame([("a", x, -1.0) for x in (1.0, 1.1, 0.9, 1.0, 50.0)] + [("b", None, 1.0), ("c", 1.0, None)], "attr string, delta_rm double, delta_j double")
    got = {r["attr"]: tuple(r)[1:] for r in trends.delta_means(deltas, ["attr"], outliers=False).collect()}
    assert got == {"a": (1.0, -1.0, True), "b": (None, 1.0, False), "c": (1.0, None, False)}
    assert {r["attr"]: r["delta_rm"] for r in trends.delta_means(deltas, ["attr"]).collect()}["a"] == pytest.approx(10.8)


def test_whole_prompts_and_centred_u(spark):
    images = spark.createDataFrame([(0, p, f"{p}{i}", float(i)) for p in "xyz" for i in range(3 if p != "z" else 1)], "topic_id int, prompt string, image_id string, reward double")
    labels = [(0, r["prompt"], r["image_id"], r["reward"], a, int(r["reward"]) % 2) for r in images.collect() for a in "ab" if (r["image_id"], a) != ("y1", "b")]
    long_ = spark.createDataFrame(labels, "topic_id int, prompt string, image_id string, reward double, attr string, g int")
    assert {r["prompt"] for r in regress.whole_prompts(images, long_, ("a", "b")).collect()} == {"x", "z"}
    assert regress.whole_prompts(images, long_, ("a",)).count() == 7
    got = {r["image_id"]: r["e"] for r in regress.centred_u(images, 3).collect()}
    u = (np.arange(1, 4) / 3) ** 2
    assert got == {f"{p}{i}": pytest.approx(u[i] - u.mean()) for p in "xy" for i in range(3)}


def test_summary_of_natural_pairs(spark):
    found = spark.createDataFrame([("a", "p", 1, 2, 1, 0.5, 0.2), ("a", "q", 3, 4, 0, 1.5, 0.4), ("a", "q", 5, 6, 2, 1.0, 0.6)], "attr string, prompt string, pos_id int, neg_id int, h int, gap double, weight double")
    intervals = spark.createDataFrame([("p", "a", 0.3), ("q", "a", 0.1), ("q", "b", 0.05)], "prompt string, attr string, ci_low double")
    got = {r["attr"]: tuple(r)[1:] for r in pairs.natural_summary(found, intervals, ("a", "b")).collect()}
    assert got == {"a": (3, 2, 1.0, 1.0, pytest.approx(0.4), 0.1), "b": (0, 0, None, None, None, None)}
