import json

import pytest

from pyspark.sql import functions as F

from ampliscope.operators import pools
from ampliscope.sources import formats, sinks
from ampliscope.streaming import detect


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body if isinstance(body, str) else json.dumps(body))
    return f"file://{p}"


def test_prompts_and_manifest(spark, tmp_path):
    path = put(tmp_path, "cluster_3.json", {"category": "c", "prompts": [f"prompt {i}" for i in range(10)] + [" "], "summary": ""})
    rows = formats.prompts(spark, path, val=4).collect()
    assert len(rows) == 10 and sum(r["split"] == "val" for r in rows) == 4 and {r["topic_id"] for r in rows} == {3}
    entry = lambda i, s: {"image_path": f"d/{i}.png", "image_id": i, "prompt": "a.b", "policy_model": "m", "reward_scores": s}
    path = put(tmp_path, "manifest.json", {"metadata": {"model_id": "m"}, "baselines": {"a.b": [entry("x", {"r": 1.5}), entry("y", {})], "none": []}})
    entries = formats.manifest(spark, path, "/root")
    assert {r["image_path"] for r in entries.collect()} == {"/root/d/x.png", "/root/d/y.png"}
    assert [tuple(r) for r in formats.rewards(entries, "r").collect()] == [("a.b", "x", 1.5)]


def test_detection_cache(spark, tmp_path):
    path = put(tmp_path, "cache.json", {"m::low": {"i": {"a, \"b\"": 1, "c": -1}}, "n::low": {"i": {"c": 0}}, "_rejected::m::low::3": ["x", "y"]})
    assert {tuple(r) for r in formats.detections(spark, path, "m::low").collect()} == {("i", 'a, "b"', 1), ("i", "c", -1)}
    assert {tuple(r) for r in formats.rejected(spark, path).collect()} == {("m::low", "3", "x"), ("m::low", "3", "y")}


def test_run_artifacts(spark, tmp_path):
    path = put(tmp_path, "ba_expand_step2_topic5.json", {"acc_pool": ["a"], "W": {"a": 0.5}, "per_prompt_r2": {"p": 0.1}})
    assert formats.steps(spark, path).select("step_idx", "topic_id").first() == (2, 5)
    path = put(tmp_path, "w.json", {"step_idx": 1, "topic_id": 5, "attrs": ["a", "b"], "per_prompt_W": {"p": [0.1, 0.2]}, "per_prompt_r2": {"p": 0.3}})
    assert [tuple(r) for r in formats.weights(spark, path).orderBy("k").collect()] == [(5, 1, "p", 0, "a", 0.1), (5, 1, "p", 1, "b", 0.2)]
    path = put(tmp_path, "h.json", {"topic_id": 5, "history": [{"step": 0, "p": 0.1}, {"step": 1, "p": 0.2, "q": 0.3}]})
    assert {tuple(r) for r in formats.r2_history(spark, path).collect()} == {(5, 0, "p", 0.1), (5, 1, "p", 0.2), (5, 1, "q", 0.3)}
    path = put(tmp_path, "res.json", {"run_id": "r", "top_attributes": [{"attribute": "a", "amplification_score": 0.5, "topic_id": 5}]})
    assert formats.results(spark, path).first()["amplification_score"] == 0.5
    path = put(tmp_path, "bon.json", {"run_id": "r", "topic_id": 5, "n_values": [1, 2], "prevalence": {"a": [0.1, 0.2]}})
    assert {tuple(r) for r in formats.curves(spark, path).collect()} == {("r", 5, "a", 1, 0.1), ("r", 5, "a", 2, 0.2)}
    path = put(tmp_path, "clean.json", {"kept_pool": ["b", "a"], "kept_loo_scores": {"a": 0.1}})
    assert [tuple(r) for r in formats.cleanup(spark, path).orderBy("pos").collect()] == [(0, "b", None), (1, "a", 0.1)]
    path = put(tmp_path, "pairs.json", {"by_attr": {"a": {"p": [{"pos_image_id": "i", "neg_image_id": "j", "hamming_other": 1, "rank": 1}]}}})
    assert formats.pairs(spark, path).select("attr", "prompt", "pos_image_id").first() == ("a", "p", "i")
    path = put(tmp_path, "meta.json", {"1": {"prompt": "x", "category": "c"}})
    assert formats.corpus_meta(spark, path).first() == ("1", "x", "c")
    path = put(tmp_path, "attrs.txt", "# list\na\n\nb\na\n")
    assert [r["attr"] for r in formats.attributes(spark, path).orderBy("pos").collect()] == ["a", "b"]
    path = put(tmp_path, "i.png", "x")
    assert formats.image_files(spark, path).first()["data_url"] == "data:image/png;base64,eA=="


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None)], "attr string, n int, prev double").withColumn("topic_id", F.lit(1))
    sinks.json_rows(df, f"{tmp_path}/j", "topic_id")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.csv_rows(df, f"{tmp_path}/c", "\t")
    assert spark.read.csv(f"{tmp_path}/c", sep="\t", header=True).count() == 2
    sinks.upserted(df, f"{tmp_path}/u")
    sinks.upserted(df.withColumn("prev", F.lit(0.9)), f"{tmp_path}/u")
    assert {r["prev"] for r in sinks.latest(spark.read.parquet(f"{tmp_path}/u"), "attr", "n").collect()} == {0.9}
    assert sinks.curve_documents(df, "r").first()["n_values"] == [1, 2]
    pair = spark.createDataFrame([("a", "p", 1, "i", "j", 0, 2.0, 1.0)], "attr string, prompt string, rank int, pos_id string, neg_id string, h int, pos_reward double, neg_reward double")
    assert sinks.pairs_document(pair).first()["by_prompt"]["p"][0]["reward_delta"] == 1.0


def test_artifacts_are_read_back(spark, tmp_path):
    rows = [(t, s, p, k, f"a{k}", t + s / 4 + k) for t in (1, 2) for s in (0, 1) for p in ("x", "y") for k in range(s + 1)]
    w = spark.createDataFrame(rows, "topic_id int, step_idx int, prompt string, k int, attr string, w double")
    r2 = w.where("k = 0").select("topic_id", "step_idx", "prompt", (F.col("w") / 10).alias("r2"))
    sinks.json_documents(sinks.weight_documents(w, r2), f"{tmp_path}/w")
    assert sorted(tuple(r) for r in formats.weights(spark, f"{tmp_path}/w").collect()) == sorted(rows)
    sinks.json_documents(sinks.history_documents(r2), f"{tmp_path}/h")
    assert {tuple(r) for r in formats.r2_history(spark, f"{tmp_path}/h").collect()} == {tuple(r) for r in r2.collect()}
    top = spark.createDataFrame([("b", 0.123456, None, 1.0, 0, 2, 7), ("a", 0.5, 0.1, 2.00005, 1, 2, 7)], "attribute string, delta_rm double, delta_j double, amplification_score double, step_found int, step_last_survived int, topic_id int")
    assert [(r["attribute"], r["delta_rm"], r["place"]) for r in sinks.final_table(top).orderBy("place").collect()] == [("a", 0.5, 1), ("b", 0.1235, 2)]


def test_a_writer_that_fails_leaves_the_old_rows(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    sinks.json_rows(df, f"{tmp_path}/j")
    with pytest.raises(Exception, match="lost"):
        sinks.json_rows(df.select(F.raise_error(F.lit("lost")).alias("x")), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 1 and [p.name for p in tmp_path.iterdir()] == ["j"]
    sinks.json_rows(df.union(df), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["j"]


def test_stream_detects_only_what_is_new(spark, tmp_path):
    src, out = tmp_path / "src", f"file://{tmp_path}/out"
    attrs = spark.createDataFrame([("a",), ("b",)], "attr string")
    calls = []

    def label(todo):
        calls.append(todo.count())
        return todo.withColumn("g", F.lit(1))

    for ids in (["x", "y"], ["y", "z"]):
        spark.createDataFrame([(i,) for i in ids], "image_id string").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("image_id string").parquet(str(src))
        detect.detect_stream(stream, attrs, label, out, f"file://{tmp_path}/check").awaitTermination()
    assert calls == [4, 2]
    assert spark.read.parquet(out).select("image_id", "attr").distinct().count() == 6 == spark.read.parquet(out).count()
    events = spark.createDataFrame([("k", "put", 1, "v"), ("k", "touch", 2, None)], "cache_key string, op string, at int, payload string")
    assert detect.latest_touch(events).first()["payload"] == "v"
    assert pools.evicted(spark.createDataFrame([(str(i), i) for i in range(20)], "cache_key string, last_used int"), 10).count() == 9
