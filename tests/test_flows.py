"""Keyed tables, cache streams, read-ahead, batches of models, samples, replies, messages and pair-free comparisons."""

import json
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliscope.functions import messages
from ampliscope.operators import choose, pairs, replies, sides, sketches
from ampliscope.plans import batches, planners
from ampliscope.sources import ahead, files, versions
from ampliscope.streaming import cache
from tests.test_operators import ABC, crowd, grouped, wins  # noqa: F401


def entries(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


@pytest.fixture()
def table(spark, tmp_path):
    return versions.KeyedTable(spark, f"file://{tmp_path}/t", "k string, v int", ("k",), buckets=3)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


# Keyed tables


def test_batches_that_run_again_change_nothing(spark, table):
    assert entries(table) == []
    for n, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2)], [], [("c", 3), ("a", 4)]]):
        for _ in range(2):
            table.append(frame(spark, *rows), "w", n)
    assert entries(table) == [("a", 4), ("b", 2), ("c", 3)] and table.entry()["version"] == 4
    assert entries(table, 1) == [("a", 1), ("b", 1)] and entries(table, 2) == [("a", 1), ("b", 2)]
    table.append(frame(spark, ("a", 9)), "other", 0)
    table.compact()
    assert entries(table) == [("a", 9), ("b", 2), ("c", 3)] and len(table.entry()["folders"]) == 1
    table.append(frame(spark, ("a", 0)), "w", 2)  # known from before the compaction
    assert entries(table)[0] == ("a", 9)
    assert table.vacuum() == 5 and entries(table) == [("a", 9), ("b", 2), ("c", 3)]


def test_one_batch_is_the_same_as_many(spark, table, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"k{k}", i) for i, k in enumerate(rng.integers(0, 20, 90))]
    for n in range(0, 90, 15):
        table.append(frame(spark, *dict(rows[n : n + 15]).items()), "w", n)
        if n == 45:
            table.compact()
    assert entries(table) == sorted(dict(rows).items())


def test_a_failed_compaction_leaves_the_version_readable(spark, table, monkeypatch):
    for n in range(3):
        table.append(frame(spark, ("a", n), (f"b{n}", n)))
    before = entries(table)

    def torn(rows):
        return rows.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        table.compact(torn)
    assert entries(table) == before and table.entry()["version"] == 3
    written = table._written

    def slow(rows, name, order=None):  # another writer commits while the base is being written
        out = written(rows, name)
        if name == "base":
            monkeypatch.setattr(table, "_written", written)
            table.append(frame(spark, ("a", 77)))
        return out

    monkeypatch.setattr(table, "_written", slow)
    table.compact(lambda rows: rows.where("k <> 'b0'"))
    assert entries(table) == [("a", 77), ("b1", 1), ("b2", 2)] and len(table.entry()["folders"]) == 2


def test_two_writers_keep_both_columns(spark, tmp_path):
    path = f"file://{tmp_path}/scores"
    images = spark.createDataFrame([(str(i),) for i in range(30)], "image_id string").persist()
    images.count()
    failed = []

    def write(name):
        try:
            kept = versions.score_table(spark, path)
            for n in range(4):
                versions.add_scores(kept, images.withColumn("score", F.lit(float(n))), name)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    kept, seen = versions.score_table(spark, path), 0
    while any(t.is_alive() for t in threads):  # a read in between sees whole versions
        now = kept.entry()
        assert now["version"] >= seen and len(now["folders"]) == now["version"]
        seen = now["version"]
    for t in threads:
        t.join()
    assert not failed and kept.entry()["version"] == 8
    assert {(r["scores"]["a"], r["scores"]["b"]) for r in versions.score_maps(kept).collect()} == {(3.0, 3.0)}


def test_a_commit_that_is_taken_is_read_again(spark, table):
    mine = table.entry()
    table.append(frame(spark, ("a", 1)))
    assert not table._claimed(mine | {"version": 1, "folders": ["x"]}) and entries(table) == [("a", 1)]
    calls = []

    def change(entry):
        calls.append(entry["version"])
        if len(calls) == 1:
            table.append(frame(spark, ("b", 2)))
        return entry | {"folders": entry["folders"]}

    assert table.commit(change)["version"] == 3 and calls == [1, 2] and entries(table) == [("a", 1), ("b", 2)]


# Cache streams


def replayed(events, ttl, flush):
    """Entries after all events in order, and when the last of them came."""
    live = {}
    for key, at, op, payload in sorted(events, key=lambda e: (e[1], e[2], e[3] or "")):
        if key is None:
            continue
        old = live.get(key)
        if op == "put":
            live[key] = (payload, at, at)
        elif old:
            if at > old[2] + ttl:
                del live[key]
            elif at // flush > old[1] // flush:
                live[key] = (*old[:2], at)
    end = max(e[1] for e in events)
    return {k: v for k, v in live.items() if v[2] + ttl >= end}


@pytest.mark.parametrize("cuts", [1, 3])
def test_streamed_cache_equals_a_replay(spark, tmp_path, cuts):
    rng = np.random.default_rng(cuts)
    events = [(None if rng.random() < 0.03 else f"k{rng.integers(0, 12)}", int(t), "put" if rng.random() < 0.3 else "touch", None if rng.random() < 0.1 else f"p{i}") for i, t in enumerate(np.sort(rng.integers(0, 400, 150)))]
    base = f"file://{tmp_path}"
    own, table = cache.streaming_session(spark, 2), cache.cache_table(spark, f"{base}/table")
    for n in range(cuts):
        part = [e for e in events if e[1] * cuts // 400 == n]
        rows = spark.createDataFrame(part, "cache_key string, at long, op string, payload string").withColumn("at", F.timestamp_seconds("at"))
        rows.write.mode("append").parquet(f"{base}/events")
        stream = own.readStream.schema(rows.schema).parquet(f"{base}/events")
        cache.write_behind(cache.entry_changes(stream, 60, 10), table, f"{base}/check", compact_every=1).awaitTermination()
    got = {r["cache_key"]: (r["payload"], r["c"], r["u"]) for r in cache.live(table).withColumns({"c": F.unix_seconds("created_at"), "u": F.unix_seconds("last_used")}).collect()}
    want = replayed(events, 60, 10)
    assert got == want and 0 < len(want) < 12


# Read-ahead


def test_lookups_open_few_files_and_bring_what_follows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"key{i}", None if i % 50 == 0 else f"p{i}", int(t)) for i, t in enumerate(rng.integers(0, 120, 1000))]
    rows += [(f"same{i}", "s", 500) for i in range(60)]  # more of one time than a chunk holds
    df = spark.createDataFrame(rows, "cache_key string, payload string, created_at long")
    held = ahead.cluster(df, f"file://{tmp_path}/c", 50)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert [tuple(r) for r in held.rows().orderBy("pos").select("cache_key", "payload", "created_at").collect()] == order

    def want(keys, chunk):
        out = {}
        for r in order:
            if r[0] in keys:
                after = [x for x in order if x[2] >= r[2] and x[0] != r[0]][:chunk]
                out |= {x[0]: (x, False) for x in after if x[0] not in keys}
        return out | {r[0]: (r, True) for r in order if r[0] in keys}

    for keys, chunk in (({"key7"}, 5), ({"same55", "key1"}, 20), ({"key3", "key500", "key999", "none"}, 120), (set(), 5), ({"none"}, 3), ({f"key{i}" for i in range(300)}, 1)):
        asked = spark.createDataFrame([(k,) for k in keys] + [(None,)], "cache_key string")
        got = {r["cache_key"]: ((r["cache_key"], r["payload"], r["created_at"]), r["hit"]) for r in held.looked_up(asked, chunk).collect()}
        assert got == want(keys, chunk)
    one = spark.createDataFrame([("key7",)], "cache_key string")
    opened = held.files_with(one)
    assert len(opened) <= 3 and len(held.rows(opened).inputFiles()) == len(opened) and held.index.count() == 22
    assert len(held.looked_up(one, 5).inputFiles()) <= 6


def test_many_keys_are_joined(spark, tmp_path, monkeypatch):
    df = spark.range(200).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.lit("p").alias("payload"), (F.col("id") % 9).alias("created_at"))
    held = ahead.cluster(df, f"file://{tmp_path}/c", 30)
    asked = df.where("created_at = 3")
    few = Counter(map(tuple, held.looked_up(asked, 4).collect()))
    monkeypatch.setattr(ahead, "MOST_ASKED", 5)
    assert Counter(map(tuple, held.looked_up(asked, 4).collect())) == few
    with pytest.raises(ValueError):
        held.files_with(asked)
    empty = ahead.cluster(df.limit(0), f"file://{tmp_path}/e", 30)
    assert empty.looked_up(asked, 4).count() == 0


# Models in batches


def test_a_failing_item_is_null_and_the_model_is_loaded_once(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("x")

        def model(x):
            if (x == 13).any():
                raise RuntimeError("bad luck")
            return [None if v % 10 == 4 else int(v) * 2 for v in x] + ([] if len(x) != 3 else [0])

        return model

    rows = spark.range(100).withColumn("x", F.col("id")).coalesce(1)
    got = {r["id"]: (r["a"]["value"], r["a"]["error"]) for r in rows.withColumn("a", batches.BatchModel(f"m{tmp_path}", load, "int", 16).column("x")).collect()}
    assert got[13] == (None, "RuntimeError: bad luck") and got[4] == (None, "no value") and len(log.read_text()) == 1
    assert all(got[i] == (2 * i, None) for i in range(100) if i != 13 and i % 10 != 4)


def test_uncovered_images_are_asked_once_more(spark):
    def load():
        return lambda attr, attempt, image: [None if (i + a) % 10 == 0 or (i % 3 == 0 and t == "b") else 1 for t, a, i in zip(attr, attempt, image)]

    images = spark.range(40).select(F.col("id").alias("image_id"))
    attrs = spark.createDataFrame([("a",), ("b",)], "attr string")
    known = spark.createDataFrame([(10, "a"), (20, "b")], "image_id long, attr string")
    labels, rest = batches.detected(images, attrs, known, batches.BatchModel("partly", load), "image_id")
    want, left = {}, set()
    for i in range(40):
        todo = [t for t in "ab" if (i, t) not in {(10, "a"), (20, "b")}]
        ok = lambda t, a: not ((i + a) % 10 == 0 or i % 3 == 0 and t == "b")
        got = {t: 0 for t in todo if ok(t, 0)}
        if not got and i not in (10, 20):
            got = {t: 1 for t in todo if ok(t, 1)}
        want |= {(i, t): a for t, a in got.items()}
        left |= {(i, t) for t in todo if t not in got}
    assert {(r["image_id"], r["attr"]): r["attempt"] for r in labels.collect()} == want and labels.count() == len(want)
    assert Counter((r["image_id"], r["attr"]) for r in rest.collect()) == Counter(left)


def test_known_scores_are_not_sent(spark):
    def load():
        return lambda x: [float(v) for v in x]

    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan"))], "x int, reward double")
    model = batches.BatchModel("plain", load, "double")
    assert {(r["x"], str(r["reward"])) for r in batches.rated(rows, model, "x").collect()} == {(1, "5.0"), (2, "2.0"), (3, "nan")}
    assert batches.rated(rows.drop("reward"), model, "x").agg(F.sum("reward")).first()[0] == 6


# Samples


def test_merged_samples_are_the_windows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sketches, "HELD", 50)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(7)
    for by, n in ((["user_id"], 3), (["event_type"], 20), (["user_id", "event_type"], 1), (["event_type"], 10_000)):
        rows = events.select(*by, "event_id", "value")
        got, want = sketches.bottom_k(rows, by, n, "event_id", seed=5), choose.sampled(rows, by, n, "event_id", seed=5)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sketches.bottom_k(events.limit(0).select("user_id", "event_id"), ["user_id"], 3, "event_id").count() == 0


def test_a_hot_group_sends_a_sample_a_task(spark):
    rows = spark.range(0, 10_000_000, numPartitions=8).select(F.when(F.col("id") % 100 == 0, F.col("id") % 700).otherwise(-1).alias("g"), "id")
    got = sketches.bottom_k(rows, ["g"], 5, "id")
    assert Counter(r["g"] for r in got.collect()) == Counter({g: 5 for g in [-1, 0, 100, 200, 300, 400, 500, 600]})


@pytest.mark.parametrize("kind", ["long", "string"])
def test_context_images_are_the_stratified_ones(spark, sf_dir, kind):
    images = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("prompt"), F.col("event_id").cast(kind).alias("image_id"), F.floor(F.col("value") / 40).cast("double").alias("reward"))
    for n in (1, 4, 7):
        got = sketches.context_images(images, n).select("prompt", "image_id")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, choose.stratified(images, n).select("prompt", "image_id").collect()))


def test_a_run_is_rebuilt_from_its_configuration(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 3).alias("topic_id"), F.col("user_id").alias("prompt"), F.col("event_id").alias("image_id"))
    runs = [sketches.RunSamples(images.repartition(n), seed=9, val=2, prompts=2, per_prompt=3) for n in (2, 5)]
    rows = [Counter(map(tuple, r.baselines().select("topic_id", "prompt", "image_id").collect())) for r in runs]
    assert rows[0] == rows[1] and Counter(t for t, _, _ in rows[0]) == Counter({t: 6 for t in range(3)})
    held = {tuple(r) for r in runs[0].validation().collect()}
    assert len(held) == 6 and not held & {r[:2] for r in rows[0]}
    labels = images.select("image_id", F.lit("a").alias("attr"), (F.col("image_id") % 2).alias("g"))
    found = runs[0].sources(labels, 2).collect()
    assert found and all(r["image_id"] % 2 == 1 for r in found) and max(Counter(r["prompt"] for r in found).values()) <= 2


# Files


def test_missing_files_are_dropped_and_counted(spark, tmp_path):
    for name in ("a.png", "sub/b.png", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = [("p", "1", "a.png"), ("p", "2", f"{tmp_path}/sub/b.png"), ("p", "3", "gone.png"), ("q", "4", "./sub/./b.png"), ("q", "5", f"file://{tmp_path}/c.txt"), ("r", "6", "c.txt"), ("p", "1", "z.png")]
    manifest = spark.createDataFrame(rows, "prompt string, image_id string, image_path string")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        found = files.listing(spark, folder, "*.png")
        assert {(r["path"], r["length"]) for r in found.collect()} == {("a.png", 5), ("sub/b.png", 9)}
        assert sorted(r["image_id"] for r in files.usable_images(manifest, found, folder).collect()) == ["1", "2", "4"]
        counts = files.image_counts(spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "prompt string"), manifest, found, folder)
        assert {tuple(r) for r in counts.collect()} == {("p", 4, 2, False), ("q", 2, 1, False), ("r", 1, 0, True), ("s", 0, 0, True)}
        assert {tuple(r) for r in files.id_paths(manifest, folder).collect()} == {("1", "a.png"), ("2", "sub/b.png"), ("3", "gone.png"), ("4", "sub/b.png"), ("5", "c.txt"), ("6", "c.txt")}
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    scored = spark.createDataFrame([("p", "1", {"m": 1.0}), ("p", "2", {"m": 2.0, "n": 1.0}), ("q", "3", {"m": 1.0}), ("q", "4", {"n": 1.0}), ("r", "5", None)], "prompt string, image_id string, reward_scores map<string,double>")
    assert sorted(r["image_id"] for r in files.scored_prompts(scored, "m").collect()) == ["1", "2"]


# Replies


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', '{"a":1}'), ('[1, 2,]', "[1,2]"), ('{"a": [1, {"b": "x,]', '{"a":[1,{"b":"x,]"}]}'), ('{"a": "q\\"{"', '{"a":"q\\"{"}'), ('{"a": [1, 2', '{"a":[1,2]}'), ('{"a": 1,', '{"a":1}'), ("", None), ("hello", None), (None, None), ("{'a': 1}", None),
    ],
)
def test_repairs(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(F.to_json(replies.parsed("raw")).alias("x")).first()["x"]
    assert got == want or got is not None and want is not None and json.loads(got) == json.loads(want)


@pytest.mark.parametrize("raw, want", [("```json\n[1]\n``` and ```x```", "[1]\n``` and ```x"), (" ```json [1]", "[1]"), ("[1] ```json", "[1] ```json"), ("```\n[1]```", "```\n[1]```")])
def test_fences(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(replies.unfenced("raw").alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    "raw, want, reasoning",
    [
        ('x {"reasoning": "why", "proposals": ["A b", "a B ", "", "Blocked", 3, null, {"k": 1}, "c"]} y', ["A b", "3", '{"k":1}'], "why"),
        ('["first one", "two", "third one"]', ["first one", "third one"], None),
        ('{"proposals": "long text"}', ["proposals", "long text"], None),
        ('{"reasoning": "why", "x": ["longer"]}', ["reasoning", "longer"], "why"),
        ('{"proposals": ["a", "b",]}', ["a", "b"], None), ("nothing", [], None), (None, [], None), ("{}", [], None), ('{"proposals": []}', [], None),
    ],
)
def test_proposals(spark, raw, want, reasoning):
    r = replies.proposals(spark.createDataFrame([(raw, ["blocked "])], "raw string, blocked array<string>"), 3).first()
    assert (r["proposals"], r["reasoning"]) == (want, reasoning)


def test_proposals_of_several_calls(spark):
    rows = [(1, 0, '{"proposals": ["a", "b"]}', None), (1, 1, '{"proposals": ["B", "c"]}', ["x"]), (2, 0, None, None), (3, 0, '{"proposals": ["b"]}', None)]
    got = replies.joined_proposals(spark.createDataFrame(rows, "topic int, call int, raw string, blocked array<string>"), 5, ["topic"], "call")
    assert {tuple(r) for r in got.collect()} == {(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (3, 0, "b")}


def cluster(index=None, members=(), **rep):
    return {"representative": rep | ({} if index is None else {"index": index}), "members": list(members)}


@pytest.mark.parametrize(
    "reply, want",
    [
        ([cluster(0, [1]), cluster(3, [1, 2, 3]), cluster(1, [1, 2])], ["d", "b"]), ([[cluster(2, [1])], [cluster(1)]], ["c"]), ([cluster(9, attribute="own"), cluster(-1)], ["own"]), ([1, "x", cluster(1)], ["b"]),
        ([1, "x"], ["a", "b"]), ({"a": 1}, ["a", "b"]), ("text", ["a", "b"]), ([], ["a", "b"]), (None, ["a", "b"]), ([{"representative": "x", "members": [1, 2]}, {"members": 5}, cluster(1)], []), ([cluster(1, [1]), cluster(0, [1])], ["b", "a"]),
    ],
)
def test_representatives(spark, reply, want):
    raw = None if reply is None else f"```json\n{json.dumps(reply)}\n```"
    df = spark.createDataFrame([(raw, list("abcd")), (raw, ["z"]), (raw, [])], "raw string, attributes array<string>")
    assert [r["representatives"] for r in replies.representatives(df, 2).collect()] == [want, ["z"], []]


# Messages


def test_shapes_of_messages(spark):
    p = messages.part
    chat = F.array(
        messages.said("system", F.lit("s")), messages.user_with_images(F.lit("look"), F.array(F.lit("data:image/png;base64,AA=="), F.lit("https://h/x"))),
        messages.message("assistant", p("reasoning", F.lit("hm")), p("text", F.lit("t")), p("call", F.lit('{"n":1}'), call_id=F.lit("c1"), name=F.lit("f"))), messages.tool_answer(F.lit("c1"), F.lit("42")),
    ).cast(messages.CHAT)
    r = spark.range(1).select(chat.alias("x")).select(*(F.to_json(f(F.col("x"))).alias(n) for n, f in (("r", messages.to_responses), ("c", messages.to_completions), ("b", messages.to_blocks))), messages.as_text(F.col("x")).alias("t"), messages.first_of(F.col("x"), "user").alias("u"), messages.first_of(F.col("x"), "robot").alias("none")).first()
    assert json.loads(r["r"])[1]["content"] == [{"type": "input_text", "text": "look"}, {"type": "input_image", "image_url": "data:image/png;base64,AA==", "detail": "auto"}, {"type": "input_image", "image_url": "https://h/x", "detail": "auto"}]
    c = json.loads(r["c"])
    assert c[0] == {"role": "system", "content": "s"} and c[1]["content"][1] == {"type": "image_url", "image_url": {"url": "data:image/png;base64,AA==", "detail": "auto"}}
    assert c[2] == {"role": "assistant", "content": "t", "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": '{"n":1}'}}], "reasoning_details": [{"type": "reasoning.text", "text": "hm"}]}
    assert c[3] == {"role": "tool", "content": "42", "tool_call_id": "c1"}
    b = json.loads(r["b"])
    assert b["system"] == "s" and b["messages"][0]["content"][1:] == [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "AA=="}}, {"type": "image", "source": {"type": "url", "url": "https://h/x"}}]
    assert b["messages"][1]["content"] == [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "t"}, {"type": "tool_use", "id": "c1", "name": "f", "input": {"n": 1}}]
    assert b["messages"][2] == {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "42"}]}
    assert r["t"].startswith("system:\ns\nuser:\nlook\n") and (r["u"], r["none"]) == ("look", None)


@pytest.mark.parametrize("status, want", [("completed", "stop"), ("incomplete", "length"), ("cancelled", "error"), ("odd", "error"), (None, "error")])
def test_answers(spark, status, want):
    raw = json.dumps({"id": "i", "created_at": 7, "model": "m", "error": {"code": 1}, "output": [{"type": "message", "status": status, "content": []}]})
    a = spark.range(1).select(messages.unified(F.parse_json(F.lit(raw))).alias("a")).select("a", messages.first_response(F.col("a")).alias("t"), messages.reasoning_content(F.col("a")).alias("r")).first()
    assert (a["a"]["choices"][0]["finish_reason"], a["t"], a["r"], a["a"]["created"], a["a"]["error"]) == (want, "", None, 7, '{"code":1}')


# Planners


def test_planner_in_sql(spark):
    images = [(p, i, float(i % 7), {"x": int(i % 7 > 3), "y": i % 2, "z": -1}) for p in range(3) for i in range(20)] + [(9, 0, 1.0, {"x": 1})]
    spark.createDataFrame(images, "prompt int, image_id int, reward double, labels map<string,int>").repartition(3).createOrReplaceTempView("context")
    planners.register(spark, "plan_attributes")
    got = spark.sql("select rank, attr, score from plan_attributes(TABLE(context) PARTITION BY prompt ORDER BY (reward, image_id), 6, 2)").collect()
    own = sorted((r[2], r[1], r[3]) for r in images[:20])
    low, high = own[:3], own[-3:]
    want = [(a, np.mean([h[2][a] for h in high]) - np.mean([x[2][a] for x in low])) for a in "xy"]
    want = sorted(((a, s) for a, s in want if s > 0), key=lambda x: (-x[1], x[0]))
    assert Counter((r["rank"], r["attr"], round(r["score"], 9)) for r in got) == Counter([(i, a, round(s, 9)) for _ in range(3) for i, (a, s) in enumerate(want)] + [(0, "x", 1.0)])

    def broken(context, n):
        raise RuntimeError("no answer")

    context = spark.table("context")
    plans = planners.planned(context, 6, 2, broken)
    assert {tuple(r) for r in plans.collect()} == {(p, -1, "RuntimeError: no answer", None) for p in (0, 1, 2, 9)}
    assert planners.initial_pool(plans, 3).count() == 0
    assert [r["attr"] for r in planners.initial_pool(planners.planned(context, 6, 2), 1).collect()] == ["x"]


# Comparisons without pairs


@pytest.mark.parametrize("q, mode, few", [(0.0, "reward", 1), (0.3, "reward", 40), (0.75, "reward", 10_000), (1.0, "reward", 1), (0.75, "score", 40), (0.3, "score_up", 1)])
def test_gap_caps_without_pairs(crowd, q, mode, few, monkeypatch):  # noqa: F811
    monkeypatch.setattr(sides, "FEW", few)
    monkeypatch.setattr(sides, "SPLIT", 4)
    monkeypatch.setattr(sides, "STRIP", 64)
    images, found = crowd
    gap_of = {"reward": lambda r: r[5] - r[6], "score": lambda r: abs(r[7] - r[8]), "score_up": lambda r: r[8] - r[7]}[mode]
    got = {r["attr"]: r for r in sides.gap_caps(sides.by_prompt(images, ABC), ABC, q, mode).collect()}
    for attr, own in grouped([r for r in found if wins(r) and gap_of(r) >= 0], lambda r: r[1]).items():
        assert got[attr]["cap"] == pytest.approx(np.quantile([gap_of(r) for r in own], q), abs=1e-12) and got[attr]["n"] == len(own)


def test_gap_caps_of_rounded_differences(spark, monkeypatch):
    monkeypatch.setattr(sides, "FEW", 1)
    rng = np.random.default_rng(3)
    rows = [(0, i, float(rng.integers(0, 40)) / 10 + float(rng.choice([0, 1e9, 1e-9])), [int(i % 2)]) for i in range(200)]
    gaps = [a[2] - b[2] for a in rows for b in rows if a[3] == [1] and b[3] == [0] and a[2] > b[2]]
    prompts = sides.by_prompt(spark.createDataFrame(rows, "prompt int, image_id int, reward double, g array<int>"), ("a",))
    for q in (0.1, 0.9):
        r = sides.gap_caps(prompts, ("a",), q).first()
        assert r["n"] == len(gaps) and r["cap"] == pytest.approx(np.quantile(gaps, q), rel=1e-12)


def test_plans_hold_no_pairs(spark, crowd):  # noqa: F811
    images, _ = crowd
    prompts = sides.by_prompt(images, ABC)
    caps = sides.gap_caps(prompts, ABC)
    plan = sides.counterfactuals(prompts, ABC, caps, 1)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join", plan)
    assert sides.gap_caps(prompts.limit(0), ABC).count() == 0 and sides.counterfactuals(prompts.limit(0), ABC, caps, 1).count() == 0
    with pytest.raises(ValueError):
        sides.gap_caps(prompts, ABC, mode="other")
    assert pairs.hamming is not None


def test_gap_caps_send_few_rows(spark, monkeypatch):
    monkeypatch.setattr(sides, "FEW", 100)
    rng = np.random.default_rng(5)
    rows = [(p, i, float(rng.normal()), [int(rng.integers(0, 2))]) for p in range(600) for i in range(20)] + [(600, i, float(rng.normal()), [i % 2]) for i in range(1200)]
    prompts = sides.by_prompt(spark.createDataFrame(rows, "prompt int, image_id int, reward double, g array<int>"), ("a",)).coalesce(2)
    sent = []
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(prompts), name, lambda self, *x, f=getattr(type(prompts), name): sent.append(f(self, *x)) or sent[-1])
    r = sides.gap_caps(prompts, ("a",)).first()
    gaps = [a[2] - b[2] for _, own in grouped(rows, lambda r: r[0]).items() for a in own if a[3] == [1] for b in own if b[3] == [0] and a[2] > b[2]]
    assert r["n"] == len(gaps) and r["cap"] == pytest.approx(np.quantile(gaps, 0.75), abs=1e-12)
    assert len(sent) > 2 and max(s.count() for s in sent) <= 2 * 2 * sides.SPLIT  # before: SPLIT rows a prompt


def test_counterfactuals_leave_in_bounded_frames(spark, monkeypatch):
    rows = [(p, i, float(i), [i % 2]) for p in range(3000) for i in range(20)]
    prompts = sides.by_prompt(spark.createDataFrame(rows, "prompt int, image_id int, reward double, g array<int>"), ("a",)).coalesce(1)
    runs = []
    kept = type(prompts).mapInPandas
    monkeypatch.setattr(type(prompts), "mapInPandas", lambda self, run, schema: runs.append(run) or kept(self, run, schema))
    caps = spark.createDataFrame([("a", 100.0)], "attr string, cap double")
    assert sides.counterfactuals(prompts, ("a",), caps, 1).count() == 3000 * 5
    sizes = [len(f) for f in runs[-1](iter([prompts.toPandas()]))]
    assert sum(sizes) == 3000 * 5 and max(sizes) < 10_100  # before: all pairs of a batch at once


def test_batches_hold_chunks_of_large_prompts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(p, i, float(rng.integers(0, 300)), [int(x) for x in rng.integers(0, 2, 2)]) for p, n in enumerate([700, 1, 5, 900, 33, 32, 64]) for i in range(n)]
    prompts = sides.kept(sides.by_prompt(spark.createDataFrame(rows, "prompt int, image_id int, reward double, g array<int>"), ("a", "b")).coalesce(1))
    sent = []
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(prompts), name, lambda self, *x, f=getattr(type(prompts), name): sent.append(self) or f(self, *x))
    found = []
    for size in (10_000, 7):  # rows of a batch: prompts go on in the next
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            caps = sides.gap_caps(prompts, ("a", "b"))
            found.append((sorted(map(tuple, caps.collect())), sorted(map(tuple, sides.counterfactuals(prompts, ("a", "b"), caps, 1).collect()))))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and max(s.select(F.max(F.size("rewards"))).first()[0] for s in sent) <= sides.CHUNK  # before: 900
    own = grouped(rows, lambda r: r[0])
    for k, attr in enumerate("ab"):
        gaps = [a[2] - b[2] for z in own.values() for a in z if a[3][k] == 1 for b in z if b[3][k] == 0 and a[2] > b[2]]
        cap = next(c for c in found[0][0] if c[0] == attr)
        assert cap[1] == pytest.approx(np.quantile(gaps, 0.75), abs=1e-12) and cap[2] == len(gaps)
        want = []
        for p, z in own.items():
            used = set()
            for a in sorted((r for r in z if r[3][k] == 1), key=lambda r: (-r[2], r[1])):
                c = [(0.5 * (a[3][1 - k] != b[3][1 - k]) + 0.5 * (a[2] - b[2]) / cap[1], b[1], b) for b in z if b[3][k] == 0 and b[1] not in used and 0 < a[2] - b[2] <= cap[1]]
                if c and len(used) < 5:
                    used.add(min(c)[1])
                    want.append((attr, p, a[1], min(c)[1], int(a[3][1 - k] != min(c)[2][3][1 - k]), a[2] - min(c)[2][2]))
        assert [r for r in found[0][1] if r[0] == attr] == sorted(want)


def test_counterfactuals_leave_out_unknown_labels(spark):
    rows = [(0, 0, 9.0, [1, 0]), (0, 1, 8.0, [0, None]), (0, 2, 7.0, [0, 0]), (0, 3, 9.5, [1, None])]
    prompts = sides.by_prompt(spark.createDataFrame(rows, "prompt int, image_id int, reward double, g array<int>"), ("a", "b"))
    caps = sides.gap_caps(prompts, ("a", "b"), 1.0)
    assert {r["attr"]: r["n"] for r in caps.collect()} == {"a": 4}
    assert [tuple(r) for r in sides.counterfactuals(prompts, ("a", "b"), caps, 2).collect()] == [("a", 0, 0, 2, 0, 2.0)]
