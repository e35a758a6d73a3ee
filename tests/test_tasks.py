"""The command line over a user's own files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliscope import tasks
from ampliscope.__main__ import main
from ampliscope.operators import bon, pairs, regress
from ampliscope.sources import formats, versions
from ampliscope.sources.banks import Bank


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A manifest, a detection cache under two keys and a list of attributes."""
    folder = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(1)
    baselines, labels, control = {}, {}, {}
    for p in range(6):
        entries = []
        for i in range(12):
            name = f"{p}_{i}"
            g = {a: int(x) for a, x in zip("abc", rng.choice([0, 1, -1], 3, p=[0.5, 0.4, 0.1]))}
            entries.append({"image_path": f"{name}.png", "image_id": name, "prompt": f"p{p}", "reward_scores": {"m": float(rng.normal() + g["a"])} if i else {"m": None}})
            labels[name] = g if i != 1 else {"a": 1}
            control[name] = {k: max(0, v) for k, v in g.items()}
        baselines[f"p{p}"] = entries
    (folder / "manifest.json").write_text(json.dumps({"metadata": {}, "baselines": baselines}))
    (folder / "cache.json").write_text(json.dumps({"eye": labels, "plain": control, "_rejected::eye::0": ["z"]}))
    (folder / "attrs.txt").write_text("# pool\na\n\nb\na\n")
    return folder


def args(files, out, *more):
    return ["--manifest", f"{files}/manifest.json", "--detections", f"{files}/cache.json", "--model", "eye", "--score", "m", "--out", str(out), *more]


@pytest.fixture(scope="module")
def own(spark, files):
    return tasks.bank(spark, tasks.options("bon-curves", args(files, "x")))


def test_bank_of_files(own, files):
    assert own.attrs == ("a", "b", "c") and own.images.count() == 60 and set(own.images.columns) == {"topic_id", "prompt", "image_id", "reward", "g"}


def test_curves_and_cleanup(spark, files, own, tmp_path):
    assert main(["bon-curves", *args(files, tmp_path / "c", "--n-values", "1,4")]) == 0
    got = {(r["attr"], r["n"]): round(r["prev"], 9) for r in formats.curves(spark, str(tmp_path / "c")).collect()}
    assert got == {(r["attr"], r["n"]): round(r["prev"], 9) for r in bon.curve(own.images, own.attrs, [1, 4]).collect()}
    assert main(["loo-cleanup", *args(files, tmp_path / "l", "--tau", "0.01")]) == 0
    removed, kept = regress.pruned(regress.with_u(own.images, 2), own.attrs, 0.01)
    assert {r["attr"]: r["loo"] for r in formats.cleanup(spark, str(tmp_path / "l")).collect()} == pytest.approx(kept)


def test_pairs(spark, files, own, tmp_path):
    assert main(["hamming-pairs", *args(files, tmp_path / "h", "--k", "2", "--attrs", f"{files}/attrs.txt")]) == 0
    two = Bank(own.images.withColumn("g", F.slice("g", 1, 2)), ("a", "b"))
    rows = spark.read.json(str(tmp_path / "h"), multiLine=True)
    n = sum(len(ps) for r in rows.collect() for ps in r["by_prompt"].asDict().values() if ps)
    assert {r["attr"] for r in rows.collect()} <= {"a", "b"} and n >= pairs.closest(two.images, two.attrs, 2, True).count()
    assert main(["natural-pairs", *args(files, tmp_path / "n", "--draws", "50")]) == 0
    assert spark.read.csv(str(tmp_path / "n"), header=True).columns[:2] == ["attr", "prompt"]


def test_fits_are_read_back(spark, files, own, tmp_path):
    assert main(["r2-report", *args(files, tmp_path / "r")]) == 0
    fits = {r["prompt"]: r for r in regress.per_prompt(regress.with_u(own.images), 3).collect()}
    for r in formats.weights(spark, f"{tmp_path}/r/weights").collect():
        assert r["w"] == pytest.approx(fits[r["prompt"]]["w"][r["k"]]) and r["attr"] == own.attrs[r["k"]]
    assert {r["prompt"]: r["r2"] for r in formats.r2_history(spark, f"{tmp_path}/r/history").collect()} == pytest.approx({p: r["r2"] for p, r in fits.items()})


def test_search_goes_on(spark, files, tmp_path):
    assert main(["search-run", *args(files, tmp_path / "s", "--steps", "1", "--tau", "-1")]) == 0
    assert main(["search-run", *args(files, tmp_path / "t", "--steps", "2", "--tau", "-1", "--resume", str(tmp_path / "s"))]) == 0
    first, both = (formats.steps(spark, str(tmp_path / x)).orderBy("step_idx").collect() for x in "st")
    assert [r["step_idx"] for r in first] == [0] and [r["step_idx"] for r in both] == [0, 1] and both[0]["candidate_ahat"] == first[0]["candidate_ahat"]


def test_reports_scores_and_clusters(spark, files, tmp_path):
    assert main(["applicability", "--detections", f"{files}/cache.json", "--model", "eye", "--control", "plain", "--out", str(tmp_path / "a")]) == 0
    rows = spark.read.json(f"{tmp_path}/a/attributes").collect()
    assert sum(r["na_to_absent"] for r in rows) > 0 and sum(r["na_to_present"] for r in rows) == 0
    (tmp_path / "edits.json").write_text("\n".join(json.dumps({"attr": a, "image_id": i, "success": i != "2", "drop": 0.5}) for a in "ab" for i in "123"))
    assert main(["edit-survey", "--edits", f"{tmp_path}/edits.json", "--out", str(tmp_path / "e")]) == 0
    assert spark.read.json(f"{tmp_path}/e/total").first()["n_attempts"] == 6
    for name, x in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        (tmp_path / "scores.json").write_text("\n".join(json.dumps({"image_id": i, "score": x}) for i in "12"))
        assert main(["score-merge", "--scores", f"{tmp_path}/scores.json", "--score", name, "--table", f"file://{tmp_path}/t"]) == 0
    assert {tuple(sorted(r["scores"].items())) for r in versions.score_maps(versions.score_table(spark, f"file://{tmp_path}/t")).collect()} == {(("a", 3.0), ("b", 2.0))}
    (tmp_path / "meta.json").write_text(json.dumps({f"i{k}": {"prompt": f"a prompt with number {k}" + (" in 4k" if k == 3 else ""), "category": "c"} for k in range(12)} | {"s": {"prompt": "short", "category": "c"}}))
    spark.createDataFrame([(f"i{k}", [float(k < 4), float(k % 2) / 10]) for k in range(12)], "id string, embedding array<double>").write.parquet(f"{tmp_path}/v")
    assert main(["clustering", "--meta", f"{tmp_path}/meta.json", "--embeddings", f"{tmp_path}/v", "--clusters", "2", "--out", str(tmp_path / "k")]) == 0
    assert sorted((r["topic_id"], len(r["prompts"])) for r in spark.read.json(f"{tmp_path}/k").collect()) == [(0, 8), (1, 3)]


def test_options_are_checked(capsys):
    with pytest.raises(SystemExit):
        main(["bon-curves", "--manifest", "x"])
    assert main([]) == 0 and "bon-curves" in capsys.readouterr().out
