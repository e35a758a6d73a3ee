"""The ten tasks of a run as commands over one's own files: python -m ampliscope TASK --option value ..

A bank comes from a manifest (images and scores), a detection cache (labels under a model's key) and a list of attributes.
Each task writes a folder in the form that the readers in sources/formats take, or Parquet where there is none."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import bon, corpus, pairs, regress, reports, trends
from .plans import search
from .sources import formats, sinks, versions
from .sources.banks import Bank

TASKS: dict[str, tuple[Callable, tuple[str, ...]]] = {}
#: Options that need no value on the command line.
DEFAULTS = {
    "topic": 0, "attrs": None, "n": 2, "n_values": "1,2,4,8,16,32,64,128", "tau": 0.0, "steps": 3, "resume": None, "k": 4, "higher": True, "max_h": 2,
    "q": 0.75, "per_prompt": 5, "draws": 500, "mode": "reward", "clusters": 10, "least": 10, "most_tokens": 75, "editable": 0.5,
}


def task(*options: str):
    """Register a command with the names of its options; options outside DEFAULTS are required."""
    def add(f):
        TASKS[f.__name__.replace("_", "-")] = (f, options)
        return f

    return add


BANK = ("manifest", "detections", "model", "score", "attrs", "topic")


def bank(spark: SparkSession, o) -> Bank:
    """The images that have the score and every label of the attributes: those of the file, or all that the cache knows, in order."""
    entries = formats.manifest(spark, o.manifest)
    labels = formats.detections(spark, o.detections, o.model)
    listed = formats.attributes(spark, o.attrs).orderBy("pos") if o.attrs else labels.select("attr").distinct().orderBy("attr")
    attrs = tuple(r["attr"] for r in listed.collect())  # a pool of attributes
    images = formats.rewards(entries, o.score)
    rows = images.join(labels, "image_id").withColumns({"topic_id": F.lit(int(o.topic)), "g": F.when(F.col("g") == 1, 1).otherwise(0)})
    return Bank(regress.fully_labelled(rows, attrs), attrs)


@task(*BANK, "n", "steps", "tau", "resume", "out")
def search_run(spark, o):
    """The discovery loop from all attributes; with --resume it goes on after the last step of an earlier run's folder."""
    own = bank(spark, o)
    cfg = search.SearchConfig(steps=int(o.steps), n=int(o.n), tau=float(o.tau), tau_partial=float(o.tau), pool_sizes=(len(own.attrs),) * int(o.steps))
    state = None
    if o.resume:
        rows = formats.documents(spark, o.resume, formats.STEP).orderBy("step_idx").collect()  # a row a step
        last, scores = rows[-1], [(r["step_idx"], a, x, 0.0, True) for r in rows for a, x in (r["candidate_ahat"] or {}).items()]
        explained = [(r["step_idx"], r["reg_var_explained"]) for r in rows]
        state = search.SearchState(tuple(last["acc_pool"]), tuple(last["humanness_rejected"] or ()), last["step_idx"] + 1, scores, explained)
    done = search.run(own, own.attrs, cfg, state=state)
    steps = [(s, int(o.topic), list(done.pool), list(done.rejected), {a: x for at, a, x, _, kept in done.rows if at == s and kept}, r2, float(o.tau)) for s, r2 in done.explained]
    form = "step_idx int, topic_id int, acc_pool array<string>, humanness_rejected array<string>, candidate_ahat map<string,double>, reg_var_explained double, tau double"
    sinks.json_documents(spark.createDataFrame(steps, form), o.out)


@task(*BANK, "n_values", "out")
def bon_curves(spark, o):
    """Prevalence among the best of n, for each attribute."""
    own = bank(spark, o)
    curve = bon.curve(own.images, own.attrs, [int(n) for n in o.n_values.split(",")])
    documents = sinks.curve_documents(curve.withColumn("topic_id", F.lit(int(o.topic))), "cli")
    sinks.json_documents(documents, o.out)


@task(*BANK, "n", "tau", "out")
def loo_cleanup(spark, o):
    """Attributes whose leave-one-out score is above tau, after those below went one by one."""
    own = bank(spark, o)
    removed, kept = regress.pruned(regress.with_u(own.images, int(o.n)), own.attrs, float(o.tau), int(o.n))
    order = sorted(kept, key=lambda a: (-kept[a], a))
    rows = [(list(own.attrs), [{"removal_rank": r, "attribute": a, "loo_score": x, "pool_size_before": len(own.attrs) - r + 1} for r, a, x in removed], order, kept)]
    form = "initial_pool array<string>, removed array<struct<removal_rank int, attribute string, loo_score double, pool_size_before int>>, kept_pool array<string>, kept_loo_scores map<string,double>"
    sinks.json_documents(spark.createDataFrame(rows, form), o.out)


@task(*BANK, "n", "max_h", "q", "per_prompt", "draws", "mode", "out")
def natural_pairs(spark, o):
    """Counterfactual pairs of prompts whose weight of the attribute is surely above zero."""
    own = bank(spark, o)
    images = regress.with_u(own.images, int(o.n))
    intervals = regress.bootstrap(images, own.attrs, int(o.draws))
    found = pairs.natural(images.drop("u"), own.attrs, intervals, int(o.max_h), float(o.q), int(o.per_prompt), o.mode)
    sinks.csv_rows(found.repartition("attr").sortWithinPartitions("attr", "prompt", "pos_id"), o.out)


@task(*BANK, "k", "higher", "out")
def hamming_pairs(spark, o):
    """The pairs of a prompt that differ in the attribute and in few others."""
    own = bank(spark, o)
    found = pairs.closest(own.images, own.attrs, int(o.k), str(o.higher).lower() == "true")
    sinks.json_documents(sinks.pairs_document(found), o.out)


@task(*BANK, "n", "out")
def r2_report(spark, o):
    """Weights and R squared of every prompt, and their distribution."""
    own = bank(spark, o)
    fits = regress.per_prompt(regress.with_u(own.images, int(o.n)), len(own.attrs))
    at = [F.struct(F.lit(k).alias("k"), F.lit(a).alias("attr"), F.col("w")[k].alias("w")) for k, a in enumerate(own.attrs)]
    named = fits.withColumns({"topic_id": F.lit(int(o.topic)), "step_idx": F.lit(0)})
    weights = named.select("topic_id", "step_idx", "prompt", F.explode(F.array(*at)).alias("z")).select("topic_id", "step_idx", "prompt", "z.*")
    sinks.json_documents(sinks.weight_documents(weights, named), f"{o.out}/weights")
    sinks.json_documents(sinks.history_documents(named), f"{o.out}/history")
    sinks.json_rows(regress.r2_distribution(fits), f"{o.out}/distribution")
    sinks.json_rows(trends.ends_by_r2(fits.select("prompt", "r2"), 10), f"{o.out}/ends")


@task("meta", "embeddings", "clusters", "least", "most_tokens", "out")
def clustering(spark, o):
    """Cluster files of a corpus: cleaned prompts without resolutions, k-means on their vectors (Parquet: id, embedding), in hash order."""
    rows = formats.corpus_meta(spark, o.meta).select("id", F.col("prompt").alias("text")).withColumn("pos", F.col("id"))
    kept = corpus.short_enough(corpus.without_resolutions(corpus.cleaned(rows, least=int(o.least))), int(o.most_tokens))
    vectors = kept.join(spark.read.parquet(o.embeddings).select("id", "embedding"), "id")
    labels = corpus.kmeans_labels(vectors, int(o.clusters), key="id")
    topics = vectors.join(labels, "id").select(F.col("cluster").alias("topic_id"), F.col("text").alias("prompt"))
    sinks.json_rows(corpus.clusters_of(topics), o.out)


@task("scores", "score", "table")
def score_merge(spark, o):
    """Merge scores (JSON lines: image_id, score) under a name into a table of scores; other names and other writers stay."""
    rows = spark.read.schema("image_id string, score double").json(o.scores).where("image_id is not null and score is not null and not isnan(score)")
    one = rows.groupBy("image_id").agg(F.max("score").alias("score"))
    versions.add_scores(versions.score_table(spark, o.table), one, o.score)


@task("edits", "editable", "out")
def edit_survey(spark, o):
    """Success and reward drop of edits (JSON lines: attr, image_id, success, drop) by attribute, and in all."""
    edits = spark.read.schema("attr string, image_id string, success boolean, drop double").json(o.edits)
    rows = reports.survey(edits).join(reports.samples(edits), "attr", "left")
    sinks.json_rows(rows.orderBy(F.desc("success_rate"), "attr").coalesce(1), f"{o.out}/attributes")  # a row an attribute
    sinks.json_rows(reports.survey_total(rows, float(o.editable)), f"{o.out}/total")


@task("detections", "model", "control", "out")
def applicability(spark, o):
    """How a detector that may answer "not applicable" differs from one that may not (two keys of one cache)."""
    a, c = (formats.detections(spark, o.detections, key) for key in (o.model, o.control))
    both = a.withColumnRenamed("g", "app").join(c.withColumnRenamed("g", "control"), ["image_id", "attr"])
    rows = reports.confusion(both)
    sinks.json_rows(rows, f"{o.out}/attributes")
    sinks.json_rows(reports.shares(rows), f"{o.out}/total")


def options(name: str, args: list[str]) -> argparse.Namespace:
    run, names = TASKS[name]
    parser = argparse.ArgumentParser(prog=f"ampliscope {name}", description=run.__doc__)
    for o in names:
        parser.add_argument(f"--{o.replace('_', '-')}", dest=o, default=DEFAULTS.get(o), required=o not in DEFAULTS)
    return parser.parse_args(args)


def run(spark: SparkSession, name: str, args: list[str]) -> None:
    TASKS[name][0](spark, options(name, args))
