"""Prompt corpora: cleaning, filters, k-means medoids, silhouettes, similarity components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import frozen
from .pools import ordered_distinct

RESOLUTION = r"(?i)\b(\d+\s*k|\d+\s*p|uhd|fhd|qhd|hd)\b"


def cleaned(rows: DataFrame, text: str = "text", pos: str = "pos", least: int = 10) -> DataFrame:
    """Trimmed texts of at least `least` characters, the first of each."""
    return ordered_distinct(rows.withColumn(text, F.trim(text)).where(F.length(text) >= least), text, pos)


def without_resolutions(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(~F.col(text).rlike(RESOLUTION))


def token_estimate(text: str = "text") -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def short_enough(rows: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Texts of at most `most` white-space words, the stand-in for a tokenizer's count."""
    return rows.where(F.size(F.split(F.trim(text), r"\s+")) <= most)


def shard(rows: DataFrame, rank: int, n: int, pos: str = "pos") -> DataFrame:
    return rows.where(F.pmod(F.col(pos) - rank, F.lit(n)) == 0)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


#: Rows of a block, whose products with another block are one task's work, and the products held at once.
BLOCK, STRIP = 4096, 512


def _blocked(rows: DataFrame, keep: list[Column], vector: str, names: list[str]) -> DataFrame:
    """Rows of whole vectors with their block b of `blocks`, dealt by hash into blocks of about BLOCK rows, under the names."""
    found = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    n = found.count()
    kept = found.select(*(c.alias(x) for c, x in zip(keep, names)), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.size(vector).alias("d"))
    return kept.withColumns({"b": F.pmod(F.xxhash64(names[0]), F.lit(-(-n // BLOCK) or 1)), "blocks": F.lit(-(-n // BLOCK) or 1)})


def _met(found: DataFrame, run, schema: str) -> DataFrame:
    """run(left, right) over all pairs of blocks i <= j of vectors of one length, each pair in one task; two blocks are all that a task holds."""
    left = found.withColumn("o", F.explode(F.sequence(F.col("b"), F.col("blocks") - 1))).withColumnsRenamed({"b": "i", "o": "j"})
    right = found.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b")))).withColumnsRenamed({"o": "i", "b": "j"})
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.groupBy("d", "i", "j").cogroup(right.groupBy("d", "i", "j")).applyInPandas(lambda key, a, b: run(key[1] == key[2], a, b), schema)


def similar_pairs(rows: DataFrame, at_least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, cosine), a < b, with cosine of at least the threshold, by matrix products of blocks; only pairs that pass leave a task.

    Vectors that are null, hold nulls or differ in length have no cosine; a zero vector has cosine 0."""
    kind = rows.schema[key].dataType.simpleString()

    def run(same, a, b):
        left, right = (_units(np.array(x["v"].tolist())) for x in (a, b)) if len(a) and len(b) else (np.zeros((0, 1)), np.zeros((0, 1)))
        x, y, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        for at in range(0, len(left), STRIP):
            cosine = left[at : at + STRIP] @ right.T
            i, j = np.nonzero(cosine >= at_least)
            value, p, q = cosine[i, j], x[at + i], y[j]
            ok = p < q if same else p != q
            p, q, value = p[ok], q[ok], value[ok]
            out.append(pd.DataFrame({"a": np.where(p < q, p, q), "b": np.where(p < q, q, p), "cosine": value}))
        return pd.concat(out) if out else pd.DataFrame({"a": x[:0], "b": x[:0], "cosine": np.zeros(0)})

    return _met(_blocked(rows, [F.col(key)], vector, ["id"]), run, f"a {kind}, b {kind}, cosine double")


def _units(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1))[:, None]
    return m / np.where(norm > 0, norm, 1.0)


def components(nodes: DataFrame, edges: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, component: the least key reachable over edges (a, b). Large-star and small-star steps in turn until nothing changes; lineage is cut by checkpoints."""
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    now = frozen(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = frozen(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct())
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before:
            break
        before = sign
    return nodes.join(now, nodes[key] == now["u"], "left").select(nodes[key], F.coalesce(now["v"], nodes[key]).alias("component"))


def medoids(rows: DataFrame, group: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """group, medoid, size: the member of least summed cosine distance; ties to the smaller key.

    Sums of cosines to all members are products with the sum of unit vectors, which one aggregation with partial sums gives, so
    no pairs are made and no vector is taken apart."""
    u = rows.select(group, F.col(key).alias("id"), unit(vector).alias("u"))
    sums = u.groupBy(group).agg(vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("t"), F.count("*").alias("size"))
    near = u.join(sums, group).withColumn("dist", F.round(F.col("size") - dot("u", "t"), 9))
    return near.groupBy(group).agg(F.min_by("id", F.struct("dist", "id")).alias("medoid"), F.max("size").alias("size"))


def component_medoids(rows: DataFrame, at_least: float, most: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """component, medoid, size of the first `most` components of rows joined by a cosine of at_least, in order of their first member."""
    found = components(rows.select(key), similar_pairs(rows, at_least, key=key, vector=vector), key)
    own = rows.join(found, key)
    return medoids(own, "component", key, vector).orderBy("component").limit(most)


def kmeans_medoids(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """The row nearest to each k-means centre; all rows if k is not positive or not below their number."""
    n = rows.count()
    if k <= 0 or n <= k:
        return rows.select(key)
    x = rows.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"), vector)
    model = KMeans(k=k, seed=seed).fit(x)
    centres = rows.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    dist = F.aggregate(F.zip_with(vector, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = model.transform(x).join(F.broadcast(centres), "prediction").withColumn("d", dist)
    return near.groupBy("prediction").agg(F.min_by(key, F.struct("d", key)).alias(key)).select(key)


def kmeans_labels(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """key, cluster: of k-means, numbered by size, the largest first; ties by least key. No more clusters than rows."""
    x = rows.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features")).persist()
    try:
        found = frozen(KMeans(k=max(2, min(k, x.count())), seed=seed).fit(x).transform(x).select(key, "prediction"))
    finally:
        x.unpersist()
    sizes = found.groupBy("prediction").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    order = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)  # a row a cluster
    return found.join(F.broadcast(order.select("prediction", "cluster")), "prediction").select(key, "cluster")


def _packed(rows: DataFrame, clusters: list[str], key: str, vector: str) -> tuple[DataFrame, int]:
    """d, b, v, c0, c1, ..: a row a block of about BLOCK whole vectors of one length d, end to end, with their clusters as text; a block a partition. And how many b there are."""
    found = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    for c in clusters:
        found = found.where(F.col(c).isNotNull())
    blocks = -(-found.count() // BLOCK) or 1
    v = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))
    kept = found.select(F.size(vector).alias("d"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"), v.alias("v"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(clusters)))
    whole = kept.repartition(blocks, "b").groupBy("d", "b").agg(F.collect_list(F.struct("v", *(f"c{i}" for i in range(len(clusters))))).alias("z"))
    return frozen(whole.select("d", "b", F.flatten("z.v").alias("v"), *(F.col(f"z.c{i}").alias(f"c{i}") for i in range(len(clusters))))), blocks


#: Blocks that a task reads for each of its own, and sums that it holds.
AGAINST, HELD = 32, 1 << 22
SUMS = pa.schema([("d", pa.int32()), ("b", pa.int64()), ("labels", pa.int32()), ("name", pa.string()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])


def _distance_sums(pairs, labelings: int):
    """Of batches of pairs of blocks: for each first block and cluster the sums of its rows' distances to the members in the second blocks."""
    held: dict = {}

    def sent():
        rows = [(*k, n, s) for k, (n, s) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SUMS)], schema=SUMS)

    for batch in pairs:
        at = {c: batch.column(c) for c in batch.schema.names}
        for r in range(len(batch)):
            d, b = at["d"][r].as_py(), at["b"][r].as_py()
            if d != at["od"][r].as_py():
                continue
            left, right = (at[c][r].values.to_numpy(zero_copy_only=False).astype(float).reshape(len(at[n][r].values), d) for c, n in (("v", "c0"), ("ov", "oc0")))
            coded = [at[f"oc{g}"][r].values.dictionary_encode() for g in range(labelings)]
            members = np.concatenate([np.eye(len(c.dictionary))[c.indices.to_numpy()] for c in coded], axis=1)
            far, total = (right * right).sum(1), np.empty((members.shape[1], len(left)))
            for start in range(0, len(left), STRIP):
                x = left[start : start + STRIP]
                dist = np.sqrt(np.maximum((x * x).sum(1)[:, None] + far - 2 * x @ right.T, 0))
                if b == at["ob"][r].as_py():
                    dist[np.arange(len(x)), start + np.arange(len(x))] = 0
                total[:, start : start + STRIP] = (dist @ members).T
            names = [(d, b, g, name) for g, c in enumerate(coded) for name in c.dictionary.to_pylist()]
            for k, n, sums in zip(names, members.sum(0), total):
                old = held.get(k, (0, 0.0))
                held[k] = old[0] + int(n), old[1] + sums
            if len(held) * BLOCK > HELD:
                yield sent()
    if held:
        yield sent()


def silhouettes_of(rows: DataFrame, clusters: list[str], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """labels (the place in clusters), silhouette: the mean Euclidean silhouette over rows whose vectors are whole, for several clusterings at once.

    All distances are needed, so time grows with the square of the rows: for samples. Blocks lie in the shared folder and each is read against
    the others from there, so disk grows with the rows: a copy, and for every AGAINST blocks a number a row and cluster. For clusters
    of which a task holds a number a row of a block: some thousands. 0 for a row alone in its cluster."""
    many, (packed, blocks) = len(clusters), _packed(rows, clusters, key, vector)
    others = packed.coalesce(-(-blocks // AGAINST)).toDF(*(f"o{c}" for c in packed.columns))
    sums = packed.crossJoin(others).mapInArrow(lambda batches: _distance_sums(batches, many), "d int, b long, labels int, name string, n long, s array<double>")

    def finished(key, blocks, sums):
        out = []
        for g, own in enumerate(blocks[f"c{i}"].iloc[0] for i in range(many)):
            mine = sums[sums["labels"] == g]
            a, b = np.full(len(own), np.nan), np.full(len(own), np.inf)
            for name, part in mine.groupby("name"):
                n, s, inside = int(part["n"].sum()), np.sum(np.stack(part["s"].tolist()), axis=0), np.asarray(own) == name
                a[inside] = s[inside] / (n - 1) if n > 1 else -1
                b[~inside] = np.minimum(b[~inside], s[~inside] / n)
            far = np.maximum(a, b)
            value = np.where((a < 0) | (b == np.inf) | (far <= 0), 0.0, (b - a) / np.where(far == 0, 1.0, far))
            out.append((g, float(value.sum()), len(own)))
        return pd.DataFrame(out, columns=["labels", "s", "n"])

    own = packed.drop("v")
    per = own.select(*(F.col(c).alias(c) for c in own.columns)).groupBy("d", "b").cogroup(sums.groupBy("d", "b")).applyInPandas(finished, "labels int, s double, n long")
    return per.groupBy("labels").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def silhouettes(rows: DataFrame, cluster: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """silhouette: that of one clustering; null without rows."""
    return silhouettes_of(rows, [cluster], key, vector).agg(F.max("silhouette").alias("silhouette"))


def best_k(rows: DataFrame, ks: list[int], key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """k, silhouette for each k below the number of rows, best first; ties to the smaller k. Distances are worked out once for all k."""
    n = rows.count()
    ks = [k for i, k in enumerate(ks) if max(ks[: i + 1]) < n]
    x = rows.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"), vector).persist()
    own = x
    for i, k in enumerate(ks):
        own = KMeans(k=k, seed=seed, predictionCol=f"_k{i}").fit(x).transform(own)
    found = [(ks[r["labels"]], r["silhouette"]) for r in silhouettes_of(own, [f"_k{i}" for i in range(len(ks))], key, vector).collect()] if ks else []
    x.unpersist()
    return rows.sparkSession.createDataFrame(found, "k int, silhouette double").orderBy(F.desc("silhouette"), "k")


def tukey(rows: DataFrame, by: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows whose value is inside the fences [q25 - k iqr, q75 + k iqr] of their group, fences included."""
    q = rows.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return rows.join(q, by).where(F.col(value).between(F.col("q")[0] - k * iqr, F.col("q")[1] + k * iqr)).drop("q")


def clusters_of(prompts: DataFrame) -> DataFrame:
    """A row per topic, prompts in hash order: the shape of a cluster file."""
    w = Window.partitionBy("topic_id").orderBy(F.xxhash64("prompt"), "prompt")
    return prompts.withColumn("_r", F.row_number().over(w)).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "prompt"))), lambda z: z["prompt"]).alias("prompts"))
