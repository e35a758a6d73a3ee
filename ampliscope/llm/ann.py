"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved

DEGREE, BEAM, ALPHA = 28, 64, 1.2
#: A shard's search beam starts here and doubles until GOAL of the exact nearest of PROBES of its vectors are found.
SEARCH_BEAM, GOAL, PROBES = 160, 0.96, 96
SHARDS, SHARD_ROWS = 8, 20_000
BLOCK, BLOCKS = 2048, 16
BITMAP = 24_000_000
PRUNED_CELLS = 1 << 20  # numbers held at once while edges are pruned


def _nearest(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, trace: bool = False):
    """Greedy searches, all queries in step: each expands its nearest unexpanded node, until none is left among its beam nearest.

    Returns ids and squared distances (m, beam), -1 and inf where fewer were met; with trace also the expanded ids (m, steps)."""
    m, n = len(queries), len(x)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = ((queries - x[entry]) ** 2).sum(1)
    seen[:, entry] = seen[:, n] = True
    steps = []
    while True:
        open_ = np.where(done, np.inf, dist)
        k = open_.argmin(1)
        live = np.flatnonzero(np.isfinite(open_[np.arange(m), k]))
        if not len(live):
            break
        at = ids[live, k[live]]
        done[live, k[live]] = True
        if trace:
            step = np.full(m, -1, np.int64)
            step[live] = at
            steps.append(step)
        near = graph[at]
        near = np.where(near < 0, n, near)
        new = ~seen[live[:, None], near]
        row, col = np.nonzero(new)
        if not len(row):
            continue
        to = near[row, col]
        seen[live[row], to] = True
        d = np.full(near.shape, np.inf)
        apart = x[to] - queries[live[row]]
        d[row, col] = np.einsum("ij,ij->i", apart, apart)
        all_d = np.concatenate([dist[live], d], 1)
        pick = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        rows = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], np.where(new, near, -1)], 1)[rows, pick]
        dist[live] = all_d[rows, pick]
        done[live] = np.concatenate([done[live], ~new], 1)[rows, pick]
    return ids, dist, np.stack(steps, 1) if trace and steps else None


def _pruned(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges (m, degree) of nodes `of` among candidates (m, c; -1: none): the nearest stays, those that it covers by the factor alpha go, and so on."""
    m, c = candidates.shape
    step = max(1, PRUNED_CELLS // (c * x.shape[1]))
    if m > step:
        return np.concatenate([_pruned(x, of[i : i + step], candidates[i : i + step], degree, alpha) for i in range(0, m, step)])
    order = np.sort(candidates, 1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    order[order == of[:, None]] = -1
    v = x[np.maximum(order, 0)]
    apart = v - x[of][:, None]
    dist = np.where(order < 0, np.inf, np.einsum("mcd,mcd->mc", apart, apart))
    out, rows = np.full((m, degree), -1, np.int64), np.arange(m)
    left = dist.copy()
    for k in range(degree):
        best = left.argmin(1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        out[ok, k] = order[rows, best][ok]
        left[rows, best] = np.inf
        apart = v - v[rows, best][:, None]
        left[ok[:, None] & (alpha * alpha * np.einsum("mcd,mcd->mc", apart, apart) <= dist)] = np.inf
    return out


def _linked_back(x: np.ndarray, graph: np.ndarray, src: np.ndarray, dst: np.ndarray, alpha: float) -> None:
    """Add the reverse edges dst -> src in place. A node whose edges no longer fit is pruned among all of them.

    Nodes are taken by the number of their candidates, in powers of two, so that one much-linked node widens no other's table."""
    degree = graph.shape[1]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    held = (graph[nodes] >= 0).sum(1)
    width = np.maximum(degree, 1 << np.ceil(np.log2(held + count)).astype(np.int64))
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        both = np.full((len(mine), int(w)), -1, np.int64)
        both[:, :degree] = graph[nodes[mine]]
        row = np.repeat(np.arange(len(mine)), count[mine])
        slot = np.arange(len(row)) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])
        both[row, held[mine][row] + slot] = src[first[mine][row] + slot]
        graph[nodes[mine]] = both if w == degree else _pruned(x, nodes[mine], both, degree, alpha)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """The graph (n, degree; -1: no edge) and its entry. Nodes are put in by batches that double; each batch searches what is there."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    if n < 2:
        return graph, 0
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        size = min(max(1, at), max(64, n // 20), max(64, BITMAP // n), n - at)
        batch = order[at : at + size]
        _, _, met = _nearest(x, graph, entry, x[batch], beam, trace=True)
        graph[batch] = _pruned(x, batch, met, degree, alpha)
        src, dst = np.repeat(batch, degree), graph[batch].ravel()
        _linked_back(x, graph, src[dst >= 0], dst[dst >= 0], alpha)
        at += size
    return graph, entry


def search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
    """The k nearest nodes met for each query, nearest first (-1: fewer)."""
    step, out = max(1, BITMAP // (len(x) + 1)), []
    for i in range(0, len(queries), step):
        ids, dist, _ = _nearest(x, graph, entry, queries[i : i + step], max(beam, k))
        out.append(np.take_along_axis(ids, np.argsort(dist, 1, kind="stable"), 1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def beam_for(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, k: int, goal: float = GOAL) -> int:
    """The least of SEARCH_BEAM, twice it and so on that finds `goal` of the k exactly nearest of the given queries; all nodes at the most."""
    n, beam = len(x), SEARCH_BEAM
    if not len(queries):
        return beam
    near = []
    for q in queries:
        apart = ((x - q) ** 2).sum(1)
        near.append(np.partition(apart, min(k, n) - 1)[min(k, n) - 1])
    near = np.array(near)
    while beam < n:
        found = search(x, graph, entry, queries, min(k, n), beam)
        apart = ((x[np.maximum(found, 0)] - queries[:, None]) ** 2).sum(2)
        if ((found >= 0) & (apart <= near[:, None])).mean() >= goal:
            break
        beam *= 2
    return beam


def usable(column: str = "embedding"):
    """Neither null nor empty nor all zero, and all components finite."""
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda v: v != 0)


def _completed(x: np.ndarray, most: float) -> np.ndarray:
    """x with one more component that brings every vector to the norm `most` (squared)."""
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]], 1)


def _asked(q: np.ndarray, most: float) -> np.ndarray:
    scale = np.sqrt(most / np.maximum((q * q).sum(1), 1e-300))[:, None]
    return np.concatenate([q * scale, np.zeros((len(q), 1))], 1)


def _answers(x, wide, graph, entry, beam, counts, ids, q, q_ids, most, k):
    """(query id, vector id, score) of the k best rows found for each query of a block."""
    found = search(wide, graph, entry, _asked(q, most), k + 1, beam)
    row, col = np.nonzero(found >= 0)
    node = found[row, col]
    scores = np.empty(len(row))
    for s in range(0, len(row), 1 << 15):
        part = slice(s, s + (1 << 15))
        scores[part] = np.einsum("ij,ij->i", x[node[part]], q[row[part]])
    many = counts[node]
    at = np.repeat((np.cumsum(counts) - counts)[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    row, scores, ids = np.repeat(row, many), np.repeat(scores, many), ids[at]
    other = q_ids[row] != ids
    row, scores, ids = row[other], scores[other], ids[other]
    by = np.lexsort([ids, -scores, row])
    row, scores, ids = row[by], scores[by], ids[by]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row[top]]), pa.array(ids[top]), pa.array(scores[top])], ["query_id", "vec_id", "score"])


def _blocks(batches):
    """Queries (vec_id, d, v) in blocks of BLOCK of one length."""
    held: dict[int, list] = {}

    def block(d):
        ids, v = zip(*held.pop(d))
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(v).tobytes()], pa.binary())], ["d", "q_ids", "q"])

    for batch in batches:
        for i, d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            held.setdefault(d, []).append((i, v.values.to_numpy()))
            if len(held[d]) == BLOCK:
                yield block(d)
    for d in list(held):
        yield block(d)


def neighbours(vectors: DataFrame, owner: str = "ann", k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (inner product in double precision) of each query's k nearest found rows.

    Queries: ids divisible by `every`; candidates: all rows with another id. Rows without an id or with an unusable vector take
    no part. Vectors of different lengths have no inner product: each length is an index of its own. A repeated row (same id
    and vector) counts once; an id with several vectors is answered by its best one. An empty table gives an empty result.
    Ties in score go to the smaller id.

    Each distinct vector is one node of the index; it stands for its k + 1 smallest ids, more of which no result could hold, so
    a vector shared by many rows costs one node. Vectors are dealt by hash to shards of about SHARD_ROWS at most, and each
    query block is searched in every shard, with a beam that the shard has tried on vectors of its own (beam_for).
    Inner products are turned into distances by one more component, which completes all vectors to one norm; distances are
    squared differences in double precision, so that one large norm leaves the others' distances apart."""
    import pandas as pd

    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("v")).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    nodes = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.collect_list("vec_id").alias("ids"))
    nodes = saved(nodes.withColumns({"d": F.size("v"), "norm": F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)}), owner, "nodes")
    parts = F.greatest(F.lit(SHARDS), F.ceil(F.count("*") / SHARD_ROWS)).cast("int")
    lengths = F.broadcast(nodes.groupBy("d").agg(F.max("norm").alias("most"), parts.alias("shards")))  # a row a vector length
    dealt = nodes.join(lengths, "d").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def index(frame):
        d, most = int(frame["d"].iloc[0]), float(frame["most"].iloc[0])
        x = np.array(frame["v"].tolist(), np.float64).reshape(len(frame), d)
        wide = _completed(x, most)
        graph, entry = build(wide)
        probes = np.unique(np.linspace(0, len(x) - 1, min(len(x), PROBES)).astype(int))
        beam = beam_for(wide, graph, entry, _asked(x[probes], most), k + 1)
        ids = [np.asarray(i, np.int64) for i in frame["ids"]]
        counts = np.array([len(i) for i in ids], np.int64)
        packed = {"x": x, "graph": graph.astype(np.int32), "counts": counts, "ids": np.concatenate(ids)}
        return pd.DataFrame([{"d": d, "shard": frame["shard"].iloc[0], "most": most, "entry": entry, "beam": beam} | {c: a.tobytes() for c, a in packed.items()}])

    tasks = 4 * (nodes.count() // SHARD_ROWS + SHARDS)
    form = "d int, shard int, most double, entry long, beam long, x binary, graph binary, counts binary, ids binary"
    graphs = saved(dealt.repartition(tasks, "d", "shard").groupBy("d", "shard").applyInPandas(index, form), owner, "graphs")

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", F.size("v").alias("d"), "v")
    asked = saved(asked.mapInArrow(_blocks, "d int, q_ids binary, q binary"), owner, "asked")
    slices = asked.count() // BLOCKS + 1  # a task searches about BLOCKS blocks in one shard
    asked = asked.join(lengths, "d").select("d", "q_ids", "q", F.pmod(F.xxhash64("q_ids"), F.lit(slices)).alias("slice"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    graphs = graphs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))

    def look(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                raw = lambda f, t, *shape: np.frombuffer(batch.column(f)[r].as_buffer(), t).reshape(*shape)  # noqa: E731,B023
                d, most, entry, beam = (batch.column(f)[r].as_py() for f in ("d", "most", "entry", "beam"))
                x, q, q_ids, counts, ids = raw("x", np.float64, -1, d), raw("q", np.float64, -1, d), raw("q_ids", np.int64, -1), raw("counts", np.int64, -1), raw("ids", np.int64, -1)
                graph = raw("graph", np.int32, len(x), -1).astype(np.int64)
                yield _answers(x, _completed(x, most), graph, entry, beam, counts, ids, q, q_ids, most, k)

    spread = [side.repartition(tasks * slices, "d", "shard", "slice") for side in (asked, graphs)]
    found = spread[0].join(spread[1], ["d", "shard", "slice"]).mapInArrow(look, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
