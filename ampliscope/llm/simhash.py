"""SimHash near-duplicates by a binary trie self-join over distinct fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, pieces_of, prepare, saved, text_bytes

SEED = 42
SHINGLE = 3
BUDGET = 2
#: Of four blocks, two fingerprints that differ in at most two bits agree in at least two.
PAIRS = tuple(combinations(range(4), 2))
#: A node of the dealt tries with more fingerprints is cut once more.
HEAVY = 1 << 15
#: Node pairs of at most this many pairs are compared without going down.
SMALL = 32


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; bytes.lower and bytes.split touch ASCII only."""
    h = xxhash.xxh64_intdigest
    out, tail = [], []
    for piece in pieces_of(text):
        words = tail + piece.lower().split()
        if len(words) >= k:
            columns = [words[i : len(words) - k + 1 + i] for i in range(k)]
            out.append(np.fromiter([h(s, SEED) for s in map(b" ".join, zip(*columns))], np.uint64, len(words) - k + 1))
        tail = words[-(k - 1) :] if k > 1 else []
    if not out and tail:
        out.append(np.array([h(b" ".join(tail), SEED)], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def _pairs_of(at: np.ndarray, most: int):
    """Index pairs (i, j) of node pairs (start, end, start, end), at most about `most` at a time; i < j within a node with itself."""
    size = (at[1] - at[0]) * (at[3] - at[2])
    for group in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1):
        rows = at[:, group]
        if len(group) == 1 and size[group[0]] > most and rows[1, 0] - rows[0, 0] > 1:
            step = max(1, int(most // (rows[3, 0] - rows[2, 0])))
            cuts = np.append(np.arange(rows[0, 0], rows[1, 0], step), rows[1, 0])
            parts = [np.array([[lo], [hi], [rows[2, 0]], [rows[3, 0]]]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        else:
            parts = [rows[:4]]
        for part in parts:
            wide, n = part[3] - part[2], (part[1] - part[0]) * (part[3] - part[2])
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(part[0], n) + place // np.repeat(wide, n), np.repeat(part[2], n) + place % np.repeat(wide, n)
            ok = ~np.repeat(rows[0] == rows[2], n) | (i < j)
            yield i[ok], j[ok]


def trie_links(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, budget: int, group: np.ndarray | None = None, most: int = 1 << 19):
    """Index pairs (i, j) whose keys differ in at most `budget` bits, within each sorted run keys[start:end], as arrays in turn.

    A node is a range of a run that shares the bits above the current level. Node pairs go down together; unlike children
    cost one of the budget, and pairs beyond the budget and empty nodes end there. Small node pairs, and those whose bits are
    used up, are compared as they are. With `group`, pairs of one group are left out, and a node pair that holds one group
    alone ends at once. A frontier over `most` pairs is halved and worked off depth first, so memory stays bounded."""
    ones = [np.concatenate([[0], np.cumsum(keys >> np.uint64(b) & np.uint64(1), dtype=np.int64)]) for b in range(bits)]
    changes = None if group is None else np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    todo = [(bits - 1, np.stack([starts, ends, starts, ends, np.zeros_like(starts)]))]
    while todo:
        bit, at = todo.pop()
        if changes is not None and at.shape[1]:
            same = (changes[at[0]] == changes[at[1] - 1]) & (changes[at[2]] == changes[at[3] - 1]) & (group[at[0]] == group[at[2]])
            at = at[:, ~same]
        small = (at[1] - at[0]) * (at[3] - at[2]) <= SMALL if bit >= 0 else np.ones(at.shape[1], bool)
        if small.any():
            for i, j in _pairs_of(at[:4, small], most):
                near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                if group is not None:
                    near &= group[i] != group[j]
                if near.any():
                    yield i[near], j[near]
            at = at[:, ~small]
        if bit < 0 or not at.shape[1]:
            continue
        if at.shape[1] > most:
            half = at.shape[1] // 2
            todo += [(bit, at[:, :half]), (bit, at[:, half:])]
            continue
        a_mid, b_mid = (at[h] - (ones[bit][at[h]] - ones[bit][at[h - 1]]) for h in (1, 3))
        own = (at[0] == at[2]) & (at[1] == at[3])
        zero = np.stack([at[0], a_mid, at[2], b_mid, at[4]])
        one = np.stack([a_mid, at[1], b_mid, at[3], at[4]])
        up = np.stack([at[0], a_mid, b_mid, at[3], at[4] + 1])
        down = np.stack([a_mid, at[1], at[2], b_mid, at[4] + 1])[:, ~own]
        at = np.concatenate([zero, one, up, down], axis=1)
        todo.append((bit - 1, at[:, (at[0] < at[1]) & (at[2] < at[3]) & (at[4] <= budget)]))


def stars(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the links a-b into root, in place: the least index of each node's component so far."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root[:] = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]


def whole_runs(batches, n_columns: int, n_keys: int):
    """Rows of longs, sorted by their first n_keys columns, in tables that never cut a run of equal keys."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_columns)], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        if (rows[-1, :n_keys] == held[0][0, :n_keys]).all():
            continue  # the run goes on
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[:, :n_keys] == rows[-1, :n_keys]).all(1))[0]
        held = [rows[last:]]
        yield rows[:last]
    if held:
        yield np.concatenate(held)


def runs_in(rows: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of several rows."""
    new = np.flatnonzero(np.concatenate([[True], (rows[1:, :n_keys] != rows[:-1, :n_keys]).any(1)]))
    ends = np.append(new[1:], len(rows))
    many = ends - new > 1
    return new[many], ends[many]


def _forest(bits: int):
    def run(batches):
        """Rows (deal, block, rest, fp) sorted by deal, block, rest: each linked fp with the least one of its local component."""
        for rows in whole_runs(batches, 4, 2):
            root = np.arange(len(rows))
            for a, b in trie_links(rows[:, 2].astype(np.uint64), *runs_in(rows, 2), bits, BUDGET):
                stars(root, a, b)
            at = np.flatnonzero(root != np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(rows[at, 3]), pa.array(rows[root[at], 3])], ["a", "b"])

    return run


def _dealt(word, width: int) -> list:
    """Six structs (deal, block, rest) of a word of four blocks of `width` bits: two blocks in front, two behind."""
    part = [F.shiftrightunsigned(word, width * (3 - i)).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]
    out = []
    for deal, (i, j) in enumerate(PAIRS):
        k, m = (x for x in range(4) if x not in (i, j))
        out.append(F.struct(F.lit(deal).alias("deal"), (part[i] * (1 << width) + part[j]).alias("block"), (part[k] * (1 << width) + part[m]).alias("rest")))
    return out


def links(fps: DataFrame, owner: str, heavy: int = HEAVY) -> DataFrame:
    """(a, b): a forest that joins all distinct fingerprints within BUDGET bits, transitively.

    Each of six bit orders puts another pair of 16-bit blocks first; every link has an order in which those 32 bits agree.
    So each order's trie is cut at depth 32, where the nodes are dealt out by their path, and the node pairs below a
    cut, a node with itself, are traversed with the whole budget. A node of more than `heavy` fingerprints is cut again in
    the same way at depth 48, below which no more than 65,536 can differ, so no task holds more than that of one node."""
    rows = saved(fps.select("fp", F.explode(F.array(*_dealt("fp", 16))).alias("d")).select("d.deal", "d.block", "d.rest", "fp"), owner, "dealt")
    at = ["deal", "block"]
    large = rows.groupBy(*at).count().where(F.col("count") > heavy).select(*at)
    again = rows.join(large, at).select("fp", "deal", "block", F.explode(F.array(*_dealt("rest", 8))).alias("d"))
    again = again.select((F.col("deal") * 6 + F.col("d.deal")).alias("deal"), (F.col("block") * 65536 + F.col("d.block")).alias("block"), "d.rest", "fp")

    def walked(some, bits):
        return some.repartition(*at).sortWithinPartitions(*at, "rest").mapInArrow(_forest(bits), "a long, b long")

    return walked(rows.join(large, at, "left_anti").select(*at, "rest", "fp"), 32).union(walked(again.select(*at, "rest", "fp"), 16))


def near_duplicates(docs: DataFrame, owner: str = "simhash", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of each row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay. Null ids are never a
    component's least unless it has no other. Exact copies meet in one fingerprint before any join, so a group of copies
    costs one row. An empty table gives an empty result."""
    prepare(docs.sparkSession)
    raw = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()
    rows = saved(raw.mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), owner, "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), owner, "classes")
    roots = components(links(classes, owner), owner)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


