"""Exact removal of repeated byte strings by hash grouping over content-defined anchors.

A window of LENGTH bytes is repeated if the same bytes start anywhere else. This is not a suffix array: a difference cover was
measured to need many times the disk allowed (README). Equality is that of 128-bit hashes.

1. Anchors. A window is represented by its leftmost least GRAM-byte hash (a string synchronising set): equal windows have
   equal anchors at equal shifts. Anchors whose gram occurs once end there.
2. Contexts. The whole context of an anchor (all windows that it represents) gets a name. A name that occurs twice settles
   all its windows at once; contexts of a gram with one single name need no finer look.
3. Cells. For grams with several names, one copy per name goes on, in cells of CELL neighbouring shifts. A cell whose core (what
   its windows share) occurs once has no repeated window; one whose whole occurs twice has only such.
4. Windows. What is left of the cells is named window by window; names that occur twice are repeated.
   The union of repeated windows is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed_schema, own_columns, prepare, saved, text_bytes

LENGTH = 200
GRAM = 32
BLOCK = 1 << 18
CELL = 24
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of data[i:i+gram] for each i, by doubling; gram is a power of two."""
    h, base, size = _TABLE[data], np.uint64(0x9E3779B97F4A7C15), 1
    while size < gram:
        h = h[:-size] * base + h[size:]
        with np.errstate(over="ignore"):
            base = base * base
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size, n = 1, len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, gram hash, anchor, first window, last window) as arrays, positions within data; a run of windows with one anchor is a row.

    data holds the documents back to back; offsets has their bounds."""
    found = []
    for s in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[s : s + BLOCK + length - 1]
        n = len(part) - length + 1
        if n < 1:
            break
        h = _gram_hashes(part, gram)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_least(key, length - gram + 1)[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lo, hi = np.searchsorted(offsets, s, "right") - 1, np.searchsorted(offsets, s + n, "left")
        bounds = np.clip(offsets[lo : hi + 1] - s, 0, n)
        doc = np.repeat(np.arange(lo, lo + len(bounds) - 1), np.diff(bounds))
        start = np.arange(n)
        ok = np.flatnonzero(start + length <= offsets[doc + 1] - s)
        if not len(ok):
            continue
        a, d = at[ok], doc[ok]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ok)) - 1
        found.append((d[first], h[a[first]], a[first] + s, ok[first] + s, ok[last] + s))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*found)))


def _two(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (column.buffers()[2].to_pybytes() if column.buffers()[2] else b"")[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sampled(batches):
    name = xxhash.xxh3_128_digest
    for batch in batches:
        if not batch.num_rows:
            continue
        text, offsets = _joined(batch.column(2))
        doc, gram, at, first, last = anchors(np.frombuffer(text, np.uint8), offsets)
        seeds = (at - first) << 16 | (last - first)
        c1, c2 = _two([name(text[f : l + LENGTH], s) for f, l, s in zip(first.tolist(), last.tolist(), seeds.tolist())])
        keys = [batch.column(i).to_numpy()[doc] for i in (0, 1)]
        arrays = [*map(pa.array, keys), pa.array(gram.view(np.int64)), c1, c2, pa.array(first - offsets[doc]), pa.array((last - first).astype(np.int32)), pa.array((at - first).astype(np.int32))]
        rows = pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "gram", "c1", "c2", "start", "more", "lead"])
        for i in range(0, rows.num_rows, 50_000):
            yield rows.slice(i, 50_000)


def _contexts(batches):
    """The bytes of each wanted context, cut out of its document."""
    for batch in batches:
        for k1, k2, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for i in range(0, len(spans), 10_000):
                part = spans[i : i + 10_000]
                arrays = [pa.array([k1] * len(part), pa.int64()), pa.array([k2] * len(part), pa.int64())]
                arrays += [pa.array([x[f] for x in part], t) for f, t in (("start", pa.int64()), ("more", pa.int32()), ("lead", pa.int32()), ("gram", pa.int64()), ("once", pa.bool_()))]
                arrays.append(pa.array([text[x["start"] : x["start"] + x["more"] + LENGTH] for x in part], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "start", "more", "lead", "gram", "once", "bytes"])


def _cells(batches):
    """The windows of a context in cells of CELL shifts against the anchor: a name for what all windows of the cell share
    (core) and one for all that the context's windows in the cell cover (union)."""
    name = xxhash.xxh3_128_digest
    for batch in batches:
        place, cores, unions, starts, more = [], [], [], [], []
        for i, (start, most, lead, gram, text) in enumerate(zip(*(batch.column(f).to_pylist() for f in ("start", "more", "lead", "gram", "bytes")))):
            seed = gram & 0xFFFFFFFFFFFFFFFF
            for cell in range((lead - most) // CELL, lead // CELL + 1):
                near, far = cell * CELL, cell * CELL + CELL - 1  # shifts of the cell; a window begins `shift` bytes before the anchor
                first, last = max(0, lead - far), min(most, lead - near)
                cores.append(name(text[lead - near : lead - far + LENGTH] + bytes([cell]), seed))
                unions.append(name(text[first : last + LENGTH] + bytes([cell, last - first, far - lead + first]), seed))
                place.append(i)
                starts.append(start + first)
                more.append(last - first)
        p1, p2 = _two(cores)
        u1, u2 = _two(unions)
        pick = pa.array(place, pa.int64())
        arrays = [*(batch.column(f).take(pick) for f in ("k1", "k2", "start", "once")), p1, p2, u1, u2, pa.array(starts, pa.int64()), pa.array(more, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "context", "once", "p1", "p2", "u1", "u2", "start", "more"])


def _windows(batches):
    """A name for each window of the wanted cells."""
    name = xxhash.xxh3_128_digest
    for batch in batches:
        place, names, starts = [], [], []
        for i, (context, start, more, text) in enumerate(zip(*(batch.column(f).to_pylist() for f in ("context", "start", "more", "bytes")))):
            for s in range(start, start + more + 1):
                names.append(name(text[s - context : s - context + LENGTH]))
                starts.append(s)
                place.append(i)
        w1, w2 = _two(names)
        pick = pa.array(place, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(f).take(pick) for f in ("k1", "k2", "once")), w1, w2, pa.array(starts, pa.int64())], ["k1", "k2", "once", "w1", "w2", "start"])


def cover(spans: list[tuple[int, int]], length: int = LENGTH) -> list[list[int]]:
    """Maximal runs [start, end) covered by windows that start in [start, start + more]."""
    runs: list[list[int]] = []
    for start, more in sorted(spans):
        end = start + more + length
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs


def _kept(batches):
    for batch in batches:
        rest, removed, counts = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            runs = cover([(s["start"], s["more"]) for s in spans or ()])
            ends = [0, *(e for _, e in runs)]
            starts = [*(s for s, _ in runs), len(text)]
            rest.append(b"".join(text[a:b] for a, b in zip(ends, starts)))
            removed.append(len(text) - len(rest[-1]))
            counts.append(len(runs))
        n = [len(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "rest"])


def _mixed(rows: DataFrame, by: list[str], names: list[str], n: str = "n > 1") -> DataFrame:
    """The groups of `by` with several rows, and whether these have several names."""
    ends = [f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]
    same = F.expr(" and ".join(f"lo_{c} = hi_{c}" for c in names))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *ends).where(n).select(*by, (~same).alias("mixed"))


def _spans(raw: DataFrame, owner: str) -> DataFrame:
    """(k1, k2, spans): the repeated windows of each document that has any, as starts and numbers of further starts."""
    span = ["k1", "k2", "start", "more"]
    rows = saved(raw.mapInArrow(_sampled, "k1 long, k2 long, gram long, c1 long, c2 long, start long, more int, lead int"), owner, "anchors")
    grams = saved(_mixed(rows, ["gram"], ["c1", "c2"]), owner, "grams")  # saved, so that the join may split a hot gram
    again = saved(rows.join(grams, "gram"), owner, "repeated")
    discard(raw.sparkSession, owner, "anchors")
    discard(raw.sparkSession, owner, "grams")
    whole, mixed = again.where("not mixed").select(*span), again.where("mixed")
    names = saved(mixed.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*span, "lead")).alias("at")), owner, "names")
    twice = mixed.join(names.where("n > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi").select(*span)
    wanted = names.select("at.*", "gram", (F.col("n") == 1).alias("once")).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "more", "lead", "gram", "once")).alias("spans"))
    # A repeated row brings its contexts again, but these all occur twice and are settled: they only serve as partners.
    texts = raw.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(_contexts, "k1 long, k2 long, start long, more int, lead int, gram long, once boolean, bytes binary")
    contexts = saved(texts, owner, "contexts")
    cells = saved(contexts.mapInArrow(_cells, "k1 long, k2 long, context long, once boolean, p1 long, p2 long, u1 long, u2 long, start long, more int"), owner, "cells")
    open_ = saved(cells.join(_mixed(cells, ["p1", "p2"], ["u1", "u2"]), ["p1", "p2"]), owner, "open")
    discard(raw.sparkSession, owner, "cells")
    place = F.struct("k1", "k2", "context", "start", "more", "once")
    unions = saved(open_.groupBy("p1", "p2", "u1", "u2").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(place).alias("at")), owner, "unions")
    shared = unions.where("n > 1").select("p1", "p2", "u1", "u2")
    cellwise = open_.where("once").join(shared, ["p1", "p2", "u1", "u2"], "left_semi").select(*span)
    left = unions.where("mixed").select("at.k1", "at.k2", "at.context", "at.start", "at.more", (F.col("at.once") & (F.col("n") == 1)).alias("once"))
    source = contexts.dropDuplicates(["k1", "k2", "start"]).select("k1", "k2", F.col("start").alias("context"), "bytes")
    windows = saved(left.join(source, ["k1", "k2", "context"]).mapInArrow(_windows, "k1 long, k2 long, once boolean, w1 long, w2 long, start long"), owner, "windows")
    equal = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    single = windows.where("once").join(equal, ["w1", "w2"], "left_semi").select("k1", "k2", "start", F.lit(0).alias("more"))
    found = whole.unionByName(twice).unionByName(cellwise).unionByName(single)
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "more")).alias("spans"))


def without_repeats(docs: DataFrame, owner: str = "suffix", key: str = "doc_id", text: str = "text", ident: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and rest (the kept bytes) of each row.

    Null texts count as empty; texts under 200 bytes keep all. A repeated row is a document of its own, so all of its windows
    repeat. Matches never cross documents. An empty table gives an empty result."""
    prepare(docs.sparkSession)
    ident = ident or key
    names = (F.xxhash64(ident, text).alias("k1"), F.xxhash64(text, ident).alias("k2"))
    raw = docs.select(*names, F.col(key).alias("doc_id"), text_bytes(text).alias("text"))
    spans = _spans(raw.select("k1", "k2", "text"), owner)
    both = raw.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_kept, keyed_schema(raw, "doc_id", "n_bytes long, n_removed long, n_spans long, rest binary"))


def deduplicated(docs: DataFrame, owner: str = "suffix") -> DataFrame:
    """The rows of docs with repeated strings removed from text and n_chars renewed. A cut inside a character leaves U+FFFD for its torn bytes.

    Null texts stay null. A repeated row repeats all of its windows, so its text empties if it has LENGTH bytes or more. An
    empty table gives an empty result."""
    prepare(docs.sparkSession)
    rest = F.struct(*own_columns(docs, "text", "n_chars")).alias("rest")
    whole = docs.select(F.struct(F.col("text").isNull().alias("none"), rest).alias("row"), F.col("doc_id").alias("ident"), "text")
    cut = without_repeats(whole, owner, key="row", ident="ident")
    text = F.when(~F.col("doc_id.none"), F.expr("make_valid_utf8(cast(rest as string))"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(new[c].alias(c) if c in new else F.col("doc_id.rest")[c].alias(c) for c in docs.columns))
