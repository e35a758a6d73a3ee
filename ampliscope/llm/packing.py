"""Mixture-controlled packing: deficit round-robin over source queues.

A queue holds the token stream of one source, cut into units. A window has room for WINDOW // UNIT units. In each round a
queue earns its target share and sends a unit when that is its due; what it is short of or ahead stays as its deficit.
The unit k of queue s is due at (k + 1/2) / weight(s), so the deficits before any window follow from the due times alone:
a unit's place is the number of units due before it, over all queues. Each task therefore knows the deficits that earlier
windows and other partitions left, and no task waits for another. An emptied queue stops sending and the others fill up."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, prepare, saved, text_bytes

WINDOW = 4096
UNIT = 128
END = 2
MAX_QUEUES = 256
CACHE_BYTES = 90 << 20  # of words, in each of two generations

_PLAIN = re.compile("[!-~¡-¬®-˿]+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_loaded: dict[str, Words] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of the tokenizer: printable Latin-1 for itself, other bytes from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of a text, word by word, with a bounded memory of words seen.

    The tokenizer never joins characters across white space, so a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.seen: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.room = CACHE_BYTES

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def part(self, s: str) -> bytes:
        """Ids of one lower-case run of letters, one digit or one run of symbols."""
        letters = s if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(letters)])

    def word(self, w: bytes) -> bytes:
        s = w.decode("utf-8", "replace")
        if not (len(s) < 1000 and _PLAIN.fullmatch(s)) or "<|" in s and _SPECIAL.search(s) or "İ" in s:
            return self.packed(self.whole.encode(s, add_special_tokens=False).ids)
        s = s.lower()
        if s.isalpha():
            return self.part(s)
        if s[:-1].isalpha():
            return self.known(s[:-1]) + self.known(s[-1])
        return b"".join(map(self.known, _WORDS.findall(s)))

    def known(self, s: str) -> bytes:
        """The ids of a part, which may have been met as a word."""
        w = s.encode()
        got = self.seen.get(w)
        if got is None:
            got = self.seen[w] = self.old.get(w) or self.part(s)
            self.room -= len(w) + len(got) + 200
        return got

    def ids(self, text: bytes) -> bytes:
        out = []
        for piece in pieces_of(text):
            words = piece.split()
            seen, old = self.seen, self.old
            for w in set(words).difference(seen):
                got = old.get(w) or self.word(w)
                seen[w] = got
                self.room -= len(w) + len(got) + 200
            out.append(b"".join(map(seen.__getitem__, words)))
            if self.room < 0:
                self.seen, self.old, self.room = {}, self.seen, CACHE_BYTES
        return b"".join(out)


def words(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def places(queue: np.ndarray, unit: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The place of each (queue, unit) among all units by (due time, queue, unit). sizes: units of each queue."""
    due = (unit + 0.5) / weights[queue]
    place = np.zeros(len(unit), np.int64)
    for s, (size, weight) in enumerate(zip(sizes.tolist(), weights.tolist())):
        k = np.floor(due * weight + 0.5).astype(np.int64)
        before, upto = k - 2, k - 2  # units due earlier than, and not later than, the given one
        for d in range(-2, 3):
            t = (k + d + 0.5) / weight
            before = np.where(t < due, k + d + 1, before)
            upto = np.where(t <= due, k + d + 1, upto)
        before, upto = np.clip(before, 0, size), np.clip(upto, 0, size)
        place += np.where(queue < s, before, np.where(queue > s, upto, unit))
    return place


def laid_out(queue, start, n, sizes, tokens, weights, window: int = WINDOW, unit: int = UNIT):
    """Pieces of documents that begin at start in their queue's stream and have n tokens: (document, start within it, length, window, offset)."""
    first, last = start // unit, (start + n - 1) // unit
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    place = places(queue[doc], k, sizes, weights)
    lo, hi = np.maximum(k * unit, start[doc]), np.minimum((k + 1) * unit, (start + n)[doc])
    per = window // unit
    at, offset = place // per, place % per * unit + lo - k * unit
    for s in range(len(sizes)):  # the last unit of a queue may be short: what follows in that window moves up
        if short := int(sizes[s] * unit - tokens[s]):
            p = places(np.array([s]), sizes[s : s + 1] - 1, sizes, weights)[0]
            offset -= np.where((at == p // per) & (place > p), short, 0)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)
    i = np.flatnonzero(new)
    ends = np.append(i[1:], len(doc)) - 1 if len(i) else i
    return doc[i], (lo - start[doc])[i], hi[ends] - lo[i], at[i], offset[i]


def targets(mass: dict, shares: dict[str, float] | None) -> dict:
    """The target share of each queue: as given, and what is left for the others in proportion to their mass.

    A share of a source that is not there, or has ended, falls to the others. Shares above 1 in all are refused."""
    shares = shares or {}
    if sum(shares.values()) > 1 + 1e-9 or any(x < 0 for x in shares.values()):
        raise ValueError("shares must not be negative, nor above 1 in all")
    total = sum(x for s, x in mass.items() if s not in shares) or 1.0
    left = max(0.0, 1 - sum(shares.values()))
    return {s: max(shares[s] if s in shares else left * x / total, 1e-12) for s, x in mass.items()}


def packed(docs: DataFrame, path: str, owner: str = "packing", key: str = "doc_id", text: str = "text", source: str = "source", shares: dict[str, float] | None = None, power: float = 1.0, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document is the ids of its text (null: empty) and END. Windows hold the targets' proportions (see targets(): a source's mass is its tokens to the power; without shares and with
    power 1 the sources' own shares, so that all queues end together) as long as sources last. Null sources count as ''. Sources with a share
    and the largest others, max_queues - 1 in all unless more have shares, have queues of their own; the others' units are dealt into one
    more queue by due times among themselves, so that they keep their proportions too. Repeated rows are packed as they come. An empty
    table gives an empty result; a very long text is one row of ids, cut unit by unit."""
    spark = docs.sparkSession
    prepare(spark)
    raw = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    kind = raw.schema["doc_id"].dataType.simpleString()

    def tokens_of(batches):
        tok, part, ends = words(path), TaskContext.get().partitionId(), {}
        stop = tok.packed([END])
        for batch in batches:
            ids = [tok.ids(t) + stop for t in batch.column(1).to_pylist()]
            n = [len(x) // tok.kind.itemsize for x in ids]
            starts = []
            for s, m in zip(batch.column(2).to_pylist(), n):
                starts.append(ends.get(s, 0))
                ends[s] = starts[-1] + m
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column(0), batch.column(2), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "source", "start", "n", "ids"])

    rows = saved(raw.mapInArrow(tokens_of, f"part int, doc_id {kind}, source string, start long, n long, ids binary"), owner, "tokens")
    sums = saved(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), owner, "sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    own = max(max_queues - 1, len(shares or []))
    top = [(r["source"], r["n"]) for r in by_source.orderBy(F.desc(F.col("source").isin(list(shares or []))), F.desc("n"), "source").limit(own).collect()]
    rest = by_source.join(F.broadcast(spark.createDataFrame([(s,) for s, _ in top], "source string")), "source", "left_anti")  # top: max_queues rows
    left, mass = rest.agg(F.sum("n"), F.sum(F.pow("n", F.lit(power)))).first()
    goal = targets({s: float(n) ** power for s, n in top} | {None: mass or 0.0}, shares)
    tokens = np.array([n for _, n in top] + [left or 0], np.int64)
    sizes = -(-tokens // UNIT)
    weights = np.array([goal[s] for s, _ in top] + [goal[None]])
    queues = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(top)], "source string, queue int")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(queues), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(top)))).select("part", "source", "queue", "base")
    if sums.count() <= 100_000:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, ["part", "source"]).withColumn("start", F.col("start") + F.col("base"))
    whole = placed.where(F.col("queue") < len(top)).select("doc_id", "source", "queue", "start", "n", F.lit(0).cast("long").alias("at"), F.col("n").alias("doc_tokens"), "ids")
    if left:
        whole = whole.unionByName(_interleaved(placed.where(F.col("queue") == len(top)), len(top), rest, power, path, owner, kind))
    wide = np.dtype("<u4")

    def cut(batches):
        narrow = words(path).kind
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            queue, start, n, at, all_ = (col[f].to_numpy(zero_copy_only=False).astype(np.int64) for f in ("queue", "start", "n", "at", "doc_tokens"))
            doc, lo, length, window, offset = laid_out(queue, start, n, sizes, tokens, weights)
            ids, crc, old, now = col["ids"], np.empty(len(doc), np.int64), -1, b""
            for i, (d, s, m) in enumerate(zip(doc.tolist(), lo.tolist(), length.tolist())):
                if d != old:
                    old, now = d, np.frombuffer(ids[d].as_py(), narrow).astype(wide).tobytes()
                crc[i] = zlib.crc32(now[4 * s : 4 * (s + m)])
            pick = pa.array(doc)
            columns = [col["doc_id"].take(pick), *map(pa.array, (lo + at[doc], length, crc, all_[doc], window, offset)), col["source"].take(pick)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return whole.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def _interleaved(placed: DataFrame, queue: int, sizes: DataFrame, power: float, path: str, owner: str, kind: str) -> DataFrame:
    """The documents of sources that share a queue, cut into their sources' units, with their start in the queue: units by due time, then source.

    Units are dealt by ranges of due times, so no task holds the queue; the starts of the ranges are sums of their tokens."""

    def units(batches):
        width = words(path).kind.itemsize
        for batch in batches:
            doc_id, source, start, n, tokens, ids = (batch.column(i).to_pylist() for i in range(6))
            out = []
            for d, s, a, m, t, raw in zip(doc_id, source, start, n, tokens, ids):
                at = 0
                while at < m:
                    unit = (a + at) // UNIT
                    end = min(m, (unit + 1) * UNIT - a)
                    out.append((d, s, (unit + 0.5) / t**power, a + at, end - at, at, m, raw[at * width : end * width]))
                    at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _unit_schema(batch))], schema=_unit_schema(batch))

    def _unit_schema(batch):
        return pa.schema([("doc_id", batch.column(0).type), ("source", pa.string()), ("due", pa.float64()), ("s", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    named = placed.join(sizes.withColumnRenamed("n", "tokens"), "source").select("doc_id", "source", "start", "n", "tokens", "ids")
    cut = named.mapInArrow(units, f"doc_id {kind}, source string, due double, s long, n long, at long, doc_tokens long, ids binary")
    order = [F.col("due"), F.col("source"), F.col("s")]
    parts = saved(cut.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), owner, "units")
    begin, starts = 0, []
    for r in sorted(parts.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row a partition
        starts.append((r["part"], begin))
        begin += r["n"]
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(parts.sparkSession.createDataFrame(starts, "part int, base long"))  # a row a partition
    rows = parts.withColumn("start", F.coalesce(F.sum("n").over(here), F.lit(0))).join(bases, "part").withColumn("start", F.col("start") + F.col("base"))
    return rows.withColumn("queue", F.lit(queue)).select("doc_id", "source", "queue", "start", "n", "at", "doc_tokens", "ids")
