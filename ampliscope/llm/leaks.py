"""Benchmark decontamination: an FM-index of each shard of training text, searched backwards for the benchmark's phrases.

A phrase is a window of consecutive item words. Documents never move: each task indexes its own shards and searches all
phrases in them, a block of the benchmark at a time. A word that the block does not hold parts the text, and a stretch between
two such words that is shorter than the shortest phrase holds no occurrence, so neither is put into the index."""

from __future__ import annotations

import re
from itertools import count, repeat
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lowered_words, own_columns, prepare, saved, text_bytes, LOWERED

SIZE = 10
SHARD_WORDS = 4 << 20  # words of training text behind one index
BLOCK_BYTES = 8 << 20  # of benchmark words that tasks hold at a time
PIECE_WORDS = 1 << 14  # a longer item is searched in pieces that overlap
SAMPLE = 8  # every so many positions of a stretch are stored
_AT_ONCE = 1 << 18


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.pad(bits, (0, 64 - len(bits) % 64)), bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class Wavelet:
    """A wavelet tree over symbols, its nodes of one depth side by side in one bit vector."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for b in reversed(range(max(1, int(top).bit_length()))):
            bits = (symbols >> b & 1).astype(bool)
            self.levels.append((b, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before i."""
        start = np.zeros_like(i)
        for b, bits, zeros in self.levels:
            right = (symbol >> b & 1).astype(bool)
            i, start = (np.where(right, zeros + ones, x - ones) for x, ones in ((i, bits.rank(i)), (start, bits.rank(start))))
        return i - start

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it occurs before."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for b, bits, zeros in self.levels:
            right = bits.at(i)
            symbol |= right.astype(np.int64) << b
            i, start = (np.where(right, zeros + ones, x - ones) for x, ones in ((i, bits.rank(i)), (start, bits.rank(start))))
        return symbol, i - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of text, in which each 0 ends a stretch and zeros rank by position.

    Sorts by as many symbols as fit in 63 bits, then doubles the length, for suffixes that are still alike only."""
    n, bits = len(text), max(1, int(text.max(initial=0)).bit_length())
    reach = 63 // bits
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    padded = np.concatenate([text.astype(np.int64), np.zeros(reach, np.int64)])
    for k in range(reach):
        now = padded[k : k + n]
        key = key << bits | np.where(ended, 0, now)
        ended |= now == 0
    order = np.argsort(key, kind="stable")
    sorted_key, alone = key[order], ended[order]
    first = np.ones(n, bool)
    first[1:] = (sorted_key[1:] != sorted_key[:-1]) | alone[1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = np.flatnonzero(~first | ~np.append(first[1:], True))
    while len(open_):
        p = order[open_]
        key = rank[p] * n + rank[p + reach]
        turn = np.argsort(key, kind="stable")
        order[open_] = p = p[turn]
        key = key[turn]
        first = np.ones(len(p), bool)
        first[1:] = key[1:] != key[:-1]
        rank[p] = open_[np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))]
        open_ = open_[~first | ~np.append(first[1:], True)]
        reach *= 2
    return order


class Index:
    """An FM-index of stretches of symbols from 1 on, each ended by a 0."""

    def __init__(self, text: np.ndarray):
        top = int(text.max(initial=0))
        order = suffix_order(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.before = Wavelet(text[order - 1], top)
        places = np.arange(len(text))
        starts = np.maximum.accumulate(np.where(np.append(True, text[:-1] == 0), places, 0))
        stored = (places - starts) % SAMPLE == 0
        self.stored = Bits(stored[order])
        self.positions = order[stored[order]]
        self.top, self.size = top, len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the range of suffixes that begin with it."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        hi[phrases.max(1, initial=0) > self.top] = 0
        live = np.flatnonzero(hi)
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k].astype(np.int64)
            ranks = self.before.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[symbol] + ranks[: len(live)], self.first[symbol] + ranks[len(live) :]
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each of these suffixes: steps back to a stored one are counted."""
        out, open_, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            done = self.stored.at(rows)
            out[open_[done]] = self.positions[self.stored.rank(rows[done])] + steps
            open_, rows, steps = open_[~done], rows[~done], steps + 1
            symbol, rank = self.before.at(rows)
            rows = self.first[symbol] + rank
        return out


class Phrases:
    """A block of the benchmark: its words by number from 1 on, and its windows by length."""

    def __init__(self, rows: list[tuple[str, bytes]], size: int):
        ids, names = defaultdict(count(1).__next__), defaultdict(count().__next__)
        words, starts, lengths, items, end = [], [], [], [], 0
        for item, text in rows:
            here = [ids[w] for w in text.split()]
            n = max(1, len(here) - size + 1)
            words += here
            starts.append(np.arange(end, end + n))
            lengths.append(np.full(n, min(size, len(here))))
            items.append(np.full(n, names[item]))
            end += len(here)
        self.ids, self.names = dict(ids), list(names)
        self.words = np.array(words, np.int32)
        self.starts, self.lengths, self.items = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, items))
        self.shortest = int(self.lengths.min(initial=size))

    def windows(self):
        """(phrases as rows of one length, their items), a bounded number at a time."""
        for m in np.unique(self.lengths).tolist():
            at = np.flatnonzero(self.lengths == m)
            for k in range(0, len(at), _AT_ONCE):
                part = at[k : k + _AT_ONCE]
                yield self.words[self.starts[part][:, None] + np.arange(m)], self.items[part]


def found_in(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text its number of words, the merged spans of words in an occurrence, and the items that occur."""
    parts, sizes = [], []
    for text in texts:
        n = 0
        for words in lowered_words(text):
            parts.append(np.fromiter(map(phrases.ids.get, words, repeat(0)), np.int32, len(words)))
            n += len(words)
        sizes.append(n)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    ends = np.cumsum(sizes, dtype=np.int64)
    known = ids > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    begins = (ends - sizes)[np.array(sizes) > 0] if sizes else np.zeros(0, np.int64)
    opens[begins] = known[begins]
    stretch = np.cumsum(opens) - 1
    long_ = np.bincount(stretch[known], minlength=int(opens.sum())) >= phrases.shortest
    origin = np.flatnonzero(known)
    origin = origin[long_[stretch[origin]]]
    change = np.zeros(len(ids) + 1, np.int64)
    pairs = []
    if len(origin):
        place = np.arange(len(origin)) + np.cumsum(opens[origin]) - 1
        text, word = np.zeros(int(place[-1]) + 2, np.int64), np.zeros(int(place[-1]) + 2, np.int64)
        text[place], word[place] = ids[origin], origin
        index = Index(text)
        for windows, items in phrases.windows():
            lo, hi = index.search(windows)
            at = np.flatnonzero(hi > lo)
            total = np.cumsum(hi[at] - lo[at])
            for k in range(0, int(total[-1]) if len(at) else 0, _AT_ONCE):  # a common phrase is located in parts
                row = np.arange(k, min(k + _AT_ONCE, int(total[-1])))
                which = np.searchsorted(total, row, side="right")
                start = word[index.locate(hi[at][which] - (total[which] - row))]
                change += np.bincount(start, minlength=len(change)) - np.bincount(start + windows.shape[1], minlength=len(change))
                pairs.append(np.unique(np.searchsorted(ends, start, side="right") * len(phrases.names) + items[at][which]))
    hit = np.cumsum(change[:-1]) > 0
    fresh = hit.copy()
    fresh[1:] &= ~hit[:-1]
    fresh[begins] = hit[begins]
    froms = np.flatnonzero(fresh)
    doc = np.searchsorted(ends, froms, side="right")
    misses = np.append(np.flatnonzero(~hit), len(hit))
    tos = np.minimum(misses[np.searchsorted(misses, froms)], ends[doc])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b, d in zip(froms.tolist(), tos.tolist(), doc.tolist()):
        base = int(ends[d]) - sizes[d]
        spans[d].append((a - base, b - base))
    items_: list[list[str]] = [[] for _ in texts]
    for x in (np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)).tolist():
        items_[x // len(phrases.names)].append(phrases.names[x % len(phrases.names)])
    return list(zip(sizes, spans, items_))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _searcher(held):
    """A mapInArrow function over a column that goes through and the text."""

    def search(batches):
        phrases = held.value

        def shard(parts):
            texts = [t for p in parts for t in p.column(1).to_pylist()]
            found = found_in(texts, phrases)
            kept = pa.concat_arrays([p.column(0) for p in parts])
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], _SPAN)
            columns = [kept, pa.array([n for n, _, _ in found], pa.int64()), spans, pa.array([i for _, _, i in found], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, [parts[0].schema.names[0], "n_words", "spans", "items"])

        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.column(1).nbytes
            if size > 5 * SHARD_WORDS:
                yield shard(parts)
                parts, size = [], 0
        if parts:
            yield shard(parts)

    return search


def _pieces(size: int):
    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for part in lowered_words(text) for w in part]
                rows = [(item, b" ".join(words[k : k + PIECE_WORDS + size - 1])) for k in range(0, max(1, len(words) - size + 1), PIECE_WORDS)] if words else []
                for k in range(0, len(rows), 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 16]), (pa.string(), pa.binary()))], ["item", "words"])

    return cut


def contaminated(docs: DataFrame, benchmark: DataFrame, owner: str = "leaks", size: int = SIZE, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (merged ranges of words, end exclusive, that lie in an occurrence of a phrase) and items (whose phrases occur, as strings).

    Own columns come through, but for ones of these three names. Null and empty texts have no words. A null item id counts as ''; items
    that share an id are one item with the phrases of all; an item without words has no phrase. Repeated rows are each searched.
    An empty table gives an empty result, an empty benchmark no spans. A very long text is one shard; a word of any length is one symbol."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.struct(*own_columns(docs.drop("n_words", "spans", "items"))).alias("own"), text_bytes(text).alias("text"))
    asked = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), text_bytes(item_text).alias("text"))
    pieces = saved(asked.mapInArrow(_pieces(size), "item string, words binary").distinct(), owner, "phrases")
    total = pieces.agg(F.sum(F.length("words") + F.length("item"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), owner, "docs")
    kept = "row" if blocks > 1 else "own"
    schema = StructType([rows.schema[kept], *StructType.fromDDL("n_words long, spans array<struct<start:long,end:long>>, items array<string>")])
    parts = []
    for b in range(blocks):  # the driver holds one block at a time
        here = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else pieces
        held = spark.sparkContext.broadcast(Phrases([tuple(r) for r in here.collect()], size))
        found = rows.select(kept, "text").mapInArrow(_searcher(held), schema)
        if blocks == 1:
            return found.select("own.*", "n_words", "spans", "items")
        parts.append(saved(found, owner, f"block{b}"))
    every = parts[0]
    for other in parts[1:]:
        every = every.union(other)
    merged = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)"), _join_span)
    return rows.select("row", "own").join(merged.withColumn("spans", joined), "row").select("own.*", "n_words", "spans", "items")


def _join_span(done, span):
    last = F.element_at(done, -1)
    longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
    return F.when((F.size(done) > 0) & (last["end"] >= span["start"]), longer).otherwise(F.concat(done, F.array(span)))


def _cut(batches):
    word = re.compile(rb"[^ ]+")
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, spans in enumerate(batch.column(2).to_pylist()):
            if spans:
                raw, left, out = texts[i].encode(), 0, []
                words = [m.span() for m in word.finditer(raw.translate(LOWERED))]
                for s in spans:
                    out.append(raw[left : words[s["start"]][0]])
                    left = words[s["end"] - 1][1]
                texts[i] = b"".join([*out, raw[left:]]).decode()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(1).type)], ["own", "text"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, owner: str = "leaks", text: str = "text", **how) -> DataFrame:
    """docs with the spans that contaminated() finds cut out of the text, each from the first byte of its first word to the last of its last.

    All columns come through as they are; null texts stay null. All else is as there."""
    packed = docs.select(F.struct(*own_columns(docs)).alias("own"), F.col(text).cast("string").alias("text"))
    found = contaminated(packed, benchmark, owner, **how).select("own", "text", "spans")
    out = found.mapInArrow(_cut, found.drop("spans").schema)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns))
