"""SentencePiece encoding and decoding by a batched Viterbi pass over words of equal length."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

SPACE = "▁"
CACHE = 400_000
#: Characters of a piece of work of a long word, and those that it shares with the one before.
CHUNK, OVERLAP = 2048, 256
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]*")
_loaded: dict[str, Pieces] = {}


class Pieces:
    """Pieces of a BPE model as sorted hash keys, with the merge that makes each.

    A text gets a dummy space in front, spaces become U+2581, and words begin at runs of these. The library merges the best
    ranked neighbours first. The same ids come from a Viterbi pass: a path may go on from one piece to the next only if merging
    would leave these two neighbours apart, and then exactly one piece can end at each place. Ranks: single characters first, then
    pieces by score. A character without a piece becomes its UTF-8 bytes' pieces; nothing merges with it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.bytes, own = {}, np.zeros(256, np.int32), []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.text[i] = piece
                own.append((len(piece) > 1, -sp.get_score(i), i, piece))
        self.raw = {i: piece.encode() for i, piece in self.text.items()} | {int(i): bytes([b]) for b, i in enumerate(self.bytes)}
        own.sort()
        rank = {piece: r for r, (_, _, _, piece) in enumerate(own)}
        self.size = len(own)
        self.left, self.right = np.arange(self.size), np.arange(self.size)  # the two that a piece is merged from; itself for a character
        usable, pairs = [], {}
        for r, (long, _, i, piece) in enumerate(own):
            if long:
                made = self.merged(piece, rank)
                if len(made) != 2:
                    continue  # merging never makes this piece
                self.left[r], self.right[r] = rank[made[0]], rank[made[1]]
                pairs[self.left[r] * self.size + self.right[r]] = r
            usable.append((r, i, piece))
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.longest = max(len(piece) for _, _, piece in usable)
        keys = np.array([int(self.hashes(np.array([[ord(c) for c in piece]], np.uint64))[0, -1]) for _, _, piece in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _, _ in usable])[order]
        self.id_of = np.array([i for _, _, i, _ in own], np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.letters = np.zeros((len(usable), self.longest), np.uint32)
        for row, k in enumerate(order.tolist()):
            piece = usable[k][2]
            self.letters[row, : len(piece)] = [ord(c) for c in piece]
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def merged(piece: str, rank: dict[str, int]) -> list[str]:
        """The neighbours that merging leaves when all but the piece itself may be made."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts if all(x in rank for x in parts) else []

    @staticmethod
    def hashes(x: np.ndarray) -> np.ndarray:
        """Hash of each row's prefixes: (n, m) for characters (n, m)."""
        out, h = np.empty(x.shape, np.uint64), np.full(len(x), 1469598103934665603, np.uint64)
        for k in range(x.shape[1]):
            h = (h ^ x[:, k]) * _MULT
            h ^= h >> np.uint64(31)
            out[:, k] = h
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b (ranks) as neighbours.

        Their merges are undone from the last one on. Where the two parts that touch could have been merged with each other at
        that time, ahead of what was done, the boundary would not have lasted."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(at):
            k = np.minimum(np.searchsorted(self.pair_keys, a * self.size + b), len(self.pair_keys) - 1)
            made = np.where(self.pair_keys[k] == a * self.size + b, self.pair_made[k], 1 << 41)
            clash = made < limit
            out[at[clash]] = False
            a_part, b_part = self.right[a], self.left[b]
            a_whole, b_whole = a_part == a, b_part == b
            undo_a = ((a > b) | b_whole) & ~a_whole
            undo_b = ~undo_a & ~b_whole
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, a_part, a), np.where(undo_b, b_part, b)
            go = ~clash & (undo_a | undo_b)
            a, b, limit, at = a[go], b[go], limit[go], at[go]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit, packed) of words of one length."""
        if len(words[0]) > 2 * CHUNK:
            return [self.packed(w, *self.chained(w)) for w in words]
        paths = self.paths(words)
        ranks = np.concatenate([r for _, r in paths])
        bounds = np.cumsum([0, *(len(r) for _, r in paths)])
        flat, ends = self.id_of[ranks].astype(np.int32).tobytes(), (4 * bounds).tolist()
        out = [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(ranks < 0), "right") - 1).tolist():
            out[i] = self.packed(words[i], *paths[i])
        return out

    def packed(self, word: str, starts: np.ndarray, ranks: np.ndarray) -> bytes:
        """The ids of a path; characters without a piece give their bytes' ids."""
        ids = self.id_of[ranks]
        lost = np.flatnonzero(ranks < 0)
        if not len(lost):
            return ids.astype(np.int32).tobytes()
        parts, done = [], 0
        for i in lost.tolist():
            parts += [ids[done:i], self.bytes[list(word[starts[i]].encode())]]
            done = i + 1
        return np.concatenate([*parts, ids[done:]]).astype(np.int32).tobytes()

    def chained(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The path of a long word, from chunks that overlap and advance together.

        A path holds if its neighbours hold as pairs. So where two chunks have one piece at one place, what goes before it in the
        first and after it in the second is a path. Chunks of a text with a period may never meet: then chunks with other
        beginnings are tried, and if these do not meet either, the word advances as one."""
        starts = range(0, len(word) - OVERLAP, CHUNK - OVERLAP)
        for shifts in ((0,), range(self.longest + 1)):
            at = [min(i + k, len(word) - CHUNK) if i else 0 for i in starts for k in shifts]
            step, paths = max(1, (1 << 20) // CHUNK), []
            for i in range(0, len(at), step):
                paths += self.paths([word[a : a + CHUNK] for a in at[i : i + step]])
            codes = [(a + x) * (self.size + 1) + r + 1 for a, (x, r) in zip(at, paths)]
            whole, end = [], codes[0]
            for i in range(len(shifts), len(at), len(shifts)):
                for code in codes[i : i + len(shifts)]:
                    _, here, there = np.intersect1d(end, code, assume_unique=True, return_indices=True)
                    if len(here):
                        break
                else:
                    break
                whole.append(end[: here[-1]])
                end = code[there[-1] :]
            else:
                whole = np.concatenate([*whole, end])
                return whole // (self.size + 1), whole % (self.size + 1) - 1
        return self.paths([word])[0]

    def paths(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(begins, ranks) of the pieces of words of one length, rank -1 for a character without a piece: all words advance together, one place at a time."""
        n, m = len(words), len(words[0])
        x = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, m)
        last = np.full((n, m + 1), -2, np.int64)  # the piece that ends at each place: a rank, -1 for a character without a piece, -2 for none
        back = np.zeros((n, m + 1), np.int32)
        for s in range(m):
            size = min(self.longest, m - s)
            h = self.hashes(x[:, s : s + size].astype(np.uint64))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            row, col = np.nonzero((self.keys[at] == h) & ((last[:, s] > -2) | (s == 0))[:, None])
            probe = at[row, col]
            for k in range(size):
                long = col >= k
                same = np.ones(len(row), bool)
                same[long] = self.letters[probe[long], k] == x[row[long], s + k]
                row, col, probe = row[same], col[same], probe[same]
                if not (col > k).any():
                    break
            piece, before = self.ranks[probe], last[row, s] if s else np.full(len(row), -1, np.int64)
            free = before < 0
            both = before[~free] * self.size + piece[~free]
            pairs, where = np.unique(both, return_inverse=True)
            ok = free.copy()
            ok[~free] = self.apart(pairs // self.size, pairs % self.size)[where]
            last[row[ok], s + col[ok] + 1] = piece[ok]
            back[row[ok], s + col[ok] + 1] = s
            alone = np.ones(n, bool)
            alone[row[col == 0]] = False
            alone &= (last[:, s] > -2) | (s == 0)
            last[alone, s + 1], back[alone, s + 1] = -1, s
        found, end, rows = np.full((n, m), -2, np.int32), np.full(n, m), np.arange(n)
        while len(rows):  # all words walk back together; a rank stands where its piece begins
            start = back[rows, end]
            found[rows, start] = last[rows, end]
            rows, end = rows[start > 0], start[start > 0]
        at, where = np.nonzero(found > -2)
        ranks, bounds = found[at, where].astype(np.int64), np.searchsorted(at, np.arange(n + 1))
        return [(where[i:j], ranks[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def learn(self, words: set[str]) -> None:
        """Encode words not seen before, by length, in blocks of bounded size."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for size, same in by.items():
            step = max(1, (1 << 20) // size)
            for i in range(0, len(same), step):
                self.seen.update(zip(same[i : i + step], self.viterbi(same[i : i + step])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE))[:-1] if t else [] for t in texts]  # the last match is empty
        words = {w for ws in split for w in ws}.difference(self.seen)
        if len(self.seen) > CACHE:  # two generations, so that common words stay
            self.seen, self.old = {}, self.seen
            words = {w for ws in split for w in ws}
        for w in words.intersection(self.old):
            self.seen[w] = self.old[w]
        self.learn(words.difference(self.seen))
        return [np.frombuffer(b"".join(map(self.seen.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return out.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), ids and round_trip (decoding gives the text back) of each row.

    Null texts count as empty, which has no pieces. A U+2581 in a text decodes as a space; only then is round_trip false. Every row, repeated ones
    too, is answered; an empty table gives an empty result. Very long words advance in chunks; texts of any length are read whole."""
    prepare(docs.sparkSession)
    raw = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = model.encode(texts)
            whole = [model.decode(x) == t for x, t in zip(ids, texts)]
            raw_ids = [x.astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in raw_ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(whole)], ["doc_id", "n_pieces", "ids_crc32", "ids", "round_trip"])

    return raw.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, ids array<int>, round_trip boolean")
