"""Scores from a log-bilinear language model, fitted in numpy by noise-contrastive estimation.

The model predicts a token from the vectors of the two before it. Its vocabulary, the commonest words, grows as the square root of
the tokens (VOCABULARY); each has a context vector and an output vector. The chance of a word is that of its class times that of the word
within the class, both bilinear in the context, so that sums over one class normalise it. Rarer words share classes by their
last two bytes and have their smoothed share of the class's tokens: chances add up to one, unseen words included. Every task
draws its own noise while it goes through its chunks; the tasks' parameters are averaged by tokens, and a second round goes on
from there. All counts come from all training documents."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, prepare, saved, text_bytes

END = b"\n"  # the end token; no word holds white space
SHARED = 16  # classes of words outside the vocabulary
CHUNK = 16 << 20
DIM, CLASS_NOISE, WORD_NOISE = 16, 24, 2
BATCH, RATE = 8192, 0.15
#: Rounds over the chunks, each over every n-th batch of tokens.
ROUNDS = (8, 1)
#: Words of the vocabulary for each root of a token.
VOCABULARY = 0.5


def _chunks(batches):
    """Documents by chunks of about CHUNK bytes: each chunk's own dictionary, and its documents as numbers into it."""
    part, number = TaskContext.get().partitionId(), count()
    held: list = []

    def chunk():
        ids: dict[bytes, int] = defaultdict(count().__next__)
        ids[END]
        arrays, sizes = [], []
        for _, _, text in held:
            n = 1
            for piece in pieces_of(text):
                words = piece.lower().split()
                arrays.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                n += len(words)
            arrays.append(np.zeros(1, np.int32))
            sizes.append(n)
        return {"chunk": part << 32 | next(number), "doc_ids": [d for d, _, _ in held], "train": [t for _, t, _ in held], "sizes": sizes, "words": b" ".join(list(ids)[1:]), "tokens": np.concatenate(arrays).tobytes()}

    size = 0
    for batch in batches:
        schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary())])
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            held.append(row)
            size += len(row[2])
            if size >= CHUNK:
                yield pa.RecordBatch.from_pylist([chunk()], schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([chunk()], schema)


def _names(words: bytes) -> list[bytes]:
    return [END, *words.split(b" ")] if words else [END]


def _counts(batches):
    for batch in batches:
        for chunk, train, sizes, words, tokens in zip(*(batch.column(f).to_pylist() for f in ("chunk", "train", "sizes", "words", "tokens"))):
            names = _names(words)
            learned = np.repeat(np.array(train, bool), sizes)
            n = np.bincount(np.frombuffer(tokens, np.int32)[learned], minlength=len(names))
            for i in range(0, len(names), 50_000):
                part = slice(i, i + 50_000)
                m = len(names[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(np.arange(i, i + m, dtype=np.int32)), pa.array(names[part], pa.binary()), pa.array(n[part].astype(np.int64))], ["chunk", "place", "word", "n"])


class Vocabulary:
    """Numbers of words: 0 .. size - 1 by class, then SHARED numbers of other words, then the start of a document.

    Words with like endings stand together and are cut into classes of one size, about the root of the vocabulary's."""

    def __init__(self, counts: dict[bytes, int]):
        names = sorted(counts, key=lambda w: w[::-1])
        self.size = len(names)
        self.number = {w: i for i, w in enumerate(names)}
        self.counts = np.array([counts[w] for w in names], np.float64)
        self.width = max(1, int(np.ceil(np.sqrt(self.size))))
        self.word_classes = -(-self.size // self.width)
        self.classes = self.word_classes + SHARED
        self.start = self.size + SHARED

    def numbers(self, names: list[bytes]) -> np.ndarray:
        known, size = self.number, self.size
        return np.array([known[w] if w in known else size + zlib.crc32(w[-2:]) % SHARED for w in names], np.int32)

    def class_of(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.size, words // self.width, self.word_classes + words - self.size)


def contexts_of(words: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The words two and one before each token; `start` before a document's first."""
    one, two = np.full(len(words), start, np.int32), np.full(len(words), start, np.int32)
    one[1:], two[2:] = words[:-1], words[:-2]
    first = np.cumsum(sizes) - sizes
    one[first] = two[first] = start
    two[(first + 1)[sizes > 1]] = start
    return two, one


def fresh(vocabulary: Vocabulary, class_counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before training: biases that give the words' own shares, small vectors."""
    rng = np.random.default_rng(seed)
    v = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    share = np.log((class_counts + 1) / (class_counts + 1).sum())
    within = np.log(vocabulary.counts + 1) - np.log(class_counts + 1)[vocabulary.class_of(np.arange(vocabulary.size))]
    return {"two": v(vocabulary.start + 1), "one": v(vocabulary.start + 1), "class": v(vocabulary.classes), "word": v(vocabulary.size), "class_bias": share.astype(np.float32), "word_bias": within.astype(np.float32)}


def _added(p: np.ndarray, sums: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
    """One AdaGrad step on the rows `at` of p, in place; repeated rows are summed first."""
    if len(p) <= 1 << 16:
        at = at.astype(np.uint16)  # short numbers are sorted by their digits
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rows = sorted_[first]
    g = np.add.reduceat(gradient[order], first, axis=0)
    sums[rows] += g * g
    p[rows] -= RATE * g / np.sqrt(sums[rows])


def train(p: dict[str, np.ndarray], vocabulary: Vocabulary, class_counts: np.ndarray, batches, seed: int, settled: float = 1.0) -> tuple[dict, int]:
    """Parameters after the batches (two, one, word), and the tokens seen. Each token's class, and its word within the class,
    are told from noise drawn by their own frequencies: CLASS_NOISE classes a batch, WORD_NOISE words a token."""
    rng = np.random.default_rng(seed)
    p = {k: x.copy() for k, x in p.items()}
    sums = {k: np.full_like(x, settled) for k, x in p.items()}  # AdaGrad; more of it for a model that has been trained
    class_share = (class_counts + 1) / (class_counts + 1).sum()
    ends = np.cumsum(vocabulary.counts + 1)
    bounds = np.concatenate([[0.0], ends])[np.minimum(np.arange(vocabulary.word_classes + 1) * vocabulary.width, vocabulary.size)]
    mass = np.diff(bounds)
    level = np.log(WORD_NOISE * (vocabulary.counts + 1) / np.repeat(mass, vocabulary.width)[: vocabulary.size]).astype(np.float32)
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    seen = 0
    for two, one, word in batches:
        n = len(word)
        seen += n
        h = p["two"][two] + p["one"][one]
        k = vocabulary.class_of(word)
        drawn = rng.choice(vocabulary.classes, CLASS_NOISE, p=class_share)
        base = np.log(CLASS_NOISE * class_share).astype(np.float32)
        right = sigma((h * p["class"][k]).sum(1) + p["class_bias"][k] - base[k]) - 1
        wrong = sigma(h @ p["class"][drawn].T + p["class_bias"][drawn] - base[drawn])
        dh = right[:, None] * p["class"][k] + wrong @ p["class"][drawn]
        at = np.concatenate([k, drawn])
        _added(p["class"], sums["class"], at, np.concatenate([right[:, None] * h, wrong.T @ h]))
        _added(p["class_bias"], sums["class_bias"], at, np.concatenate([right, wrong.sum(0)]))
        mine = np.flatnonzero(word < vocabulary.size)
        if len(mine):
            w, kw, hw = word[mine], k[mine], h[mine]
            noise = np.searchsorted(ends, bounds[kw][:, None] + rng.random((len(w), WORD_NOISE)) * mass[kw][:, None], "right")
            noise = np.minimum(noise, np.minimum((kw + 1) * vocabulary.width, vocabulary.size)[:, None] - 1)
            words = np.concatenate([w[:, None], noise], 1)
            own = p["word"][words]
            d = sigma(np.einsum("nd,njd->nj", hw, own) + p["word_bias"][words] - level[words])
            d[:, 0] -= 1
            dh[mine] += np.einsum("nj,njd->nd", d, own)
            flat = words.ravel()
            _added(p["word"], sums["word"], flat, (d[:, :, None] * hw[:, None]).reshape(-1, DIM))
            _added(p["word_bias"], sums["word_bias"], flat, d.ravel())
        _added(p["two"], sums["two"], two, dh)
        _added(p["one"], sums["one"], one, dh)
    return p, seen


def _log_softmax(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithms of the softmax of each row at one place. s is used up."""
    own = s[np.arange(len(s)), at].copy()
    top = s.max()
    if top > 60 or s.min() < -60:  # else exponentials of all rows are safe as they are
        high = s.max(1)
        s -= high[:, None]
        own -= high
    return own - np.log(np.exp(s, out=s).sum(1))


def log_chances(p: dict[str, np.ndarray], vocabulary: Vocabulary, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural logarithms of each token's chance; of words outside the vocabulary, of their class's."""
    out = np.empty(len(word), np.float64)
    for i in range(0, len(word), 1 << 16):
        part = slice(i, i + (1 << 16))
        h, w = p["two"][two[part]] + p["one"][one[part]], word[part]
        k = vocabulary.class_of(w)
        found = _log_softmax(h @ p["class"].T + p["class_bias"], k)
        order = np.argsort(k.astype(np.uint16) if vocabulary.classes <= 1 << 16 else k, kind="stable")
        cuts = np.searchsorted(k[order], np.arange(vocabulary.word_classes + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[c] : cuts[c + 1]]
            lo = c * vocabulary.width
            s = h[mine] @ p["word"][lo : lo + vocabulary.width].T + p["word_bias"][lo : lo + vocabulary.width]
            found[mine] += _log_softmax(s, w[mine] - lo)
        out[part] = found
    return out


def _common(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words of the greatest counts, `most` of them or a few less: those of equal count come or stay away together.

    The driver learns how many words have each count, of which there are no more than the root of twice the tokens, and then
    gets the words that pass."""
    by_count = sorted(((r["c"], r["n"]) for r in counts.where("c > 0").groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, most
    for c, n in by_count:
        if n > room:
            break
        least, room = c, room - n
    if least is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).select("word", "c").collect()}


def _averaged(batches):
    """Sums of the weighted parameters of some tasks, block by block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(values, np.float64)
            sums[block] = sums[block] + x if block in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])


def fitted(chunks: DataFrame, vocabulary: Vocabulary, class_counts: np.ndarray, rounds=ROUNDS) -> dict[str, np.ndarray]:
    """The model after all rounds over the training tokens of all chunks."""
    start = fresh(vocabulary, class_counts)
    shapes = {k: x.shape for k, x in start.items()}
    for turn, stride in enumerate(rounds):

        def learn(batches, start=start, turn=turn, stride=stride):
            part, p, seen = TaskContext.get().partitionId(), start, 0

            def tokens():
                place = 0
                for batch in batches:
                    for train_, sizes, names, ids in zip(*(batch.column(f).to_pylist() for f in ("train", "sizes", "words", "tokens"))):
                        words, sizes = vocabulary.numbers(_names(names))[np.frombuffer(ids, np.int32)], np.array(sizes, np.int64)
                        two, one = contexts_of(words, sizes, vocabulary.start)
                        mine = np.flatnonzero(np.repeat(np.array(train_, bool), sizes))
                        for i in range(0, len(mine), BATCH):
                            if place % stride == 0:
                                at = mine[i : i + BATCH]
                                yield two[at], one[at], words[at]
                            place += 1

            p, seen = train(start, vocabulary, class_counts, tokens(), 1000 * turn + part, 100.0 if turn else 1.0)
            flat = np.concatenate([np.concatenate([x.ravel() for x in p.values()]).astype(np.float64) * seen, [seen]])
            for block, i in enumerate(range(0, len(flat), 1 << 16)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([flat[i : i + (1 << 16)].tobytes()], pa.binary())], ["block", "sums"])

        learned = chunks.select("train", "sizes", "words", "tokens").mapInArrow(learn, "block int, sums binary")
        sums = learned.repartition("block").mapInArrow(_averaged, "block int, sums binary").toPandas().sort_values("block")
        flat = np.concatenate([np.frombuffer(x, np.float64) for x in sums["sums"]]) if len(sums) else np.zeros(1)
        if not flat[-1]:
            break
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        start = {k: (x / flat[-1]).reshape(s).astype(np.float32) for (k, s), x in zip(shapes.items(), np.split(flat[:-1], ends)[:-1])}
    return start


def scored(docs: DataFrame, owner: str = "lm", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; scores are log10.

    Held out: crc32 of the id as text leaves 2 modulo 7 (a null id counts as ''). Null texts are empty: one end token. Repeated
    rows each count and are each scored. An empty training set gives the smoothed scores; an empty table an empty result.
    Words are counted once a chunk before any shuffle. The vocabulary's counts go to every task; of other words only those
    of several chunks are joined back, which are rare, so no word's rows meet in one task."""
    spark = docs.sparkSession
    prepare(spark)
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    raw = docs.select(F.col(key).alias("doc_id"), (~held).alias("train"), text_bytes(text).alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()
    chunks = saved(raw.mapInArrow(_chunks, f"chunk long, doc_ids array<{kind}>, train array<boolean>, sizes array<long>, words binary, tokens binary"), owner, "chunks")
    listed = chunks.select("chunk", "train", "sizes", "words", "tokens").mapInArrow(_counts, "chunk long, place int, word binary, n long")
    counts = saved(listed.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")), owner, "counts")
    total, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = _common(counts, max(64, int(VOCABULARY * np.sqrt(total))))
    vocabulary = Vocabulary(common)
    least = min(common.values(), default=0)
    rare = counts.where(F.col("c") < least) if common else counts
    shares = np.zeros((2, SHARED))
    for r in rare.where("c > 0").groupBy((F.crc32(F.substring("word", -2, 2)) % SHARED).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        shares[:, r["k"]] = r["n"], r["v"]
    starts = np.arange(vocabulary.word_classes) * vocabulary.width
    own = np.add.reduceat(vocabulary.counts, starts) if vocabulary.size else np.zeros(0)
    model = fitted(chunks, vocabulary, np.concatenate([own, shares[0]]))
    many = rare.where("chunks > 1").select("word", "c")
    joined = listed.select("chunk", "place", "word").join(many, "word").select("chunk", "place", "c")
    floor = np.log10(total + distinct + 1)

    def numbered(batches):
        """Chunks with their words as numbers, which is all that scoring needs of them."""
        for batch in batches:
            for i, names in enumerate(batch.column("words").to_pylist()):
                one = batch.slice(i, 1)
                numbers = pa.array([vocabulary.numbers(_names(names)).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([numbers if f == "words" else one.column(f) for f in one.schema.names], one.schema.names)

    def score(key_, found: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        numbers, tokens, sizes = np.frombuffer(row["words"], np.int32), np.frombuffer(row["tokens"], np.int32), np.asarray(row["sizes"], np.int64)
        c = np.bincount(tokens[np.repeat(np.asarray(row["train"], bool), sizes)], minlength=len(numbers)).astype(float)
        c[found["place"].to_numpy()] = found["c"].to_numpy()
        usual = numbers < vocabulary.size
        c[usual] = vocabulary.counts[numbers[usual]]
        k = np.where(usual, 0, numbers - vocabulary.size)
        within = np.where(usual, 0.0, np.log10(c + 1) - np.log10(shares[0] + shares[1] + 1)[k])
        two, one = contexts_of(numbers[tokens], sizes, vocabulary.start)
        chances = log_chances(model, vocabulary, two, one, numbers[tokens]) / np.log(10)
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({"doc_id": list(row["doc_ids"]), "held_out": ~np.asarray(row["train"], bool), "n_tokens": sizes, "n_known": add((c > 0).astype(np.int64)[tokens]), "train_tokens": int(total), "base_score": add((np.log10(c + 1) - floor)[tokens]), "score": add(chances + within[tokens])})

    # As many tasks as chunks, so that a task's chunks do not grow in number with the input.
    tasks = max(1, chunks.count())
    pairs = joined.repartition(tasks, "chunk").groupBy("chunk").cogroup(chunks.mapInArrow(numbered, chunks.schema).repartition(tasks, "chunk").groupBy("chunk"))
    return pairs.applyInPandas(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
