"""Importance resampling towards a target distribution over hashed n-grams; n-gram hashes are composed from word hashes.

A CRC over GF(2) is linear: crc(a b) = shift(crc(a), bytes of b) ^ crc(b), where shift is a 32 x 32 bit matrix that depends on the
length alone. Each distinct word's CRC is computed once; n-gram strings are never made."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import placed
from .common import free_name, lowered_words, own_columns, prepare, saved, text_bytes

BUCKETS = 10_000
LEAST_WORDS = 20
POLYNOMIAL = 0xEDB88320
TABLED = 64  # lengths up to this have byte tables at hand


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The matrix, given by the images of the 32 bits, applied to each value."""
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _one_byte() -> np.ndarray:
    """The matrix that appends a zero byte: eight steps of the shift register for each bit."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        images = np.where(images & np.uint32(1), images >> np.uint32(1) ^ np.uint32(POLYNOMIAL), images >> np.uint32(1))
    return images


def length_matrix(n: int) -> np.ndarray:
    """The matrix that appends n zero bytes, by repeated squaring."""
    out, power = np.uint32(1) << np.arange(32, dtype=np.uint32), _one_byte()
    while n:
        if n & 1:
            out = _times(power, out)
        power, n = _times(power, power), n >> 1
    return out


def _tables() -> np.ndarray:
    """For each length up to TABLED and each byte of a value, the images of its 256 states."""
    out = np.empty((TABLED + 1, 4, 256), np.uint32)
    states = np.arange(256, dtype=np.uint32)
    for n in range(TABLED + 1):
        matrix = length_matrix(n)
        for byte in range(4):
            out[n, byte] = _times(matrix, states << np.uint32(8 * byte))
    return out


_table: list[np.ndarray] = []


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes: a matrix for each length, long ones by their bits."""
    if not _table:
        _table.append(_tables())
    flat, base = _table[0].ravel(), np.minimum(lengths, TABLED) * 1024
    out = flat[base + (crcs & np.uint32(255))]
    for byte in range(1, 4):
        out ^= flat[base + 256 * byte + (crcs >> np.uint32(8 * byte) & np.uint32(255))]
    over = np.flatnonzero(lengths > TABLED)
    for n in np.unique(lengths[over]).tolist():
        at = over[lengths[over] == n]
        out[at] = _times(length_matrix(n), crcs[at])
    return out


def ngram_crcs(words: np.ndarray, doc: np.ndarray, crc: np.ndarray, size: np.ndarray, longest: int):
    """(CRCs, documents) of the runs of 1, 2 ... longest words, joined by a space. words index crc and size (bytes) of distinct words."""
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    tail = shifted(space, size) ^ crc  # of a space and the word
    now = crc[words]
    yield now, doc
    for n in range(2, longest + 1):
        if len(words) < n:
            return
        last = words[n - 1 :]
        now = shifted(now[:-1], size[last] + 1) ^ tail[last]
        inside = doc[: len(now)] == doc[n - 1 :]
        yield now[inside], doc[: len(now)][inside]


def features(texts: list[bytes], longest: int):
    """(words of each text, CRCs of all n-grams, their texts) of a batch."""
    ids = defaultdict(count().__next__)
    parts, sizes = [], []
    for text in texts:
        n = 0
        for words in lowered_words(text):
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            n += len(words)
        sizes.append(n)
    crc = np.fromiter(map(zlib.crc32, ids), np.uint32, len(ids))
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    found = list(ngram_crcs(words, doc, crc, size, longest))
    return np.array(sizes, np.int64), np.concatenate([c for c, _ in found]), np.concatenate([d for _, d in found])


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = 2, text: str = "text") -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. A task sends one row a bucket at most."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0).to_pylist(), longest)[1] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select(text_bytes(text).alias("text")).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log of the buckets' likelihood ratios, one added to each count."""
    n, raw_all, target_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * float(raw_all + n) / ((s + 1) * float(target_all + n)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _weigher(gain: np.ndarray, longest: int):
    def weigh(batches):
        for batch in batches:
            words, crc, doc = features(batch.column(1).to_pylist(), longest)
            n = np.bincount(doc, minlength=len(words))
            total = np.bincount(doc, weights=gain[crc % np.uint32(len(gain))], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], ["own", "n_words", "n_features", "weight"])

    return weigh


def noise(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the key, the same in every run: the highest weights and noise are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, owner: str = "resample", key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, buckets: int = BUCKETS, longest: int = 2, least: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """docs (but for its text) with n_words, n_features, weight (floored mean gain of its n-grams), score (weight and noise) and rank.

    Of the documents with enough words the given per cent with the highest scores are drawn and ranked from 1; ties go to the smaller
    key, a null key first; the others' rank is null. Repeated rows have features each and are drawn each. Null and empty texts
    have no features and weight 0. Own columns come through, but for ones of these names. An empty table gives an empty
    result, an empty target weights against a flat one. Texts and words of any length are read whole."""
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets, longest, text), bucket_counts(target, buckets, longest, target_text))
    kept = docs.drop(text, "n_words", "n_features", "weight", "score", "rank")
    packed = docs.select(F.struct(*own_columns(kept)).alias("own"), text_bytes(text).alias("text"))
    schema = StructType([packed.schema["own"], *StructType.fromDDL("n_words long, n_features long, weight long")])
    weighed = packed.mapInArrow(_weigher(gain, longest), schema).select("own.*", "n_words", "n_features", "weight")
    row = free_name(docs, "row")
    rows = saved(weighed.withColumns({"score": F.col("weight") + noise(F.col(key), seed), row: F.monotonically_increasing_id()}), owner, "scores")
    able = rows.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    ranked = placed(able, F.desc("score"), F.asc_nulls_first(key), F.asc(row), name="rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))).drop(row)


def drawn(docs: DataFrame, target: DataFrame, owner: str = "resample", key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The drawn documents with all their columns, in no order. Decisions go by (key, text), so that copies of a row all stay or all go."""
    k = free_name(docs, "k")
    both = docs.withColumn(k, F.struct(F.xxhash64(key, text), F.xxhash64(text, key)))
    good = resampled(both.select(key, text, k), target, owner, key, text, **how).where(F.col("rank").isNotNull()).select(k).distinct()
    return both.join(good, k, "left_semi").select(*own_columns(docs))
