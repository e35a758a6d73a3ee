"""Weakly supervised quality rules: rules vote or abstain, EM estimates their accuracies, a posterior decides."""

from __future__ import annotations

from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, own_columns, pieces_of, prepare, saved, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks")
WINDOW = 5
#: The prior on the rules' votes, see fit().
PRIOR, GOOD, OWN = 0.1, 0.995, 0.05
#: Rules that vote against together this often are a style of bad text; a slip of a rule on a good document is as rare.
LEAST = 0.005
_SPACES = b" \t\n\r\x0b\x0c"
_UPPER, _LOWER, _SYMBOLS, _MARKS = bytes(range(65, 91)), bytes(range(97, 123)), b"#*$%&|<>", b"!|"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeats(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, words inside 5-word windows that occur at least twice in it."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    h = doc[at].astype(np.uint64)
    for k in range(WINDOW):
        h = (h ^ words[at + k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    left, right = at[order[:-1][same]], at[order[1:][same]]
    if not all((words[left + k] == words[right + k]).all() for k in range(WINDOW)) or (doc[left] != doc[right]).any():
        order = np.lexsort([words[at + k] for k in range(WINDOW)] + [doc[at]])  # two windows share a hash: compare the words themselves
        a, b = at[order[:-1]], at[order[1:]]
        same = (doc[a] == doc[b]) & np.logical_and.reduce([words[a + k] == words[b + k] for k in range(WINDOW)])
        left, right = a[same], b[same]
    edge = np.zeros(len(words) + 1, np.int32)
    for part in (np.union1d(left, right),):
        np.add.at(edge, part, 1)
        np.add.at(edge, part + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=n_docs).astype(np.int64)


def measure_batch(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in MEASURES}
    ids: dict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], []
    for i, text in enumerate(texts):
        n = 0
        for piece in pieces_of(text):
            words = piece.split()
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            n += len(words)
        sizes.append(n)
        out["n_words"][i] = n
        bare = text.translate(None, _SPACES)
        out["word_chars"][i] = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
        for name, chars in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_marks", _MARKS)):
            out[name][i] = len(bare) - len(bare.translate(None, chars))
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    doc = np.repeat(np.arange(len(texts)), sizes)
    out["n_repeat_words"] = _repeats(np.concatenate(parts) if parts else np.zeros(0, np.int64), doc, len(texts))
    return out


def _measure(batches):
    for batch in batches:
        got = measure_batch(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k]) for k in MEASURES)], ["doc_id", *MEASURES])


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, 0 bad, -1 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    per_word = F.col("word_chars") / words
    symbols, marks = F.col("n_symbols") / words, F.col("n_marks") / words
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    again = F.col("n_repeat_words") / words
    upper = F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "length": vote(F.col("n_words") < 10, F.col("n_words") >= 30),
        "word_length": vote((per_word < 2) | (per_word > 15), per_word.between(3, 10)),
        "symbols": vote(symbols > 0.3, symbols < 0.1),
        "marks": vote(marks > 0.3, marks < 0.1),
        "case": vote(upper > 0.5, upper < 0.25),
        "lines": vote(dup > 0.4, dup < 0.1),
        "repeats": vote(again > 0.2, again < 0.05),
    }


def styles(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The styles of bad text: sets of rules that vote against together in LEAST of the rows at least, and how many rows do."""
    sets, which = np.unique(patterns == 0, axis=0, return_inverse=True)
    rows = np.bincount(which.ravel(), weights=counts, minlength=len(sets))
    found = sets.any(1) & (rows >= LEAST * counts.sum())
    return sets[found], rows[found]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1/0/1) with their counts.

    Classes: good documents, and the styles of bad ones (see styles(); at most 1 / LEAST). A style has the whole set of rules that it fails, so
    rules that fail together do not stand in for one another, and a rule that fails alone has a style too. Returns the shares of the
    classes and P(a vote cast is for | class) for each rule: for the good class that is the rule's accuracy on good documents, for a style one less
    its accuracy on that style. All are estimated, under a Beta prior worth PRIOR of a class's rows (and two votes): GOOD of the
    votes are for, OWN of those of a style's own rules. Abstentions carry no evidence. Failures together that are rarer than LEAST are left to the
    classes to explain: as a style with a slip, or as a good document with one."""
    own, rows = styles(patterns, counts)
    style = np.vstack([np.zeros((1, patterns.shape[1]), bool), own])
    size = np.concatenate([[counts.sum()], rows])
    mean, weight = np.where(style, OWN, GOOD), PRIOR * size[:, None] + 2
    shares, chance = size / size.sum(), mean
    post = _classes(patterns, shares, chance)
    for _ in range(rounds):
        w = post * counts[:, None]
        shares = (w.sum(0) + 1e-3) / (w.sum() + 1e-3 * len(size))
        chance = np.clip((w.T @ (patterns == 1) + mean * weight) / (w.T @ (patterns >= 0) + weight), 1e-6, 1 - 1e-6)
        new = _classes(patterns, shares, chance)
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    return shares, chance


def _classes(patterns: np.ndarray, shares: np.ndarray, chance: np.ndarray) -> np.ndarray:
    score = np.log(shares) + (patterns == 1) @ np.log(chance).T + (patterns == 0) @ np.log(1 - chance).T
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def posterior(patterns: np.ndarray, shares: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The probability of the good class for each pattern."""
    return _classes(patterns, shares, chance)[:, 0]


def judged(docs: DataFrame, owner: str = "quality", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measures, base_failed, quality (posterior) and kept for each row of docs.

    Null texts count as empty. Repeated rows are each judged. Rules vote on all rows; the driver sees only the counts of
    vote patterns, 3 to the power of the number of rules at most. An empty table gives an empty result."""
    spark = docs.sparkSession
    prepare(spark)
    raw = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()
    rows = raw.mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in MEASURES))
    named = rules()
    rows = saved(rows.withColumn("votes", F.concat_ws(",", *(v.cast("string") for v in named.values()))), owner, "measures")
    found = rows.groupBy("votes").count().collect()
    patterns = np.array([[int(x) for x in r["votes"].split(",")] for r in found]).reshape(-1, len(named))
    counts = np.array([r["count"] for r in found], float)
    good = posterior(patterns, *fit(patterns, counts)) if found else []
    lookup = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(found, good)], "votes string, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        rows.join(F.broadcast(lookup), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= 0.5))
        .select("doc_id", *MEASURES[:5], "base_failed", "kept", "quality")
    )


def kept(docs: DataFrame, owner: str = "quality") -> DataFrame:
    """The rows of docs that pass, with all their columns. Decisions go by (doc_id, text), so rows that share an id are told apart.

    Null and empty texts fail, having fewer than 10 words; null ids are judged like others; repeated rows all stay or all go.
    An empty table gives an empty result."""
    k = free_name(docs, "k")
    both = docs.withColumn(k, F.struct(F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")))
    bad = judged(both, owner, key=k).where(~F.col("kept")).select(F.col("doc_id").alias(k)).distinct()
    return both.join(bad, k, "left_anti").select(*own_columns(docs))
