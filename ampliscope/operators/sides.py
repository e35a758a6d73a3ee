"""Comparisons of a prompt's images with and without a label that never make their pairs.

A prompt is one row of arrays, sorted by reward; what is asked of its pairs is counted or chosen within the row. The plan
holds no pair but those that are returned. A row takes eight bytes an image, label and number: a prompt of some ten million images fits a task.
Rows go to Python in chunks of images, so what a task holds there is its largest prompt, not a batch of large ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import frozen

#: Thresholds that a pass counts for one quantile, values that are sorted at last, numbers that a task handles at once.
SPLIT, FEW, STRIP = 128, 10_000, 1 << 20
#: Images of a prompt that is counted together with others, and of all these; rows of chosen pairs that a task holds.
SMALL, POOL, ROWS = 512, 1 << 16, 10_000
#: Images of a prompt in a row that goes to Python: batches of Arrow count rows.
CHUNK = 32
ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
MODES = ("reward", "score", "score_up")


def by_prompt(images: DataFrame, attrs: tuple[str, ...], only: DataFrame | None = None) -> DataFrame:
    """A row for each prompt: ids, rewards, scores and labels (flat) by rising reward, and the attrs that count. Images without a reward are left out.

    images: prompt, image_id, reward, g, and score if gaps are of a second score. only: the (prompt, attr) that count."""
    score = F.col("score") if "score" in images.columns else F.lit(None).cast("double")
    known = images.where(F.col("reward").isNotNull() & ~F.isnan("reward"))
    z = F.array_sort(F.collect_list(F.struct("reward", "image_id", score.alias("score"), "g")))
    rows = known.groupBy("prompt").agg(z.alias("z"))
    if only is None:
        rows = rows.withColumn("attrs", F.array(*map(F.lit, attrs)))
    else:
        rows = rows.join(only.where(F.col("attr").isin(*attrs)).groupBy("prompt").agg(F.collect_set("attr").alias("attrs")), "prompt")
    return rows.select("prompt", "attrs", F.col("z.image_id").alias("ids"), F.col("z.reward").alias("rewards"), F.col("z.score").alias("scores"), F.flatten("z.g").alias("labels"))


def _chunks(prompts: DataFrame, mode: str, *more: str) -> DataFrame:
    """The prompts in rows of up to CHUNK images, those of a prompt one behind the other; only its first has the attrs. more: further columns."""
    width = F.expr("int(size(labels) div size(rewards))")
    rows = prompts.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("rewards") - 1, F.lit(CHUNK))))
    cut = {c: F.slice(c, F.col("at") + 1, CHUNK) for c in ("ids", "rewards", "scores")} | {"labels": F.slice("labels", F.col("at") * width + 1, width * CHUNK)}
    columns = ("rewards", "labels", *(["scores"] if mode != "reward" else []), *more)
    return rows.select(F.when(F.col("at") == 0, F.col("attrs")).alias("attrs"), *(cut.get(c, F.col(c)).alias(c) for c in columns))


def _tables(batches):
    """Tables of whole prompts: the chunks of a batch's last prompt wait for the next batch."""
    held: list = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("attrs").is_valid().to_numpy(zero_copy_only=False))
        if len(starts):
            cut = int(starts[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _rows(frames):
    """The chunks of each prompt."""
    held: list = []
    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.attrs is not None and held:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _joined(chunks: list, column: str) -> np.ndarray:
    return np.concatenate([getattr(x, column) for x in chunks])


def _sides(chunks: list, attrs: tuple[str, ...]):
    """(attr, indices with the label, indices with 0) of a prompt, and its label matrix. An image with an unknown label is at no known distance and left out."""
    labels = np.asarray(_joined(chunks, "labels"))
    if labels.dtype.kind in "fO":  # with nulls
        labels = np.asarray(labels, float)
        labels = np.where(np.isnan(labels), np.iinfo(np.int8).min, labels)
    labels = labels.astype(np.int8).reshape(sum(len(x.rewards) for x in chunks), -1)
    known = (labels != np.iinfo(np.int8).min).all(1)
    own = set(chunks[0].attrs)
    for k, attr in enumerate(attrs):
        if attr in own:
            pos, neg = np.flatnonzero(known & (labels[:, k] == 1)), np.flatnonzero(known & (labels[:, k] == 0))
            if len(pos) and len(neg):
                yield attr, pos, neg, labels


class Gaps:
    """The gaps of the winning pairs of some prompts for one attribute: how many are at most x, and which lie between.

    p, start, stop: the rewards of images with the label, and where the opposites below begin and end in u; c: opposites before each place of u.
    Opposites of equal reward are one place, unless gaps are of a second score (s, t)."""

    def __init__(self, rewards: np.ndarray, scores: np.ndarray | None, first: np.ndarray, pos: np.ndarray, neg: np.ndarray, mode: str):
        """first: where each image's prompt begins; pos, neg: which images have the label, and 0."""
        self.mode, self.one, at = mode, not first.any(), np.arange(len(rewards))
        new = np.ones(len(rewards), bool)
        new[1:] = (rewards[1:] != rewards[:-1]) | (first[1:] != first[:-1])
        equal = np.maximum.accumulate(np.where(new, at, 0))
        here = np.flatnonzero(neg)
        if mode == "reward":
            here, n = np.unique(equal[here], return_counts=True)
        else:
            n = np.ones(len(here), np.int64)
            self.s, self.t = scores[pos], scores[here]
        self.c = np.concatenate([[0], np.cumsum(n)])
        self.p, self.u = rewards[pos], rewards[here]
        self.start, self.stop = np.searchsorted(here, first[pos]), np.searchsorted(here, equal[pos])

    def _strips(self, start: np.ndarray, stop: np.ndarray):
        """(gaps, their numbers) of the places from start up to stop of each image, some STRIP at a time."""
        n = np.maximum(stop - start, 0)
        upto = np.cumsum(n)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + STRIP, side="right")))
            m = n[low:high]
            if total := int(m.sum()):
                i = np.repeat(np.arange(low, high), m)
                j = np.arange(total) + np.repeat(start[low:high] - (np.cumsum(m) - m), m)
                if self.mode == "reward":
                    yield self.p[i] - self.u[j], self.c[j + 1] - self.c[j]
                else:
                    gap = self.t[j] - self.s[i]
                    gap = np.abs(gap) if self.mode == "score" else gap
                    gap = gap[gap >= 0]
                    yield gap, np.ones(len(gap), np.int64)
            low = high

    def _first(self, x: np.ndarray) -> np.ndarray:
        """For each x and image of one prompt the first opposite whose gap is at most x; gaps are compared as they are computed."""
        p, u, last = self.p[None, :], self.u, len(self.u) - 1
        lo = np.minimum(np.searchsorted(u, p - x[:, None]), self.stop)
        while (down := (lo > 0) & (p - u[np.maximum(lo - 1, 0)] <= x[:, None])).any():
            lo = lo - down
        while (up := (lo < self.stop) & (p - u[np.minimum(lo, last)] > x[:, None])).any():
            lo = lo + up
        return lo

    def _searched(self, n: int) -> bool:
        """Whether n thresholds are found by search: one prompt, and fewer steps than gaps."""
        return self.mode == "reward" and self.one and len(self.p) * n < int((self.stop - self.start).sum())

    def ends(self) -> tuple[int, float, float]:
        """How many there are, the least and the largest."""
        if self.mode != "reward":
            parts = [(len(g), g.min(), g.max()) for g, _ in self._strips(self.start, self.stop) if len(g)]
            return sum(x[0] for x in parts), min((x[1] for x in parts), default=0.0), max((x[2] for x in parts), default=0.0)
        at = np.flatnonzero(self.stop > self.start)
        if not len(at):
            return 0, 0.0, 0.0
        p, start, stop = self.p[at], self.start[at], self.stop[at]
        return int((self.c[stop] - self.c[start]).sum()), float((p - self.u[stop - 1]).min()), float((p - self.u[start]).max())

    def at_most(self, x: np.ndarray) -> np.ndarray:
        if self._searched(len(x)):
            size = max(1, STRIP // len(self.p))
            return np.concatenate([(self.c[self.stop] - self.c[self._first(x[k : k + size])]).sum(1) for k in range(0, len(x), size)])
        found = np.zeros(len(x) + 1, np.int64)
        for gap, n in self._strips(self.start, self.stop):
            found += np.bincount(np.searchsorted(x, gap), weights=n, minlength=len(x) + 1).astype(np.int64)
        return np.cumsum(found[:-1])

    def between(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """The distinct gaps above low and up to high, with their numbers."""
        if self._searched(2):
            start, stop = self._first(np.array([high, low]))
        else:
            start, stop = self.start, self.stop
        found = [np.zeros(0)], [np.zeros(0, np.int64)]
        for gap, n in self._strips(start, stop):
            inside = (gap > low) & (gap <= high)
            if inside.any():
                for at, part in zip(found, _summed(gap[inside], n[inside])):
                    at.append(part)
        return _summed(*map(np.concatenate, found))


def _summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values with the sums of their numbers."""
    values, place = np.unique(values, return_inverse=True)
    return values, np.bincount(place, weights=n, minlength=len(values)).astype(np.int64)


def _pooled(table, attrs: tuple[str, ...], mode: str):
    """(attr, gaps) of the prompts of a table: small ones together, up to POOL images, a larger one by itself."""
    at = {c: table.column(c).combine_chunks() for c in table.column_names}
    starts = np.flatnonzero(at["attrs"].is_valid().to_numpy(zero_copy_only=False))
    sizes = np.add.reduceat(at["rewards"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), starts)
    rewards = at["rewards"].flatten().to_numpy(zero_copy_only=False)
    scores = at["scores"].flatten().to_numpy(zero_copy_only=False).astype(float) if mode != "reward" else None
    labels = at["labels"].flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(rewards), -1)
    named = at["attrs"].flatten().to_numpy(zero_copy_only=False)
    owners = np.repeat(np.arange(len(starts)), at["attrs"].drop_null().value_lengths().to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        done = int(ends[low - 1]) if low else 0
        high = low + 1
        if sizes[low] <= SMALL:
            large = np.flatnonzero(sizes[low:] > SMALL)
            high = max(high, min(int(np.searchsorted(ends, done + POOL, side="right")), low + int(large[0]) if len(large) else len(sizes)))
        part = slice(done, int(ends[high - 1]))
        first = np.repeat(ends[low:high] - sizes[low:high] - done, sizes[low:high])
        for k, attr in enumerate(attrs):
            own = np.zeros(high - low, bool)
            has = owners[named == attr] - low
            own[has[(has >= 0) & (has < high - low)]] = True
            counts = np.repeat(own, sizes[low:high])
            pos, neg = counts & (labels[part, k] == 1), counts & (labels[part, k] == 0)
            if pos.any() and neg.any():
                yield attr, Gaps(rewards[part], scores if scores is None else scores[part], first, pos, neg, mode)
        low = high


def _folded(prompts: DataFrame, attrs: tuple[str, ...], mode: str, add, rows, schema: str) -> DataFrame:
    """What each task makes of all its prompts: add(state, attr, gaps) for each part, then the rows of the state, a dict."""
    columns = [x.split() for x in schema.split(", ")]

    def run(batches):
        state: dict = {}
        for table in _tables(batches):
            for attr, gaps in _pooled(table, attrs, mode):
                add(state, attr, gaps)
        found = list(zip(*rows(state))) or [[]] * len(columns)
        yield pa.RecordBatch.from_arrays([pa.array(x, ARROW[kind]) for x, (_, kind) in zip(found, columns)], [name for name, _ in columns])

    return _chunks(prompts, mode).mapInArrow(run, schema)


def gap_caps(prompts: DataFrame, attrs: tuple[str, ...], q: float = 0.75, mode: str = "reward") -> DataFrame:
    """attr, cap, n: the interpolated q-quantile of the gap over all pairs where the label's image wins, and their number.

    prompts: by_prompt(), read once a pass. A quantile lies in a range of gaps that each pass cuts into SPLIT parts by counting, prompt by prompt, until
    it holds FEW gaps, which are then sorted. A task adds up all its prompts and sends SPLIT counts, or its share of the FEW gaps, an attribute and rank."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}")
    spark = prompts.sparkSession

    def ends(state, attr, gaps):
        n, low, high = gaps.ends()
        if n:
            m, least, most = state.get(attr, (0, low, high))
            state[attr] = (m + n, min(least, low), max(most, high))

    found = _folded(prompts, attrs, mode, ends, lambda state: [(a, *x) for a, x in state.items()], "attr string, n long, low double, high double")
    state, total = {}, {}
    for r in found.groupBy("attr").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        total[r["attr"]] = r["n"]
        at = (r["n"] - 1) * q
        for rank in {int(np.floor(at)), int(np.ceil(at))}:
            state[r["attr"], rank] = (float(np.nextafter(r["low"], -np.inf)), r["high"], 0, r["n"])
    while todo := {k: np.unique(np.linspace(lo, hi, SPLIT + 1)[1:]) for k, (lo, hi, _, inside) in state.items() if inside > FEW and np.nextafter(lo, np.inf) < hi}:
        ranges = {(k[0], *state[k][:2]): x for k, x in todo.items()}  # ranks that lie side by side mostly share one

        def counts(state, attr, gaps, ranges=ranges):
            for key, x in ranges.items():
                if key[0] == attr:
                    state[key] = state.get(key, 0) + gaps.at_most(x)

        rows = lambda state: [(*key, i, int(n)) for key, found in state.items() for i, n in enumerate(found) if n]
        sums = _folded(prompts, attrs, mode, counts, rows, "attr string, low double, high double, at long, n long")
        upto = {key: np.zeros(len(x), np.int64) for key, x in ranges.items()}
        for r in sums.groupBy("attr", "low", "high", "at").agg(F.sum("n").alias("n")).collect():
            upto[r["attr"], r["low"], r["high"]][r["at"]] = r["n"]
        for k, x in todo.items():
            seen = upto[k[0], *state[k][:2]]
            at = int(np.argmax(seen > k[1]))
            low, below = (x[at - 1], seen[at - 1]) if at else (state[k][0], state[k][2])
            state[k] = (float(low), float(x[at]), int(below), int(seen[at] - below))
    left = {(attr, low, high): below for (attr, _), (low, high, below, _) in state.items()}

    def values(state, attr, gaps):
        for key in left:
            if key[0] == attr:
                old, new = state.get(key, (np.zeros(0), np.zeros(0, np.int64))), gaps.between(*key[1:])
                state[key] = _summed(*map(np.concatenate, zip(old, new)))

    rows = lambda state: [(*key, left[key], float(v), int(n)) for key, found in state.items() for v, n in zip(*found)]
    few = _folded(prompts, attrs, mode, values, rows, "attr string, low double, high double, below long, gap double, n long").groupBy("attr", "low", "high", "below", "gap").agg(F.sum("n").alias("n"))
    upto = {}
    for r in few.orderBy("attr", "low", "high", "gap").collect():  # FEW gaps an attribute and rank
        upto.setdefault((r["attr"], r["low"], r["high"]), []).append((r["gap"], r["n"]))
    at = {}
    for (attr, rank), (low, high, below, _) in state.items():
        gap, n = zip(*upto[attr, low, high])
        at[attr, rank] = gap[int(np.argmax(below + np.cumsum(n) > rank))]
    out = []
    for attr, n in sorted(total.items()):
        place = (n - 1) * q
        low, high = at[attr, int(np.floor(place))], at[attr, int(np.ceil(place))]
        out.append((attr, low + (high - low) * (place - np.floor(place)), n))
    return spark.createDataFrame([(a, float(c), n) for a, c, n in out], "attr string, cap double, n long")


def counterfactuals(prompts: DataFrame, attrs: tuple[str, ...], caps: DataFrame, max_h: int, per_prompt: int = 5, mode: str = "reward") -> DataFrame:
    """attr, prompt, pos_id, neg_id, h, gap: for each label's image, strongest first, the free opposite of least score.

    Candidates win on reward, differ in at most max_h other labels and keep the attr's gap cap. Score: half h over max_h, half gap over
    cap; ties to the smaller ids. One image at a time is held against its prompt's opposites, and the prompt is left after per_prompt pairs."""
    cap = {r["attr"]: r["cap"] for r in caps.select("attr", "cap").collect()}  # a row an attribute
    ident = prompts.schema["ids"].dataType.elementType.simpleString()
    columns = ["attr", "prompt", "pos_id", "neg_id", "h", "gap"]

    def run(frames):
        out = []
        for chunks in _rows(frames):
            rewards, ids, prompt = np.asarray(_joined(chunks, "rewards"), float), _joined(chunks, "ids"), chunks[0].prompt
            scores = None if mode == "reward" else np.asarray(_joined(chunks, "scores"), float)
            for attr, pos, neg, labels in _sides(chunks, attrs):
                if attr in cap:
                    neg = neg[np.argsort(ids[neg], kind="stable")]
                    free, most = np.ones(len(neg), bool), cap[attr] if cap[attr] > 0 else 1.0
                    strongest = sorted(pos.tolist(), key=lambda i: (-rewards[i], ids[i]))
                    found = 0
                    for i in strongest:
                        if found == per_prompt:
                            break
                        gap = rewards[i] - rewards[neg] if mode == "reward" else np.abs(scores[i] - scores[neg]) if mode == "score" else scores[neg] - scores[i]
                        h = (labels[neg] != labels[i]).sum(1) - 1
                        ok = free & (rewards[neg] < rewards[i]) & (gap >= 0) & (gap <= cap[attr]) & (h <= max_h)
                        if ok.any():
                            score = np.where(ok, 0.5 * h / max(1, max_h) + 0.5 * gap / most, np.inf)
                            j = int(np.argmin(score))
                            free[j], found = False, found + 1
                            out.append((attr, prompt, ids[i], ids[neg[j]], int(h[j]), float(gap[j])))
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    kind = prompts.schema["prompt"].dataType.simpleString()
    return _chunks(prompts, mode, "prompt", "ids").mapInPandas(run, f"attr string, prompt {kind}, pos_id {ident}, neg_id {ident}, h int, gap double")


def kept(prompts: DataFrame) -> DataFrame:
    """The rows behind a checkpoint: they are read once a pass."""
    return frozen(prompts)
