"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: (verdict, rule): host/path; fits the host and its subdomains, and paths that start with the rule's.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SAMPLE = 20_000
#: Domains with at least this share of all rows are joined by broadcast.
HOT = 0.001
BINS = 32
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "parameters", "dashes", "suffix_rate", "suffix_count", "domain_rate", "domain_count", "last_length")
STATS = ("suffix_rate", "suffix_n", "domain_rate", "domain_n")


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(found(1), upper, upper.lower()), found(2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of texts, and the code points of all in a row."""
    return np.array(list(map(len, texts)), np.int64), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _counted(texts: list[str], chars: str) -> np.ndarray:
    """How many of the given characters each text has."""
    size, points = _points(texts)
    return np.bincount(np.repeat(np.arange(len(texts)), size), np.isin(points, [ord(c) for c in chars]), len(texts))


def features(urls: list[str], hosts: list[str], paths: list[str], known: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each URL. known: a row of STATS for each URL."""
    out = np.zeros((len(urls), len(FEATURES)))
    if not urls:
        return out
    size, points = _points(urls)
    row = np.repeat(np.arange(len(urls)), size)
    of = _counted
    out[:, 0], out[:, 1], out[:, 2] = size, list(map(len, hosts)), list(map(len, paths))
    parts = [[x for x in p.split("/") if x] for p in paths]
    out[:, 3], out[:, 14] = list(map(len, parts)), [len(x[-1]) if x else 0 for x in parts]
    out[:, 4] = of(hosts, ".") + 1
    out[:, 5] = of(urls, "0123456789") / np.maximum(1, size)
    out[:, 6] = of(hosts, "0123456789") / np.maximum(1, out[:, 1])
    # Entropy: runs of one character within a URL's sorted characters.
    both = np.sort(row.astype(np.int64) << 32 | points)
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    share = np.diff(np.append(new, len(both))) / np.maximum(1, size)[both[new] >> 32] if len(both) else np.zeros(0)
    out[:, 7] = -np.bincount(both[new] >> 32, share * np.log2(share), len(urls)) if len(both) else 0
    out[:, 8] = of([u.partition("?")[2].partition("#")[0] for u in urls], "=&")
    out[:, 9] = of(urls, "-_")
    out[:, 10], out[:, 11] = known[:, 0], np.log1p(known[:, 1])
    out[:, 12], out[:, 13] = known[:, 2], np.log1p(known[:, 3])
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 20) -> dict:
    """Gradient-boosted trees for log loss, on quantile histograms. y in 0..1."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    start = math.log(mean / (1 - mean))
    score, found = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-9
        node, splits = np.zeros(len(y), int), {}
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                at = node * BINS + binned[:, f]
                gs, hs, ns = (np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones(len(y))))
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(ns < least) | (ns[:, -1:] - ns < least)] = 0
                k = gain.argmax(1)
                for n in np.flatnonzero(gain[np.arange(width), k] > best):
                    if k[n] < len(cuts[f]):
                        best[n] = gain[n, k[n]]
                        splits[level, int(n)] = (f, int(k[n]))
            step = np.zeros(len(y), int)
            for n in range(width):
                if (level, n) in splits:
                    f, k = splits[level, n]
                    mine = node == n
                    step[mine] = binned[mine, f] > k
            node = 2 * node + step
        leaf = np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1) * rate
        score += leaf[node]
        found.append(({k: (f, float(cuts[f][c])) for k, (f, c) in splits.items()}, leaf))
    return {"start": start, "trees": found, "depth": depth}


def scored(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability that each row is allowed."""
    score = np.full(len(x), model["start"])
    for splits, leaf in model["trees"]:
        node = np.zeros(len(x), int)
        for level in range(model["depth"]):
            step = np.zeros(len(x), int)
            for n in range(1 << level):
                if (level, n) in splits:
                    f, cut = splits[level, n]
                    step[node == n] = x[node == n, f] > cut
            node = 2 * node + step
        score += leaf[node]
    return 1 / (1 + np.exp(-score))


def training_rows(drawn: list) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of distinct labelled URLs, with rates that leave out the URL's own rows and, for the suffix, its domain's."""
    y = np.array([r["label"] == "allow" for r in drawn], float)
    count = lambda c: np.array([r[c] for r in drawn], float)
    a, m, own = count("a"), count("m"), count("own")
    known = np.stack([(count("suffix_a") - a + 1) / (count("suffix_m") - m + 2), count("suffix_n"), (a - own * y + 1) / (m - own + 2), count("domain_n")], 1)
    return features(*([r[c] for r in drawn] for c in ("url", "host", "path")), known), y


def fitted(drawn: list) -> dict:
    """The model of labelled URLs; without any, or with labels of one kind only, that kind (or allow) for all."""
    y = np.array([r["label"] == "allow" for r in drawn], float)
    if not len(y) or y.min() == y.max():
        return {"start": 5.0 if not len(y) or y.mean() >= 0.5 else -5.0, "trees": [], "depth": 0}
    return boost(*training_rows(drawn))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and allowed (the model's probability; null where a rule fits).

    The labels are the rules' verdicts. Suffix and domain statistics count all rows, exactly; the trees are fitted on about
    `sample` distinct labelled URLs at most, those under a bound of the hash that follows from their number. The rates that a
    fitted URL is shown leave out its own rows, and its suffix's those of its domain, so that no label can be read off them.
    Null URLs and those without "://" have empty host and path and
    go to the model, like any other. Without labelled URLs, or with labels of one kind only, that kind (or allow) is the verdict.
    Repeated rows are each judged, alike; an empty table gives an empty result."""
    spark = pages.sparkSession
    prepare(spark)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "label": verdict, "domain": F.substring_index("host", ".", -2)})
    by_domain = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count("label").alias("m"), F.count_if(F.col("label") == "allow").alias("a"))
    by_domain = by_domain.withColumn("suffix", F.substring_index("domain", ".", -1))
    by_suffix = by_domain.groupBy("suffix").agg(*(F.sum(c).alias(f"suffix_{c}") for c in "nma"))
    share = lambda a, m: (F.col(a) + 1) / (F.col(m) + 2)
    raw = ["a", "m", "suffix_a", "suffix_m"]
    stats = by_domain.join(by_suffix, "suffix").select("domain", share("suffix_a", "suffix_m").alias("suffix_rate"), "suffix_n", share("a", "m").alias("domain_rate"), F.col("n").alias("domain_n"), *raw)
    hot = F.broadcast(stats.where(F.col("domain_n") >= HOT * rows.count()))

    def known(some: DataFrame) -> DataFrame:
        """With STATS; the few domains of many rows are joined apart, so that none lands in one task."""
        rest = some.join(hot.select("domain"), "domain", "left_anti").join(stats, "domain")
        return some.join(hot, "domain").unionByName(rest)

    labelled = rows.where("label is not null").groupBy("url", "host", "path", "domain", "label").agg(F.count("*").alias("own"))
    size = labelled.count()
    if size > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 32)) < int(sample / size * (1 << 32)))
    model = fitted(sorted(known(labelled).collect(), key=lambda r: r["url"]))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            u, h, p = ([x or "" for x in batch.column(i).to_pylist()] for i in (1, 2, 3))
            x = features(u, h, p, np.stack([batch.column(i).to_numpy().astype(float) for i in range(6, 10)], 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array(scored(model, x))], ["page_id", "host", "path", "rule", "label", "allowed"])

    out = known(rows).select("page_id", "url", "host", "path", "rule", "label", *STATS).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, label string, allowed double")
    ruled = F.col("rule").isNotNull()
    return out.select("page_id", "host", "path", "rule", F.when(ruled, F.col("label")).when(F.col("allowed") >= 0.5, "allow").otherwise("block").alias("verdict"), F.when(~ruled, F.col("allowed")).alias("allowed"))
