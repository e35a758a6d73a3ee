"""Decontamination, importance resampling and clustering against brute-force versions, on whole small tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ampliscope.llm import clusters, leaks, queries, resample
from tests.conftest import same

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, n_words string, spans string, rank int, `a.b` string, row string"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


LEAK = "the quick brown fox jumps over a lazy dog near the river bank today"
ODD = [
    None, "", " \n,;", "One", "one two", LEAK, LEAK, LEAK.upper() + "!", "x " + LEAK.replace(" ", ", ") + " y", LEAK[:-12], LEAK + " " + LEAK, "z" * 5000, "café  你好 " * 30, "a1 b2 " * 40,
    " ".join(f"w{i}" for i in range(200)), "the quick brown fox jumps over a lazy dog near and then jumps over a lazy dog near the river bank", "one one one one", "K K İ i",
]
ITEMS = [(1, LEAK), (2, "One, two!"), (3, None), (4, ""), (5, " ".join(f"W{i}" for i in range(50, 100))), (5, "b2 a1 " * 8), (10, LEAK), (None, "café  你好"), (7, "w3"), (9, "nowhere to be seen at all in any of these documents here")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "n", "s", i, f"dot{i}", "r") for i, t in enumerate(ODD)]
    rows += [rows[5], (None, LEAK + " and more words to have twenty of them in this text at least", None, None, None, None, None), (None,) * 7]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def slow_leaks(texts, items, size=10):
    """(words, hit words, items) of each text, by comparing every window with every place."""
    phrases = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    lengths = {len(p) for p in phrases}
    for t in texts:
        w, hit, seen = words(t), set(), set()
        for k in range(len(w)):
            for m in lengths:
                if k + m <= len(w) and (found := phrases.get(tuple(w[k : k + m]))):
                    hit |= set(range(k, k + m))
                    seen |= found
        yield len(w), hit, seen


def check_leaks(df, items, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = Counter((i, n, tuple(sorted(hit)), tuple(sorted(seen))) for (i, _), (n, hit, seen) in zip(rows, slow_leaks([t for _, t in rows], [(r["item_id"], r["text"]) for r in items.collect()])))
    got = Counter()
    for r in leaks.contaminated(df, items, owner="t11", **how).collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        got[r["doc_id"], r["n_words"], tuple(k for a, b in spans for k in range(a, b)), tuple(sorted(r["items"]))] += 1
    assert got == want


def test_contaminated(spark, sf_dir):
    check_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@pytest.mark.parametrize("block", [leaks.BLOCK_BYTES, 100])
def test_contaminated_odd_rows(odd, items, block):
    check_leaks(odd, items, block_bytes=block)
    check_leaks(odd, items.limit(0), block_bytes=block)
    check_leaks(odd.limit(0), items, block_bytes=block)
    check_leaks(odd, items.where("item_id = 5"), block_bytes=block)


def test_long_items_and_texts(spark, monkeypatch):
    """An item beyond one piece, a document above 1 MiB and several shards a task."""
    rng = np.random.default_rng(1)
    item = [f"v{x}" for x in rng.integers(0, 900, 3 * leaks.PIECE_WORDS + 5)]
    texts = [" ".join(item[a:b]) for a, b in ((0, 10), (leaks.PIECE_WORDS - 5, leaks.PIECE_WORDS + 5), (3 * leaks.PIECE_WORDS - 6, 3 * leaks.PIECE_WORDS + 5), (7, 16))] + [" ".join(f"v{x}" for x in rng.integers(0, 900, 300_000)) + " " + " ".join(item[100:140])]
    assert len(texts[-1]) > 1 << 20
    monkeypatch.setattr(leaks, "SHARD_WORDS", 10)
    check_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))


def test_a_common_phrase_in_a_third_of_the_rows(spark):
    data = [(i, LEAK if i % 3 == 0 else f"text {i} of its own") for i in range(3000)]
    found = leaks.contaminated(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, LEAK) for i in range(20)], "item_id long, text string"), owner="t11")
    assert found.where("size(items) = 20 and size(spans) = 1").count() == 1000 == found.where("size(spans) > 0").count()


def test_decontaminated(odd, items):
    found = leaks.decontaminated(odd, items, owner="t11")
    assert found.dtypes == odd.dtypes
    rows = sorted(odd.collect(), key=str)
    want = []
    for r, (_, hit, _) in zip(rows, slow_leaks([r["text"] for r in rows], ITEMS)):
        t = r["text"]
        if hit:
            at = [m.span() for m in re.finditer(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t))]
            gone = {x for k in hit for x in range(*at[k])} | {x for k in hit if k + 1 in hit for x in range(at[k][1], at[k + 1][0])}
            t = "".join(c for x, c in enumerate(t) if x not in gone)
        want.append((*r[:1], t, *r[2:]))
    assert Counter(map(tuple, found.collect())) == Counter(want)


@pytest.mark.parametrize("top", [1, 2, 5, 70])
def test_index_finds_all_occurrences(top):
    rng = np.random.default_rng(top)
    stretches = [rng.integers(1, top + 1, n).tolist() for n in rng.integers(1, 60, 30)]
    stretches += [stretches[0]] * 5 + [[1] * 40]
    text = np.array([x for s in stretches for x in [*s, 0]])
    index = leaks.Index(text)
    order = sorted(range(len(text)), key=lambda p: [*((1, x) for x in text[p : p + list(text[p:]).index(0)]), (0, p + list(text[p:]).index(0))])
    assert leaks.suffix_order(text).tolist() == order
    assert index.locate(np.arange(len(text))).tolist() == order
    for m in (1, 2, 3, 10, 30):
        asked = np.array([s[:m] for s in stretches if len(s) >= m] + [[top + 1] * m, rng.integers(1, top + 1, m).tolist()])
        for phrase, lo, hi in zip(asked.tolist(), *index.search(asked)):
            want = [p for p in range(len(text) - m + 1) if text[p : p + m].tolist() == phrase]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def slow_resample(rows, target, percent=25, buckets=10_000, longest=2):
    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)], len(w)

    own, aim = [grams(t) for _, t in rows], [grams(t)[0] for t in target]
    raw, want = Counter(b for g, _ in own for b in g), Counter(b for g in aim for b in g)
    n_raw, n_want = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (n_raw + buckets) / ((raw[b] + 1) * (n_want + buckets))))
    out = []
    for (i, _), (g, n) in zip(rows, own):
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = able[: percent * len(able) // 100]
    return Counter((*r[:4], None) for r in out if not any(r is d for d in drawn)) + Counter((*r[:4], k + 1) for k, r in enumerate(drawn))


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_resampled_odd_rows(odd, items, longest):
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    for df, target in ((odd, items), (odd, items.limit(0)), (odd.limit(0), items), (odd.where("doc_id is null"), items)):
        found = resample.resampled(df, target, owner="t12", percent=60, longest=longest)
        assert found.columns == ["doc_id", "spans", "a.b", "row", "n_words", "n_features", "weight", "score", "rank"]
        want = slow_resample([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in target.collect()], 60, longest=longest)
        assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == want
    kept = resample.drawn(odd, items, owner="t12", percent=60)
    assert kept.dtypes == odd.dtypes and 0 < kept.count() < odd.count()


def test_resampled_long_texts(spark):
    data = [(i, ("w" * (n % 300 + 1) + f"{n} ") * 2 + " ".join(f"{'ab' * (n % 40)}{k}" for k in range(n))) for i, n in enumerate((200_000, 30, 90, 70))] + [(9, "y" * 1_200_000 + " end")]
    assert len(data[0][1]) > 1 << 20
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = resample.resampled(df, df.where("doc_id = 2"), owner="t12", percent=50)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()) == slow_resample(data, [data[2][1]], 50)


def test_length_matrices():
    rng = np.random.default_rng(2)
    heads = [rng.bytes(n) for n in range(300)]
    for n in (0, 1, 2, 7, 64, 65, 100, 5000):
        tail = rng.bytes(n)
        got = resample.shifted(np.array([zlib.crc32(h) for h in heads], np.uint32), np.full(300, n)) ^ np.uint32(zlib.crc32(tail))
        assert got.tolist() == [zlib.crc32(h + tail) for h in heads]


def slow_clusters(data, k=8, rounds=10, dims=64):
    usable = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x) for x in map(float, v)]) for i, v in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in usable))[:k]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in usable]
        for n in range(len(centroids)):
            mine = [v for (_, v), a in zip(usable, at) if a == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    at = [place(v) for _, v in usable]
    inertia = Counter()
    for d, n in at:
        inertia[n] += d
    name = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    whole = {n: all(fits(d) is not None for d, m in at if m == n) for _, n in at}
    return Counter((i, n, fits(d), fits(inertia[n]) if whole[n] else None, fits(sum(inertia.values())) if all(whole.values()) else None, name(centroids[n])) for (i, _), (d, n) in zip(usable, at))


@pytest.mark.parametrize("spread", [1.0, 1e4, 1e9, 1e30])
def test_clustered_odd_rows(spark, spread):
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(i % 5, 0.3, 4) * (spread if i % 7 == 0 else 1)).astype(np.float32).tolist()) for i in range(90)]
    data += [(i, [1.5, -2.0, 0.25, 0.0]) for i in range(90, 140)] + [data[3], (200, None), (201, [1.0]), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf")] * 4), (None, [0.5] * 4), (205, [0.0] * 4), (206, [])]
    kind = "vec_id long, embedding array<float>, cluster string"
    df = spark.createDataFrame([(*r, "c") for r in data], kind).repartition(3)
    for part, rows in ((df, data), (df.where("vec_id < 3"), data[:3]), (df.where("vec_id between 100 and 110"), data[100:111]), (df.where("vec_id >= 200 and vec_id < 205"), []), (df.limit(0), [])):
        got = clusters.clustered(part, owner="t13", dims=4, rounds=4)
        assert Counter(map(tuple, got.collect())) == slow_clusters(rows, rounds=4, dims=4)


def test_annulus_leaves_centroids_out_and_keeps_ties():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(-5, 6, (300, 2)), rng.integers(-5, 6, (300, 2)) * 100])
    centroids = [[int(x) for x in c] for c in np.concatenate([rows[::20], rows[:30:20], [[3, 4], [4, 3], [-3, 4], [0, 5]]])]
    best, least, computed = clusters.nearest(rows, centroids)
    want = [min((sum((a - b) ** 2 for a, b in zip(r, c)), n) for n, c in enumerate(centroids)) for r in rows.tolist()]
    assert list(zip(least.astype(int).tolist(), best.tolist())) == want
    assert computed < 0.65 * len(rows) * len(centroids)


@pytest.mark.parametrize("name", ["op11_leaks", "op12_resample", "op13_clusters"])
def test_new_queries_equal_their_sql(spark, sf_dir, duck, name):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.SQL[name])
