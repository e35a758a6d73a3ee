import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ampliscope.functions import cost, scalars
from ampliscope.operators import amplify, bon, choose, corpus, lineage, pairs, pools, regress, selections, trends
from ampliscope.plans import models, search
from ampliscope.sources.banks import Bank, events_bank

ROWS = [("p", i, float(r), [g]) for i, (r, g) in enumerate(zip([1, 2, 2, 3], [0, 1, 0, 1]))]


def bank(spark, rows=ROWS, attrs=("a",)):
    return Bank(spark.createDataFrame([(0, *r) for r in rows], "topic_id int, prompt string, image_id int, reward double, g array<int>"), attrs)


def amp(b, n=2, mode="bon", policy="absent"):
    return amplify.amplification(amplify.scored(b, n, mode), n, mode, policy).first()["a_hat"]


def test_golden_prompt(spark):
    b = bank(spark)
    u = [r["u"] for r in regress.with_u(b.images).orderBy("image_id").collect()]
    assert u == [0.25, 0.75, 0.75, 1.0]
    assert [r["u"] for r in b.images.select("image_id", amplify.rank_u(["prompt"]).alias("u")).orderBy("image_id").collect()] == [0.25, 0.5, 0.75, 1.0]
    assert amp(b) == pytest.approx(0.1875)
    assert amp(b, mode="kl") == pytest.approx(0.25)
    fit = regress.one_label(regress.with_u(b.images), 0).first()
    assert (fit["w"], fit["r2"]) == (pytest.approx(0.375), pytest.approx(0.473684, abs=1e-6))
    prev = {r["n"]: r["prev"] for r in bon.curve(b.images, ("a",), [1, 2, 4]).collect()}
    assert prev == {1: pytest.approx(0.5), 2: pytest.approx(0.75), 4: pytest.approx(1.0)}


def test_saturated_and_inapplicable_labels(spark):
    assert amp(bank(spark, [(p, i, r, [1]) for p, i, r, _ in ROWS])) == 0
    third = [(p, i, r, [-1] if i == 2 else g) for p, i, r, g in ROWS]
    assert amp(bank(spark, third), policy="raw") == pytest.approx(0.15625)
    assert amp(bank(spark, third)) == pytest.approx(0.1875)
    only = bank(spark, [("p", i, float(i), [-1]) for i in range(3)])
    assert amplify.amplification(amplify.scored(only), policy="raw").count() == 0
    with pytest.raises(ValueError):
        amplify.na(F.col("g"), "other")


def test_single_image_prompt_is_skipped(spark):
    assert amplify.amplification(amplify.scored(bank(spark, [("p", 0, 1.0, [1])]))).count() == 0


def test_amplification_properties(spark, sf_dir):
    b = events_bank(spark, sf_dir)
    a = {r["attr"]: r["a_hat"] for r in amplify.amplification(amplify.scored(b)).collect()}
    flipped = Bank(b.images.withColumn("g", F.transform("g", lambda x: 1 - x)), b.attrs)
    for r in amplify.amplification(amplify.scored(flipped)).collect():
        assert r["a_hat"] == pytest.approx(-a[r["attr"]], abs=1e-12)
    per = amplify.scored(b).groupBy("attr", "prompt").agg((2 * F.covar_pop("g", "s")).alias("c")).groupBy("attr").agg(F.avg("c").alias("c"))
    for r in per.collect():
        assert r["c"] == pytest.approx(a[r["attr"]], abs=1e-12)
    long = amplify.amplification(amplify.scored(b.long()))
    for r in long.collect():
        assert r["a_hat"] == pytest.approx(a[r["attr"]], abs=1e-12)


def test_curve_properties(spark, sf_dir):
    b = events_bank(spark, sf_dir)
    mass = bon.winner_mass(b.images, [1, 4, 64]).groupBy("prompt", "n").agg(F.sum("mass").alias("s"))
    assert mass.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    exact = {(r["attr"], r["n"]): r["prev"] for r in bon.curve(b.images, b.attrs, [1, 8]).collect()}
    drawn = bon.curve_mc(b.images, b.attrs, [1, 8], trials=60)
    for r in drawn.collect():
        assert r["prev"] == pytest.approx(exact[r["attr"], r["n"]], abs=0.08)


def test_fits_agree_with_numpy(spark, sf_dir):
    b = events_bank(spark, sf_dir)
    images = regress.with_u(b.images).persist()
    fits = regress.per_prompt(images, 5)
    found = {r["prompt"]: r for r in fits.collect()}
    e = {(r["prompt"], r["image_id"]): r["e"] for r in regress.residuals(images, fits).collect()}
    loo = {a: [] for a in b.attrs}
    for prompt, frame in images.toPandas().groupby("prompt"):
        g, u = np.array(frame["g"].tolist(), float), frame["u"].to_numpy()
        g, u = g - g.mean(0), u - u.mean()
        w = np.linalg.lstsq(g, u, rcond=1e-10)[0]
        assert np.allclose(found[prompt]["w"], w, atol=1e-9)
        assert found[prompt]["r2"] == pytest.approx(1 - (u - g @ w).var() / u.var(), abs=1e-9)
        assert np.allclose([e[prompt, i] for i in frame["image_id"]], u - g @ w, atol=1e-9)
        for k, a in enumerate(b.attrs):
            rest = np.delete(g, k, 1)
            left = u - rest @ np.linalg.lstsq(rest, u, rcond=1e-10)[0]
            loo[a].append((g[:, k] * left).mean())
    for r in regress.leave_one_out(regress.grams(images, 5), b.attrs, b.attrs).collect():
        assert r["loo"] == pytest.approx(2 * np.mean(loo[r["attr"]]), abs=1e-9)
    removed, kept = regress.pruned(images, b.attrs, 0.0)
    assert len(kept) == 1 or min(kept.values()) > 0
    assert len(removed) + len(kept) == 5
    w, explained = regress.pooled(images, 5)
    assert 0 <= explained <= 1 and len(w) == 5


def test_degenerate_fits(spark):
    flat = bank(spark, [("p", i, 1.0, [i % 2]) for i in range(4)])
    assert regress.per_prompt(regress.with_u(flat.images), 1).first()["r2"] == 0
    twice = bank(spark, [("p", i, float(r), [g, g]) for i, (r, g) in enumerate(zip([1, 2, 2, 3], [0, 1, 0, 1]))], ("a", "b"))
    assert regress.per_prompt(regress.with_u(twice.images), 2).first()["w"] == [pytest.approx(0.1875), pytest.approx(0.1875)]
    few = bank(spark, [("p", 0, 1.0, [0, 1, 0]), ("p", 1, 2.0, [1, 0, 1])], ("a", "b", "c"))
    assert regress.per_prompt(regress.with_u(few.images), 3).first()["w"] == [0, 0, 0]


@pytest.fixture(scope="module")
def crowd(spark):
    """Prompts of 0 to 60 images with ties, null rewards and inapplicable labels, and all their pairs by loops."""
    rng = np.random.default_rng(8)
    rows = []
    for p, n in enumerate([60, 25, 1, 8, 12, 30]):
        for _ in range(n):
            reward = None if rng.random() < 0.08 else float(rng.integers(0, 12)) / 2
            rows.append((p, len(rows), reward, [int(x) for x in rng.choice([0, 0, 1, 1, -1], 3)], float(rng.integers(0, 9)) / 8))
    images = spark.createDataFrame(rows, "prompt long, image_id long, reward double, g array<int>, score double").persist()
    found = []
    for k, attr in enumerate("abc"):
        for p, i, r, g, s in rows:
            for q, j, t, h, u in rows:
                if p == q and g[k] == 1 and h[k] == 0:
                    found.append((p, attr, i, j, sum(x != y for x, y in zip(g, h)) - 1, r, t, s, u))
    return images, found


ABC = ("a", "b", "c")
PAIR = ["prompt", "attr", "pos_id", "neg_id", "h", "pos_reward", "neg_reward"]


def grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def wins(r):
    return r[5] is not None and r[6] is not None and r[5] > r[6]


def test_crossed_has_all_pairs(crowd):
    images, found = crowd
    assert sorted(tuple(r) for r in pairs.crossed(images, ABC).select(*PAIR, "pos_score", "neg_score").collect()) == sorted(found)
    near = pairs.crossed(images.drop("score"), ABC, ("a", "c"), max_h=1)
    assert sorted(tuple(r) for r in near.select(*PAIR).collect()) == sorted(r[:7] for r in found if r[4] <= 1 and r[1] != "b")


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("higher", [False, True])
def test_closest_pairs(crowd, k, higher):
    images, found = crowd
    want = set()
    for own in grouped([r for r in found if wins(r) or not higher], lambda r: r[:2]).values():
        own.sort(key=lambda r: (r[4], r[2], r[3]))
        want |= {(*r[:5], i) for i, r in enumerate(own[:k], 1)}
    got = pairs.closest(images, ABC, k, higher).select(*PAIR[:5], "rank").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("k", [1, 4])
def test_identical_pairs(crowd, k):
    images, found = crowd
    want = set()
    for own in grouped([r for r in found if r[4] == 0 and None not in r[5:7]], lambda r: r[:2]).values():
        own.sort(key=lambda r: (-abs(r[5] - r[6]), r[2], r[3]))
        want |= {(*r[:4], i) for i, r in enumerate(own[:k], 1)}
    got = pairs.identical(images, ABC, k).select(*PAIR[:4], "rank").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_totals_are_the_summary_of_all_pairs(crowd):
    images, found = crowd
    got = {r["attr"]: r for r in pairs.totals(images, ABC).collect()}
    for attr, own in grouped(found, lambda r: r[1]).items():
        gaps = [r[5] - r[6] for r in own if None not in r[5:7]]
        r = got[attr]
        assert (r["n_pairs"], r["n_prompts"]) == (len(own), len({x[0] for x in own}))
        assert r["mean_h"] == pytest.approx(np.mean([x[4] for x in own])) and r["mean_gap"] == pytest.approx(np.mean(gaps))


@pytest.mark.parametrize("q", [0.0, 0.3, 0.75, 1.0])
@pytest.mark.parametrize("sketch", [1e-4, 0.02])
def test_gap_caps_are_quantiles(crowd, q, sketch, monkeypatch):
    monkeypatch.setattr(pairs, "SKETCH", sketch)
    images, found = crowd
    got = {r["attr"]: r for r in pairs.gap_cap(pairs.crossed(images, ABC), q).collect()}
    for attr, own in grouped(filter(wins, found), lambda r: r[1]).items():
        assert got[attr]["cap"] == pytest.approx(np.quantile([r[5] - r[6] for r in own], q)) and got[attr]["n"] == len(own)


@pytest.mark.parametrize("mode", ["reward", "score", "score_up"])
def test_natural_pairs_follow_the_greedy_rule(spark, crowd, mode):
    """Strongest first, each takes the free opposite of least score, among the sure prompts; the cap comes from these alone."""
    images, found = crowd
    gap_of = {"reward": lambda r: r[5] - r[6], "score": lambda r: abs(r[7] - r[8]), "score_up": lambda r: r[8] - r[7]}[mode]
    sure = {(p, a): (0.2 * p + 0.1, 0.05, 0.1 + p) for p in (0, 1, 4, 5) for a in "ab"}
    unsure = [(p, "c", 0.4, -0.1, 0.5) for p in range(6)]
    intervals = spark.createDataFrame([(*k, *v) for k, v in sure.items()] + unsure, "prompt long, attr string, w_mean double, ci_low double, ci_high double")
    want = set()
    winners = [r for r in found if wins(r) and gap_of(r) >= 0 and (r[0], r[1]) in sure]
    for attr, own in grouped(winners, lambda r: r[1]).items():
        cap = np.quantile([gap_of(r) for r in own], 0.75)
        for prompt, rows in grouped([r for r in own if r[4] <= 1 and gap_of(r) <= cap], lambda r: r[0]).items():
            used, n = set(), 0
            for pos in sorted({(-r[5], r[2]) for r in rows}):
                free = [(0.5 * r[4] + 0.5 * gap_of(r) / (cap or 1), r[3], r) for r in rows if r[2] == pos[1] and r[3] not in used]
                if free and n < 3:
                    r, n = min(free)[2], n + 1
                    used.add(r[3])
                    mean, low, high = sure[prompt, attr]
                    parts = 1 - r[4], 1 - gap_of(r) / (cap or 1), min(5, max(0, mean / (high - low))) / 5
                    want.add((attr, prompt, r[2], r[3], r[4], round(gap_of(r), 9), round(sum(parts) / 3, 9)))
    got = pairs.natural(images, ABC, intervals, 1, 0.75, 3, mode).collect()
    assert {(*tuple(r)[:5], round(r["gap"], 9), round(r["weight"], 9)) for r in got} == want and len(got) == len(want) > 10


@pytest.mark.parametrize("tolerance", [None, 0.5])
def test_matches_take_the_nearest_free_reward(crowd, tolerance):
    images, _ = crowd
    left, right = images.where("g[0] = 1"), images.where("g[0] = 0")
    want = set()
    for prompt, own in grouped(left.where("reward is not null").collect(), lambda r: r["prompt"]).items():
        free = sorted((r["reward"], r["image_id"]) for r in right.where(f"prompt = {prompt} and reward is not null").collect())
        for reward, image in sorted((r["reward"], r["image_id"]) for r in own):
            best = min(free, key=lambda f: (abs(f[0] - reward), f), default=None)
            if best and (tolerance is None or abs(best[0] - reward) <= tolerance):
                free.remove(best)
                want.add((prompt, image, best[1]))
    assert {tuple(r) for r in pairs.matched_by_reward(left, right, tolerance).collect()} == want and want


def test_pools(spark):
    pool = spark.createDataFrame([("a", 0), ("b", 1)], "attr string, pos int")
    new = spark.createDataFrame([("b", 0), ("c", 1), ("c", 2)], "attr string, pos int")
    assert [(r["attr"], r["pos"]) for r in pools.appended(pool, new).orderBy("pos").collect()] == [("a", 0), ("b", 1), ("c", 3)]
    a, b = (spark.createDataFrame([("i", "x", g)], "image_id string, attr string, g int") for g in (0, 1))
    assert pools.merged(a, b).first()["g"] == 1
    assert pools.last_wins([b, a], "image_id", "attr").first()["g"] == 0
    assert not pools.all_scored(spark.createDataFrame([], "reward double")).first()["ok"]
    assert [r["attr"] for r in pools.without(new, pool, "attr").select("attr").distinct().collect()] == ["c"]


def test_choices(spark):
    rows = spark.createDataFrame([("p", i, float(i - 2), float(i)) for i in range(5)], "prompt string, image_id int, e double, reward double")
    assert {(r["side"], r["rank"], r["image_id"]) for r in choose.extremes(rows, 1).collect()} == {("plus", 1, 4), ("minus", 1, 0)}
    assert choose.extremes(rows.where("e > 0"), 1).count() == 0
    assert choose.sampled(rows, ["prompt"], 3, "image_id").collect() == choose.sampled(rows, ["prompt"], 3, "image_id").collect()
    assert {r["label"] for r in choose.score_labels(rows, "minmax").collect()} == {"0.00", "0.25", "0.50", "0.75", "1.00"}
    with pytest.raises(ValueError):
        choose.score_labels(rows, "other")
    assert choose.random_sides(rows, 1).count() == 2


def test_corpus(spark):
    rows = spark.createDataFrame([(0, " a cat on a mat "), (1, "a cat on a mat"), (2, "short"), (3, "an 8k photo of it")], "pos int, text string")
    once = corpus.cleaned(rows)
    assert [r["pos"] for r in once.orderBy("pos").collect()] == [0, 3] and corpus.cleaned(once).count() == 2
    assert [r["pos"] for r in corpus.without_resolutions(once).collect()] == [0]
    assert corpus.short_enough(rows, 1).count() == 1
    nodes = spark.createDataFrame([(i,) for i in range(6)], "vec_id int")
    edges = spark.createDataFrame([(4, 3), (3, 1), (5, 2)], "a int, b int")
    assert {r["vec_id"]: r["component"] for r in corpus.components(nodes, edges).collect()} == {0: 0, 1: 1, 3: 1, 4: 1, 2: 2, 5: 2}
    x = spark.createDataFrame([(i, [float(i // 3 * 10), float(i)]) for i in range(6)], "vec_id int, embedding array<double>")
    assert corpus.kmeans_medoids(x, 2).count() == 2 and corpus.kmeans_medoids(x, 9).count() == 6


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalars.slug(F.lit("  A b/C! "))) == "a_b_c" and one(scalars.slug(F.lit("!!"))) == "attribute"
    assert one(scalars.verdict(F.lit('x {"applicable": false}'))) == -1
    assert one(scalars.verdict(F.lit('{"applicable": true, "present": true}'))) == 1 and one(scalars.verdict(F.lit("none"))) == 0
    assert one(scalars.quoted_proposals(F.lit('["first one", "abc", "first one", "second"]'), 5)) == ["first one", "second"]
    assert one(scalars.image_tokens(F.lit(512), F.lit(512))) == 255 and one(scalars.image_tokens(F.lit(2048), F.lit(4096))) == 85 + 170 * 6
    assert one(scalars.yes_no(F.lit(" yes, it is"))) == "YES" and one(scalars.passes_human(F.lit(None).cast("string")))
    assert one(scalars.fenced_json(F.lit('a ```json\n{"a": 1}\n``` b'))) == '{"a": 1}'
    assert one(scalars.plain(F.lit("  a  b. "))) == "a b" and one(scalars.number(F.lit("x"))) is None
    assert one(scalars.edit_instruction(F.lit("remove"), F.lit("hats."))).endswith("hats.")
    assert one(scalars.image_of_path(F.lit("a/b/baseline_x1.png"))) == "x1"
    with pytest.raises(Exception, match="unknown mode"):
        one(scalars.edit_instruction(F.lit("blur"), F.lit("x")))
    chat = spark.createDataFrame([(1, "user", "b"), (0, "system", "a"), (2, "assistant", "c")], "turn long, role string, text string").agg(scalars.history().alias("m"))
    assert chat.select(scalars.rendered(scalars.added("m", "user", F.lit("d"))).alias("x")).first()["x"] == "SYSTEM: a\nUSER: b\nASSISTANT: c\nUSER: d"
    assert '"model":"m"' in chat.select(scalars.request_body(F.lit("m"), "m", top_p=F.lit(None).cast("double")).alias("x")).first()["x"]


def test_costs():
    plan = cost.SearchPlan(train_prompts=(10, 3), steps=2, fixed_images=100, initial_pool=20, attrs_per_call=4, most_prompts=5, context_images=2, proposals=6, proposer_calls=3, proposer_images=8)
    one = cost.Price(1e6, 0)
    got = cost.search_cost(plan, one, one, one, one, one, 10, 20, 30, batched=True)
    calls = 5, 3
    assert got["planner"] == sum(calls) * (1000 + 2 * 10) and got["cluster"] == sum(calls) * 4 * 60
    assert got["humanness"] == (20 + 6 + 12 + 6) * 80 and got["detection"] == (20 + 6 + 12 + 6) * 100 * (200 + 20) / 2
    assert got["proposer"] == 2 * 3 * (600 + 8 * 30) and got["validation"] == 2 * 6 * 3 * 100 * 110 and got["total"] == sum(v for k, v in got.items() if k != "total")
    assert cost.search_cost(plan, one, one, one, one, one, local_detector=True)["detection"] == 0
    many = cost.SearchPlan(train_prompts=(10,), steps=1, fixed_images=1, initial_pool=5, prompts_per_call=4)
    assert cost.search_cost(many, cost.Price(0, 1e6), one, one, one, one)["planner"] == 3 * 15_000 and cost.search_cost(many, one, one, one, one, one)["proposer"] == 0


def test_search_runs_and_resumes(spark, sf_dir):
    b = events_bank(spark, sf_dir)
    cfg = search.SearchConfig(steps=2, tau=-1.0, tau_partial=-1.0, pool_sizes=(3, 3))
    whole = search.run(b, b.attrs[:2], cfg)
    half = search.step(b, search.SearchState(b.attrs[:2]), cfg, search.labelled_first(b))
    assert search.run(b, (), cfg, state=half).rows == whole.rows and whole.step == 2
    assert search.run(b, b.attrs[:2], search.SearchConfig(steps=1, tau=999.0, pool_sizes=(3,))).pool == ()
    with pytest.raises(ValueError):
        search.SearchConfig(steps=2, pool_sizes=(1,))


def test_models(spark):
    rows = spark.createDataFrame([("i", "p", 1.0), ("j", "p", None)], "image_id string, prompt string, reward double")
    with pytest.raises(LookupError):
        models.scored(rows, "none")
    assert models.scored(rows.where("reward is not null"), "none").count() == 1
    models.register_scorer("two", lambda r: r.withColumn("reward", F.lit(2.0)))
    assert {r["reward"] for r in models.scored(rows, "two").collect()} == {1.0, 2.0}


def test_components_of_a_long_path(spark):
    import random

    ids = list(range(300))
    random.Random(4).shuffle(ids)
    nodes = spark.createDataFrame([(i,) for i in range(302)], "vec_id long")
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (300, 999), (301, 999)], "a long, b long")
    assert {r["vec_id"]: r["component"] for r in corpus.components(nodes, edges).collect()} == {**dict.fromkeys(ids, 0), 300: 300, 301: 301}


def test_byte_chunks_never_pass_the_cap(spark):
    sizes = [40, 70, 30, 150, 10, 90, 5, 5, 100, 1]
    rows = spark.createDataFrame([("f", i, n) for i, n in enumerate(sizes)], "file string, pos long, bytes long")
    found = {r["pos"]: r["chunk"] for r in scalars.byte_chunks(rows, "file", "pos", "bytes", 100).collect()}
    assert [found[i] for i in range(10)] == [0, 1, 1, 2, 3, 3, 4, 4, 5, 6]


def test_bootstrap_resamples_centred_rows_as_they_are(spark):
    rng = np.random.default_rng(3)
    data = [(p, i, [int(x) for x in rng.integers(0, 2, 2)], float(rng.random())) for p in range(3) for i in range(12)] + [(9, i, [1, 0], 0.5) for i in range(5)]
    images = spark.createDataFrame(data, "prompt long, image_id long, g array<int>, u double")
    got = {(r["prompt"], r["attr"]): r for r in regress.bootstrap(images, ("a", "b"), 300).collect()}
    hashes = {r["prompt"]: r["h"] for r in images.select("prompt", F.xxhash64("prompt").alias("h")).distinct().collect()}
    for p in range(3):
        own = [d for d in data if d[0] == p]
        g, u = np.array([d[2] for d in own], float), np.array([d[3] for d in own])
        g, u = g - g.mean(0), u - u.mean()
        draws = np.random.default_rng([0, hashes[p] & 0x7FFFFFFF]).integers(0, len(u), (300, len(u)))
        w = np.array([np.linalg.lstsq(g[d], u[d], rcond=None)[0] for d in draws])
        for k, attr in enumerate("ab"):
            r = got[p, attr]
            assert np.allclose([r["w_mean"], r["ci_low"], r["ci_high"]], [w[:, k].mean(), np.percentile(w[:, k], 5), np.percentile(w[:, k], 95)], atol=1e-6)
    assert got[9, "a"]["ci_low"] == -np.inf and got[9, "a"]["ci_high"] == np.inf


def test_eviction_narrows_to_the_boundary(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{i}", int(t)) for i, t in enumerate(rng.integers(0, 9000, 12_000))]
    kept = {r["cache_key"] for r in pools.evicted(spark.createDataFrame(rows, "cache_key string, last_used long"), 10_000).collect()}
    assert kept == {k for k, _ in sorted(rows, key=lambda r: (r[1], r[0]))[3000:]}


@pytest.mark.parametrize("most", [10, 9_000])
def test_eviction_of_rows_of_one_time(spark, most):
    keys = [f"key{i * 7919 % 10_007:05d}" for i in range(10_000)] + ["key", "key0", "\u00e9", "a"]
    kept = {r["cache_key"] for r in pools.evicted(spark.createDataFrame([(k, 5) for k in keys], "cache_key string, last_used long"), most).collect()}
    assert kept == set(sorted(keys, key=str.encode)[len(keys) - int(most * 0.9) :])


def test_edits_count_every_task(spark):
    tasks = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, True)], "target string, image_id int, has_file boolean")
    before = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", 1), (2, "a", 0), (2, "c", 0), (3, "a", 1), (4, "a", 1)], "image_id int, attr string, g int")
    after = spark.createDataFrame([("a", 1, "a", 0), ("a", 1, "b", 0), ("a", 2, "a", 0), ("a", 2, "c", 1), ("a", 3, "a", 0), ("b", 1, "b", 1)], "target string, image_id int, attr string, g int")
    found = trends.edit_results(tasks, before, after)
    assert {(r["target"], r["image_id"], r["edited"], r["original"], r["success"], r["error"]) for r in found.collect()} == {("a", 1, 0, 1, True, None), ("a", 2, 0, 0, True, None), ("a", 3, None, 1, False, "no edited file"), ("a", 4, None, 1, False, None), ("b", 1, 1, 1, False, None)}
    assert {tuple(r) for r in trends.edit_success(found).collect()} == {("a", 4, 2, 1), ("b", 1, 0, 0)}
    assert {tuple(r) for r in trends.drift(found, before, after).select("target", "image_id", "attr", "was", "now").collect()} == {("a", 1, "b", 1, 0), ("a", 1, "c", 1, -1)}


def test_records_refuse_what_is_not_there(spark):
    attrs = spark.createDataFrame([(0, "Red car"), (1, "blue CAR"), (2, "tree")], "pos long, attr string")
    assert [r["attr"] for r in selections.selected(attrs, ["tree", "car", 0]).orderBy("place").collect()] == ["tree", "Red car", "blue CAR"]
    with pytest.raises(ValueError):
        selections.selected(attrs, ["boat"])
    files = spark.createDataFrame([(1, 3, "a"), (1, 3, "b"), (2, 1, "c")], "topic_id int, step_idx int, path string")
    with pytest.raises(ValueError):
        selections.latest_file(files)
    with pytest.raises(ValueError):
        selections.only_values(spark.createDataFrame([(1, 0.5), (2, 0.6)], "n int, prevalence double"), [1, 4])


def test_component_medoids(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(6)[:4]
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.05, 6)).tolist()) for i in range(30) if i % 4 < 3 or i < 12]
    found = corpus.component_medoids(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, 3).collect()
    want = []
    for k in range(4):
        own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i % 4 == k]
        far = [(round(sum(1 - a @ b for _, b in own), 9), i) for i, a in own]
        want.append((min(i for i, _ in own), min(far)[1], len(own)))
    assert [tuple(r) for r in found] == sorted(want)[:3]


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from ampliscope.__main__ import main

    assert main(["largest_groups", sf_dir, str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert main(["no_such_query", sf_dir]) == 2 and "amp_bon_n2" in capsys.readouterr().out


def test_places_over_all_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(int(p), float(rng.integers(0, 4))) for p in rng.permutation(500)]
    r2 = spark.createDataFrame(rows, "prompt long, r2 double").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["prompt"]: r["idx"] for r in lineage.placed(r2, F.col("r2"), F.col("prompt")).collect()}
    assert got == {p: i for i, (p, _) in enumerate(order)}
    band = {r["prompt"] for r in choose.middle_band(r2, 0.2, 0.6, 150, 1).collect()}
    assert band == {order[100 + i % 200][0] for i in range(150, 300)}
    assert lineage.placed(r2.where("prompt < 0"), F.col("r2"), F.col("prompt")).count() == 0
    assert choose.middle_band(r2.where("prompt < 0"), 0.2, 0.6, 3).count() == 0


def test_blocks_give_all_similar_pairs_and_silhouettes(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(70, 4))
    x[5], x[9], x[11] = x[4], 0, x[12] * 3
    label = [i % 3 for i in range(69)] + [9]
    rows = [(i, label[i], [float(v) for v in x[i]]) for i in range(70)]
    odd = [(100, 0, None), (101, 1, [1.0, None, 2.0, 0.0]), (102, 2, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    norm = np.linalg.norm(x, axis=1)
    u = x / np.where(norm > 0, norm, 1)[:, None]
    want = {(i, j): float(u[i] @ u[j]) for i in range(70) for j in range(i + 1, 70) if u[i] @ u[j] >= 0.7}
    got = corpus.similar_pairs(table, 0.7).collect()
    assert len(got) == len(want) and all(abs(want[r["a"], r["b"]] - r["cosine"]) < 1e-9 for r in got)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    scores = []
    for i in range(70):
        to = {c: [dist[i, j] for j in range(70) if j != i and label[j] == c] for c in set(label)}
        near = min(np.mean(to[c]) for c in to if c != label[i])
        own = to[label[i]]
        scores.append((near - np.mean(own)) / max(near, np.mean(own)) if own else 0)
    whole = table.where("vec_id < 70")
    assert corpus.silhouettes(whole).first()[0] == pytest.approx(np.mean(scores), abs=1e-9)
    assert corpus.silhouettes(whole.where("vec_id < 0")).first()[0] is None and corpus.similar_pairs(whole.where("vec_id < 0"), 0.1).count() == 0


def test_pruning_by_hand(spark):
    """Leave-one-out scores and removals against fits with numpy, one label after the other."""
    rng = np.random.default_rng(11)
    rows = []
    for p in range(5):
        g = rng.integers(0, 2, (30, 4))
        g[:, 3] = g[:, 0]  # a copy: the first of the two goes
        reward = g @ [1.0, 0.2, 0.0, 1.0] + rng.normal(size=30)
        rows += [(p, 100 * p + i, float(r), [int(v) for v in x]) for i, (r, x) in enumerate(zip(reward, g))]
    images = regress.with_u(spark.createDataFrame(rows, "prompt int, image_id int, reward double, g array<int>"))
    data = {p: [(r[2], r[3]) for r in rows if r[0] == p] for p in range(5)}

    def scores(pool):
        out = dict.fromkeys(pool, 0.0)
        for own in data.values():
            rewards = np.array([r for r, _ in own])
            u = np.array([(rewards <= r).mean() for r in rewards])
            u = u - u.mean()
            g = np.array([x for _, x in own], float)
            g = g - g.mean(0)
            for a in pool:
                rest = ["abcd".index(b) for b in pool if b != a]
                e = u - g[:, rest] @ np.linalg.lstsq(g[:, rest], u, rcond=None)[0] if rest else u
                out[a] += 2 * (g[:, "abcd".index(a)] * e).mean() / len(data)
        return out

    pool, removed = list("abcd"), []
    while len(pool) > 1:
        now = scores(pool)
        worst = min(pool, key=lambda a: (round(now[a], 12), pool.index(a)))
        if now[worst] > 0.002:
            break
        removed.append((len(removed) + 1, worst, pytest.approx(now[worst], abs=1e-9)))
        pool.remove(worst)
    got, kept = regress.pruned(images, tuple("abcd"), 0.002)
    assert len(removed) >= 2 and kept == pytest.approx(scores(pool), abs=1e-9)
    assert [(r, x) for r, _, x in got] == [(r, x) for r, _, x in removed] and {a for _, a, _ in got} | set(kept) == set("abcd")


def test_silhouettes_of_several_k_and_medoids_by_hand(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.4, (20, 3)) for c in ([0, 0, 0], [4, 0, 0], [0, 4, 0])])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for k in (2, 3, 5):
        model = KMeans(k=k, seed=42).fit(rows.select("vec_id", array_to_vector("embedding").alias("features")))
        found = model.transform(rows.select("vec_id", array_to_vector("embedding").alias("features"))).orderBy("vec_id").collect()
        c = np.array([r["prediction"] for r in found])
        s = []
        for i in range(len(x)):
            own = (c == c[i]) & (np.arange(len(x)) != i)
            if not own.any():
                s.append(0.0)
                continue
            a, b = far[i, own].mean(), min(far[i, c == d].mean() for d in set(c) - {c[i]})
            s.append((b - a) / max(a, b))
        want[k] = np.mean(s)
        centres = np.array(model.clusterCenters())
        near = {int(min(np.flatnonzero(c == d), key=lambda i: (((x[i] - centres[d]) ** 2).sum(), i))) for d in range(k)}
        assert {r["vec_id"] for r in corpus.kmeans_medoids(rows, k).collect()} == near
    got = corpus.best_k(rows, [2, 3, 5, 60]).collect()
    assert [(r["k"], r["silhouette"]) for r in got] == [(k, pytest.approx(v)) for k, v in sorted(want.items(), key=lambda z: -z[1])] and got[0]["k"] == 3
    labels = corpus.kmeans_labels(rows, 3).collect()
    assert sorted({r["cluster"] for r in labels}) == [0, 1, 2] and len(labels) == 60
    assert {r["vec_id"] for r in corpus.kmeans_medoids(rows, 60).collect()} == set(range(60))


def test_draws_move_an_image_once(spark):
    rng = np.random.default_rng(8)
    rows = [(p, i, None if i == 5 else float("nan") if (p, i) == (1, 7) else float(rng.integers(0, 6)), [int(rng.integers(-1, 2)), None if i % 4 == 0 else 1]) for p, m in ((1, 90), (2, 3), (None, 11), (4, 1)) for i in range(m)]
    images = spark.createDataFrame(rows, "prompt int, image_id int, reward double, g array<int>").repartition(3)
    each = images.where("reward is not null").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(19))))
    pos = F.row_number().over(Window.partitionBy("prompt", "trial").orderBy(F.xxhash64("prompt", "image_id", "trial", F.lit(3)), "image_id"))
    drawn = each.withColumn("pos", pos).withColumn("n", F.explode(F.array(*map(F.lit, [1, 2, 8])))).where("pos <= n")
    won = drawn.groupBy("prompt", "trial", "n").agg(F.max_by("g", F.struct("reward", F.negative("pos"))).alias("g"))
    want = {(a, r["n"]): r[a] for r in won.groupBy("n").agg(*(F.avg((F.coalesce(F.col("g")[i], F.lit(0)) == 1).cast("int")).alias(a) for i, a in enumerate("xy"))).collect() for a in "xy"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a prompt spans batches
    try:
        found = bon.curve_mc(images, ("x", "y"), [8, 1, 2], 20, 3)
        assert {(r["attr"], r["n"]): r["prev"] for r in found.collect()} == want and len(want) == 6
        assert bon.curve_mc(images.where("prompt > 4"), ("x", "y"), [1], 20).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.split("MapInArrow")[1].count("explode") == 0  # before: a row an image and trial


def test_drift_by_image_moves_an_image_once(spark, sf_dir):
    from ampliscope.plans import records

    results, before, after = records._edits(spark, sf_dir)
    found = trends.drift_by_image(records._edited_images(spark, sf_dir))
    columns = ["target", "image_id", "attr", "was", "now"]
    want = trends.drift(results, before, after).select(columns)
    assert want.count() == found.count() > 1000 and want.exceptAll(found.select(columns)).count() == 0
    rows = [(1, [("a", 1), ("b", 1), ("c", 1), ("d", None)], [("a", True, [("a", 0), ("b", 0), ("c", None)]), ("b", False, [("b", 0)]), ("c", None, [("c", 0)]), ("z", True, [])])]
    images = spark.createDataFrame(rows, "image_id int, before array<struct<attr: string, g: int>>, edits array<struct<target: string, has_file: boolean, after: array<struct<attr: string, g: int>>>>")
    assert {tuple(r) for r in trends.drift_by_image(images).select(columns).collect()} == {("a", 1, "b", 1, 0), ("a", 1, "c", 1, -1)}
    plan = records.QUERIES["side_effect_drift"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == plan.count("Exchange ") - 1 == 1 and "Join" not in plan  # and the few counts


def test_silhouettes_leave_blocks_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 8)
    rows = [(i, str(i % 3), [float(i % 3), float(i * i % 7)]) for i in range(40)] + [(i, "x" if i % 2 else "y", [float(i)]) for i in range(40, 50)]
    plan = corpus.silhouettes(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    scores = []
    for i, c, v in rows:
        to = {}
        for j, o, w in rows:
            if j != i and len(w) == len(v):
                to.setdefault(o, []).append(float(np.linalg.norm(np.subtract(v, w))))
        a, b = np.mean(to[c]), min(np.mean(x) for o, x in to.items() if o != c)
        scores.append((b - a) / max(a, b))
    assert plan.first()[0] == pytest.approx(np.mean(scores), abs=1e-9)
    assert "explode" not in plan._jdf.queryExecution().optimizedPlan().toString()  # before: a copy of each row for every block
