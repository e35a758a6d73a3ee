"""All registered queries of the analytics engine on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import amplify, bon, choose, corpus, pairs, pools, regress, reports, sides
from ..sources import banks
from ..sources.banks import D_LONG, E_ATTRS, E_LONG, E_WIDE, L_LONG, T_LONG, documents_bank, events_bank, lineitem_bank, table
from . import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N_VALUES = [1, 2, 4, 8, 16, 32]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show; a negative zero becomes zero."""
    return df.select(*(((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)) for c, kind in df.dtypes))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _amp_sql(bank: str, n: int = 2, g: str = "g", kl: bool = False) -> str:
    s = "reward" if kl else f"pow(cume_dist() over (partition by attr, prompt order by reward), {n - 1})"
    return f"""with {bank}, u as (select attr, prompt, {g} g, {s} s from bank),
per as (select attr, prompt, count(*) n, count(*) filter (g = 1) n1, count(*) filter (g = 0) n0, avg(s) filter (g = 1) s1, avg(s) filter (g = 0) s0 from u group by 1, 2),
c as (select *, {1 if kl else n} * (n1 / n) * (n0 / n) * coalesce(s1 - s0, 0) c from per where n >= 2 and n1 + n0 > 0)
select attr, count(*) n_prompts, round(avg(n1 / n), 6) p1, round(avg(n0 / n), 6) p0, round(avg(c), 6) + 0.0 a_hat from c group by 1"""


ABSENT = "case when g = -1 then 0 else g end"


def _amp(bank, n=2, mode="bon", policy="absent"):
    return amplify.amplification(amplify.scored(bank, n, mode), n, mode, policy)


@query(_amp_sql(E_LONG))
def amp_bon_n2(spark, d):
    return _amp(events_bank(spark, d))


@query(_amp_sql(E_LONG, 8))
def amp_bon_n8(spark, d):
    return _amp(events_bank(spark, d), 8)


@query(_amp_sql(E_LONG, kl=True))
def amp_kl(spark, d):
    return _amp(events_bank(spark, d), mode="kl")


@query(_amp_sql(T_LONG))
def amp_na_raw(spark, d):
    return _amp(events_bank(spark, d, tri=True), policy="raw")


@query(_amp_sql(T_LONG, g=ABSENT))
def amp_na_absent(spark, d):
    return _amp(events_bank(spark, d, tri=True))


@query(_amp_sql(T_LONG, g="abs(g)"))
def amp_na_present(spark, d):
    return _amp(events_bank(spark, d, tri=True), policy="present")


@query(_amp_sql(D_LONG))
def amp_missing_labels(spark, d):
    return _amp(documents_bank(spark, d))


@query(_amp_sql(L_LONG, 4))
def amp_lineitem(spark, d):
    return _amp(lineitem_bank(spark, d), 4)


@query(f"select attr, n_prompts, p1, p0, a_hat from ({_amp_sql(L_LONG)}) where a_hat > -1 order by a_hat desc, attr limit 3")
def amp_tau_topk(spark, d):
    return amplify.survivors(rounded(_amp(lineitem_bank(spark, d))), -1.0, 3)


@query(f"with {E_LONG}, t as (select count(distinct image_id) n from bank) select attr, round(count(*) filter (g = 1) / max(n), 6) p1 from bank, t group by 1 having count(*) filter (g = 1) / max(n) between 0.2 and 0.6")
def p1_band(spark, d):
    return amplify.prevalence(events_bank(spark, d).long()).where(F.col("p1").between(0.2, 0.6))


@query(f"with {T_LONG}, m as (select attr, count(*) filter (g = 1) n1, count(*) filter (g <> 1) n0, avg(reward) filter (g = 1) mu1, avg(reward) filter (g <> 1) mu0 from bank group by 1) select attr, n1, n0, round(mu1, 6) mu1, round(mu0, 6) mu0 from m where mu1 > mu0")
def mu_filter(spark, d):
    return amplify.means_by_label(events_bank(spark, d, tri=True).long()).where("mu1 > mu0")


@query("select user_id prompt, event_id image_id, round(cume_dist() over (partition by user_id order by value), 6) u from events")
def ecdf_u(spark, d):
    return events_bank(spark, d).images.select("prompt", "image_id", amplify.ecdf(["prompt"]).alias("u"))


@query("select user_id prompt, event_id image_id, round(row_number() over (partition by user_id order by value, event_id) / count(*) over (partition by user_id), 6) u from events")
def rank_u(spark, d):
    return events_bank(spark, d).images.select("prompt", "image_id", amplify.rank_u(["prompt"]).alias("u"))


@query("select user_id prompt, event_id image_id, round_even(100 * cume_dist() over (partition by user_id order by value), 0)::int::varchar as label from events")
def score_labels(spark, d):
    return choose.score_labels(events_bank(spark, d).images, "quantile").select("prompt", "image_id", "label")


U_SQL = f"{E_WIDE}, u as (select *, cume_dist() over (partition by prompt order by reward) u from e)"


@query(f"with {U_SQL} select prompt, image_id, round(g0 - avg(g0) over (partition by prompt), 6) + 0.0 g, round(u - avg(u) over (partition by prompt), 6) + 0.0 u from u")
def centered(spark, d):
    w = Window.partitionBy("prompt")
    rows = regress.with_u(events_bank(spark, d).images).withColumn("g", F.col("g")[0])
    return rows.select("prompt", "image_id", (F.col("g") - F.avg("g").over(w)).alias("g"), (F.col("u") - F.avg("u").over(w)).alias("u"))


K1_SQL = f"{U_SQL}, k1 as (select prompt, case when var_pop(u) >= 1e-10 and var_pop(g0) > 0 then regr_slope(u, g0) else 0 end w, case when var_pop(u) >= 1e-10 and var_pop(g0) > 0 then regr_r2(u, g0) else 0 end r2 from u group by 1 having count(*) >= 2)"


@query(f"with {K1_SQL} select prompt, round(w, 6) + 0.0 w, round(r2, 6) + 0.0 r2 from k1")
def ols_k1(spark, d):
    return regress.one_label(regress.with_u(events_bank(spark, d).images), 0)


@query(f"""with {U_SQL}, s as (select prompt, var_pop(g0) aa, var_pop(g2) bb, covar_pop(g0, g2) ab, covar_pop(g0, u) au, covar_pop(g2, u) bu, var_pop(u) uu from u group by 1 having count(*) >= 2),
w as (select *, (aa * bb - ab * ab > 1e-12) and uu >= 1e-10 ok, (au * bb - bu * ab) / nullif(aa * bb - ab * ab, 0) x, (bu * aa - au * ab) / nullif(aa * bb - ab * ab, 0) y from s)
select prompt, case when ok then round(x, 6) + 0.0 else 0.0 end w1, case when ok then round(y, 6) + 0.0 else 0.0 end w2, case when ok then round((x * au + y * bu) / uu, 6) + 0.0 else 0.0 end r2 from w""")
def ols_k2(spark, d):
    return regress.two_labels(regress.with_u(events_bank(spark, d).images), 0, 2)


@query(f"""with {U_SQL}, c as (select g0 - avg(g0) over (partition by prompt) g, u - avg(u) over (partition by prompt) u from u)
select round(sum(g * u) / sum(g * g), 6) w, round(sum(g * u) * sum(g * u) / (sum(g * g) * sum(u * u)), 6) var_explained from c""")
def ols_k1_global(spark, d):
    w, explained = regress.pooled(regress.with_u(events_bank(spark, d).images), 1)
    return spark.createDataFrame([(float(w[0]), explained)], "w double, var_explained double")


@query()
def ols_k5(spark, d):
    return regress.per_prompt(regress.with_u(events_bank(spark, d).images), 5).select("prompt", "m", F.col("w")[0].alias("w0"), F.col("w")[4].alias("w4"), "r2")


@query(f"with {K1_SQL} select count(*) n, round(avg(r2), 6) mean, round(quantile_cont(r2, 0.5), 6) median, round(max(r2), 6) max, count(*) filter (r2 > 0.05) over_05, count(*) filter (r2 > 0.1) over_10, count(*) filter (r2 > 0.2) over_20 from k1")
def r2_distribution(spark, d):
    return regress.r2_distribution(regress.one_label(regress.with_u(events_bank(spark, d).images), 0))


TREND_SQL = f"""{E_LONG}, u as (select *, cume_dist() over (partition by attr, prompt order by reward) u from bank),
f as (select attr, prompt, case when var_pop(u) >= 1e-10 and var_pop(g) > 0 then regr_r2(u, g) else 0 end r2, count(*) m from u group by 1, 2 having count(*) >= 2),
t as (select 0 topic_id, array_position(['purchase', 'click', 'k_gt_50', 'morning', 'weekend'], attr)::int step_idx, avg(r2) r2, avg(1 - (1 - r2) * (m - 1) / (m - 1 - 1)) adj from f where m > 2 group by 1, 2)"""


def _trend(spark, d):
    u = regress.with_u(events_bank(spark, d).images)
    sizes = u.groupBy("prompt").agg(F.count("*").alias("m"))
    out = None
    for i in range(len(E_ATTRS)):
        own = regress.one_label(u, i).join(sizes, "prompt").where("m > 2")
        row = own.agg(F.lit(0).alias("topic_id"), F.lit(i + 1).alias("step_idx"), F.avg("r2").alias("r2"), F.avg(1 - (1 - F.col("r2")) * (F.col("m") - 1) / (F.col("m") - 2)).alias("adj"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {TREND_SQL} select topic_id, step_idx, round(r2, 6) r2, round(adj, 6) adj from t")
def adjusted_r2(spark, d):
    return _trend(spark, d)


@query(f"with {TREND_SQL} select step_idx, round(r2 - lag(r2) over (partition by topic_id order by step_idx), 6) d_r2, round(adj - lag(adj) over (partition by topic_id order by step_idx), 6) d_adj from t")
def delta_r2(spark, d):
    return reports.step_deltas(_trend(spark, d), "r2", "adj").select("step_idx", "d_r2", "d_adj")


@query(f"with {TREND_SQL} select topic_id, arg_max(step_idx, adj) peak_step, round(max(adj), 6) peak from t group by 1")
def peak_r2(spark, d):
    return reports.peak(_trend(spark, d), "adj")


@query(f"""with {U_SQL}, l as (select prompt, u, unnest([0, 1, 2, 3, 4]) k, unnest([g0, g1, g2, g3, g4]) g from u),
c as (select prompt, k, var_pop(g) > 1e-12 v, corr(g, u) c, count(*) m from l group by 1, 2)
select prompt, count(*) filter (v)::int active, round(coalesce(max(abs(c)) filter (v), 0), 6) max_corr from c where m >= 2 group by 1""")
def corr_max(spark, d):
    return regress.strongest_correlation(regress.with_u(events_bank(spark, d).images), 5)


RESIDUAL_SQL = f"""{U_SQL}, w as (select prompt, case when var_pop(u) >= 1e-10 and var_pop(g0) > 0 then regr_slope(u, g0) else 0 end w from u group by 1 having count(*) >= 2),
r as (select u.*, u - avg(u) over (partition by prompt) - w * (g0 - avg(g0) over (partition by prompt)) e from u join w using (prompt))"""


def _residuals(spark, d):
    u = regress.with_u(events_bank(spark, d).images)
    fits = regress.one_label(u, 0).select("prompt", F.array("w").alias("w"))
    return u, regress.residuals(u.withColumn("g", F.array(F.col("g")[0])), fits)


@query(f"""with {RESIDUAL_SQL}, l as (select prompt, e, unnest(['purchase', 'click', 'k_gt_50', 'morning', 'weekend']) attr, unnest([g0, g1, g2, g3, g4]) g from r),
c as (select attr, prompt, covar_pop(g, e) c from l group by 1, 2 having count(*) >= 2) select attr, round(2 * avg(c), 6) + 0.0 partial_a_hat from c group by 1""")
def partial_ahat(spark, d):
    _, e = _residuals(spark, d)
    return amplify.partial_amplification(events_bank(spark, d).long().join(e, ["prompt", "image_id"]))


@query(f"""with {RESIDUAL_SQL}, s as (select prompt, image_id, round(e, 9) e, case when round(e, 9) > 0 then 'plus' else 'minus' end side from r where round(e, 9) <> 0),
b as (select *, count(distinct side) over (partition by prompt) k, row_number() over (partition by prompt, side order by abs(e) desc, image_id) as rank from s)
select prompt, image_id, side, rank::int as rank from b where k = 2 and rank <= 3""")
def pplus_pminus(spark, d):
    _, e = _residuals(spark, d)
    return choose.extremes(e.withColumn("e", F.round("e", 9)), 3).select("prompt", "image_id", "side", "rank")


@query("""with r as (select user_id prompt, event_id image_id, row_number() over (partition by user_id order by value, event_id)::int as rank, row_number() over (partition by user_id order by value desc, event_id desc) d from events)
select prompt, image_id, rank from r where rank <= 2 or d <= 3""")
def stratified_context(spark, d):
    return choose.stratified(events_bank(spark, d).images, 5).select("prompt", "image_id", "rank")


@query(f"""with {K1_SQL}, o as (select prompt, round(r2, 9) r2, row_number() over (order by round(r2, 9), prompt) - 1 idx, count(*) over () n from k1)
select prompt, idx::int idx from o where idx >= floor(n * 0.25) and idx < floor(n * 0.75) and
  ((idx - floor(n * 0.25)::bigint - 10) % (floor(n * 0.75) - floor(n * 0.25))::bigint + (floor(n * 0.75) - floor(n * 0.25))::bigint) % (floor(n * 0.75) - floor(n * 0.25))::bigint < 10""")
def middle_band(spark, d):
    r2 = regress.one_label(regress.with_u(events_bank(spark, d).images), 0).withColumn("r2", F.round("r2", 9))
    return choose.middle_band(r2, 0.25, 0.75, 10, 1).select("prompt", "idx")


WEIGHTS_SQL = f"""{E_LONG}, u as (select *, cume_dist() over (partition by attr, prompt order by reward) u from bank),
w as (select prompt, attr, round(case when var_pop(u) >= 1e-10 and var_pop(g) > 0 then regr_slope(u, g) else 0 end, 9) w from u group by 1, 2 having count(*) >= 2)"""


def _weights(spark, d):
    u = regress.with_u(events_bank(spark, d).images)
    out = None
    for i, a in enumerate(E_ATTRS):
        own = regress.one_label(u, i).select("prompt", F.lit(a).alias("attr"), F.round("w", 9).alias("w"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"with {WEIGHTS_SQL}, r as (select *, row_number() over (partition by prompt order by w desc, attr) - 1 as rank from w where w > 0.02) select prompt, attr, round(w, 6) w, rank::int as rank from r where rank < 2")
def topn_per_prompt(spark, d):
    return choose.top_per_prompt(_weights(spark, d), 2, 0.02)


CURVE_SQL = f"""{E_WIDE}, s as (select prompt, reward, [g0, g1, g2, g3, g4] g, count(*) over (partition by prompt) m,
  count(*) over (partition by prompt order by reward range between unbounded preceding and current row) le, count(*) over (partition by prompt, reward) eq from e),
x as (select s.*, n, least(n, m) k from s, (select unnest({N_VALUES}) n) where m >= n or (select max(m) from s) < n),
mass as (select prompt, n, g, (list_product(list_transform(range(k), lambda j: greatest(le - j, 0)::double / (m - j)))
  - list_product(list_transform(range(k), lambda j: greatest(le - eq - j, 0)::double / (m - j)))) / eq p from x),
l as (select prompt, n, unnest(['purchase', 'click', 'k_gt_50', 'morning', 'weekend']) attr, unnest(g) g, p from mass),
per as (select attr, n, prompt, sum(p * g) v from l group by 1, 2, 3),
curve as (select attr, n, avg(v) prev from per group by 1, 2)"""


def _curve(spark, d):
    return bon.curve(events_bank(spark, d).images, E_ATTRS, N_VALUES)


@query(f"with {CURVE_SQL} select attr, n, round(prev, 6) prev from curve")
def bon_curve(spark, d):
    return _curve(spark, d)


@query(f"with {CURVE_SQL}, b as (select *, prev - first_value(prev) over (partition by attr order by n) d from curve) select n, round(avg(prev), 6) mean, round(stddev_pop(prev), 6) std, round(avg(d), 6) + 0.0 mean_delta, round(stddev_pop(d), 6) std_delta from b group by 1")
def bon_summary(spark, d):
    return bon.summary(_curve(spark, d))


@query(f"with {CURVE_SQL} select attr, round(max(prev) filter (n = 16) - max(prev) filter (n = 1), 6) + 0.0 delta from curve group by 1")
def bon_delta(spark, d):
    return bon.delta(_curve(spark, d), 16)


@query(f"with {CURVE_SQL} select attr, " + ", ".join(f"round(max(prev) filter (n = {n}), 6) n{n}" for n in N_VALUES) + " from curve group by 1")
def bon_pivot(spark, d):
    return bon.pivot(_curve(spark, d), N_VALUES)


@query(f"with {CURVE_SQL}, dl as (select attr, round(max(prev) filter (n = 16) - max(prev) filter (n = 1), 6) + 0.0 delta from curve group by 1), am as ({_amp_sql(E_LONG)}) select attr, a_hat, delta from am left join dl using (attr) order by delta desc nulls last, a_hat desc, attr limit 3")
def top_attributes(spark, d):
    amp = rounded(_amp(events_bank(spark, d))).select("attr", "a_hat")
    return reports.top_attributes(amp, rounded(bon.delta(_curve(spark, d), 16)), 3)


@query()
def bon_mc(spark, d):
    return bon.curve_mc(events_bank(spark, d).images, E_ATTRS, [1, 4, 16])


PAIRS_SQL = f"""{E_WIDE}, v as (select prompt, image_id, reward, [g0, g1, g2, g3, g4] g from e), k as (select unnest(range(1, 6)) k, unnest(['purchase', 'click', 'k_gt_50', 'morning', 'weekend']) attr),
pairs as (select p.prompt, attr, p.image_id pos_id, n.image_id neg_id, p.reward pos_reward, n.reward neg_reward,
  ((p.g[1] <> n.g[1])::int + (p.g[2] <> n.g[2])::int + (p.g[3] <> n.g[3])::int + (p.g[4] <> n.g[4])::int + (p.g[5] <> n.g[5])::int - 1) h
  from k, v p, v n where p.prompt = n.prompt and p.g[k] = 1 and n.g[k] = 0)"""


@query(f"with {PAIRS_SQL}, r as (select *, row_number() over (partition by prompt, attr order by h, pos_id, neg_id) as rank from pairs where pos_reward > neg_reward) select prompt, attr, pos_id, neg_id, h::int h, rank::int as rank from r where rank <= 3")
def hamming_topk(spark, d):
    return pairs.closest(events_bank(spark, d).images, E_ATTRS, 3, True).select("prompt", "attr", "pos_id", "neg_id", "h", "rank")


@query(f"with {PAIRS_SQL}, r as (select *, row_number() over (partition by prompt, attr order by abs(pos_reward - neg_reward) desc, pos_id, neg_id) as rank from pairs where h = 0) select prompt, attr, pos_id, neg_id, rank::int as rank from r where rank <= 2")
def hamming_h0(spark, d):
    return pairs.identical(events_bank(spark, d).images, E_ATTRS, 2).select("prompt", "attr", "pos_id", "neg_id", "rank")


@query(f"with {PAIRS_SQL}, b as (select attr, prompt, min(h)::int h from pairs group by 1, 2), r as (select *, row_number() over (partition by attr order by h, prompt) r from b) select attr, prompt, h from r where r <= 10")
def hamming_prompt_cap(spark, d):
    return pairs.best_prompts(pairs.pattern_pairs(events_bank(spark, d).images, E_ATTRS), 10)


@query(f"with {PAIRS_SQL} select attr, round(quantile_cont(pos_reward - neg_reward, 0.75), 6) cap, count(*) n from pairs where pos_reward > neg_reward group by 1")
def gap_cap(spark, d):
    return sides.gap_caps(sides.kept(sides.by_prompt(events_bank(spark, d).images, E_ATTRS)), E_ATTRS)


@query(f"with {PAIRS_SQL} select attr, count(*) n_pairs, count(distinct prompt) n_prompts, round(avg(h), 6) mean_h, round(avg(pos_reward - neg_reward), 6) + 0.0 mean_gap from pairs group by 1")
def pair_summary(spark, d):
    return pairs.totals(events_bank(spark, d).images, E_ATTRS)


@query(f"""with recursive {E_WIDE}, r as (select prompt, list({{'i': image_id, 'v': reward}} order by reward, image_id) all_ from e where g0 = 0 and reward is not null group by 1),
l as (select prompt, image_id, reward, row_number() over (partition by prompt order by reward, image_id) k from e where g0 = 1 and reward is not null),
m as (select prompt, 0::bigint k, []::bigint[] used, null::bigint pos_id, null::bigint neg_id from r
  union all select prompt, k, list_append(used, x), pos_id, x from (select m.prompt, l.k, used, l.image_id pos_id,
    list_sort(list_transform(list_filter(all_, lambda z: not list_contains(used, z.i)), lambda z: {{'far': abs(z.v - l.reward), 'v': z.v, 'i': z.i}}))[1].i x
    from m join l on m.prompt = l.prompt and l.k = m.k + 1 join r on r.prompt = m.prompt) where x is not null)
select prompt, pos_id, neg_id from m where k > 0""")
def match_by_reward(spark, d):
    images = events_bank(spark, d).images
    return pairs.matched_by_reward(images.where("g[0] = 1").select("prompt", "image_id", "reward"), images.where("g[0] = 0").select("prompt", "image_id", "reward"))


@query(f"""with recursive {PAIRS_SQL}, cap as (select attr, quantile_cont(pos_reward - neg_reward, 0.75) cap from pairs where pos_reward > neg_reward group by 1),
c as (select attr, prompt, pos_id, pos_reward, neg_id, h::int h, pos_reward - neg_reward gap, 0.5::double * h / 2 + 0.5::double * (pos_reward - neg_reward) / cap score from pairs join cap using (attr) where pos_reward > neg_reward and h <= 2 and pos_reward - neg_reward <= cap),
o as (select attr, prompt, pos_id, max(pos_reward) reward, list({{'n': neg_id, 'h': h, 'gap': gap}} order by score, neg_id) all_ from c group by 1, 2, 3),
p as (select *, row_number() over (partition by attr, prompt order by reward desc, pos_id) k from o),
m as (select distinct attr, prompt, 0::bigint k, []::bigint[] used, null::bigint pos_id, null::struct(n bigint, h integer, gap double) x from p
  union all select attr, prompt, k, case when x is null then used else list_append(used, x.n) end, pos_id, x from (select m.attr, m.prompt, p.k, used, p.pos_id,
    list_filter(all_, lambda z: not list_contains(used, z.n))[1] x from m join p on p.attr = m.attr and p.prompt = m.prompt and p.k = m.k + 1 where len(used) < 5))
select attr, prompt, pos_id, x.n neg_id, x.h h, round(x.gap, 6) gap from m where x is not null""")
def best_counterfactual(spark, d):
    prompts = sides.kept(sides.by_prompt(events_bank(spark, d).images, E_ATTRS))
    return sides.counterfactuals(prompts, E_ATTRS, sides.gap_caps(prompts, E_ATTRS), 2)


@query()
def natural_pairs(spark, d):
    images = regress.with_u(events_bank(spark, d).images)
    return pairs.natural(images.drop("u"), E_ATTRS, regress.bootstrap(images, E_ATTRS), 2)


@query()
def bootstrap_ci(spark, d):
    return regress.bootstrap(regress.with_u(events_bank(spark, d).images), E_ATTRS)


@query()
def loo_scores(spark, d):
    return regress.leave_one_out(regress.grams(regress.with_u(events_bank(spark, d).images), 5), E_ATTRS, E_ATTRS)


@query()
def loo_prune(spark, d):
    removed, kept = regress.pruned(regress.with_u(events_bank(spark, d).images), E_ATTRS, 0.0)
    rows = [(r, a, float(s), False) for r, a, s in removed] + [(0, a, float(s), True) for a, s in kept.items()]
    return spark.createDataFrame(rows, "removal_rank int, attr string, loo double, kept boolean")


UNIT_SQL = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) u from embeddings)"


@query(f"with {UNIT_SQL} select a.vec_id a, b.vec_id b, round(list_dot_product(a.u, b.u), 6) cosine from v a, v b where a.vec_id < b.vec_id and list_dot_product(a.u, b.u) >= 0.4")
def cosine_pairs(spark, d):
    return corpus.similar_pairs(table(spark, d, "embeddings"), 0.4)


@query(f"""with {UNIT_SQL}, p as (select a.label, a.vec_id, round(sum(1 - list_dot_product(a.u, b.u)), 9) dist, count(*) n from v a join v b on a.label = b.label group by 1, 2),
r as (select *, row_number() over (partition by label order by dist, vec_id) r from p) select label, vec_id medoid, n size from r where r = 1""")
def medoid(spark, d):
    return corpus.medoids(table(spark, d, "embeddings"), "label")


@query()
def kmeans_medoids(spark, d):
    return corpus.kmeans_medoids(table(spark, d, "embeddings"), 8)


@query("""with v as (select vec_id i, label c, embedding::double[] v from embeddings), t as (select a.i, a.c, b.c d, avg(list_distance(a.v, b.v)) m from v a join v b on a.i <> b.i group by 1, 2, 3),
p as (select i, max(m) filter (c = d) a, min(m) filter (c <> d) b from t group by 1) select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) silhouette from p""")
def silhouette(spark, d):
    return corpus.silhouettes(table(spark, d, "embeddings"))


@query()
def silhouette_k(spark, d):
    return corpus.best_k(table(spark, d, "embeddings"), [2, 4])


@query(f"""with recursive {UNIT_SQL}, e as materialized (select a.vec_id x, b.vec_id y from v a, v b where a.vec_id <> b.vec_id and list_dot_product(a.u, b.u) >= 0.4),
reach as (select vec_id, vec_id seen from v union select vec_id, y from reach join e on seen = x) select vec_id, min(seen) component from reach group by 1""")
def dedup_components(spark, d):
    rows = table(spark, d, "embeddings")
    return corpus.components(rows.select("vec_id"), corpus.similar_pairs(rows, 0.4))


def _known(spark, d):
    """Detections known so far: all labels of clicks, and purchase for the first half of ids."""
    return events_bank(spark, d).long().join(table(spark, d, "events").select(F.col("event_id").alias("image_id"), "event_type"), "image_id").where("event_type = 'click' or (attr = 'purchase' and image_id % 2 = 0)").select("image_id", "attr", "g")


KNOWN_SQL = f"{E_LONG}, known as (select image_id, attr, g from bank join events on event_id = image_id where event_type = 'click' or (attr = 'purchase' and image_id % 2 = 0))"


def _attrs(spark, names=E_ATTRS):
    return spark.createDataFrame([(a, i) for i, a in enumerate(names)], "attr string, pos int")


@query(f"with {KNOWN_SQL} select image_id, attr from bank where (image_id, attr) not in (select (image_id, attr) from known)")
def cache_miss(spark, d):
    return pools.misses(events_bank(spark, d).images, _attrs(spark), _known(spark, d))


@query(f"with {KNOWN_SQL}, fresh as (select image_id, attr, 1 - g g from bank where image_id % 3 = 0) select coalesce(n.image_id, o.image_id) image_id, coalesce(n.attr, o.attr) attr, coalesce(n.g, o.g) g from known o full join fresh n on o.image_id = n.image_id and o.attr = n.attr")
def cache_merge(spark, d):
    fresh = events_bank(spark, d).long().where("image_id % 3 = 0").select("image_id", "attr", (1 - F.col("g")).alias("g"))
    return pools.merged(_known(spark, d), fresh)


@query("select (user_id % 10)::int topic_id, array_to_string(list_sort(list(distinct event_type)), ',') attrs from events where event_type <> 'view' or value > 100 group by 1")
def rejected_union(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("topic_id"), F.col("event_type").alias("attr"), "value")
    return pools.sorted_union(e.where("attr <> 'view'"), e.where("value > 100")).withColumn("attrs", F.array_join("attrs", ","))


@query(f"with {KNOWN_SQL}, p as (select image_id, count(distinct attr) k from known group by 1) select (select count(distinct image_id) from bank) total, count(*) filter (k = 5) fully_covered, 'unseen' missing from p")
def coverage(spark, d):
    images = events_bank(spark, d).images
    known = _known(spark, d)
    full = pools.coverage(images, list(E_ATTRS), known).select("total", "fully_covered")
    return full.crossJoin(pools.coverage(images, [*E_ATTRS, "unseen"], known).select("missing"))


@query(f"with {KNOWN_SQL} select attr, count(distinct image_id) covered, (select count(distinct image_id) from bank) total from known group by 1 having count(distinct image_id) < (select count(distinct image_id) from bank)")
def fully_covered(spark, d):
    return pools.partly_covered(events_bank(spark, d).images, _attrs(spark), _known(spark, d))


@query("select event_type attr, min(event_id) pos from events group by 1")
def ordered_distinct(spark, d):
    return pools.ordered_distinct(table(spark, d, "events").select(F.col("event_type").alias("attr"), F.col("event_id").alias("pos")), "attr")


@query("select p_type attr, count(*) n from part where lower(trim(p_type)) not in (select lower(trim(p_type)) from part where p_type < 'M') and lower(trim(p_type)) not in (select lower(trim(p_brand)) from part) group by 1")
def block_list(spark, d):
    p = table(spark, d, "part")
    free = pools.unblocked(p.select(F.col("p_type").alias("attr")), p.where("p_type < 'M'").select(F.col("p_type").alias("attr")), p.select(F.col("p_brand").alias("attr")))
    return free.groupBy("attr").agg(F.count("*").alias("n"))


@query("""with pool as (select event_type attr, min(event_id) pos from events where event_type in ('click', 'view') group by 1),
fresh as (select event_type attr, min(event_id) pos from events group by 1) select attr, pos from pool union all
select attr, pos + (select max(pos) from pool) + 1 from fresh where attr not in (select attr from pool)""")
def next_pool(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("attr")).agg(F.min("event_id").alias("pos"))
    return pools.appended(e.where("attr in ('click', 'view')"), e)


@query("with t as (select event_id::varchar cache_key, floor(epoch(ts))::bigint last_used from events), o as (select *, row_number() over (order by last_used, cache_key) r, count(*) over () n from t) select cache_key, last_used from o where n <= 500 or r > n - 450")
def lru_evict(spark, d):
    cache = table(spark, d, "events").select(F.col("event_id").cast("string").alias("cache_key"), F.unix_timestamp("ts").alias("last_used"))
    return pools.evicted(cache, 500)


POOL_SQL = "pool as (select (user_id % 10)::int topic_id, (hour(ts) % 6)::int step_idx, event_type attr, round(avg(value), 9) score from events where value > 20 group by 1, 2, 3)"


def _pool(spark, d):
    e = table(spark, d, "events").where("value > 20")
    return e.groupBy((F.col("user_id") % 10).cast("int").alias("topic_id"), (F.hour("ts") % 6).cast("int").alias("step_idx"), F.col("event_type").alias("attr")).agg(F.round(F.avg("value"), 9).alias("score"))


@query(f"with {POOL_SQL} select topic_id, step_idx, attr, min(step_idx) over (partition by topic_id, attr) first_seen, step_idx - min(step_idx) over (partition by topic_id, attr) age from pool")
def first_seen(spark, d):
    return pools.ages(_pool(spark, d)).drop("score")


@query(f"with {POOL_SQL} select topic_id, attr, min(step_idx) step_found, max(step_idx) step_last_survived, round(arg_max(score, step_idx), 6) score from pool group by 1, 2")
def found_upsert(spark, d):
    return pools.history(_pool(spark, d))


@query(f"with {POOL_SQL}, r as (select *, row_number() over (partition by topic_id, attr order by step_idx desc) r from pool where step_idx < 3) select topic_id, step_idx, attr, round(score, 6) score from r where r = 1")
def latest_stats(spark, d):
    return pools.latest_before(_pool(spark, d), 3, "topic_id", "attr").select("topic_id", "step_idx", "attr", "score")


@query("""with t as (select doc_id, trim(text) as text from documents where length(trim(text)) >= 10), r as (select *, row_number() over (partition by text order by doc_id) r from t) select doc_id, md5(text) text_md5 from r where r = 1""")
def clean_corpus(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return corpus.cleaned(docs, pos="doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(r"select doc_id, greatest(1, floor(length(text) / 4))::bigint tokens from documents where not regexp_matches(text, '(?i)\b(\d+\s*k|\d+\s*p|uhd|fhd|qhd|hd)\b')")
def resolution_filter(spark, d):
    return corpus.without_resolutions(table(spark, d, "documents")).select("doc_id", corpus.token_estimate().alias("tokens"))


@query("select source, count(*) n, sum(n_chars)::bigint chars from documents where doc_id % 4 = 1 group by 1")
def shard_mod(spark, d):
    return corpus.shard(table(spark, d, "documents"), 1, 4, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""select item_id, md5(text)[1:10] || '_' || lpad((item_id % 100)::varchar, 2, '0') image, sha1(text)[1:8] sha, sha256('model' || chr(10) || 'cat' || chr(10) || text)[1:16] keyed, 'm::' || item_id model_key from benchmark""")
def hash_keys(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", scalars.image_id("text", F.col("item_id") % 100).alias("image"), scalars.short_hash("text", 8, "sha1").alias("sha"), scalars.text_key(F.lit("model"), F.lit("cat"), "text").alias("keyed"), scalars.model_key(F.lit("m"), F.col("item_id").cast("string")).alias("model_key"))


@query("""with s as (select item_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[1:80] s from benchmark) select item_id, case when s = '' then 'attribute' else s end slug from s""")
def slugify(spark, d):
    return table(spark, d, "benchmark").select("item_id", scalars.slug("text").alias("slug"))


@query("""with e as (select event_id, event_type, json_extract(props, '$.k')::int k from events) select event_id, case when event_type = 'error' then -1 when event_type <> 'view' and k > 50 then 1 else 0 end verdict from e""")
def verdict_parse(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(F.struct((F.col("event_type") != "error").alias("applicable"), (k > 50).alias("present")))
    reply = F.when(F.col("event_type") == "view", "no object here").otherwise(F.concat(F.lit("Answer: ```json\n"), body, F.lit("\n```")))
    return e.select("event_id", scalars.verdict(reply).alias("verdict"))


@query("""with m as (select conv_id, list(upper(role) || ': ' || text order by turn) filter (role <> 'system') l, min(text order by turn) filter (role = 'user') x, arg_min(text, turn) filter (role = 'user') first_user, count(*) n from conversations group by 1)
select conv_id, md5(array_to_string(coalesce(l, []), chr(10))) rendered, md5(first_user) first_user, n from m""")
def chat_render(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(scalars.history().alias("m"), F.count("*").alias("n"))
    md5 = lambda x: F.md5(x.cast("binary"))
    return c.select("conv_id", md5(scalars.rendered(scalars.without_system("m"))).alias("rendered"), md5(scalars.first_of("m", "user")).alias("first_user"), "n")


@query("""with p as (select p_partkey, p_size * 40 w, p_size * 25 h from part), f as (select *, least(1.0::double, 2048.0::double / greatest(w, h)) f from p), g as (select *, least(1.0::double, 768.0::double / least(w * f, h * f)) g from f)
select p_partkey, (85 + 170 * ceil(round(w * f * g / 512, 9)) * ceil(round(h * f * g / 512, 9)))::bigint tokens, round(((85 + 170 * ceil(round(w * f * g / 512, 9)) * ceil(round(h * f * g / 512, 9))) * 2.5::double + 300 * 10) / 1e6, 6) cost from g""")
def token_cost(spark, d):
    t = scalars.image_tokens(F.col("p_size") * 40, F.col("p_size") * 25)
    return table(spark, d, "part").select("p_partkey", t.alias("tokens")).withColumn("cost", scalars.call_cost("tokens", F.lit(300), 2.5, 10.0))


@query("""with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b from lineitem group by 1)
select l_returnflag, count(*) n, round(avg(l_extendedprice), 4) mean from lineitem join q using (l_returnflag) where l_extendedprice between a - 0.5 * (b - a) and b + 0.5 * (b - a) group by 1""")
def tukey_mean(spark, d):
    rows = corpus.tukey(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", 0.5)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


EDITS_SQL = "edits as (select event_type attr, event_id image_id, json_extract(props, '$.k')::int > 40 success, case when hour(ts) < 18 then value - 50 end as drop from events)"
SURVEY_SQL = f"{EDITS_SQL}, s as (select attr, count(*) n_attempts, avg(success::int) success_rate, count(drop) n_rewards, avg(drop) mean_drop, count(*) filter (drop > 0) / greatest(count(drop), 1) pct_positive from edits group by 1)"


def _edits(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(F.col("event_type").alias("attr"), F.col("event_id").alias("image_id"), (k > 40).alias("success"), F.when(F.hour("ts") < 18, F.col("value") - 50).alias("drop"))


@query(f"with {SURVEY_SQL} select attr, n_attempts, round(success_rate, 6) success_rate, n_rewards, round(mean_drop, 6) mean_drop, round(pct_positive, 6) pct_positive from s")
def survey_rows(spark, d):
    return reports.survey(_edits(spark, d))


@query(f"with {SURVEY_SQL} select count(*) n_attrs, sum(n_attempts)::bigint n_attempts, count(*) filter (success_rate >= 0.5) n_editable, round(sum(mean_drop * n_rewards) / sum(n_rewards), 6) weighted_drop from s")
def survey_global(spark, d):
    return reports.survey_total(reports.survey(_edits(spark, d)))


@query(f"with {EDITS_SQL}, r as (select *, row_number() over (partition by attr order by image_id) r from edits where success) select attr, array_to_string(list_sort(list(image_id)), ',') images from r where r <= 4 group by 1")
def survey_samples(spark, d):
    return reports.samples(_edits(spark, d)).withColumn("images", F.array_join("images", ","))


AGREE_SQL = f"""{E_LONG}, s as (select b.attr, t.g app, b.g control from bank b join (select image_id, attr, case when event_type = 'error' then -1 when image_id % 7 = 0 then 1 - g else g end g from bank join events on event_id = image_id) t using (image_id, attr)),
c as (select attr, count(*) n, count(*) filter (app = control) agree, count(*) filter (app = -1 and control = 0) na_to_absent, count(*) filter (app = -1 and control = 1) na_to_present, count(*) filter (app = 1 and control = 0) present_to_absent, count(*) filter (app = 0 and control = 1) absent_to_present from s group by 1)"""


def _agreement(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("image_id"), "event_type")
    app = F.when(F.col("event_type") == "error", -1).when(F.col("image_id") % 7 == 0, 1 - F.col("g")).otherwise(F.col("g"))
    return reports.confusion(events_bank(spark, d).long().join(e, "image_id").select("attr", app.alias("app"), F.col("g").alias("control")))


@query(f"with {AGREE_SQL} select * from c")
def applicability_confusion(spark, d):
    return _agreement(spark, d)


@query(f"with {AGREE_SQL} select sum(n)::bigint n, " + ", ".join(f"round(100 * sum({c}) / sum(n), 6) pct_{c}" for c in ("agree", "na_to_absent", "na_to_present", "present_to_absent", "absent_to_present")) + " from c")
def applicability_total(spark, d):
    return reports.shares(_agreement(spark, d))


ROUNDS_SQL = f"{T_LONG}, rounds as (select attr, image_id, unnest([g, g, case when image_id % 5 = 0 then 0 else g end]) g from bank)"


@query(f"with {ROUNDS_SQL} select attr, image_id from rounds group by 1, 2 having count(*) filter (g = 1) = 3 and count(*) filter (g = -1) = 0")
def consistency_filter(spark, d):
    rounds = events_bank(spark, d, tri=True).long().withColumn("g", F.explode(F.array("g", "g", F.when(F.col("image_id") % 5 == 0, 0).otherwise(F.col("g")))))
    return reports.consistent(rounds, 3)


@query("""with p as (select (user_id % 6)::int step_idx, event_type <> 'error' human, event_type <> 'error' and value > 30 validated, event_type <> 'error' and value > 90 admitted from events)
select step_idx, count(*) proposed, count(*) filter (human) human, count(*) filter (validated) validated, count(*) filter (admitted) admitted, round(count(*) filter (human) / count(*), 6) human_rate, round(count(*) filter (admitted) / greatest(count(*) filter (validated), 1), 6) admit_rate from p group by 1""")
def funnel(spark, d):
    human = F.col("event_type") != "error"
    return reports.funnel(table(spark, d, "events").select((F.col("user_id") % 6).cast("int").alias("step_idx"), human.alias("human"), (human & (F.col("value") > 30)).alias("validated"), (human & (F.col("value") > 90)).alias("admitted")))


@query()
def search_loop(spark, d):
    bank = lineitem_bank(spark, d)
    state = search.run(bank, bank.attrs[:2], search.SearchConfig(steps=3, tau=-1.0, tau_partial=-1.0, pool_sizes=(4, 4, 4)))
    return spark.createDataFrame([(s, a, float(x), float(p), k) for s, a, x, p, k in state.rows], "step_idx int, attr string, a_hat double, p1 double, kept boolean")
