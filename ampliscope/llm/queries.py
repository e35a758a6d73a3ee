"""The corpus operators applied to their tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clusters, leaks, lm, packing, pieces, pii, quality, resample, simhash, suffix, urls, warc
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER, owner="op1", power=0.7)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), owner="op3")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), owner="op4")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), PIECES).drop("ids")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), owner="op6").drop("url", "payload")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), owner="op7")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(table(spark, sf_dir, "documents"), owner="op8")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), owner="op10")


def op11_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), owner="op11")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (hit > 0).alias("contaminated"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), owner="op12")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), owner="op13")


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def _clusters_sql() -> str:
    """Plain k-means: every vector against every centroid, round after round."""
    steps = [
        """v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        "e as materialized (select r, d, x[d] x from v, range(1, 65) t(d))",
        """c0 as materialized (select c, d, x[d] x from (select row_number() over (order by sha256('3:' || vec_id), x) - 1 c, x from v qualify c < 8), range(1, 65) t(d))""",
    ]
    near = "a{0} as materialized (select r, arg_min(c, (s, c)) c, min(s) s from (select r, c, sum((e.x - k.x) * (e.x - k.x))::bigint s from e join c{0} k using (d) group by r, c) group by r)"
    for n in range(10):
        steps.append(near.format(n))
        steps.append(f"c{n + 1} as materialized (select o.c, o.d, coalesce(m.x, o.x) x from c{n} o left join (select c, d, floor(sum(x)::double / count(*))::bigint x from e join a{n} using (r) group by c, d) m using (c, d))")
    steps.append(near.format(10))
    return "with " + ",\n".join(steps) + """
select vec_id, c::int cluster, s distance, (sum(s) over (partition by c))::bigint cluster_inertia, (sum(s) over ())::bigint inertia, sha256(names.x) centroid_sha256
from a10 join v using (r) join (select c, string_agg(x::varchar, ',' order by d) x from c10 group by c) names using (c)"""


QUERIES = {f.__name__: f for f in (op1_packing, op2_pii, op3_simhash, op4_lm, op5_pieces, op6_warc, op7_quality, op8_suffix, op9_urls, op10_ann, op11_leaks, op12_resample, op13_clusters)}
SQL = {
    "op6_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h) payload_bytes, sha1(h) x, max(page_id) over (partition by sha1(h)) last from p)
select page_id, payload_bytes::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, ((i // 4) * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') payload_digest,
  case when last is null or page_id = last then 'response' else 'revisit' end record_type,
  case when page_id is distinct from last then last end refers_to
from d""",
    "op11_leaks": f"""
with d as (select doc_id, row_number() over () r, {_WORDS} w from documents),
i as (select coalesce(item_id::varchar, '') item, {_WORDS} w from benchmark),
p as (select distinct item, least(10, len(w)) m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') phrase
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) k from i where len(w) > 0)),
u as (select r, m, k, array_to_string(w[k:k + m - 1], ' ') phrase
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) k from d, (select distinct m from p) where len(w) >= m)),
o as (select r, k, u.m, item from u join p on u.m = p.m and u.phrase = p.phrase),
h as (select r, count(distinct x) n from (select r, unnest(range(k, k + m)) x from o) group by r),
t as (select r, count(*) n, string_agg(item, ',' order by item) items from (select distinct r, item from o) group by r)
select doc_id, len(w)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(t.n, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from d left join h using (r) left join t using (r)""",
    "op12_resample": f"""
with recursive d as (select doc_id, row_number() over () r, {_WORDS} w from documents),
i as (select {_WORDS} w from benchmark),
fd as (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) f from d),
fi as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) f from i),
bits as (select b byte, list_reduce(list_prepend(b::ubigint, [0::ubigint for _ in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::ubigint)) v from range(256) t(b)),
step as (select f, hex(f) h, 0 pos, 4294967295::ubigint c from (select distinct f from (select f from fd union all select f from fi))
  union all select f, h, pos + 1, xor(c >> 8, v) from step join bits on byte = xor(c, ('0x' || substr(h, 2 * pos + 1, 2))::ubigint) & 255 where 2 * pos < len(h)),
crc as (select f, (xor(c, 4294967295::ubigint) % 10000)::bigint b from step where 2 * pos = len(h)),
s as (select b, count(*) n from fd join crc using (f) group by b), t as (select b, count(*) n from fi join crc using (f) group by b),
g as (select b, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((select count(*) from fd) + 10000)::double / ((coalesce(s.n, 0) + 1) * ((select count(*) from fi) + 10000)::double)))::bigint gain from s full join t using (b)),
m as (select r, count(*) n, floor(sum(gain)::double / count(*))::bigint weight from fd join crc using (f) join g using (b) group by r),
x as (select doc_id, len(w) words, coalesce(n, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint score from d left join m using (r)),
k as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id nulls first) place from x)
select doc_id, n_features, weight, score, case when words >= 20 and place <= 25 * (select count(*) from x where words >= 20) // 100 then place end::bigint "rank" from k""",
    "op13_clusters": _clusters_sql(),
}
