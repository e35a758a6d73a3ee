"""Registered queries on caches, streams, models, samples, replies and messages, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages
from ..operators import replies, sketches
from ..operators.lineage import scratch
from ..sources import ahead, files, versions
from ..sources.banks import E_ATTRS, E_LONG, events_bank, table
from ..streaming import cache
from . import batches, planners
from .catalog import query
from .records import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

SLICES, TTL, FLUSH = 3, 43200, 600


def cache_events(spark, d):
    """Events as puts (purchases and signups) and touches; a key for each user."""
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("k"), "user_id").alias("cache_key"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("touch").alias("op"), F.col("props").alias("payload"))


CACHE_EVENTS = "e as (select 'k' || user_id cache_key, ts tm, event_type in ('purchase', 'signup') put, props payload from events)"


@query(f"""with {CACHE_EVENTS}, p as (select cache_key, max(tm) tm, arg_max(payload, (tm, payload)) payload from e where put group by 1),
t as (select p.cache_key, e.tm, lag(e.tm, 1, p.tm) over (partition by p.cache_key order by e.tm) before from e join p on e.cache_key = p.cache_key and epoch_us(e.tm) // {FLUSH * 1000000} > epoch_us(p.tm) // {FLUSH * 1000000} and not e.put),
u as (select cache_key, max(tm) last_used, bool_or(tm > before + interval {TTL} seconds) dead from t group by 1)
select p.cache_key, payload, p.tm created_at, coalesce(last_used, p.tm) last_used from p left join u using (cache_key)
where not coalesce(dead, false) and coalesce(last_used, p.tm) + interval {TTL} seconds >= (select max(tm) from e)""")
def cache_replay(spark, d):
    """The live entries of a cache that a stream of puts and touches kept, in SLICES runs that go on from each other's checkpoint."""
    own = cache.streaming_session(spark)
    folder, events = scratch(spark, "cache-replay"), cache_events(spark, d)
    span = events.agg(F.min(F.unix_micros("at")).alias("a"), F.max(F.unix_micros("at")).alias("b")).first()
    place = F.least(F.floor((F.unix_micros("at") - span["a"]) / max(1, span["b"] - span["a"]) * SLICES), F.lit(SLICES - 1))
    kept = cache.cache_table(spark, f"{folder}/table")
    for n in range(SLICES):
        events.where(place == n).write.mode("append").parquet(f"{folder}/events")
        stream = own.readStream.schema(events.schema).parquet(f"{folder}/events")
        changes = cache.entry_changes(stream, TTL, FLUSH)
        cache.write_behind(changes, kept, f"{folder}/checkpoint", compact_every=2).awaitTermination()
    return cache.live(kept).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_used")})


@query("""with e as (select 'k' || (event_id % 300) cache_key, event_type op, props payload, ts created_at, event_id, event_id % 5 b from events where event_id % 1000 <> 7)
select cache_key, arg_max(op, (b, created_at, event_id)) op, arg_max(payload, (b, created_at, event_id)) payload, arg_max(created_at, (b, created_at, event_id)) created_at from e group by 1""")
def compacted_cache(spark, d):
    """Five batches of entries in a keyed table, one of them twice, folded on the way."""
    e = table(spark, d, "events").where("event_id % 1000 <> 7")
    rows = e.select(F.concat(F.lit("k"), F.col("event_id") % 300).alias("cache_key"), F.col("event_type").alias("op"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), "event_id")
    kept = versions.KeyedTable(spark, scratch(spark, "compacted"), "cache_key string, op string, payload string, created_at timestamp", ("cache_key",))
    for b in (0, 1, 1, 2, 3, 4):
        batch = rows.where(F.col("event_id") % 5 == b).groupBy("cache_key").agg(F.max_by(F.struct("cache_key", "op", "payload", "created_at"), F.struct("created_at", "event_id")).alias("r"))
        kept.append(batch.select("r.*"), "feed", b)
        if b == 2:
            kept.compact()
    return kept.read()


@query("""with s as (select event_id::varchar image_id, round(value / 2, 6) a, case when event_id % 3 = 0 then round(value * 2, 6) end b from events)
select image_id, a, b from s""")
def merged_scores(spark, d):
    """Two score columns of images, merged by image; the second writer began before the first was done."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("image_id"), "value", "event_id")
    kept = versions.score_table(spark, scratch(spark, "scores"))
    versions.add_scores(kept, e.withColumn("score", F.lit(0.0)), "a")
    versions.add_scores(kept, e.where("event_id % 3 = 0").withColumn("score", F.col("value") * 2), "b")
    versions.add_scores(kept, e.withColumn("score", F.col("value") / 2), "a")
    return versions.score_maps(kept).select("image_id", F.col("scores")["a"].alias("a"), F.col("scores")["b"].alias("b"))


@query("""with c as (select 'k' || event_id cache_key, props payload, date_trunc('hour', ts) created_at from events),
p as (select *, row_number() over (order by created_at, cache_key) pos from c), h as (select *, (select min(pos) from p q where q.created_at = p.created_at) start from p where cache_key[2:]::bigint % 400 = 3),
w as (select distinct p.pos from p join h on p.pos >= h.start and p.pos <= h.start + case when h.pos <= h.start + 16 then 16 else 15 end)
select cache_key, payload, created_at, pos in (select pos from h) hit from p where pos in (select pos from w union select pos from h)""")
def cache_read_ahead(spark, d):
    """Entries that were asked for, with the 16 that follow each, from a cache clustered by time."""
    e = table(spark, d, "events").select(F.concat(F.lit("k"), "event_id").alias("cache_key"), F.col("props").alias("payload"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("created_at"), "event_id")
    clustered = ahead.cluster(e, scratch(spark, "clustered"), 500)
    return clustered.looked_up(e.where("event_id % 400 = 3").unionByName(e.limit(1).withColumn("cache_key", F.lit("unknown"))), 16)


def _eye():
    def label(attr, attempt, image_id):
        if (image_id % 97 == 0).any():
            raise ValueError("an image that cannot be read")
        seen = (image_id % 5 + attr.str.len()) % 2
        return seen.where((image_id % 10 != 3) | (attempt == 1) & (image_id % 20 == 3)).tolist()

    return label


EYE = batches.BatchModel("eye", _eye, "int", 64)
WORK = "w as (select event_id image_id, unnest(['red', 'blue']) attr from events), known as (select image_id, attr from w where image_id % 4 = 1 and (attr = 'red' or image_id % 8 = 1))"


def _asked(spark, d):
    images = table(spark, d, "events").select(F.col("event_id").alias("image_id"))
    attrs = spark.createDataFrame([("red",), ("blue",)], "attr string")
    work = images.withColumn("attr", F.explode(F.array(F.lit("red"), F.lit("blue"))))
    return images, attrs, work.where("image_id % 4 = 1 and (attr = 'red' or image_id % 8 = 1)")


@query(f"""with {WORK}, t as (select * from w where (image_id, attr) not in (select image_id, attr from known) and image_id % 97 <> 0)
select image_id, attr, ((image_id % 5 + len(attr)) % 2)::int g, (image_id % 10 = 3)::int attempt from t where image_id % 10 <> 3 or image_id % 20 = 3 and image_id not in (select image_id from known)""")
def detected_labels(spark, d):
    """Labels by a model that drops a tenth of the images at first, half of these again, and fails on some."""
    images, attrs, known = _asked(spark, d)
    return batches.detected(images, attrs, known, EYE, "image_id")[0]


@query(f"""with {WORK}, t as (select * from w where (image_id, attr) not in (select image_id, attr from known))
select image_id, attr, case when image_id % 97 = 0 then 'ValueError: an image that cannot be read' else 'no value' end error from t
where image_id % 97 = 0 or image_id % 10 = 3 and (image_id % 20 <> 3 or image_id in (select image_id from known))""")
def undetected_labels(spark, d):
    """What is still open after the second try."""
    images, attrs, known = _asked(spark, d)
    return batches.detected(images, attrs, known, EYE, "image_id")[1]


def _judge():
    return lambda image_id, prompt: [None if i % 11 == 0 else (i % 7) / 4 + p for i, p in zip(image_id, prompt)]


@query("""select event_id image_id, user_id prompt, case when event_id % 2 = 0 then round(value, 6) when event_id % 11 <> 0 then round((event_id % 7) / 4 + user_id, 6) end reward,
case when event_id % 2 = 1 and event_id % 11 = 0 then 'no value' end reward_error from events""")
def rated_images(spark, d):
    """Rewards by a model for the images that have none."""
    e = table(spark, d, "events").select(F.col("event_id").alias("image_id"), F.col("user_id").alias("prompt"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("reward"))
    return batches.rated(e, batches.BatchModel("judge", _judge, "double"), "image_id", "prompt")


PLAN = f"""with {E_LONG}, r as (select *, row_number() over (partition by prompt, attr order by reward, image_id) i, count(*) over (partition by prompt, attr) n from bank),
c as (select prompt, attr, g, i > n - (least(n, 9) - least(n, 9) // 2) and i > 4 high, i, n from r where i <= 4 or i > n - 5),
o as (select prompt, attr, g, row_number() over (partition by prompt, attr order by i) k, count(*) over (partition by prompt, attr) m from c),
s as (select prompt, attr, coalesce(avg(g) filter (k > m // 2), 0) - coalesce(avg(g) filter (k <= m // 2), 0) score from o group by 1, 2),
p as (select prompt, (row_number() over (partition by prompt order by score desc, attr) - 1)::int rank, attr, score from s where score > 1e-12)"""


def _plans(spark, d):
    bank = events_bank(spark, d)
    return planners.planned(planners.with_labels(sketches.context_images(bank.images.select("prompt", "image_id", "reward"), 9), bank.long().select("image_id", "attr", "g")), 9, 3)


@query(f"{PLAN} select prompt, rank, attr, round(score, 6) score from p where rank < 3")
def planned_attributes(spark, d):
    """Attributes that a planner proposes for each prompt, from its four worst and five best images."""
    return _plans(spark, d)


@query(f"""{PLAN}, q as (select attr, count(distinct prompt) n_prompts, round(avg(score), 6) score from p where rank < 3 group by 1)
select (row_number() over (order by n_prompts desc, score desc, attr) - 1)::int pos, attr, n_prompts, score from q qualify pos < 4""")
def initial_pool(spark, d):
    return planners.initial_pool(_plans(spark, d), 4)


@query(f"""with {E_LONG}, s as (select *, case when reward > 150 then 'plus' when reward < 20 then 'minus' end side from bank where prompt % 30 = 4),
h as (select attr, coalesce(avg((g = 1)::int) filter (side = 'plus'), 0) - coalesce(avg((g = 1)::int) filter (side = 'minus'), 0) score from s group by 1)
select (row_number() over (order by score desc, attr) - 1)::int rank, attr, round(score, 6) score from h where score > 0 and attr <> 'click' qualify rank < 2""")
def proposed_attributes(spark, d):
    """What a proposer finds in the best and worst images of some prompts, less what is blocked."""
    bank = events_bank(spark, d)
    chosen = bank.images.where("prompt % 30 = 4").withColumn("side", F.when(F.col("reward") > 150, "plus").when(F.col("reward") < 20, "minus")).where("side is not null").withColumn("rank", F.lit(1))
    blocked = spark.createDataFrame([(" Click",), ("other",)], "attr string")
    return planners.proposed(chosen, bank.long().select("image_id", "attr", "g"), blocked, 2)


@query()
def run_samples(spark, d):
    """The fixed baselines of a run, from its configuration alone: two levels of samples that merge."""
    return sketches.RunSamples(events_bank(spark, d).images, prompts=6, per_prompt=16).baselines().select("topic_id", "prompt", "image_id")


@query()
def source_images(spark, d):
    bank = events_bank(spark, d)
    return sketches.sources_with(bank.images, bank.long().select("image_id", "attr", "g"), 4)


@query()
def prompts_per_attr(spark, d):
    return sketches.per_attr(events_bank(spark, d).long().where("g = 1").select("attr", "prompt", "image_id"), 20)


@query("""with m as (select user_id prompt, event_id image_id, value from events where value > 170), n as (select prompt, count(*) n from m group by 1)
select prompt, image_id, round(value, 6) reward from m join n using (prompt) where n >= 2""")
def scored_prompts(spark, d):
    """The scored images of a manifest, of prompts with two at least."""
    e = table(spark, d, "events")
    scores = F.when(F.col("value") > 170, F.create_map(F.lit("m"), "value", F.lit("other"), F.lit(1.0))).otherwise(F.create_map(F.lit("other"), F.lit(1.0)))
    return files.scored_prompts(e.select(F.col("user_id").alias("prompt"), F.col("event_id").alias("image_id"), scores.alias("reward_scores")), "m")


@query("""with m as (select n_regionkey prompt, case when n_nationkey % 3 = 0 then 'nation.parquet' when n_nationkey % 3 = 1 then 'region.parquet' else 'none' || n_nationkey end path from nation where n_regionkey < 4)
select r_regionkey prompt, count(path) n_listed, count(path) filter (path not like 'none%') n_files, count(path) filter (path not like 'none%') = 0 missing from region left join m on r_regionkey = prompt group by 1""")
def image_counts(spark, d):
    """Files of a manifest that are there; the tables' own files stand for images."""
    n = table(spark, d, "nation").where("n_regionkey < 4")
    k = F.col("n_nationkey") % 3
    path = F.when(k == 0, "nation.parquet").when(k == 1, F.concat(F.lit(f"{d}/./"), F.lit("region.parquet"))).otherwise(F.concat(F.lit("none"), "n_nationkey"))
    manifest = n.select(F.col("n_regionkey").alias("prompt"), path.alias("image_path"))
    return files.image_counts(table(spark, d, "region").select(F.col("r_regionkey").alias("prompt")), manifest, files.listing(spark, d, "*.parquet"), d)


REPLY = """case event_id % 6 when 0 then 'Sure: {"reasoning": "r", "proposals": ["' || event_type || ' a", " ' || event_type || ' A ", "blocked", 7,]} done'
when 1 then '["' || event_type || ' first", "abc", "second one"]' when 2 then null when 3 then '{"other": ["' || event_type || ' x"]}' when 4 then 'no list' else '{"proposals": ["' || event_type || '", "z"' end"""


@query(f"""with r as (select event_id, event_type t, {REPLY} raw from events) select event_id, case event_id % 6 when 0 then t || ' a|7' when 1 then t || ' first|second one' when 3 then 'other|' || t || ' x' when 5 then
  case when t = 'error' then 'proposals|error' else 'proposals|' || t end else '' end proposals, case when event_id % 6 = 0 then 'r' end reasoning from r""".replace("case when t = 'error' then 'proposals|error' else 'proposals|' || t end", "case when len(t) >= 5 then 'proposals|' || t else 'proposals' end"))
def reply_proposals(spark, d):
    """Proposals read from replies of many kinds."""
    e = table(spark, d, "events")
    k, t = F.col("event_id") % 6, F.col("event_type")
    raw = (
        F.when(k == 0, F.concat(F.lit('Sure: {"reasoning": "r", "proposals": ["'), t, F.lit(' a", " '), t, F.lit(' A ", "blocked", 7,]} done')))
        .when(k == 1, F.concat(F.lit('["'), t, F.lit(' first", "abc", "second one"]'))).when(k == 3, F.concat(F.lit('{"other": ["'), t, F.lit(' x"]}')))
        .when(k == 4, F.lit("no list")).when(k == 5, F.concat(F.lit('{"proposals": ["'), t, F.lit('", "z"')))
    )
    rows = e.select("event_id", raw.alias("raw"), F.array(F.lit(" Blocked")).alias("blocked"))
    return replies.proposals(rows, 3).select("event_id", F.array_join("proposals", "|").alias("proposals"), "reasoning")


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'c|a' when o_orderkey % 5 = 1 then 'a|b' when o_orderkey % 5 = 2 then 'own|d' when o_orderkey % 5 = 3 then 'a|b' else 'b' end reps from orders""")
def reply_clusters(spark, d):
    """Representatives of clusters read from replies of many kinds."""
    k = F.col("o_orderkey") % 5
    big = '{"representative": {"index": 2}, "members": [1, 2, 3]}'
    raw = (
        F.when(k == 0, F.lit('```json\n[{"representative": {"index": 0}, "members": [1]}, ' + big + ', "x", {"representative": {"index": 9}}]\n``` bye'))
        .when(k == 1, F.lit('{"a": 1}')).when(k == 2, F.lit('[[{"representative": {"index": 9, "attribute": "own"}, "members": [1, 2]}, {"representative": {"index": 3}, "members": [1]}]]'))
        .when(k == 4, F.lit('[{"representative": "x", "members": [1, 2]}, {"representative": {"index": 1}, "members": [1]}'))
    )
    rows = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), F.array(*map(F.lit, "abcd")).alias("attributes"))
    return replies.representatives(rows, 2).select("o_orderkey", F.array_join("representatives", "|").alias("reps"))


def _chats(spark, d):
    """Conversations as chats: every third user turn shows an image, every fourth answer calls a tool after some reasoning."""
    u, a = F.col("role") == "user", F.col("role") == "assistant"
    text = F.coalesce("text", F.lit(""))
    shown = messages.user_with_images(text, F.array(F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("conv_id").cast("string").cast("binary"))), F.lit("https://host/x.png"), F.lit(None)))
    call = messages.message("assistant", messages.part("reasoning", F.lit("hm")), messages.part("text", text), messages.part("call", F.lit('{"n":1}'), call_id=F.concat(F.lit("c"), "turn"), name=F.lit("look")))
    m = F.when(u & (F.col("turn") % 3 == 1), shown).when(a & (F.col("turn") % 4 == 2), call).when(F.col("role") == "tool", messages.tool_answer(F.lit("c1"), text)).otherwise(messages.said(F.col("role"), text))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", m.alias("m")))).alias("z"))
    return rows.select("conv_id", F.transform("z", lambda z: z["m"]).cast(messages.CHAT).alias("chat"))


@query("""with c as (select conv_id, turn, role, coalesce(text, '') t from conversations)
select conv_id, count(*) n, sha256(string_agg(role || ':' || chr(10) || t, chr(10) order by turn, role, t)) digest, true responses, true completions, true blocks from c group by 1""")
def message_shapes(spark, d):
    """Chats that come back the same from all three shapes (from blocks: with the system messages in front, as one)."""
    chats = _chats(spark, d)
    system = F.filter("chat", lambda m: m["role"] == "system")
    front = F.when(F.size(system) > 0, F.array(messages.said("system", F.array_join(F.transform(system, lambda m: messages.texts(m)), "\n")))).otherwise(F.array().cast(messages.CHAT))
    there = chats.select("conv_id", "chat", F.concat(front, messages.without_system(F.col("chat"))).alias("moved"), *(f(F.col("chat")).alias(n) for n, f in (("r", messages.to_responses), ("c", messages.to_completions), ("b", messages.to_blocks))))
    return there.select(
        "conv_id", F.size("chat").cast("long").alias("n"), F.sha2(messages.as_text(F.col("chat")), 256).alias("digest"),
        F.col("chat").eqNullSafe(messages.from_responses(F.col("r"))).alias("responses"), F.col("chat").eqNullSafe(messages.from_completions(F.col("c"))).alias("completions"), F.col("moved").eqNullSafe(messages.from_blocks(F.col("b"))).alias("blocks"),
    )


@query("""select event_id, case when event_id % 3 < 2 then 't' || event_id end content, case event_id % 3 when 0 then 'stop' when 1 then 'length' end finish_reason, case when event_id % 3 < 2 then 'because' end reasoning from events""")
def unified_answers(spark, d):
    """Answers of two kinds of servers, and one without choices, as one schema."""
    k, t = F.col("event_id") % 3, F.concat(F.lit("t"), "event_id")
    listed = F.concat(F.lit('{"id": "i", "created": 5, "model": "m", "choices": [{"finish_reason": "", "native_finish_reason": "stop", "message": {"content": "'), t, F.lit('", "reasoning_details": [{"type": "reasoning.summary", "summary": "because"}]}}]}'))
    spoken = F.concat(F.lit('{"id": "i", "created_at": 5, "model": "m", "output": [{"type": "reasoning", "summary": []}, {"type": "reasoning", "summary": [{"text": "because"}]}, {"type": "message", "status": "incomplete", "content": [{"type": "refusal"}, {"type": "output_text", "text": "'), t, F.lit('"}]}]}'))
    answer = messages.unified(F.parse_json(F.when(k == 0, listed).when(k == 1, spoken).otherwise(F.lit('{"id": "i", "created": 5, "model": "m", "choices": []}'))))
    rows = table(spark, d, "events").select("event_id", answer.alias("a"))
    return rows.select("event_id", *(f(F.col("a")).alias(n) for n, f in (("content", messages.first_response), ("finish_reason", messages.finish_reason), ("reasoning", messages.reasoning_content))))
