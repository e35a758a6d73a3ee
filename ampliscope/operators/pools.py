"""Attribute pools and detection tables: set operations, merges, coverage, cache eviction, step history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_distinct(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The first row of each key by pos, in columns as given."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("_r = 1").drop("_r")


def appended(pool: DataFrame, new: DataFrame, key: str = "attr") -> DataFrame:
    """Pool rows, then the new keys not among them; pos goes on from the pool's last. Both have (key, pos)."""
    last = pool.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_last"))
    late = new.join(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("_last") + 1).drop("_last")
    return ordered_distinct(pool.unionByName(late), key)


def without(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return rows.join(other.select(*keys).distinct(), list(keys), "left_anti")


def normalized(column: str = "attr"):
    return F.lower(F.trim(column))


def unblocked(proposals: DataFrame, *blocks: DataFrame) -> DataFrame:
    """Proposals whose lower-case, trimmed text is in no block list."""
    blocked = None
    for b in blocks:
        own = b.select(normalized().alias("_n"))
        blocked = own if blocked is None else blocked.union(own)
    return proposals.withColumn("_n", normalized()).join(blocked.distinct(), "_n", "left_anti").drop("_n")


#: Attributes that a detector is asked for at once.
MOST_ATTRS = 10_000


def misses(images: DataFrame, attrs: DataFrame, detections: DataFrame) -> DataFrame:
    """(image_id, attr) still to detect: every image with every attribute of the list (MOST_ATTRS at most, else an error), less what is known."""
    listed = [r["attr"] for r in attrs.select("attr").limit(MOST_ATTRS + 1).collect()]
    if len(listed) > MOST_ATTRS:
        raise ValueError(f"a detection list has at most {MOST_ATTRS} attributes")
    named = F.explode(F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")).alias("attr")
    return images.select("image_id", named).join(detections.select("image_id", "attr"), ["image_id", "attr"], "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, attr, g) of both; the new label wins."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return both.groupBy("image_id", "attr").agg(F.max_by("g", "_p").alias("g"))


def last_wins(tables: list[DataFrame], *keys: str) -> DataFrame:
    """Union of tables; for each key the row of the last table that has it."""
    ranked = [t.withColumn("_p", F.lit(i)) for i, t in enumerate(tables)]
    both = ranked[0]
    for t in ranked[1:]:
        both = both.unionByName(t)
    w = Window.partitionBy(*keys).orderBy(F.desc("_p"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def coverage(images: DataFrame, attrs: list[str], detections: DataFrame) -> DataFrame:
    """total images, full ones (all attrs detected), and missing: attrs detected on no image, in order."""
    own = detections.where(F.col("attr").isin(attrs)).join(images.select("image_id"), "image_id", "left_semi")
    per = own.groupBy("image_id").agg(F.countDistinct("attr").alias("k"))
    full = per.agg(F.count_if(F.col("k") == len(attrs)).alias("fully_covered"))
    seen = own.agg(F.collect_set("attr").alias("seen"))
    total = images.agg(F.countDistinct("image_id").alias("total"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, attrs)), "seen"))
    return total.crossJoin(full).crossJoin(seen).select("total", "fully_covered", F.array_join(missing, ",").alias("missing"))


def partly_covered(images: DataFrame, attrs: DataFrame, detections: DataFrame) -> DataFrame:
    """attr, covered, total of attributes that some image lacks."""
    total = images.agg(F.countDistinct("image_id").alias("total"))
    own = detections.join(images.select("image_id"), "image_id", "left_semi").groupBy("attr").agg(F.countDistinct("image_id").alias("covered"))
    rows = attrs.select("attr").join(own, "attr", "left").withColumn("covered", F.coalesce("covered", F.lit(0))).join(F.broadcast(total))
    return rows.where("covered < total")


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """The cache without its least recently used rows, down to 90 % of `most`, if it holds more. cache: cache_key, last_used.

    Rows go in order of (last_used, cache_key). The place where they stop is found by counting parts of the range of times, and
    then beginnings of the keys at the boundary time, so no task sorts the cache, even if all its rows have one time."""
    n = cache.count()
    if n <= most:
        return cache
    go = n - int(most * 0.9)
    time, before = _edge(cache.groupBy("last_used").agg(F.count("*").alias("n")), "last_used", go)
    at = F.col("last_used") == F.lit(time)
    key = _edge_key(cache.where(at).select("cache_key"), go - before)
    return cache.where((F.col("last_used") > F.lit(time)) | at & (F.col("cache_key") > F.lit(key)))


def _edge_key(keys: DataFrame, go: int) -> str:
    """The key at which the first `go` keys end: the beginning that it has is made longer until few keys have it."""
    start = ""
    while True:
        rows = keys.where(F.col("cache_key").startswith(start))
        few = sorted((r["cache_key"] for r in rows.limit(4097).collect()), key=str.encode)
        if len(few) <= 4096:
            return few[go - 1]
        for r in sorted(rows.groupBy(F.substring("cache_key", 1, len(start) + 1).alias("p")).count().collect(), key=lambda r: r["p"].encode()):
            if r["count"] >= go:
                break
            go -= r["count"]
        if r["p"] == start:
            return start
        start = r["p"]


def _edge(counts: DataFrame, name: str, go: int) -> tuple:
    """The value of a column at which the first `go` rows end, and how many rows come before it: the range is narrowed by counts of its parts. counts: name, n."""
    at = F.col(name).cast("double")
    rows, before = counts, 0
    while True:
        lo, hi, kinds = rows.agg(F.min(at), F.max(at), F.count("*")).first()
        if kinds <= 4096 or lo == hi:
            break
        part = F.least(F.floor((at - lo) / (hi - lo) * 1024), F.lit(1023))
        for r in sorted(rows.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect(), key=lambda r: r["p"]):
            if before + r["n"] >= go:
                rows = rows.where(part == r["p"])
                break
            before += r["n"]
    for r in sorted(rows.collect(), key=lambda r: r[name]):
        if before + r["n"] >= go:
            return r[name], before
        before += r["n"]


def history(pool: DataFrame) -> DataFrame:
    """topic_id, attr, step_found, step_last_survived, score (at the last step). pool: topic_id, step_idx, attr, score."""
    return pool.groupBy("topic_id", "attr").agg(F.min("step_idx").alias("step_found"), F.max("step_idx").alias("step_last_survived"), F.max_by("score", "step_idx").alias("score"))


def ages(pool: DataFrame) -> DataFrame:
    """Pool rows with first_seen and age in steps."""
    first = F.min("step_idx").over(Window.partitionBy("topic_id", "attr"))
    return pool.withColumn("first_seen", first).withColumn("age", F.col("step_idx") - F.col("first_seen"))


def latest_before(stats: DataFrame, step: int, *keys: str) -> DataFrame:
    """For each key the row of the largest step below `step`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("step_idx"))
    return stats.where(F.col("step_idx") < step).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sorted_union(*lists: DataFrame) -> DataFrame:
    """topic_id, attrs: the sorted distinct attributes of all lists (topic_id, attr)."""
    both = lists[0].select("topic_id", "attr")
    for x in lists[1:]:
        both = both.unionByName(x.select("topic_id", "attr"))
    return both.groupBy("topic_id").agg(F.array_sort(F.collect_set("attr")).alias("attrs"))


def all_scored(entries: DataFrame, score: str = "reward"):
    """Whether there is an entry and all have the score."""
    return entries.agg(F.coalesce(F.every(F.col(score).isNotNull()), F.lit(False)).alias("ok"))


def memoized(rows: DataFrame, cache: DataFrame, key: str, decide, value: str = "decision") -> tuple[DataFrame, DataFrame]:
    """rows with a decision: known ones from cache (key, value), others from decide(rows); and the new cache rows.

    decide sees each unknown key once."""
    known = rows.join(cache.select(key, value).dropDuplicates([key]), key, "left")
    fresh = decide(rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])).select(key, F.col(value).alias("_new"))
    return known.join(fresh, key, "left").withColumn(value, F.coalesce(value, "_new")).drop("_new"), fresh.withColumnRenamed("_new", value)


def covered_or_error(rows: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """rows with scores joined on; an error if no row has one."""
    joined = rows.join(scores.select(key, score), key, "left")
    if joined.where(F.col(score).isNotNull()).isEmpty():
        raise ValueError(f"no row has {score}")
    return joined


def undesirable(found: DataFrame) -> DataFrame:
    """Attributes whose reward goes up while the judge's does not; unknown deltas do not count."""
    return found.where((F.col("delta_rm") > 0) & (F.col("delta_j") <= 0))
