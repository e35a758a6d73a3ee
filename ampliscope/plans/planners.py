"""Planners and proposers as table functions: a partition's context goes to a model, its reply comes back as attributes.

Registered for SQL, a planner is called as  plan(TABLE(images) PARTITION BY prompt ORDER BY (reward, image_id), 4, 3).
The context that a model sees is a few rows a prompt; draw it with sketches.context_images or choose.extremes first, so that no partition is large."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

#: Called with the context (rows as dictionaries, in order) and the number of attributes asked for; gives (attribute, score) pairs.
Plan = Callable[[list[dict], int], list[tuple[str, float]]]


def by_labels(context: list[dict], n: int) -> list[tuple[str, float]]:
    """A planner without a model: the attributes whose share in the better half of the context is most above that in the other.

    Context rows have labels, a map from attribute to 0/1/-1 (-1 counts as 0), and come by rising reward. Only attributes whose share rises count; ties by name."""
    half = len(context) // 2
    low, high = context[:half], context[half:]
    names = sorted({a for r in context for a in r["labels"]})

    def share(rows, a):
        return sum(r["labels"].get(a) == 1 for r in rows) / len(rows) if rows else 0.0

    rise = [(a, share(high, a) - share(low, a)) for a in names]
    return sorted((x for x in rise if x[1] > 0), key=lambda x: (-x[1], x[0]))[:n]


def by_sides(context: list[dict], n: int) -> list[tuple[str, float]]:
    """A proposer without a model: the attributes that images of side plus have more often than those of side minus."""
    ordered = [r for r in context if r["side"] == "minus"], [r for r in context if r["side"] == "plus"]
    names = sorted({a for r in context for a in r["labels"]})

    def share(rows, a):
        return sum(r["labels"].get(a) == 1 for r in rows) / len(rows) if rows else 0.0

    rise = [(a, share(ordered[1], a) - share(ordered[0], a)) for a in names]
    return sorted((x for x in rise if x[1] > 0), key=lambda x: (-x[1], x[0]))[:n]


def planner(plan: Plan = by_labels) -> UserDefinedTableFunction:
    """A table function (rank, attr, score) over partitions of context rows, with n_context and n_attrs as further arguments.

    Of a partition in its order the n_context // 2 first and the n_context - n_context // 2 last rows are kept, without repeats, as rows come by;
    n_context 0 keeps all. A plan that fails gives no attribute and one row of rank -1 with the error."""

    class Planned:
        def __init__(self):
            self.first, self.last, self.n, self.size = [], deque(), 0, None

        def eval(self, row, n_context: int, n_attrs: int):
            self.n = n_attrs
            if self.size is None:
                self.size = n_context
                self.last = deque(maxlen=n_context - n_context // 2 if n_context else None)
            if len(self.first) < self.size // 2:
                self.first.append(row.asDict())
            else:
                self.last.append(row.asDict())

        def terminate(self):
            if self.size is None:
                return
            try:
                found = plan([*self.first, *self.last], self.n)
            except Exception as e:
                yield -1, f"{type(e).__name__}: {e}", None
                return
            for rank, (attr, score) in enumerate(found):
                yield rank, attr, score

    return F.udtf(Planned, returnType="rank int, attr string, score double")


def register(spark: SparkSession, name: str, plan: Plan = by_labels) -> None:
    """Make a planner known to SQL under the name."""
    spark.udtf.register(name, planner(plan))


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """images with labels, a map from attribute to label. labels: image_id, attr, g."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "g"))))
    return images.join(labels.groupBy("image_id").agg(pairs.alias("labels")), "image_id", "left").withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,int>")))


def planned(context: DataFrame, n_context: int, n_attrs: int, plan: Plan = by_labels) -> DataFrame:
    """prompt, rank, attr, score for every prompt. context: prompt, image_id, reward, and what the plan takes."""
    keyed = context.asTable().partitionBy("prompt").orderBy("reward", "image_id")
    rows = planner_with_key("prompt", context, plan)(keyed, F.lit(n_context), F.lit(n_attrs))
    return rows


def planner_with_key(key: str, context: DataFrame, plan: Plan) -> UserDefinedTableFunction:
    """The planner's table function with the partition's key in front of each row."""
    kind = context.schema[key].dataType.simpleString()
    inner = planner(plan).func

    class Keyed(inner):
        def __init__(self):
            super().__init__()
            self.key = None

        def eval(self, row, n_context: int, n_attrs: int):
            self.key = row[key]
            super().eval(row, n_context, n_attrs)

        def terminate(self):
            for found in super().terminate():
                yield self.key, *found

    return F.udtf(Keyed, returnType=f"{key} {kind}, rank int, attr string, score double")


def initial_pool(plans: DataFrame, n_pop: int) -> DataFrame:
    """pos, attr, n_prompts, score: the n_pop attributes that most prompts plan, then by mean score, then by name; failed plans are left out."""
    per = plans.where("rank >= 0").groupBy("attr").agg(F.countDistinct("prompt").alias("n_prompts"), F.avg("score").alias("score"))
    top = per.orderBy(F.desc("n_prompts"), F.desc(F.round("score", 9)), "attr").limit(n_pop)
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_prompts")).alias("a"), (-F.round("score", 9)).alias("b"), "attr", "n_prompts", "score"))).alias("z"))
    return rows.select(F.posexplode("z").alias("pos", "z")).select("pos", "z.attr", "z.n_prompts", "z.score")


def proposed(sides: DataFrame, labels: DataFrame, blocked: DataFrame, n: int, plan: Plan = by_sides) -> DataFrame:
    """rank, attr, score: what a proposer makes of all sides together, less the blocked attributes (attr). sides: prompt, image_id, side, rank, of some prompts.

    The proposer is one call over a bounded choice of prompts (choose.middle_band), so it is one partition."""
    context = with_labels(sides.select("prompt", "image_id", "side", "rank"), labels).withColumn("call", F.lit(0))
    call = planner_with_key("call", context, plan)
    found = call(context.asTable().partitionBy("call").orderBy("prompt", "side", "rank", "image_id"), F.lit(0), F.lit(n + blocked.count()))
    own = found.where("rank >= 0").join(blocked.select(F.lower(F.trim("attr")).alias("_b")).distinct(), F.lower(F.trim("attr")) == F.col("_b"), "left_anti")
    first = own.agg(F.array_sort(F.collect_list(F.struct("rank", "attr", "score"))).alias("z"))
    return first.select(F.posexplode(F.slice("z", 1, n)).alias("rank", "z")).select("rank", "z.attr", "z.score")
