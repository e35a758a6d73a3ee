"""Survey, funnel, trend and agreement reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def survey(edits: DataFrame) -> DataFrame:
    """attr, n_attempts, success_rate, n_rewards, mean_drop, pct_positive. edits: attr, success BOOLEAN, drop DOUBLE (null: unscored)."""
    return edits.groupBy("attr").agg(F.count("*").alias("n_attempts"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.count("drop").alias("n_rewards"), F.avg("drop").alias("mean_drop"), (F.count_if(F.col("drop") > 0) / F.greatest(F.count("drop"), F.lit(1))).alias("pct_positive"))


def survey_total(rows: DataFrame, editable: float = 0.5) -> DataFrame:
    """n_attrs, n_attempts, n_editable and weighted_drop of a survey."""
    return rows.agg(F.count("*").alias("n_attrs"), F.sum("n_attempts").alias("n_attempts"), F.count_if(F.col("success_rate") >= editable).alias("n_editable"), (F.sum(F.col("mean_drop") * F.col("n_rewards")) / F.sum("n_rewards")).alias("weighted_drop"))


def ranked(rows: DataFrame) -> DataFrame:
    """A survey with place: by success rate, the most attempts and then the name breaking ties. A row an attribute."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("success_rate"), F.desc("n_attempts"), "attr")))


def markdown(rows: DataFrame, *columns: str, digits: int = 4, most: int = 1000) -> str:
    """A report of at most `most` rows as a table in Markdown, in the rows' order."""
    columns = columns or tuple(rows.columns)

    def cell(x) -> str:
        return "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")

    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = [columns, ["---"] * len(columns), *([cell(x) for x in r] for r in found)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def samples(edits: DataFrame, n: int = 4) -> DataFrame:
    """attr, images: the ids of its first n successful edits."""
    w = Window.partitionBy("attr").orderBy("image_id")
    first = edits.where("success").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return first.groupBy("attr").agg(F.array_sort(F.collect_list("image_id")).alias("images"))


def confusion(samples_: DataFrame) -> DataFrame:
    """attr, n, agree, na_to_absent, na_to_present, present_to_absent, absent_to_present. samples_: attr, app, control in 1/0/-1."""
    case = lambda a, c: F.count_if((F.col("app") == a) & (F.col("control") == c))
    return samples_.groupBy("attr").agg(F.count("*").alias("n"), F.count_if(F.col("app") == F.col("control")).alias("agree"), case(-1, 0).alias("na_to_absent"), case(-1, 1).alias("na_to_present"), case(1, 0).alias("present_to_absent"), case(0, 1).alias("absent_to_present"))


def shares(rows: DataFrame) -> DataFrame:
    """A confusion table's totals and percentages."""
    n = F.greatest(F.sum("n"), F.lit(1))
    return rows.agg(F.sum("n").alias("n"), *((100 * F.sum(c) / n).alias(f"pct_{c}") for c in ("agree", "na_to_absent", "na_to_present", "present_to_absent", "absent_to_present")))


def consistent(rounds: DataFrame, n: int, target: int = 1) -> DataFrame:
    """(attr, image_id) whose n rounds all gave the target; any -1 disqualifies."""
    return rounds.groupBy("attr", "image_id").agg(F.count_if(F.col("g") == target).alias("hits"), F.count_if(F.col("g") == -1).alias("na")).where(f"hits = {n} and na = 0").select("attr", "image_id")


def funnel(proposals: DataFrame) -> DataFrame:
    """step_idx, proposed, human, validated, admitted and rates. proposals: step_idx, human, validated, admitted BOOLEAN."""
    n = lambda c: F.count_if(F.col(c))
    return proposals.groupBy("step_idx").agg(F.count("*").alias("proposed"), n("human").alias("human"), n("validated").alias("validated"), n("admitted").alias("admitted"), (n("human") / F.count("*")).alias("human_rate"), (n("admitted") / F.greatest(n("validated"), F.lit(1))).alias("admit_rate"))


def step_deltas(trend: DataFrame, *values: str) -> DataFrame:
    """trend (topic_id, step_idx, values) with the change of each value against the step before."""
    w = Window.partitionBy("topic_id").orderBy("step_idx")
    return trend.withColumns({f"d_{v}": F.col(v) - F.lag(v).over(w) for v in values})


def peak(trend: DataFrame, value: str) -> DataFrame:
    return trend.groupBy("topic_id").agg(F.max_by("step_idx", F.struct(value, F.negative("step_idx"))).alias("peak_step"), F.max(value).alias("peak"))


def top_attributes(found: DataFrame, deltas: DataFrame, k: int) -> DataFrame:
    """Found attributes with their curve's delta, by delta (missing last), then score, then name."""
    return found.join(deltas, "attr", "left").orderBy(F.desc_nulls_last("delta"), F.desc("a_hat"), "attr").limit(k)
