"""Image banks: one row per (prompt, image) with a reward and 0/1/-1 labels, bound to the driver's tables.

A wide bank has a struct-free column per label list: `g ARRAY<INT>` in the order of the bank's attributes; long() explodes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Bank:
    """images: topic_id, prompt, image_id, reward and g, the labels of attrs in order."""

    images: DataFrame
    attrs: tuple[str, ...]

    def long(self, *keep: str) -> DataFrame:
        """A row per image and attribute; columns of images in keep stay."""
        named = F.arrays_zip(F.array(*map(F.lit, self.attrs)).alias("attr"), F.col("g"))
        return self.images.select("topic_id", "prompt", "image_id", "reward", *keep, F.explode(named).alias("z")).select(
            "topic_id", "prompt", "image_id", "reward", *keep, F.col("z.attr").alias("attr"), F.col("z.g").alias("g")
        )

    def label(self, attr: str) -> Column:
        return F.col("g")[self.attrs.index(attr)]


E_ATTRS = ("purchase", "click", "k_gt_50", "morning", "weekend")
L_ATTRS = ("disc_ge_05", "returned", "qty_gt_40", "open_status")
D_ATTRS = ("quality", "toxic")


def events_bank(spark: SparkSession, sf_dir: str, tri: bool = False) -> Bank:
    """Rewards and labels of events; with tri, labels of error events are -1 (not applicable)."""
    flags = [
        F.col("event_type") == "purchase",
        F.col("event_type") == "click",
        F.get_json_object("props", "$.k").cast("int") > 50,
        F.hour("ts") < 12,
        F.dayofweek("ts").isin(1, 7),
    ]
    g = F.array(*(f.cast("int") for f in flags))
    if tri:
        g = F.when(F.col("event_type") == "error", F.array(*[F.lit(-1)] * len(flags))).otherwise(g)
    e = table(spark, sf_dir, "events")
    return Bank(e.select((F.col("user_id") % 10).cast("int").alias("topic_id"), F.col("user_id").alias("prompt"), F.col("event_id").alias("image_id"), F.col("value").alias("reward"), g.alias("g")), E_ATTRS)


def lineitem_bank(spark: SparkSession, sf_dir: str) -> Bank:
    flags = [F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R", F.col("l_quantity") > 40, F.col("l_linestatus") == "O"]
    li = table(spark, sf_dir, "lineitem")
    image = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return Bank(li.select((F.col("l_suppkey") % 10).cast("int").alias("topic_id"), F.col("l_suppkey").alias("prompt"), image.alias("image_id"), F.col("l_extendedprice").alias("reward"), F.array(*(f.cast("int") for f in flags)).alias("g")), L_ATTRS)


def documents_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long bank with missing detections: documents without labels have no rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    named = F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (attr, g)")
    labels = table(spark, sf_dir, "labels").select("doc_id", named).where("g is not null")
    return d.join(labels, "doc_id").select(F.lit(0).alias("topic_id"), F.col("source").alias("prompt"), F.col("doc_id").alias("image_id"), F.col("n_chars").cast("double").alias("reward"), "attr", F.col("g").cast("int").alias("g"))


#: The same banks in SQL, as common table expressions.
E_WIDE = """e as (select (user_id % 10)::int topic_id, user_id prompt, event_id image_id, value reward,
  (event_type = 'purchase')::int g0, (event_type = 'click')::int g1, (json_extract(props, '$.k')::int > 50)::int g2,
  (hour(ts) < 12)::int g3, (dayofweek(ts) in (0, 6))::int g4, event_type from events)"""
E_LONG = E_WIDE + """, bank as (select topic_id, prompt, image_id, reward, unnest(['purchase', 'click', 'k_gt_50', 'morning', 'weekend']) attr,
  unnest([g0, g1, g2, g3, g4]) g from e)"""
T_LONG = E_WIDE + """, bank as (select topic_id, prompt, image_id, reward, unnest(['purchase', 'click', 'k_gt_50', 'morning', 'weekend']) attr,
  unnest(case when event_type = 'error' then [-1, -1, -1, -1, -1] else [g0, g1, g2, g3, g4] end) g from e)"""
L_LONG = """bank as (select (l_suppkey % 10)::int topic_id, l_suppkey prompt, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) image_id,
  l_extendedprice reward, unnest(['disc_ge_05', 'returned', 'qty_gt_40', 'open_status']) attr,
  unnest([(l_discount >= 0.05)::int, (l_returnflag = 'R')::int, (l_quantity > 40)::int, (l_linestatus = 'O')::int]) g from lineitem)"""
D_LONG = """bank as (select 0 topic_id, source prompt, d.doc_id image_id, n_chars::double reward, attr, g from documents d join
  (select doc_id, 'quality' attr, quality g from labels union all select doc_id, 'toxic', toxic from labels) l on d.doc_id = l.doc_id where g is not null)"""
