"""What the corpus operators share: scratch tables, worker set-up, word splitting, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ARROW_BYTES = 8 << 20

_scratch: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound Arrow batches by bytes so that long texts fit in memory."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only on a local master without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="ampliscope-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame, owner: str, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors.

    owner groups the tables of one caller for release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ampliscope/{owner}-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.setdefault(owner, []).append(path)
    schema = df.schema
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now; it waits for the driver's garbage collector otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, owner: str, name: str) -> None:
    """Delete one scratch table that no later step reads."""
    gone = [p for p in _scratch.get(owner, []) if p.rpartition("/")[2].startswith(f"{owner}-{name}-")]
    _scratch[owner] = [p for p in _scratch.get(owner, []) if p not in gone]
    _delete(spark, gone)


def adopt(owner: str, path: str) -> None:
    """Count a folder that an operator wrote by itself among the owner's scratch."""
    _scratch.setdefault(owner, []).append(path)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the scratch tables of an owner whose results have been written."""
    _delete(spark, _scratch.pop(owner, []))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{stem}{i}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def own_columns(df: DataFrame, *but: str) -> list[Column]:
    """All columns of df but the named ones, with names quoted: a struct of them keeps clear of an operator's own names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in but]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps, which have no order."""
    return F.xxhash64(*[c for c, f in zip(own_columns(df), df.schema) if "map<" not in f.dataType.simpleString()])


def keyed_schema(df: DataFrame, key: str, rest: str) -> StructType:
    """The key column of df, whatever its type and field names, and the columns of a DDL string."""
    return StructType([df.schema[key], *StructType.fromDDL(rest)])


def text_bytes(column: str = "text"):
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def pieces_of(text: bytes, most: int = 1 << 20):
    """Slices of at most about `most` bytes, cut at ASCII white space, so that a long text never becomes one word list."""
    start, end = 0, len(text)
    while end - start > most:
        cut = max(text.rfind(c, start, start + most) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= start:
            cut = min((p for p in (text.find(c, start + most) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0), default=end)
        yield text[start:cut]
        start = cut
    yield text[start:]


#: Lower-case ASCII letters, digits and bytes from 0x80 on stay, A-Z are lowered, all else parts words.
LOWERED = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def lowered_words(text: bytes):
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text whose A-Z are lowered, in lists of bounded length."""
    for piece in pieces_of(text.translate(LOWERED)):
        yield piece.split()


def components(edges: DataFrame, owner: str) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its connected component.

    Large-star and small-star steps in turn; each round is saved, and the driver sees only a count and a checksum."""
    spark = edges.sparkSession
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), owner, "edges")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        now = saved(small, owner, "edges")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == before:
            break
        before = tuple(sign)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
