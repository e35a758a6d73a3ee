"""A cache clustered by time: lookups open the files that may hold a key, and bring along the entries that follow.

Rows lie in files of equal size in order of (created_at, cache_key), so a row's place tells its file. An index has a row a file: its
bounds and a Bloom filter of its keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import placed

CHUNK = 128  # entries that follow a hit
FILE_ROWS = 100_000
MOST_ASKED = 10_000  # keys that are tested against the filters at once
_BITS, _PROBES = 12, 6  # bits a key, and places looked at: a file opens for nothing in one of 300 cases


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """The bit places of keys, a row a key, from two hashes."""
    a, b = first.astype(np.uint64), second.astype(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + b[:, None] * np.arange(_PROBES, dtype=np.uint64)) % np.uint64(size)


def _bloom(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    size = max(64, _BITS * len(frame))
    bits = np.zeros(size, bool)
    bits[_places(frame["a"].to_numpy(), frame["b"].to_numpy(), size).ravel()] = True
    return pd.DataFrame({"file": [key[0]], "low": [frame["created_at"].min()], "high": [frame["created_at"].max()], "n": [len(frame)], "size": [size], "bits": [np.packbits(bits).tobytes()]})


def _hashes(key: str = "cache_key"):
    return F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")


def cluster(cache: DataFrame, path: str, file_rows: int = FILE_ROWS) -> ClusteredCache:
    """Write cache (cache_key, payload, created_at; one row a key) as files in order of time, with their index."""
    rows = placed(cache.select("cache_key", "payload", "created_at"), F.col("created_at"), F.col("cache_key"), name="pos")
    dealt = rows.withColumn("file", F.floor(F.col("pos") / file_rows).cast("long")).repartition("file").sortWithinPartitions("file", "pos")
    dealt.write.partitionBy("file").parquet(f"{path}/rows")
    spark = cache.sparkSession
    kind = cache.schema["created_at"].dataType.simpleString()
    own = spark.read.schema(dealt.schema).parquet(f"{path}/rows").select("file", "created_at", *_hashes())
    own.groupBy("file").applyInPandas(_bloom, f"file long, low {kind}, high {kind}, n long, size long, bits binary").write.parquet(f"{path}/index")
    return ClusteredCache(spark, path, file_rows)


class ClusteredCache:
    def __init__(self, spark: SparkSession, path: str, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.file_rows = spark, path, file_rows
        self.schema = spark.read.parquet(f"{path}/rows").schema if self._filled() else None

    def _filled(self) -> bool:
        return not self.spark.read.parquet(f"{self.path}/index").isEmpty()

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def rows(self, files: list[int] | None = None) -> DataFrame:
        """The rows of some files; no other file is opened. Without a list those of all."""
        if self.schema is None or files == []:
            return self.spark.createDataFrame([], self.schema or "cache_key string, payload string, created_at timestamp, pos long, file long")
        if files is None:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/file={f}" for f in files))

    def files_with(self, asked: DataFrame) -> list[int]:
        """The files whose filter has one of the keys, in order. Up to MOST_ASKED keys."""
        keys = asked.select(*_hashes()).distinct().limit(MOST_ASKED + 1).toPandas()
        if len(keys) > MOST_ASKED:
            raise ValueError(f"more than {MOST_ASKED} keys: join the rows instead")
        a, b = keys["a"].to_numpy(np.int64), keys["b"].to_numpy(np.int64)

        def held(frames):
            for frame in frames:
                hit = []
                for size, raw in zip(frame["size"], frame["bits"]):
                    at = _places(a, b, size).astype(np.int64)
                    bits = np.frombuffer(raw, np.uint8)
                    hit.append(bool((bits[at >> 3] >> (7 - (at & 7)) & 1).all(1).any()))
                yield frame.loc[hit, ["file"]]

        return sorted(r["file"] for r in self.index.select("file", "size", "bits").mapInPandas(held, "file long").collect())

    def looked_up(self, asked: DataFrame, chunk: int = CHUNK) -> DataFrame:
        """cache_key, payload, created_at, hit: the entries of the asked keys, and (hit false) those that follow each of them.

        A hit brings the first `chunk` other entries that are not older than it, in order of (created_at, cache_key). More keys
        than the filters take at once are joined with all rows; the result is the same. Null and unknown keys bring nothing."""
        keys = asked.select("cache_key").where("cache_key is not null").distinct()
        many = keys.limit(MOST_ASKED + 1).count() > MOST_ASKED
        found = self.rows(None if many else self.files_with(keys)).join(keys, "cache_key").select("cache_key", "created_at", "pos")
        times = found.select("created_at").distinct()
        first = self._first_rows(None if many else self._files_from(times)).join(times, "created_at")
        last = F.col("start") + F.when(F.col("pos") <= F.col("start") + chunk, chunk).otherwise(chunk - 1)
        wanted = found.join(first, "created_at").select(F.col("pos").alias("own"), F.explode(F.sequence("start", last)).alias("pos"))
        wanted = wanted.where("pos <> own").select("pos").unionByName(found.select("pos")).distinct()
        rows = self.rows(None if many else self._files_of(wanted)).join(wanted, "pos")
        rows = rows.join(found.select("pos", F.lit(True).alias("hit")), "pos", "left")
        return rows.select("cache_key", "payload", "created_at", F.coalesce("hit", F.lit(False)).alias("hit"))

    def _files_from(self, times: DataFrame) -> list[int]:
        """For each of up to MOST_ASKED times the first file that reaches it: rows of that time begin there."""
        reached = self.index.select("file", "high").join(F.broadcast(times), F.col("high") >= F.col("created_at"))
        return sorted(r["file"] for r in reached.groupBy("created_at").agg(F.min("file").alias("file")).select("file").distinct().collect())

    def _first_rows(self, files: list[int] | None) -> DataFrame:
        """created_at, start: the first place of each time in the files."""
        return self.rows(files).groupBy("created_at").agg(F.min("pos").alias("start"))

    def _files_of(self, wanted: DataFrame) -> list[int]:
        """The files that hold places, of those that there are."""
        places = wanted.select(F.floor(F.col("pos") / self.file_rows).cast("long").alias("file")).distinct()
        return sorted(r["file"] for r in places.join(self.index.select("file"), "file").collect())
