"""Keyed tables that grow by commits: deltas are appended, the latest row of a key wins, compaction folds them.

A table is a folder of Parquet folders and a log. A commit is one small file in the log, named by its version, that lists the
folders of that version; it appears whole and only if no other has that name. So readers see a whole version or the one before,
and of two writers that start from one version the second reads again and adds its change to the first one's."""

from __future__ import annotations

import errno
import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_EMPTY = {"version": 0, "folders": [], "batches": {}}


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class KeyedTable:
    """Rows of a schema at path, one for each key. `buckets` folders by key hash keep compaction and lookups apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), tuple(keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(conf)
        self._fs.mkdirs(self._at("log"))

    # The log

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def entry(self, version: int | None = None) -> dict:
        """The commit of a version, by default of the last."""
        if version is None:
            version = max((int(x[:-5]) for x in self._names("log") if x.endswith(".json")), default=0)
        if not version:
            return dict(_EMPTY)
        stream = self._fs.open(self._at(f"log/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _claimed(self, entry: dict) -> bool:
        """Put the commit in place, whole, unless its version is taken. Needs a store whose rename refuses a name in use; local disks have links."""
        final, temporary = self._at(f"log/{entry['version']:012d}.json"), self._at(f"log/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        try:
            if self._fs.getScheme() != "file":
                return not self._fs.exists(final) and self._fs.rename(temporary, final)
            os.link(temporary.toUri().getPath(), final.toUri().getPath())
            return True
        except OSError as e:
            if e.errno != errno.EEXIST:
                raise
            return False
        finally:
            self._fs.delete(temporary, False)

    def commit(self, change: Callable[[dict], dict | None], tries: int = 50) -> dict:
        """Apply change to the last commit; on a conflict to the one that was faster. None: nothing to do."""
        for n in range(tries):
            last = self.entry()
            new = change(json.loads(json.dumps(last)))
            if new is None:
                return last
            new["version"] = last["version"] + 1
            if self._claimed(new):
                return new
            time.sleep(min(1.0, 0.01 * 2 ** min(n, 6)))
        raise Conflict(f"{self.path}: {tries} commits in a row lost to other writers")

    # Rows

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, name: str, order: str | None = None) -> str:
        """Rows as a new folder by buckets; not part of the table before a commit."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn("_bucket", self.bucket())
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> dict:
        """Commit rows as a delta. A batch number of a writer that is already in the table changes nothing.

        Of several rows of one key in a delta any may win: give one."""
        def known(entry):
            return batch is not None and entry["batches"].get(writer, -1) >= batch

        if known(self.entry()):
            return self.entry()
        folder = self._written(rows, "delta")

        def change(entry):
            if known(entry):
                return None
            entry["folders"].append(folder)
            if batch is not None:
                entry["batches"][writer] = batch
            return entry

        return self.commit(change)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: of each key that of the last folder."""
        return self._folded(self.entry(version)["folders"])

    def _folded(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        names = [f.name for f in self.schema]
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{x}").select(*names) for x in folders]
        if len(parts) == 1:
            return parts[0]
        every = None
        for i, part in enumerate(parts):
            part = part.withColumn("_age", F.lit(i))
            every = part if every is None else every.unionAll(part)
        row = F.max_by(F.struct(*names), "_age").alias("row")
        return every.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys))).agg(row).select("row.*")

    def compact(self, keep: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """Fold all folders into one; keep may leave rows out (eviction). Deltas that others commit meanwhile stay as they are.

        A run that fails before its commit changes nothing; what it wrote is removed by vacuum()."""
        start = self.entry()
        if not start["folders"] or len(start["folders"]) == 1 and keep is None:
            return start
        rows = self.read(start["version"])
        base = self._written(keep(rows) if keep else rows, "base")

        def change(entry):
            if entry["folders"][: len(start["folders"])] != start["folders"]:
                raise Conflict(f"{self.path}: compacted by another run since")
            entry["folders"] = [base, *entry["folders"][len(start["folders"]) :]]
            return entry

        return self.commit(change)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete folders that none of the last versions lists, and older commits; how many folders went.

        Only where no writer is under way: what it has written and not committed yet is listed nowhere."""
        last = self.entry()["version"]
        versions = sorted(int(x[:-5]) for x in self._names("log") if x.endswith(".json"))
        used = {f for v in versions if v > last - keep_versions for f in self.entry(v)["folders"]}
        gone = [x for x in self._names("data") if f"data/{x}" not in used]
        for x in gone:
            self._fs.delete(self._at(f"data/{x}"), True)
        for v in versions:
            if v <= last - keep_versions:
                self._fs.delete(self._at(f"log/{v:012d}.json"), False)
        return len(gone)


def score_table(spark: SparkSession, path: str) -> KeyedTable:
    """Scores of images by name; writers of different score names never overwrite each other."""
    return KeyedTable(spark, path, "image_id string, name string, score double", ("image_id", "name"))


def add_scores(table: KeyedTable, scores: DataFrame, name: str, column: str = "score") -> dict:
    """Merge a score column, keyed by image_id, into the table; known images get the new score."""
    return table.append(scores.select("image_id", F.lit(name).alias("name"), F.col(column).alias("score")))


def score_maps(table: KeyedTable) -> DataFrame:
    """image_id, scores: a map from name to score, names in order."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "score")))
    return table.read().groupBy("image_id").agg(F.map_from_entries(pairs).alias("scores"))
