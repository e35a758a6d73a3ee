"""The response cache as a stream: puts and touches of keys become state with timers, and changes go to a keyed table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.versions import KeyedTable

CHANGE = "cache_key string, op string, payload string, created_at timestamp, last_used timestamp"
#: How long a writer waits for more to write.
FLUSH_SECONDS = 0.5


class CacheEntries(StatefulProcessor):
    """The entry of each key. Events: cache_key, at, op (put or touch), payload.

    Events count in order of time. A put replaces the entry, whatever it finds. A touch moves last_used of an entry that is alive; touches in the
    flush of its put (`at` floored to flush_seconds) are part of the put and do not. An entry that `ttl` passes over unused is
    dead: a timer removes it when the watermark is past, and a touch that comes later finds nothing. Of puts at one time that of
    greatest payload counts; a put older than the entry does not. So what is left depends on the events alone and not on how they fell into micro-batches,
    as long as they are no later than the watermark allows. Each micro-batch gives a row for a key that changed: put, touch, or expired."""

    def __init__(self, ttl_seconds: float, flush_seconds: float = FLUSH_SECONDS):
        self.ttl, self.flush = int(ttl_seconds * 1e6), int(flush_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "payload string, created_at long, last_used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["at", "op", "payload"], na_position="first")
        payload, created, used = self.entry.get() if self.entry.exists() else (None, None, None)
        before, op = (payload, created, used), None
        for at, is_put, text in zip(_micros(events["at"]), events["op"] == "put", events["payload"]):
            if is_put:
                if created is None or at >= created:
                    payload, created, used, op = (None if pd.isna(text) else text), at, at, "put"
            elif created is not None:
                if at > used + self.ttl:
                    payload = created = used = None
                elif at // self.flush > created // self.flush and at > used:
                    used, op = at, op or "touch"
        if (payload, created, used) == before:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if created is None:
            if self.entry.exists():
                self.entry.clear()
                yield _change(key, "expired", *before)
            return
        self.entry.update((payload, created, used))
        self.handle.registerTimer((used + self.ttl) // 1000 + 1)
        yield _change(key, op or "put", payload, created, used)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.entry.get()
        self.entry.clear()
        yield _change(key, "expired", *old)

    def close(self) -> None:
        pass


def _micros(at: pd.Series) -> list[int]:
    return at.to_numpy("datetime64[us]").astype("int64").tolist()


def _change(key, op: str, payload: str | None, created: int, used: int) -> pd.DataFrame:
    times = {"created_at": pd.to_datetime([created], unit="us"), "last_used": pd.to_datetime([used], unit="us")}
    return pd.DataFrame({"cache_key": [key[0]], "op": [op], "payload": pd.Series([payload], dtype=object)} | times)


def entry_changes(events: DataFrame, ttl_seconds: float, flush_seconds: float = FLUSH_SECONDS, late: str = "0 seconds") -> DataFrame:
    """A stream of changes (cache_key, op, payload, created_at, last_used) of the entries. Needs the RocksDB state store.

    A key's entry is all that is held; `late` is how far behind events may come. Null keys are left out."""
    own = events.where("cache_key is not null").select("cache_key", "at", "op", F.col("payload").cast("string").alias("payload")).withWatermark("at", late)
    return own.groupBy("cache_key").transformWithStateInPandas(CacheEntries(ttl_seconds, flush_seconds), CHANGE, "Append", "EventTime")


def streaming_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session with the state store that timers need; the number of state partitions is fixed when a stream first starts, by default one a core."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    return own


def cache_table(spark, path: str) -> KeyedTable:
    return KeyedTable(spark, path, CHANGE, ("cache_key",))


def live(table: KeyedTable) -> DataFrame:
    """The entries of the table; expired ones are rows that compaction leaves out."""
    return table.read().where("op <> 'expired'").drop("op")


def write_behind(changes: DataFrame, table: KeyedTable, checkpoint: str, writer: str = "cache", compact_every: int = 64, **trigger) -> StreamingQuery:
    """Append each micro-batch of changes to the table as one delta, and fold the deltas now and then.

    How much a batch holds is the source's own bound (maxFilesPerTrigger, maxOffsetsPerTrigger), how long it waits the trigger's
    (processingTime; availableNow by default). A batch that runs again is known by its number and changes nothing."""

    def flush(rows: DataFrame, number: int) -> None:
        one = rows.groupBy("cache_key").agg(F.max_by(F.struct(*rows.columns), F.struct("last_used", F.col("op") == "expired")).alias("row")).select("row.*")
        table.append(one, writer, number)
        if len(table.entry()["folders"]) > compact_every:
            table.compact(lambda rows: rows.where("op <> 'expired'"))

    return changes.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
