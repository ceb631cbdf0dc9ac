"""Streaming variants, an extension: windows over events with late data, first rows of keys, overlap and cleaning on arrival.

Results that change as rows arrive (windows, first rows) are written as the changes of each batch, and read as the last
change of each key; a batch that runs again writes its own folder again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators import clean, overlap
from corpusloom.sources.files import keep_last

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream."""
    schema = spark.read.parquet(path).schema
    # As a glob: a plain path would have to be a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """The events table as a stream of its files, with its event time as an instant."""
    return read_files(spark, path, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each window of ``width`` that begins at a multiple of ``step``."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def new_texts(texts: DataFrame, reference: DataFrame, text: str = "text") -> DataFrame:
    """A stream's rows whose text isn't in the reference table: each batch is anti-joined with the whole table."""
    return overlap.without_overlap(texts, reference, text)


class _First(StatefulProcessor):
    """Of each key the row that comes first by (time, order), sent out whenever an earlier one arrives.

    Once the watermark is past its time and the lateness allowed, no earlier row can come: a timer settles the key, whose state
    is then one flag.
    """

    def __init__(self, at: str, order: str, late_ms: int, columns: Sequence[str]):
        self.at, self.order, self.late_ms, self.columns = at, order, late_ms, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "micros long, place long")
        self.settled = handle.getValueState("settled", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if self.settled.exists():
            return
        frame = pd.concat(frames).sort_values([self.at, self.order]).head(1)
        micros, place = int(frame[self.at].iloc[0]), int(frame[self.order].iloc[0])
        if self.first.exists() and tuple(self.first.get()) <= (micros, place):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(micros // 1000 + self.late_ms)
        self.first.update((micros, place))
        yield frame[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        self.settled.update((True,))
        return iter(())

    def close(self) -> None:
        pass


def first_of_key(events: DataFrame, key: str, order: str, late_minutes: int = 120) -> DataFrame:
    """The changes of each key's first row by (ts, order): the last change of a key is its first row."""
    columns = [c for c in events.columns if c != "ts"]
    out = events.select(*columns).schema
    marked = events.withColumn("event_micros", F.unix_micros("ts")).withWatermark("ts", f"{late_minutes} minutes")
    first = _First("event_micros", order, late_minutes * 60_000, columns)
    return marked.groupBy(key).transformWithStateInPandas(first, outputStructType=out, outputMode="Update", timeMode="EventTime")


class _Sessions(StatefulProcessor):
    """A key's open sessions: rows at most ``gap`` apart. What a batch changes is sent out; a session that was joined to an earlier one has no rows left.

    A timer drops sessions that the watermark, with the lateness allowed, has left behind.
    """

    def __init__(self, key: str, gap: int, late: int):
        self.key, self.gap, self.late = key, gap, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, lasts array<long>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = list(zip(*map(list, self.open.get()), strict=True)) if self.open.exists() else []
        new = [(t, t, 1) for frame in rows for t in frame["event_micros"].tolist()]
        after: list[list[int]] = []
        for start, last, n in sorted([*before, *new]):
            if after and start - after[-1][1] <= self.gap:
                after[-1][1], after[-1][2] = max(after[-1][1], last), after[-1][2] + n
            else:
                after.append([start, last, n])
        changed = {s: n for s, _, n in after} | {s: 0 for s, *_ in before if s not in {x[0] for x in after}}
        for s, _, n in before:
            if changed.get(s) == n:
                del changed[s]
        self._keep(after)
        yield pd.DataFrame({self.key: [key[0]] * len(changed), "session_micros": list(changed), "n": list(changed.values())})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.late - self.gap
        self._keep([x for x in zip(*map(list, self.open.get()), strict=True) if x[1] > passed] if self.open.exists() else [])
        return iter(())

    def _keep(self, sessions: list) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not sessions:
            self.open.clear()
            return
        self.open.update(tuple([int(x[i]) for x in sessions] for i in range(3)))
        self.handle.registerTimer((min(x[1] for x in sessions) + self.gap + self.late) // 1000 + 1)

    def close(self) -> None:
        pass


def sessions(events: DataFrame, key: str = "user_id", gap_minutes: int = 30, late_minutes: int = 120) -> DataFrame:
    """(key, session_start, n) of each session that a batch changes; n is 0 where it is now part of an earlier one."""
    kind = events.schema[key].dataType.simpleString()
    marked = events.select(key, "ts", F.unix_micros("ts").alias("event_micros")).withWatermark("ts", f"{late_minutes} minutes")
    processor = _Sessions(key, gap_minutes * 60_000_000, late_minutes * 60_000_000)
    found = marked.groupBy(key).transformWithStateInPandas(processor, outputStructType=f"{key} {kind}, session_micros long, n long", outputMode="Update", timeMode="EventTime")
    return found.select(F.timestamp_micros("session_micros").cast("timestamp_ntz").alias("session_start"), key, "n")


def without_repeats(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def cleaned(texts: DataFrame, rules: clean.Rules = clean.Rules()) -> DataFrame:
    return clean.clean(texts, rules=rules)


def run_changes(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str]) -> DataFrame:
    """All that is there now, through the streaming engine in update mode: what each batch changes is written, and the last change of a key read."""
    spark, schema = stream.sparkSession, stream.schema
    spark.createDataFrame([], schema).withColumn("_batch", F.lit(-1).cast("long")).write.parquet(f"{path}/none")
    write = lambda batch, number: batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    changes = spark.read.schema(spark.read.parquet(f"{path}/none").schema).option("recursiveFileLookup", "true").parquet(path)
    return keep_last(changes, key, ["_batch"]).drop("_batch")


def append_files(stream: DataFrame, path: str, checkpoint: str):
    """An append sink of Parquet files with exactly-once restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
