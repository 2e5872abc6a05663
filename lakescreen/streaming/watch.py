"""Continuous operators: folders that are watched until files are stable, and alerts on pasted text."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds between looks, lengths, cooldown, limits.
POLL_SECONDS, COOLDOWN_SECONDS = 5, 8
CLIP_LEAST, CLIP_MOST, CATEGORIES_SHOWN = 15, 50_000, 6
#: Seconds after which a path that no look brings is gone, and a source that pastes nothing is forgotten.
GONE_SECONDS, FORGOTTEN_SECONDS = 2.5 * POLL_SECONDS, 24 * 3600
#: State with timers needs this store; set spark.sql.streaming.stateStore.providerClass to it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEMPORARY = r"^(?:~\$|\.)|\.(?:tmp|part|crdownload|download)$"


class FolderReader(SimpleDataSourceStreamReader):
    """Each look gives every file of the folder: path, mtime, size, the number of the look and its time."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"look": 0}

    def _rows(self, look: int) -> list[tuple]:
        out, now = [], datetime.now(UTC)
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            if os.path.isfile(path):
                stat = os.stat(path)
                out.append((path, stat.st_mtime, stat.st_size, look, now))
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        look = start["look"] + 1
        return iter(self._rows(look)), {"look": look}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(end["look"]))


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return "path string, mtime double, size long, look long, at timestamp"

    def simpleStreamReader(self, schema: object) -> FolderReader:
        return FolderReader(self.options)


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of looks at a folder that the driver sees."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("watched_folder").option("path", folder).load()


def changes(looks: DataFrame) -> DataFrame:
    """Batch form: files of each look that are new or differ from the look before, temporary names aside."""
    named = looks.where(~F.regexp_extract("path", r"([^/]*)$", 1).rlike(TEMPORARY))
    before = Window.partitionBy("path").orderBy("look")
    was = F.lag(F.struct("look", "mtime", "size")).over(before)
    same = (was["look"] == F.col("look") - 1) & (was["mtime"] == F.col("mtime")) & (was["size"] == F.col("size"))
    return named.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")


class Settling(StatefulProcessor):
    """What is known of a path: its last look, whether it changed there, and a timer that forgets it when looks stop."""

    def __init__(self, keep_seconds: float):
        self.keep = int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "mtime double, size long, look long, timer long, pending boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        was = self.seen.get() if self.seen.exists() else None
        if was is not None:
            self.handle.deleteTimer(was[3])
        for row in sorted(rows, key=lambda r: r.look):
            if was is not None and row.ms > was[3]:
                yield Row(path=key[0], event="gone", mtime=was[0], size=was[1], look=was[2])
                was = None
            # What is there at the first look is the baseline.
            same = was is not None and was[:3] == (row.mtime, row.size, row.look - 1)
            if same and was[4]:
                yield Row(path=key[0], event="stable", mtime=row.mtime, size=row.size, look=row.look)
            pending = not same and (was is not None or row.look != 1)
            was = (row.mtime, row.size, row.look, row.ms + self.keep, pending)
        self.seen.update(was)
        self.handle.registerTimer(was[3])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        was = self.seen.get()
        self.seen.clear()
        yield Row(path=key[0], event="gone", mtime=was[0], size=was[1], look=was[2])

    def close(self) -> None:
        pass


def file_events(looks: DataFrame, keep_seconds: float = GONE_SECONDS) -> DataFrame:
    """(path, event, mtime, size, look) from a stream of looks (path, mtime, size, look, at).

    event: ``stable`` for files that appeared or changed after the first look, once they are the same for one full look;
    ``gone``, with the last look that had it, for a path that no look has brought for ``keep_seconds``. A path that is gone
    leaves no state. Looks come in order of their times; temporary names are passed over.
    """
    named = looks.where(~F.regexp_extract("path", r"([^/]*)$", 1).rlike(TEMPORARY)).withWatermark("at", "0 seconds")
    timed = named.select("path", "mtime", "size", "look", "at", F.unix_millis("at").alias("ms"))
    return timed.groupBy("path").transformWithState(Settling(keep_seconds), "path string, event string, mtime double, size long, look long", "append", "EventTime")


def stable_files(looks: DataFrame, keep_seconds: float = GONE_SECONDS) -> DataFrame:
    """(path, mtime, size, look) of files that appeared or changed after the first look, once they are the same for one full look."""
    return file_events(looks, keep_seconds).where("event = 'stable'").drop("event")


#: Alerts that are kept, folders that are watched at once.
ALERTS, FOLDERS = 50, 3


def scan_alerts(results: DataFrame, n: int = ALERTS) -> DataFrame:
    """(timestamp, path, risk_level, finding_count, notify) of the last n scanned files; red and black ones call for a notice."""
    severe = F.col("risk_level").isin("rød", "svart")
    return results.select("timestamp", "path", "risk_level", "finding_count", severe.alias("notify")).orderBy(F.desc("timestamp"), "path").limit(n)


def scan_changes(stable: DataFrame, scan: Callable[[DataFrame], DataFrame], history: str, notify: Callable[[DataFrame], None] | None = None):
    """Start scanning what a stream of stable files brings: each batch's results are added to ``history``, severe ones told.

    scan: from files (path, mtime, size, look) to results (timestamp, path, risk_level, finding_count). A batch that runs
    again replaces its own part of the history.
    """

    def each(files: DataFrame, batch: int) -> None:
        results = scan(files)
        results.withColumn("source", F.lit("watch")).write.mode("overwrite").parquet(f"{history.rstrip('/')}/batch={batch}")
        if notify is not None:
            severe = scan_alerts(files.sparkSession.read.parquet(f"{history.rstrip('/')}/batch={batch}")).where("notify")
            if not severe.isEmpty():
                notify(severe)

    return stable.writeStream.foreachBatch(each)


def watch_all(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One stream of looks at several folders, three at most."""
    if not 1 <= len(folders) <= FOLDERS:
        raise ValueError(f"1 to {FOLDERS} folders can be watched")
    streams = [watch(spark, f) for f in folders]
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    return out


def clipboard_alert(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, ts, hash, risk_level, finding_count, categories) of pasted texts that are red or black; never the text.

    texts: (doc_id, source, ts, text); findings of the first ``CLIP_MOST`` characters, with severity and order.
    """
    severe = findings.where(F.col("severity").isin("rød", "svart") & ~F.col("category").startswith("⚠"))
    order = F.struct("det_ord", "sub_ord", "match_ord")
    first = severe.groupBy("doc_id", "category").agg(F.min(order).alias("o"), F.count("*").alias("n"), F.max(F.col("severity") == "svart").alias("black"))
    by = first.groupBy("doc_id").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "category"))), lambda x: x["category"]), 1, CATEGORIES_SHOWN).alias("categories"),
        F.sum("n").alias("finding_count"),
        F.when(F.max("black"), "svart").otherwise("rød").alias("risk_level"),
    )
    long_enough = texts.where(F.length(F.trim("text")) >= CLIP_LEAST)
    return long_enough.join(by, "doc_id").select("source", "ts", F.sha2("text", 256).alias("hash"), "risk_level", "finding_count", "categories")


def clipped(text: str | Column) -> Column:
    return F.substr(F.col(text) if isinstance(text, str) else text, F.lit(1), F.lit(CLIP_MOST))


class Told(NamedTuple):
    """Of a source: the last paste's hash and time, and the last alert's."""

    last: str | None = None
    at: int | None = None
    told: str | None = None
    told_at: int | None = None


def paste(was: Told, us: int, hash_: str | None, severe: bool | None, cooldown: float, forgotten: float) -> tuple[Told, bool]:
    """The state after a paste at ``us`` microseconds, and whether it calls for an alert."""
    if was.at is not None and us - was.at > forgotten * 1e6:
        was = Told()
    new = was.at is None or hash_ != was.last
    alert = bool(severe) and new and hash_ != was.told and (was.told_at is None or us - was.told_at >= cooldown * 1e6)
    return Told(hash_, us, hash_ if alert else was.told, us if alert else was.told_at), alert


class Throttling(StatefulProcessor):
    """The state of ``paste`` by source, forgotten by a timer."""

    def __init__(self, cooldown: float, forgotten: float):
        self.cooldown, self.forgotten = cooldown, forgotten

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "last string, at long, told string, told_at long")

    def _timer(self, state: Told) -> int:
        return int(state.at / 1000 + self.forgotten * 1000) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        state = Told(*self.told.get()) if self.told.exists() else Told()
        if state.at is not None:
            self.handle.deleteTimer(self._timer(state))
        for row in sorted(rows, key=lambda r: (r.us, r.hash or "")):
            state, alert = paste(state, row.us, row.hash, row.severe, self.cooldown, self.forgotten)
            if alert:
                yield Row(source=key[0], us=row.us, hash=row.hash)
        self.told.update(tuple(state))
        self.handle.registerTimer(self._timer(state))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.told.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle(pastes: DataFrame, cooldown: float = COOLDOWN_SECONDS, forgotten: float = FORGOTTEN_SECONDS) -> DataFrame:
    """Alerts (source, ts, hash) of a stream (source, ts, hash, severe): not for what was just seen or told, nor within the cooldown.

    A source that has pasted nothing for ``forgotten`` seconds starts anew and leaves no state. Pastes come in order of their
    times; those of one time go by hash.
    """
    kind = pastes.schema["source"].dataType.simpleString()
    timed = pastes.withWatermark("ts", "0 seconds").select("source", "ts", F.unix_micros("ts").alias("us"), "hash", "severe")
    told = timed.groupBy("source").transformWithState(Throttling(cooldown, forgotten), f"source {kind}, us long, hash string", "append", "EventTime")
    return told.select("source", F.timestamp_micros("us").alias("ts"), "hash")


def throttled(pastes: DataFrame, cooldown: float = COOLDOWN_SECONDS, forgotten: float = FORGOTTEN_SECONDS) -> DataFrame:
    """``throttle`` of a table. An alert depends on the one before it, so a source's pastes are read in order, but never held."""
    kind = pastes.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, state, first = None, Told(), True
        for batch in batches:
            at = []
            for k, (own, us, hash_, severe) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if first or own != source:
                    source, state, first = own, Told(), False
                state, alert = paste(state, us, hash_, severe, cooldown, forgotten)
                if alert:
                    at.append(k)
            yield batch.select(["source", "us", "hash"]).take(pa.array(at, pa.int64()))

    ordered = pastes.select("source", F.unix_micros("ts").alias("us"), "hash", "severe").repartition("source").sortWithinPartitions("source", "us", F.coalesce("hash", F.lit("")))
    told = ordered.mapInArrow(run, f"source {kind}, us long, hash string")
    return told.select("source", F.timestamp_micros("us").alias("ts"), "hash")
