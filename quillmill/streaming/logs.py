"""Log lines: union without repeats, filters, tails and session format, for tables and streams; progress of writes and streams; and the stream of new manuscripts."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

KEYS = ["time", "level", "stage", "message", "detail"]
TAIL, RECENT, TRACES = 250, 8, 400


def merged(*sources: DataFrame) -> DataFrame:
    """All lines of the sources, each once."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return rows.dropDuplicates(KEYS)


def merged_stream(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same for a stream with a timestamp column ts: repeats within the delay are dropped, and older state is let go."""
    return lines.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEYS)


def matching(lines: DataFrame, level: str | None = None, text: str = "") -> DataFrame:
    """Lines of a level (None or ALL: any) that hold the text in message, detail, stage or level, in any case."""
    rows = lines if level in (None, "", "ALL") else lines.where(F.col("level") == level)
    return rows.where(F.lower(F.concat_ws(" ", "message", "detail", "stage", "level")).contains(text.lower())) if text else rows


def tail(lines: DataFrame, order: str, n: int = TAIL, by: str | None = None) -> DataFrame:
    """The last n lines, of each group if one is named; a limited top-n keeps tasks small."""
    if by is None:
        return lines.orderBy(F.desc(order)).limit(n)
    return lines.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def without_runs(lines: DataFrame, order: str, by: str, columns: list[str]) -> DataFrame:
    """Lines that differ from the one before them in their group."""
    key = F.struct(*columns)
    before = F.lag(key).over(Window.partitionBy(by).orderBy(order))
    return lines.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != key)).drop("_b")


class _Ring(StatefulProcessor):
    """Per key: lines that wait for their turn, the last n that had it, and the key columns of the very last one.

    A line waits until the watermark has passed its time, so lines that come out of order within the delay are taken in order.
    """

    def __init__(self, by: str, schema: StructType, time_column: str, order: str, columns: list[str] | None, n: int):
        self.by, self.schema, self.time, self.order, self.columns, self.n = by, schema, time_column, order, columns, n

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.ring = handle.getListState("ring", self.schema)

    def _rows(self, state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            own = frame[self.schema.names]
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in own.astype(object).itertuples(index=False)])
            self.handle.registerTimer(int(frame[self.time].max().timestamp() * 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, names = timerValues.getCurrentWatermarkInMs(), self.schema.names
        at, order = names.index(self.time), names.index(self.order)
        waiting = self._rows(self.waiting)
        due = sorted((r for r in waiting if pd.Timestamp(r[at]).timestamp() * 1000 <= passed), key=lambda r: r[order])
        if not due:
            yield pd.DataFrame()
            return
        ring = self._rows(self.ring)
        for row in due:
            same = [names.index(c) for c in self.columns or []]
            if not ring or not same or any(row[i] != ring[-1][i] for i in same):
                ring.append(row)
        ring = ring[-self.n :]
        self.ring.put(ring)
        left = [r for r in waiting if pd.Timestamp(r[at]).timestamp() * 1000 > passed]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        shown = pd.DataFrame(ring, columns=names)
        shown.insert(0, self.by, key[0])
        yield shown.assign(version=passed)

    def close(self) -> None:
        pass


def tail_stream(lines: DataFrame, order: str, by: str, n: int = TAIL, columns: list[str] | None = None, time_column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream's last n lines of each group, without lines equal to the one before in `columns` if these are named: rows of the group's tail and its version.

    A group's tail is given out anew, with a higher version, whenever the watermark lets lines into it: latest() of what was given out is what
    tail() and without_runs() make of the same lines as a table. Lines later than the delay are left out. State is a ring of n lines a group and
    the lines within the delay; it needs a state store of the RocksDB kind.
    """
    schema = StructType([f for f in lines.schema if f.name != by])
    out = StructType([lines.schema[by], *schema, StructField("version", LongType())])
    grouped = lines.withWatermark(time_column, delay).groupBy(by)
    return grouped.transformWithStateInPandas(_Ring(by, schema, time_column, order, columns, n), out, "Update", "EventTime")


def latest(given: DataFrame, by: str) -> DataFrame:
    """The tails of the highest version of each group, of all that a tail_stream() gave out."""
    newest = given.groupBy(by).agg(F.max("version").alias("version"))
    return given.join(newest, [by, "version"], "left_semi").dropDuplicates().drop("version")


def session_lines(lines: DataFrame) -> DataFrame:
    """One string per line, as session files hold them."""
    detail = F.when(F.coalesce("detail", F.lit("")) == "", "").otherwise(F.concat(F.lit(" | "), "detail"))
    return lines.select(F.concat(F.lit("["), "time", F.lit("] ["), "level", F.lit("] ["), "stage", F.lit("] "), "message", detail).alias("value"))


def clamp_progress(percent: int) -> int:
    return max(0, min(100, percent))


class Trace:
    """What a run tells while it goes on: each step to `notify`(percent, stage, detail), if there is one, and the last TRACES as rows."""

    def __init__(self, notify: Callable[[int, str, str], None] | None = None):
        self.notify, self.entries = notify, deque(maxlen=TRACES)

    def __call__(self, percent: int, stage: str, detail: str = "") -> None:
        self.entries.append((time.strftime("%H:%M:%S"), "INFO", stage, f"{clamp_progress(percent)} %", detail))
        if self.notify:
            self.notify(clamp_progress(percent), stage, detail)

    def lines(self, spark: SparkSession) -> DataFrame:
        """The entries as log lines."""
        return spark.createDataFrame(list(self.entries), ", ".join(f"{k} string" for k in KEYS))


@contextmanager
def progress(spark: SparkSession, trace: Trace, stage: str, low: int = 0, high: int = 100, every: float | None = 0.2) -> Iterator[None]:
    """Tell the trace, every so many seconds, how far the jobs within have come: tasks done of those known, as a percentage between low and high that only rises; and of a failure.

    The jobs run as a group, whose tasks the status tracker counts; stages that adaptive execution adds later count as they come. every: None tells of failures alone.
    """
    context, group, over = spark.sparkContext, uuid.uuid4().hex, threading.Event()
    reached = [low]

    def look() -> None:
        tracker = context.statusTracker()
        while not over.wait(every):
            stages: dict[int, tuple[int, int]] = {}
            for job in tracker.getJobIdsForGroup(group):
                info = tracker.getJobInfo(job)
                for number in info.stageIds if info else ():
                    told = tracker.getStageInfo(number)
                    if told:
                        stages[number] = (told.numCompletedTasks, told.numTasks)
            done, known = sum(d for d, _ in stages.values()), sum(n for _, n in stages.values())
            percent = low + (high - low) * done // (known + 1)
            if percent > reached[0]:
                reached[0] = percent
                trace(percent, stage, f"{done} of {known} tasks")

    watcher = threading.Thread(target=look, daemon=True) if every else None
    if watcher:
        context.setJobGroup(group, stage)
        watcher.start()
    try:
        yield
    except Exception as e:
        over.set()
        trace(reached[0], stage, f"failed: {type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
        raise
    finally:
        over.set()
        if watcher:
            watcher.join()
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)


class StreamTrace(StreamingQueryListener):
    """Tells a trace of every batch of the session's streams, and how they end: spark.streams.addListener(StreamTrace(trace))."""

    def __init__(self, trace: Trace):
        self.trace = trace

    def onQueryStarted(self, event) -> None:
        self.trace(0, event.name or "stream", "begins")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.trace(50, p.name or "stream", f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.trace(100, "stream", f"failed: {event.exception.splitlines()[0][:200]}" if event.exception else "done")


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Extension: new text files in a folder become manuscripts(doc_id, title, lang, text), batch by batch; started, not awaited."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    path = F.col("_metadata.file_path")
    rows = files.select(F.xxhash64(path).alias("doc_id"), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), F.lit("en").alias("lang"), F.col("value").alias("text"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_id") % 7 == 0, "RISK").otherwise("INFO")
    return e.select("event_id", "user_id", F.date_format("ts", "HH:mm").alias("time"), level.alias("level"), F.col("event_type").alias("stage"), F.concat(F.lit("user "), F.col("user_id") % 10).alias("message"), F.coalesce(F.substring("props", 1, 4), F.lit("")).alias("detail"))


def log_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    return merged(lines.where("event_id % 2 = 0 OR event_id % 3 = 0"), lines.where("event_id % 2 > 0 OR event_id % 3 = 0")).select(*KEYS)  # all events, some in both


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(event_lines(spark, sf_dir), "RISK", "USER 1")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail(event_lines(spark, sf_dir), "event_id")


def log_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail(without_runs(event_lines(spark, sf_dir), "event_id", "user_id", ["stage"]), "event_id", RECENT, "user_id").select("event_id", "user_id", "stage")


def log_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_lines(event_lines(spark, sf_dir))


_L = "(SELECT event_id, user_id, strftime(ts, '%H:%M') AS time, CASE WHEN event_id % 7 = 0 THEN 'RISK' ELSE 'INFO' END AS level, event_type AS stage, 'user ' || (user_id % 10) AS message, coalesce(props[1:4], '') AS detail FROM events)"
QUERIES = {"log_merged": log_merged, "log_search": log_search, "log_tail": log_tail, "log_recent": log_recent, "log_session": log_session}
ORACLES = {
    "log_merged": f"SELECT DISTINCT time, level, stage, message, detail FROM {_L}",
    "log_search": f"SELECT * FROM {_L} WHERE level = 'RISK' AND contains(lower(concat_ws(' ', message, detail, stage, level)), 'user 1')",
    "log_tail": f"SELECT * FROM {_L} ORDER BY event_id DESC LIMIT 250",
    "log_recent": f"SELECT event_id, user_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM {_L}) WHERE b IS NULL OR b <> stage) WHERE r <= 8",
    "log_session": f"SELECT '[' || time || '] [' || level || '] [' || stage || '] ' || message || CASE WHEN detail = '' THEN '' ELSE ' | ' || detail END AS value FROM {_L}",
}
