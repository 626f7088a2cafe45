"""Structured Streaming jobs over keyed tables. Checkpoints and sinks live in a shared folder."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from matchloom import rules as R
from matchloom.sources import snapshots, tables


def stream_upsert(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    partition: Sequence[str] = (),
    available_now: bool = True,
) -> StreamingQuery:
    """Add each micro-batch's last row per key to the keyed table at ``path``; read it with ``snapshots.read``.

    A batch is published under the id of its query and its own number, so one that is run again adds its rows once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
        name = f"{json.loads(known)['id']}-{batch_id}"
        snapshots.append(tables.latest(batch, keys, order), path, name, partition)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def failure_windows(events: DataFrame, failed: Column, ts: str = "ts", window: str = R.ALARM_WINDOW, lateness: str = "10 minutes") -> DataFrame:
    """Failed executions per event-time window; works on a stream and on a table."""
    return (
        events.where(failed)
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(F.col("w.start").alias("window_start"), "failures")
    )


def stream_alarms(
    stream: DataFrame, failed: Column, path: str, checkpoint: str, ts: str = "ts", window: str = R.ALARM_WINDOW,
    lateness: str = "10 minutes", available_now: bool = True,
) -> StreamingQuery:
    """Write every window with a failure as soon as it has one, and again when its count grows.

    Update mode raises the alarm at once instead of after the watermark; the highest count per
    window is the current one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    writer = (
        failure_windows(stream, failed, ts, window, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_alarms(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("window_start").agg(F.max("failures").alias("failures"))


def stream_alarm_once(
    stream: DataFrame, failed: Column, path: str, checkpoint: str, ts: str = "ts", window: str = R.ALARM_WINDOW,
    lateness: str = "10 minutes", available_now: bool = True,
) -> StreamingQuery:
    """Append one row (window_start) for each window with a failure, at its first failure and never again.

    The state holds the windows that have raised an alarm until the watermark has passed their end; files are committed with
    the checkpoint, so a restart neither repeats nor loses one.
    """
    windows = stream.where(failed).withWatermark(ts, lateness).select(F.window(ts, window).alias("w")).dropDuplicates(["w"])
    writer = windows.select(F.col("w.start").alias("window_start")).writeStream.format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_retention(
    stream: DataFrame, now: Column, path: str, checkpoint: str, ttl_days: int = R.ARTIFACT_TTL_DAYS,
    modified: str = "lastModified",
) -> StreamingQuery:
    """Append the expired rows of newly seen manifest files to the prune list at ``path`` (a timer run)."""
    return (
        tables.expired_artifacts(stream, now, ttl_days, modified)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


STUCK_OUTPUT = "tenantId string, jobId string, startedAt timestamp"
#: Groups the jobs are dealt to by a hash; each keeps its jobs as one value.
STUCK_SHARDS = 512
_NEVER = -(1 << 63)  # no STATUS yet, or no timer


class StuckJobs(StatefulProcessor):
    """State of the jobs of a shard: of each its latest STATUS, whether a RESULT has come, early or late, and its timer.

    A job is reported when event time passes its latest RUNNING plus the limit while neither a later STATUS
    (such as FAILED) nor a RESULT is there: the rule of ``tables.stuck_jobs``. The rows of a batch meet the state of all
    jobs of the shard at once: a call to the state store per job would cost far more than the rule. The shard's own timer
    waits for the earliest of its jobs.
    """

    def __init__(self, limit_seconds: int):
        self.limit_ms = limit_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "held binary")

    def _held(self) -> list[pd.DataFrame]:
        held = self.jobs.get()
        return [pa.ipc.open_stream(held[0]).read_pandas()] if held else []

    def _hold(self, held: pd.DataFrame) -> None:
        table, sink = pa.Table.from_pandas(held, _HELD, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        self.jobs.update((sink.getvalue().to_pybytes(),))

    def _wait(self, due: pd.Series) -> None:
        waiting = due[due != _NEVER]
        if len(waiting):
            self.handle.registerTimer(int(waiting.min()))

    @staticmethod
    def _latest(parts: list[pd.DataFrame]) -> pd.DataFrame:
        """One row per job: its latest STATUS, by moment and status."""
        rows = pd.concat(parts, ignore_index=True).sort_values(["millis", "status"], kind="stable")
        by_job = rows.groupby(["tenantId", "jobId"], sort=False, dropna=False, as_index=False)
        return by_job.agg({"millis": "last", "status": "last", "ended": "max", "due": "max", "touched": "max"})

    def handleInputRows(self, key, rows, timerValues):
        parts = []
        for part in rows:
            dated = (part["entityType"] == "STATUS") & part["millis"].notna()
            frame = pd.DataFrame({"tenantId": part["tenantId"], "jobId": part["jobId"]})
            frame["millis"] = part["millis"].where(dated, _NEVER).astype("int64")
            frame["status"] = part["status"].where(dated & part["status"].notna(), "").astype(object)
            frame["ended"], frame["due"], frame["touched"] = part["entityType"] == "RESULT", _NEVER, True
            parts = [self._latest([*parts, frame])] if parts else [frame]
        jobs = self._latest([held.assign(touched=False) for held in self._held()] + parts)
        # event time may have passed the limit already
        waits = (jobs["millis"] + self.limit_ms).clip(lower=timerValues.getCurrentWatermarkInMs()) + 1
        waits = waits.where((jobs["status"] == "RUNNING") & ~jobs["ended"].astype(bool), _NEVER)
        jobs["due"] = jobs["due"].mask(jobs["touched"].astype(bool), waits)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._hold(jobs)
        self._wait(jobs["due"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (jobs,) = self._held()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        stuck = (jobs["due"] != _NEVER) & (jobs["due"] <= passed)
        jobs["due"] = jobs["due"].mask(stuck, _NEVER)
        self._hold(jobs)
        self._wait(jobs["due"])
        found = jobs.loc[stuck, ["tenantId", "jobId"]].reset_index(drop=True)
        yield found.assign(startedAt=pd.to_datetime(jobs.loc[stuck, "millis"].to_numpy(), unit="ms", utc=True))

    def close(self) -> None:
        pass


_HELD = pa.schema(
    [("tenantId", pa.string()), ("jobId", pa.string()), ("millis", pa.int64()), ("status", pa.string()), ("ended", pa.bool_()), ("due", pa.int64())]
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_stuck(
    stream: DataFrame, limit_seconds: int = R.STUCK_AFTER_SECONDS, ts: str = "ts", lateness: str = "10 minutes", shards: int = STUCK_SHARDS
) -> DataFrame:
    """Jobs whose latest STATUS is RUNNING for longer than the limit in event time, without a RESULT.

    The session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass``). The mark of an ended
    job stays, so that a RESULT that comes before its STATUS ends the job too. Jobs are dealt to ``shards`` groups, whose
    number stays as it is for the life of a checkpoint; a batch reads and writes the state of the groups it has rows of.
    """
    rows = stream.withWatermark(ts, lateness)
    shard = F.pmod(F.xxhash64("tenantId", "jobId"), F.lit(shards)).cast("int").alias("shard")
    rows = rows.select(shard, "tenantId", "jobId", "entityType", "status", F.unix_millis(F.col(ts).cast("timestamp")).alias("millis"), ts)
    return rows.groupBy("shard").transformWithStateInPandas(
        StuckJobs(limit_seconds), STUCK_OUTPUT, outputMode="append", timeMode="eventTime"
    )
