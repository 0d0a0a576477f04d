"""The same derivations on streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.threads import PEAKS, SUMS
from ..sources.taskstats import GROUPED


def rollup(samples: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(at timestamp, name, host, value) -> epoch-aligned intervals; what comes later than ``late`` after the newest sample is dropped."""
    windows = samples.withWatermark("at", late).groupBy(F.window("at", width), "name", "host")
    return windows.agg(F.max("value").alias("highest"), F.avg("value").alias("mean"), F.count("value").alias("n")).select("name", "host", F.unix_timestamp(F.col("window")["start"]).alias("bucket"), "highest", "mean", "n")


def rates(readings: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(host, subject, ts double, counter) -> host, subject, ts, rate. The last reading of each subject is its state.

    Of one batch, a subject's readings are taken in order of time; one that is older than the last that was seen is left out. No row for a first
    reading, nor where the counter went back. Subjects that say nothing for ``idle_ms`` are forgotten; without it none is, as a run over
    what is there now has to end, and one that waits for the clock does not.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, None)
        out = []
        for ts, counter in pd.concat(list(frames)).sort_values("ts", kind="stable")[["ts", "counter"]].itertuples(index=False):
            if last[0] is not None and ts <= last[0]:
                continue
            if last[0] is not None and counter >= last[1]:
                out.append((*key, ts, (counter - last[1]) / (ts - last[0])))
            last = (float(ts), int(counter))
        state.update(last)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["host", "subject", "ts", "rate"])

    return readings.groupBy("host", "subject").applyInPandasWithState(step, "host string, subject string, ts double, rate double", "ts double, counter long", "append", timeout)


def merge_threads(tasks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Threads that ended -> processes that ended, when the last thread of each is heard of: host, tgid, threads, the sums and peaks, comm, exit_status, end_epoch.

    Processes whose last thread is never heard of are forgotten after ``idle_ms`` (two minutes are usual), or never.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    figures = [*SUMS, *PEAKS]
    schema = "host string, tgid long, threads long, " + ", ".join(f"{c} long" for c in figures) + ", comm string, exit_status long, end_epoch double"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else [0, *[0] * len(figures), None]
        out = []
        for row in pd.concat(list(frames)).sort_values(["at", "flag"], kind="stable").to_dict("records"):
            held[0] += 1
            for k, c in enumerate(figures, 1):
                held[k] = max(held[k], int(row[c])) if c in PEAKS else held[k] + int(row[c])
            held[-1] = row["comm"] if row["pid"] == row["tgid"] else held[-1]
            if row["version"] < GROUPED or row["flag"] & 32:
                out.append((*key, *held[:-1], held[-1] or row["comm"], row["exit_status"], row["at"]))
                held = [0, *[0] * len(figures), None]
        if held[0]:
            state.update(tuple(held))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    state = "threads long, " + ", ".join(f"{c} long" for c in figures) + ", comm string"
    return tasks.groupBy("host", "tgid").applyInPandasWithState(step, schema, state, "append", timeout)


@contextmanager
def provider(spark: SparkSession, name: str):
    """Queries that start within keep their state in this store; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key, None)
    spark.conf.set(key, f"org.apache.spark.sql.execution.streaming.state.{name}")
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def rocksdb(spark: SparkSession):
    """State on the executors' disks, which timers and lists need, and which may outgrow memory."""
    return provider(spark, "RocksDBStateStoreProvider")


def run_once(stream: DataFrame, write, checkpoint: str, mode: str = "append"):
    """All that is there now, in bounded batches, to ``write(rows, batch)``; then it ends. The next run goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bounded(write, most: int, note=None, queue: str = "exits", host: str | None = None):
    """For ``foreachBatch``: of each partition of a batch the first ``most`` rows go to ``write(rows, batch)``; the rest is lost, and how many were is told.

    A partition is a queue of its own with room for so many. What came and what was kept is observed while the rows are written (no second pass, no shuffle), and ``note(samples, batch)`` gets a row of samples with the number of those lost.
    The returned function has the totals of all batches so far in ``lost``.
    """

    def take(rows: DataFrame, batch: int) -> None:
        seen = Observation(f"queue-{queue}-{batch}-{uuid.uuid4().hex}")
        # the number of a row within its partition is in the lower 33 bits
        kept = F.col("_place").bitwiseAND((1 << 33) - 1) < most
        counted = rows.withColumn("_place", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("came"), F.count_if(kept).alias("kept"), F.count_if(F.col("_place").isNull()).alias("none"))
        write(counted.where(kept).drop("_place"), batch)
        lost = seen.get["came"] - seen.get["kept"]
        take.lost += lost
        take.came += seen.get["came"]
        if note is not None:
            labels = F.create_map(F.lit("queue"), F.lit(queue))
            note(rows.sparkSession.range(1).select(F.lit("acct_lost").alias("name"), F.lit(host).cast("string").alias("host"), labels.alias("labels"), F.unix_timestamp().alias("ts"), F.lit(float(lost)).alias("value")), batch)

    take.lost = take.came = 0
    return take


class Counted(StreamingQueryListener):
    """Totals of what named observations of streaming queries counted: ``stream.observe(name, ...)`` before the sink. They are there when the batch's progress is reported."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            held = self.totals.setdefault(name, {})
            for key, n in row.asDict().items():
                held[key] = held.get(key, 0) + (n or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def samples(self, spark: SparkSession, ts: int, host: str) -> DataFrame:
        """The totals as samples: name is the counted thing, the observation is a label."""
        rows = [(key, host, {"observed": name}, ts, float(n)) for name, held in sorted(self.totals.items()) for key, n in sorted(held.items())]
        return spark.createDataFrame(rows, "name string, host string, labels map<string,string>, ts bigint, value double")
