"""Processes from first sight to end, on a stream: whatever order their news comes in, each end is told once, and what has ended is forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.lineage import TOLERANCE

#: News of a process: a sweep saw it ("sample"), it called exec ("exec"), the kernel said that it ended ("exit"). ``at`` is when it was seen or heard, in epoch seconds.
NEWS = "host string, pid long, kind string, start double, at double, comm string, cmdline string, unit string, cpu_seconds double"
#: What is told of an end. heard: the kernel said so; else it was gone for two sweeps, which noticed is the end of.
ENDS = "host string, pid long, start double, noticed double, heard boolean, comm string, cmdline string, unit string, described_by string, cpu_seconds double"
_NEWS = "kind string, start double, at double, comm string, cmdline string, unit string, cpu_seconds double"
#: One process of a pid: when it began, when there was last news of it, what it ran by its samples and by its execs, and when it ended.
_LIFE = "start double, seen double, comm string, sampled string, called string, unit string, cpu_seconds double, ended double"
_KINDS = {"exec": 0, "sample": 1, "exit": 2}


def follow(lives: list[list], news: list[tuple], now: float, sweep: float, tolerance: float = TOLERANCE) -> tuple[list[list], list[tuple], float | None]:
    """One pid's lives after some news, taken in order of time, up to ``now``: (lives, ends, when to look again).

    News is of the life that began within the tolerance, the nearest. An exit ends it; without one it has ended when two sweeps have passed since it was last seen. What comes of
    a life that has ended is not told again. Two sweeps and the tolerance after its end a life is forgotten.
    """
    ends = []

    def lapse(until: float) -> None:
        for life in lives:
            due = life[1] + 2 * sweep
            if life[7] is None and due < until:
                life[7] = due
                ends.append((life[0], due, False, *_said(life), life[6]))
        lives[:] = [x for x in lives if x[7] is None or x[7] + 2 * sweep + tolerance >= until]

    for kind, start, at, comm, cmdline, unit, cpu in sorted(news, key=lambda n: (n[2], _KINDS[n[0]], n[1], tuple(str(x) for x in n[3:]))):
        lapse(at)
        near = [x for x in lives if abs(x[0] - start) <= tolerance]
        life = min(near, key=lambda x: (abs(x[0] - start), x[0])) if near else None
        if life is None:
            life = [start, at, comm, None, None, None, None, None]
            lives.append(life)
        if life[7] is not None:
            continue
        life[1], life[2] = at, comm or life[2]
        life[5] = unit or life[5]
        life[6] = cpu if life[6] is None else life[6] if cpu is None else max(life[6], cpu)
        if kind == "sample":
            life[3] = cmdline or life[3]
        elif kind == "exec":
            life[4] = cmdline or life[4]
        else:
            life[7] = at
            ends.append((life[0], at, True, *_said(life), life[6]))
    lapse(now)
    due = [x[1] + 2 * sweep if x[7] is None else x[7] + 2 * sweep + tolerance for x in lives]
    return lives, ends, min(due) if due else None


def _said(life: list) -> tuple:
    """comm, cmdline, unit, described_by: a sample knows better than an exec."""
    return life[2], life[3] or life[4], life[5], "sample" if life[3] else "exec" if life[4] else None


def _rows(frame: pd.DataFrame) -> list[tuple]:
    """A frame of NEWS as tuples of _NEWS; what is of no known kind or has no time is left out."""
    cells = frame[[c.split()[0] for c in _NEWS.split(", ")]].astype(object)
    return [n for n in cells.where(cells.notna(), None).itertuples(index=False, name=None) if n[0] in _KINDS and n[1] is not None and n[2] is not None]


class Lives(StatefulProcessor):
    """The state of one (host, pid): news that the watermark has not reached yet, and its lives.

    A timer is set for the first moment at which there is something to do. When it expires all that the watermark has passed is done at once, so what waits is read once for a batch, not once for each piece of news.
    """

    def __init__(self, sweep: float, tolerance: float = TOLERANCE):
        self.sweep, self.tolerance = sweep, tolerance
        # parsed here, as it takes a session
        self.schemas = StructType.fromDDL(_NEWS), StructType.fromDDL(_LIFE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Keys that are done in this batch: a second timer of one that expires with the first finds nothing.
        self.done = set()
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.lives = handle.getListState("lives", self.schemas[1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [n for frame in rows for n in _rows(frame)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(n[2] for n in new))
        yield from ()

    def _wake(self, at: float) -> None:
        self.handle.registerTimer(int(at * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:
            return
        self.done.add(key)
        now = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = [tuple(x) for x in self.waiting.get()]
        lives = [list(x) for x in self.lives.get()]
        ready, later = [n for n in waiting if n[2] <= now], [n for n in waiting if n[2] > now]
        lives, ends, due = follow(lives, ready, now, self.sweep, self.tolerance)
        if ready:
            self._put(self.waiting, later)
        self._put(self.lives, [tuple(x) for x in lives])
        todo = [n[2] for n in later] + ([] if due is None else [max(due, now)])
        if todo:
            self._wake(min(todo))
        if ends:
            yield pd.DataFrame([(*key, *e) for e in ends], columns=[c.split()[0] for c in ENDS.split(", ")])

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def _known(news: DataFrame) -> DataFrame:
    """News without a host or a pid is of no process."""
    return news.where("host is not null and pid is not null")


def ends(news: DataFrame, sweep: float, late: str = "1 minute", tolerance: float = TOLERANCE) -> DataFrame:
    """A stream of NEWS -> a stream of ENDS, each process's end once.

    News is held until the watermark, ``late`` behind the newest, has reached it, and taken in order of time: so the ends are the same however news is dealt over batches,
    an exit that is heard of a sweep late still finds what it was, and an old process's exit takes nothing from a new one of its number. Needs the RocksDB state store.
    """
    timed = _known(news).withColumn("_at", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("bigint"))).withWatermark("_at", late)
    return timed.groupBy("host", "pid").transformWithStateInPandas(statefulProcessor=Lives(sweep, tolerance), outputStructType=StructType.fromDDL(ENDS), outputMode="Append", timeMode="EventTime")


def ends_of(news: DataFrame, sweep: float, tolerance: float = TOLERANCE, until: float | None = None) -> DataFrame:
    """The same of a table, up to a moment (by default until all have ended): one group for each (host, pid), which bounds what a task holds."""

    def all_of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [n for n in _rows(frame) if until is None or n[2] <= until]
        _, found, _ = follow([], rows, float("inf") if until is None else until, sweep, tolerance)
        return pd.DataFrame([(*key, *e) for e in found], columns=[c.split()[0] for c in ENDS.split(", ")])

    return _known(news).groupBy("host", "pid").applyInPandas(all_of, ENDS)


def leftover(spark: SparkSession, checkpoint: str, closed: float) -> DataFrame:
    """ENDS of what was still unexplained when the stream was closed: lives without an exit that the last sweep of their host did not see. Read from the stream's own state, for one last write."""
    lives = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "lives").load()
    flat = lives.select(F.col("key.host").alias("host"), F.col("key.pid").alias("pid"), "list_element.*").where("ended is null")
    last = flat.groupBy("host").agg(F.max("seen").alias("_last"))
    gone = flat.join(last, "host").where("seen < _last")
    by = F.when(F.col("sampled").isNotNull(), "sample").when(F.col("called").isNotNull(), "exec")
    return gone.select("host", "pid", "start", F.lit(float(closed)).alias("noticed"), F.lit(False).alias("heard"), "comm", F.coalesce("sampled", "called").alias("cmdline"), "unit", by.alias("described_by"), "cpu_seconds")
