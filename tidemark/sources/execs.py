"""Exec events: the kernel's process connector, captured to files, as a Python data source for batches and streams."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "host string, file string, place long, since_boot_ns long, cpu long, thread long, pid long"
_ARROW = pa.schema([("host", pa.string()), ("file", pa.string()), ("place", pa.int64()), ("since_boot_ns", pa.int64()), ("cpu", pa.int64()), ("thread", pa.int64()), ("pid", pa.int64())])
# The wire format. A netlink header, a connector header, then what happened, on which CPU and when, and of an exec the thread and its process.
NETLINK, CONNECTOR = struct.Struct("=IHHII"), struct.Struct("=IIIIHH")
EVENT, EXEC_TASK = struct.Struct("=IIQ"), struct.Struct("=II")
CN_IDX_PROC, CN_VAL_PROC, PROC_EVENT_EXEC = 1, 1, 2
#: Events in one Arrow batch.
MANY = 65_536
#: Bytes of a file that are read at once.
BLOCK = 1 << 20


def events(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(place, nanoseconds since boot, cpu, thread, process) of each exec in captured datagrams, one after the other.

    Each message says its length and begins at a multiple of 4. Other events and messages of others are passed over; a message that is cut off ends what can be read, and
    one that says it is shorter than its own header as well.
    """
    return events_of(io.BytesIO(data))


def events_of(stream, block: int = BLOCK) -> Iterator[tuple[int, int, int, int, int]]:
    """The same from what can be read, of which a block and the message it cuts are held at a time."""
    # held begins at base; the next message at held[at], which may lie beyond its end
    held, base, at, least = b"", 0, 0, NETLINK.size + CONNECTOR.size + EVENT.size
    need = 0
    while more := stream.read(max(block, need)):
        held += more
        need = 0
        while at + NETLINK.size <= len(held):
            size = NETLINK.unpack_from(held, at)[0]
            if size < NETLINK.size:
                return
            if at + size > len(held):
                need = at + size - len(held)
                break
            if size >= least + EXEC_TASK.size:
                idx, val, *_ = CONNECTOR.unpack_from(held, at + NETLINK.size)
                what, cpu, when = EVENT.unpack_from(held, at + NETLINK.size + CONNECTOR.size)
                if (idx, val, what) == (CN_IDX_PROC, CN_VAL_PROC, PROC_EVENT_EXEC):
                    yield base + at, when, cpu, *EXEC_TASK.unpack_from(held, at + least)
            at += (size + 3) & ~3
        passed = min(at, len(held))
        held, base, at = held[passed:], base + passed, at - passed


def message(what: int, cpu: int, when: int, thread: int, pid: int) -> bytes:
    """One event as the kernel sends it, for captures that are made."""
    body = EVENT.pack(what, cpu, when) + EXEC_TASK.pack(thread, pid) + b"\0" * 16
    return NETLINK.pack(NETLINK.size + CONNECTOR.size + len(body), 3, 0, 0, 0) + CONNECTOR.pack(CN_IDX_PROC, CN_VAL_PROC, 0, 0, len(body), 0) + body


class _File(InputPartition):
    def __init__(self, host: str, file: str):
        super().__init__((host, file))
        self.host, self.file = host, file


class _Files:
    """Captures lie at <path>/host=<host>/<file>; each host's later files have names that sort after its earlier ones."""

    def __init__(self, path: str):
        self.path = path

    def system(self):
        """(file system, path on it); any store that Arrow reaches by its address."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def listed(self) -> list[tuple[str, str]]:
        from pyarrow import fs

        system, base = self.system()
        found = []
        for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            host, _, name = f.path[len(base) :].lstrip("/").partition("/")
            if f.type == fs.FileType.File and host.startswith("host=") and name and "/" not in name and not name.startswith((".", "_")):
                found.append((host[5:], name))
        return sorted(found)

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        system, base = self.system()
        held: list[tuple] = []
        with system.open_input_stream(f"{base}/host={part.host}/{part.file}") as f:
            for e in events_of(f):
                held.append((part.host, part.file, *e))
                if len(held) == MANY:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Batch(DataSourceReader, _Files):
    def partitions(self):
        return [_File(*f) for f in self.listed()] or [_File("", "")]

    def read(self, partition):
        if partition.file:
            yield from _Files.read(self, partition)


class _Stream(DataSourceStreamReader, _Files):
    """The offset is the last file of each host that was read, so a stream that starts again reads on where it was."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(self.listed())

    def partitions(self, start: dict, end: dict):
        return [_File(h, f) for h, f in self.listed() if start.get(h, "") < f <= end.get(h, "")]

    def read(self, partition):
        yield from _Files.read(self, partition)

    def commit(self, end: dict) -> None:
        pass


class ExecEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exec_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options["path"])

    def streamReader(self, schema):
        return _Stream(self.options["path"])


def write_captures(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (host, file, what, cpu, when, thread, pid) as captures under ``path``, in order of time; host, file and number of messages of each. A task that runs again writes the same file again.

    Rows come to a task sorted and are written as they come, so a file may be larger than the task's memory.
    """
    files = _Files(path)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = files.system()
        key, f, n = None, None, 0
        try:
            for frame in frames:
                for k, rows_ in frame.groupby(["host", "file"], sort=False, dropna=False):
                    k = tuple(None if pd.isna(x) else x for x in k)
                    if k != key:
                        if f is not None:
                            f.close()
                            yield pd.DataFrame([(*key, n)], columns=["host", "file", "n"])
                        system.create_dir(f"{base}/host={k[0]}", recursive=True)
                        key, f, n = k, system.open_output_stream(f"{base}/host={k[0]}/{k[1]}"), 0
                    f.write(b"".join(message(*r) for r in zip(*(rows_[c].astype("int64").tolist() for c in ("what", "cpu", "when", "thread", "pid")))))
                    n += len(rows_)
        finally:
            if f is not None:
                f.close()
        if key is not None:
            yield pd.DataFrame([(*key, n)], columns=["host", "file", "n"])

    return rows.repartition("host", "file").sortWithinPartitions("host", "file", "when", "pid").mapInPandas(write, "host string, file string, n long")


def read_execs(spark: SparkSession, path: str) -> DataFrame:
    """All captured exec events: a task for each file."""
    spark.dataSource.register(ExecEvents)
    return spark.read.format("exec_events").option("path", path).load()


def stream_execs(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ExecEvents)
    return spark.readStream.format("exec_events").option("path", path).load()


def described_execs(execs: DataFrame, boots: DataFrame, readings: DataFrame, within: float = 1.0) -> DataFrame:
    """host, pid, at, start_ticks, comm, ppid, pgid, cmdline: what each process was, read when its exec was heard of.

    ``readings`` (host, pid, ts, start_ticks, comm, ppid, pgid, cmdline) are its stat before (no cmdline), its command line, and its stat again, in ``within`` seconds after the exec. Where the two stats differ in their start
    the number was used again in between, and the command line may be another's: such an exec is dropped, as is one without command line or second stat. Of several execs before a reading, it is the last one's.
    """
    at = execs.join(boots.select("host", "boot"), "host").select("host", "pid", (F.col("boot") + F.col("since_boot_ns") / 1e9).alias("_t"), F.lit(0).alias("_read"))
    told = readings.select("host", "pid", F.col("ts").alias("_t"), F.lit(1).alias("_read"), F.struct("start_ticks", "comm", "ppid", "pgid", "cmdline").alias("_r"))
    w = Window.partitionBy("host", "pid").orderBy("_t", "_read").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = at.unionByName(told, allowMissingColumns=True).withColumn("at", F.last(F.when(F.col("_read") == 0, F.col("_t")), True).over(w)).where(f"_read = 1 and _t <= at + {within}")
    stat = F.when(F.col("_r.start_ticks").isNotNull(), F.col("_t"))
    one = of.groupBy("host", "pid", "at").agg(F.min_by("_r", stat).alias("_a"), F.max_by("_r", stat).alias("_b"), F.count(stat).alias("_stats"), F.max("_r.cmdline").alias("cmdline"))
    same = (F.col("_stats") > 1) & (F.col("_a.start_ticks") == F.col("_b.start_ticks")) & (F.coalesce("cmdline", F.lit("")) != "")
    return one.where(same).select("host", "pid", "at", "_a.start_ticks", "_a.comm", "_a.ppid", "_a.pgid", "cmdline")
