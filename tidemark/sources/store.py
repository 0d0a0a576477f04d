"""The store: a folder of Parquet files for samples, records, spans and rollups, in partitions by day and batch."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model

#: Resolutions of rollups in seconds; each is a table of its own, rollups-300 and so on.
TIERS = (300, 3600)
SCHEMAS = {"samples": model.SAMPLES, "records": model.RECORDS, "spans": model.SPANS, "rollups": "name string, host string, labels map<string,string>, resolution int, bucket bigint, highest double, lowest double, mean double, total double, n bigint"}
TIME = {"samples": ("ts", 1), "records": ("ts_us", 1_000_000), "spans": ("start_ns", 1_000_000_000), "rollups": ("bucket", 1)}
TABLES = ("samples", "records", "spans", *(f"rollups-{t}" for t in TIERS))
#: What the batch of compacted rows begins with; the names of later ones sort after those of earlier ones.
COMPACT = "compact-"


def choose(given: str | None = None, own: str | None = None, host: str | None = None) -> str:
    """Which store to read: the one that is given, else one's own, else the host's."""
    for path in (given, own, host):
        if path:
            return path
    raise ValueError("no store is given, and there is neither one's own nor the host's")


def own_store(environment=None) -> str | None:
    env = os.environ if environment is None else environment
    base = env.get("XDG_DATA_HOME") or (env.get("HOME") and os.path.join(env["HOME"], ".local/share"))
    return os.path.join(base, "tidemark") if base else None


class Store:
    """One writer appends, a maintainer compacts and drops, many readers read: partitions by day and batch, and nothing else.

    A batch goes into partitions of its own, which are overwritten if it comes again, so a stream that starts anew repeats nothing. Compaction writes a day's batches
    as one, in which rows know where they came from, and then deletes theirs; as long as a batch has a partition of its own, its rows in the compacted one don't
    count. So a compaction that stops midway changes nothing, an append meanwhile has a partition that compaction does not touch, and a batch that comes again afterwards replaces
    its rows. Rows without a time are of no day: their day is null. A reader who began before days are dropped or compacted begins again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        """(file system, path)"""
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _partitions(self, table: str) -> dict[int | None, list[str]]:
        """The batches of each day, by name."""
        fs, at = self._at(table, "day=*", "batch=*")
        out: dict[int | None, list[str]] = {}
        for s in fs.globStatus(at) or []:
            day, batch = (x.getName().partition("=")[2] for x in (s.getPath().getParent(), s.getPath()))
            out.setdefault(int(day) if day.lstrip("-").isdigit() else None, []).append(batch)
        return {day: sorted(batches) for day, batches in out.items()}

    def _rows(self, table: str, of_days=lambda day: True) -> DataFrame:
        """Rows that count, of some days, with day, batch and _from (the batch that a compacted row came with)."""
        schema = f"{SCHEMAS[table.partition('-')[0]]}, _from string, day int, batch string"
        held = {day: batches for day, batches in self._partitions(table).items() if of_days(day)}
        if not held:
            return self.spark.createDataFrame([], schema)
        # of several compactions (one stopped before it deleted what it had read) the last has all
        old = [b for batches in held.values() for b in [b for b in batches if b.startswith(COMPACT)][:-1]]
        again = [(day, b) for day, batches in held.items() if batches[-1:] and any(b.startswith(COMPACT) for b in batches) for b in batches if not b.startswith(COMPACT)]
        days = [d for d in held if d is not None]
        wanted = F.col("day").isin(days) if days else F.lit(False)
        out = self.spark.read.schema(schema).parquet(f"{self.path}/{table}").where(wanted | F.col("day").isNull() if None in held else wanted)
        if old:
            out = out.where(~F.col("batch").isin(old))
        if again:  # at most the batches that came since a day was compacted
            twice = self.spark.createDataFrame(again, "_day int, _batch string")
            out = out.join(F.broadcast(twice), F.col("batch").startswith(COMPACT) & F.col("day").eqNullSafe(F.col("_day")) & (F.col("_from") == F.col("_batch")), "left_anti")
        return out

    def _tables(self, table: str) -> list[str]:
        return [t for t in TABLES if t.startswith("rollups-")] if table == "rollups" else [table]

    def read(self, table: str, days=None) -> DataFrame:
        """The table, with its day; an empty one of the same columns if nothing was ever written (a store without spans has no jobs). ``days``: (first, last), others are not read. rollups: all tiers."""
        parts = [self._rows(t, lambda day: days is None or (day is not None and days[0] <= day <= days[1])).drop("_from", "batch") for t in self._tables(table)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def between(self, table: str, since: float, until: float) -> DataFrame:
        """Rows in [since, until] in epoch seconds; days outside are not read."""
        column, scale = TIME[table.partition("-")[0]]
        return self.read(table, (int(since // 86_400), int(until // 86_400))).where(F.col(column).between(int(since * scale), int(until * scale)))

    def _dated(self, table: str, rows: DataFrame) -> DataFrame:
        column, scale = TIME[table.partition("-")[0]]
        return rows.withColumn("day", F.floor(F.col(column) / (scale * 86_400)).cast("int"))

    def _delete(self, table: str, day: int | None, batch: str | None = None) -> None:
        fs, at = self._at(table, f"day={'__HIVE_DEFAULT_PARTITION__' if day is None else day}", *([f"batch={batch}"] if batch else []))
        fs.delete(at, True)

    def append(self, table: str, rows: DataFrame, batch: int | None = None) -> None:
        """Adds rows. A batch that was added before (a stream that starts again) is replaced and so not there twice, also where it has other days now."""
        name = f"b{batch}" if batch is not None else f"w{uuid.uuid4().hex}"
        dated = self._dated(table, rows).withColumns({"_from": F.lit(name), "batch": F.lit(name)})
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/{table}")
        if batch is None:
            return
        for day, batches in self._partitions(table).items():
            if (name in batches or any(b.startswith(COMPACT) for b in batches)) and dated.where(F.col("day").eqNullSafe(F.lit(day).cast("int"))).isEmpty():
                # a day that it had before, by itself or compacted, and has no more
                if not self._rows(table, lambda d, day=day: d == day).where(F.col("_from") == name).isEmpty():
                    self._rewrite(table, day, F.col("_from") != name)

    def writer(self, table: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda rows, batch: self.append(table, rows, batch)

    def days(self, table: str) -> list[tuple[int, int]]:
        """(day, bytes) of what is held, from the folders alone; rows without a time are of none."""
        out: dict[int, int] = {}
        for t in self._tables(table):
            fs, at = self._at(t, "day=*")
            for s in fs.globStatus(at) or []:
                day = s.getPath().getName()[4:]
                if day.lstrip("-").isdigit() and (size := int(fs.getContentSummary(s.getPath()).getLength())):
                    out[int(day)] = out.get(int(day), 0) + size
        return sorted(out.items())

    def range(self, table: str) -> tuple[float, float] | None:
        """The first and last moment that is held, in epoch seconds; read from the first and last day alone."""
        column, scale = TIME[table.partition("-")[0]]
        days = sorted(d for d in self._partitions(table) if d is not None)
        if not days:
            return None
        low, high = self._rows(table, lambda d: d in (days[0], days[-1])).agg(F.min(column), F.max(column)).first()
        return None if low is None else (low / scale, high / scale)

    def drop(self, table: str, day: int) -> None:
        for t in self._tables(table):
            self._delete(t, day)

    def drop_before(self, table: str, moment: float) -> None:
        """All before a moment in epoch seconds: days before its own whole, of that the rows."""
        column, scale = TIME[table.partition("-")[0]]
        for day in self._partitions(table):
            if day is not None and (day + 1) * 86_400 <= moment:
                self._delete(table, day)
            elif day is not None and day * 86_400 < moment:
                self._rewrite(table, day, F.col(column) >= int(moment * scale))

    def bytes(self) -> int:
        return sum(size for table in TABLES for _, size in self.days(table))

    def _rewrite(self, table: str, day: int | None, keep=None, files: int = 1, sort=()) -> None:
        """A day's rows (those to keep) as one batch of their own; then what they were read from is deleted."""
        seen = self._partitions(table).get(day, [])
        rows = self._rows(table, lambda d: d == day)
        rows = (rows if keep is None else rows.where(keep)).repartition(files)
        rows = rows.sortWithinPartitions(*sort) if sort else rows
        last = max((int(b[len(COMPACT) :].partition("-")[0]) for b in seen if b.startswith(COMPACT)), default=0)
        name = f"{COMPACT}{last + 1:09d}-{uuid.uuid4().hex}"
        rows.withColumn("batch", F.lit(name)).write.mode("append").partitionBy("day", "batch").parquet(f"{self.path}/{table}")
        for b in seen:
            self._delete(table, day, b)

    def compact(self, table: str, day: int, files: int = 1, sort=()) -> None:
        """A day's batches written again as one, of few files, in the order in which they are read."""
        for t in self._tables(table):
            if len(self._partitions(t).get(day, [])) > 1:
                self._rewrite(t, day, None, files, sort)
