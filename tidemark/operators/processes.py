"""Processes as captures show them: who they are, their gauges, and what two captures say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.endings import is_kernel_thread
from ..functions.numbers import finite, percent, rate, saturating
from ..functions.units import unit_of
from ..sources import captures as read

#: Clock ticks a second and bytes of a page, where the host does not say.
HZ, PAGE = 100, 4096
HOUR = 3600


def labels(pid, comm, user, unit) -> Column:
    """The label set of a process's series; a process in no unit has no unit to be selected by."""
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("pid", pid.cast("string")), ("comm", comm), ("user", user), ("proc", F.concat(comm, F.lit("["), pid.cast("string"), F.lit("]"))), ("unit", F.nullif(unit, F.lit(""))))]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def admitted(captures: DataFrame, boots: DataFrame, users: DataFrame, hz: int = HZ, page: int = PAGE) -> DataFrame:
    """A row for each process in each capture: host, ts, pid, start (boot and ticks), who it is and its counters. ``boots`` (host, boot), ``users`` (uid, user).

    A process is its (pid, start_ticks): a number that is used again is another one. Who it is, its unit and user, is what was read when it was first seen. What its status says is kept where a later
    one could not be read, and is 0 where none ever was; bytes and waiting time that were not shown are null, not 0.
    """
    by = ["host", "ts", "pid"]
    rows = read.pid_files(captures).withColumn("switches", F.col("voluntary_switches") + F.col("involuntary_switches"))
    rows = unit_of(rows.withColumn("path", F.col("cgroup")), users).drop("path")
    life = Window.partitionBy("host", "pid", "start_ticks").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "uid": F.coalesce(F.first("uid", False).over(life), F.lit(0)), "switches": F.coalesce(F.last("switches", True).over(life), F.lit(0)),
        "unit": F.first("unit", False).over(life), "cgroup": F.first("cgroup", False).over(life), "comm": F.last("comm").over(life),
    })
    rows = read.user_names(rows, users).join(boots.select("host", "boot"), "host", "left")
    return rows.select(
        *by, "comm", "ppid", F.col("pgrp").alias("pgid"), "start_ticks", (F.col("boot") + F.col("start_ticks") / hz).alias("start"), "uid", "user", "unit", "cgroup", is_kernel_thread("flags").alias("kernel_thread"), "threads",
        F.coalesce(F.col("rss_kb") * 1024, F.col("rss_pages") * page).alias("rss_bytes"), "vsize_bytes", (F.col("swap_kb") * 1024).alias("swap_bytes"), "utime", "stime", "minflt", "majflt", "switches", "read_bytes", "write_bytes", "wait_ns", "blkio_ticks",
    )


def gauges(rows: DataFrame, min_age: float = 0, kernel_threads: bool = False, delay_accounting: bool = True, hz: int = HZ) -> DataFrame:
    """What admitted() says, as samples (name, host, labels, ts, value): shares and rates since the reading before, and levels. No sample for a process's first reading.

    Processes younger than ``min_age`` are left out, and kernel threads if they are not wanted; those have no memory of their own. What was not read at both ends has no rate.
    """
    w = Window.partitionBy("host", "pid", "start_ticks").orderBy("ts")
    counters = ("utime", "stime", "minflt", "majflt", "switches", "read_bytes", "write_bytes", "wait_ns", "blkio_ticks")
    both = rows.withColumns({f"_{c}": F.lag(c).over(w) for c in ("ts", *counters)}).withColumn("_s", (F.col("ts") - F.col("_ts")).cast("double")).where("_s > 0")
    both = both.where(F.col("ts") - F.col("start") >= min_age)
    if not kernel_threads:
        both = both.where("not kernel_thread")
    used = lambda c: saturating(c, f"_{c}") / hz
    own = lambda c: F.when(~F.col("kernel_thread"), F.col(c))
    moved = lambda c: F.when(F.col("read_bytes").isNotNull() & F.col("_read_bytes").isNotNull(), saturating(c, f"_{c}") / F.col("_s"))
    named = {
        "proc_cpu_pct": percent(used("utime") + used("stime"), "_s"), "proc_cpu_user_pct": percent(used("utime"), "_s"), "proc_cpu_system_pct": percent(used("stime"), "_s"), "proc_cpu_seconds": (F.col("utime") + F.col("stime")) / hz, "proc_threads": F.col("threads"),
        "proc_minor_faults_per_sec": rate("minflt", "_minflt", "_s"), "proc_major_faults_per_sec": rate("majflt", "_majflt", "_s"), "proc_context_switches_per_sec": rate("switches", "_switches", "_s"),
        "proc_rss_bytes": own("rss_bytes"), "proc_vsize_bytes": own("vsize_bytes"), "proc_swap_bytes": own("swap_bytes"), "proc_io_read_bytes_per_sec": moved("read_bytes"), "proc_io_write_bytes_per_sec": moved("write_bytes"),
        "proc_cpu_wait_pct": rate("wait_ns", "_wait_ns", "_s") / 1e7, **({"proc_io_wait_pct": percent(used("blkio_ticks"), "_s")} if delay_accounting else {}),
    }
    # what is no sample goes before rows are made of the rest; so the figures are also no part of the loop that makes them, which would be too long a method to be compiled
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in named.items()]), lambda g: finite(g["value"])))
    out = both.select("host", labels(F.col("pid"), F.col("comm"), F.col("user"), F.col("unit")).alias("labels"), "ts", each.alias("_g"))
    return out.select("_g.name", "host", "labels", "ts", "_g.value")


def once(captures: DataFrame, boots: DataFrame, users: DataFrame, **wanted) -> DataFrame:
    """Samples of each host's second capture, against the one before it: the first is for the differences alone. Nothing for a host with one capture, or with captures over an hour apart."""
    moments = captures.select("host", "ts").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("host").orderBy(F.col("ts").desc()))).where("_k <= 2")
    # a row for each host, which is sent to all: hosts are few, and dealing the captures out by host would leave most tasks without any
    two = moments.groupBy("host").agg(F.min("ts").alias("_first"), F.max("ts").alias("_second")).where(f"_second > _first and _second - _first <= {HOUR}")
    near = captures.join(F.broadcast(two), "host").where("ts in (_first, _second)").select(*captures.columns)
    return gauges(admitted(near, boots, users), **wanted)
