"""From threads that ended to processes that ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.endings import FORKED, LAST
from ..sources.taskstats import GROUPED

SUMS = ("user_us", "system_us", "minor_faults", "major_faults", "read_char", "write_char", "read_bytes", "write_bytes", "voluntary_switches", "involuntary_switches", "cpu_delay_ns", "blkio_delay_ns", "swapin_delay_ns", "reclaim_delay_ns", "thrashing_delay_ns")
PEAKS = ("peak_rss_kb", "peak_vm_kb")


def merge_threads(tasks: DataFrame) -> DataFrame:
    """A row for each process whose last thread has ended: sums of its threads' figures, the highest of their peaks (they share their memory).

    Name and fork flag are the leader's, status and ids the last thread's. Its start is when it was heard of less how long it ran. Of one
    tgid, a thread belongs to the process that the next last thread ends. Threads that no last one follows are left for later.
    """
    alone = F.col("version") < GROUPED
    ends = (alone | (F.col("flag").bitwiseAND(LAST) != 0)).cast("int")
    before = Window.partitionBy("host", "tgid").orderBy("at", F.col("flag").bitwiseAND(LAST), "pid").rowsBetween(Window.unboundedPreceding, -1)
    life = tasks.withColumn("_last", ends).withColumn("_life", F.coalesce(F.sum("_last").over(before), F.lit(0)))
    lead = F.col("pid") == F.col("tgid")
    of_last = lambda c: F.max(F.when(F.col("_last") == 1, F.col(c))).alias(c)
    elapsed = F.max(F.when(F.col("_last") == 1, F.when(F.col("version") >= GROUPED, F.col("group_elapsed_us")).otherwise(F.col("elapsed_us")))) / 1e6
    merged = life.groupBy("host", "tgid", "_life").agg(
        F.count("*").alias("threads"), *[F.sum(c).alias(c) for c in SUMS], *[F.max(c).alias(c) for c in PEAKS], F.coalesce(F.max(F.when(lead, F.col("comm"))), F.max(F.when(F.col("_last") == 1, F.col("comm")))).alias("comm"),
        F.coalesce(F.bool_or(lead & (F.col("flag").bitwiseAND(FORKED) != 0)), F.lit(False)).alias("forked"), *[of_last(c) for c in ("ppid", "uid", "gid", "nice", "exit_status", "flag")], F.max(F.when(F.col("_last") == 1, F.col("at"))).alias("end_epoch"), elapsed.alias("elapsed_seconds"),
    )
    return merged.where("end_epoch is not null").withColumn("start_epoch", F.col("end_epoch") - F.col("elapsed_seconds")).drop("_life")
