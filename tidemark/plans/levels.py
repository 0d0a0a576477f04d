"""Queries on a host's levels and totals, typed metadata, known fields, and jobs that run beside those that have ended."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import committed_pct, hugepages, inodes_pct, memory, swap_pct
from ..operators import derive, reconcile, traces
from ..sources import captures, metadata
from ..sources.model import processes, records, spans, table, with_sql
from .kernel import NUMBERS, _captured


def memory_levels(spark, sf):
    """Of each order a host whose memory is written from its numbers; some have neither swap nor huge pages."""
    text = "MemTotal: {k4} kB\nMemAvailable: {k} kB\nCommitted_AS: {ck} kB\nSwapTotal: {k7} kB\nSwapFree: {h} kB\nHugePages_Total: {c9}\nHugePages_Free: {h}\n"
    keyed = captures.keyed(_captured(spark, sf, ("meminfo", text))).groupBy("host", "ts").pivot("key", ["MemTotal", "MemAvailable", "Committed_AS", "SwapTotal", "SwapFree", "HugePages_Total", "HugePages_Free"]).agg(F.first("value"))
    used, huge = memory("MemTotal", "MemAvailable"), hugepages("HugePages_Total", "HugePages_Free")
    return keyed.select(
        "host", "ts", used["used"].alias("used"), F.round(used["used_pct"], 9).alias("used_pct"), F.round(swap_pct("SwapTotal", "SwapFree"), 9).alias("swap_pct"), F.round(committed_pct("Committed_AS", "MemTotal", "SwapTotal"), 9).alias("committed_pct"), huge["total"].alias("huge_total"), huge["free"].alias("huge_free"),
        F.round(inodes_pct("HugePages_Total", "HugePages_Free"), 9).alias("inodes_pct"),
    )


def interface_totals(spark, sf):
    """Customers are interfaces of hosts, read at each of their orders' keys; lo is no part of the totals, lo1 is."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 3).cast("string")).alias("host"), F.concat(F.lit("lo"), F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 7).cast("string")).otherwise("")).alias("iface"), F.expr("o_orderkey div 40").alias("ts"), F.col("o_orderkey").alias("rx_bytes"), (F.col("o_totalprice").cast("bigint")).alias("tx_bytes"))
    read = o.groupBy("host", "iface", "ts").agg(F.max("rx_bytes").alias("rx_bytes"), F.max("tx_bytes").alias("tx_bytes"))
    return derive.interface_totals(read).select("host", "ts", F.round("rx_bytes", 6).alias("rx"), F.round("tx_bytes", 6).alias("tx"))


def metadata_typed(spark, sf):
    """Attributes of spans, packed and read again by their keys, each with its type; a key of another type than was asked for is null."""
    s = spans(spark, sf).withColumn("attributes", metadata.packed(process__pid=F.col("trace") * 100 + F.col("span"), process__unit=F.when(F.col("span") % 3 > 0, F.col("unit")), process__cpu_seconds=F.col("duration_s") / 4, process__forked=F.col("span") % 2 == 0))
    own = metadata.typed(s).where("process_unit is not null and process_cpu_seconds >= 5")
    return own.select("trace", "span", "process_pid", "process_unit", "process_cpu_seconds", "process_forked", metadata.get("attributes", "process.unit", "bigint").alias("no_number"), metadata.get("attributes", "process").alias("no_key"))


def known_fields(spark, sf):
    r = records(spark, sf).select("host", "pid", F.col("ts_us").alias("started"), "service", F.when(F.col("pid") % 2 == 0, F.col("unit")).alias("unit"))
    known = records(spark, sf).where("pid % 3 <> 0").select("host", "pid", F.col("ts_us").alias("started"), F.when(F.col("pid") % 4 > 0, F.concat(F.lit("/bin/"), "service")).otherwise("").alias("exe"), F.concat("service", F.lit(" -x")).alias("cmdline"), F.lit("").alias("started_as"), F.lit("kept.service").alias("unit"))
    return reconcile.with_known(r, known)


def jobs_running_and_ended(spark, sf):
    return traces.jobs_now(processes(spark, sf), spans(spark, sf), 3600 * 30, 3600 * 20, until=3600 * 60)


def command_lines(spark, sf):
    """Command lines as the kernel has them: parts end with a zero byte, a secret is withheld."""
    return captures.pid_cmdline(_captured(spark, sf, ("{k}/cmdline", "app{k7}\0--token=s{k}\0-n\0{c}\0"), ("{k}/comm", "x")))


QUERIES = {f.__name__: f for f in (memory_levels, interface_totals, metadata_typed, known_fields, jobs_running_and_ended, command_lines)}

_O = "WITH o AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in NUMBERS.items()) + " FROM orders) "
_S, _R = with_sql("spans"), with_sql("records")
_BOTH = "WITH " + ",\n".join(with_sql(n).removeprefix("WITH ").rstrip().rstrip(",") for n in ("spans", "processes"))
_FIRST = "min(start_s) AS started, count(*) AS processes, CAST(sum({cpu}) AS DOUBLE) AS cpu, arg_min(unit, (start_s, {id})) AS unit, arg_min({name}, (start_s, {id})) AS command"
ORACLE = {
    "memory_levels": _O + "SELECT 'h' || h AS host, k AS ts, k4 - k AS used, CASE WHEN k4 > 0 THEN round(100.0::DOUBLE * (k4 - k) / k4, 9) END AS used_pct, CASE WHEN k7 = 0 THEN 0 ELSE round(100.0::DOUBLE * (k7 - h) / k7, 9) END AS swap_pct, CASE WHEN k4 + k7 > 0 THEN round(100.0::DOUBLE * ck / (k4 + k7), 9) END AS committed_pct, CASE WHEN c9 > 0 THEN c9 END AS huge_total, CASE WHEN c9 > 0 THEN h END AS huge_free, CASE WHEN c9 > 0 THEN round(100.0::DOUBLE * (c9 - h) / c9, 9) END AS inodes_pct FROM o",
    "interface_totals": "WITH r AS (SELECT 'h' || (o_custkey % 3) AS host, o_custkey % 7 AS iface, o_orderkey // 40 AS ts, max(o_orderkey) AS rx, max(CAST(trunc(o_totalprice) AS BIGINT)) AS tx FROM orders WHERE o_custkey % 7 > 0 GROUP BY ALL), p AS (SELECT *, lag(ts) OVER w AS t, lag(rx) OVER w AS prx, lag(tx) OVER w AS ptx FROM r WINDOW w AS (PARTITION BY host, iface ORDER BY ts)) SELECT host, ts, round(sum((rx - prx) / (ts - t)) FILTER (rx >= prx), 6) AS rx, round(sum((tx - ptx) / (ts - t)) FILTER (tx >= ptx), 6) AS tx FROM p WHERE t IS NOT NULL GROUP BY host, ts",
    "metadata_typed": _S + "x AS (SELECT 1) SELECT trace, span, trace * 100 + span AS process_pid, unit AS process_unit, duration_s / 4 AS process_cpu_seconds, span % 2 = 0 AS process_forked, CAST(NULL AS BIGINT) AS no_number, CAST(NULL AS VARCHAR) AS no_key FROM spans WHERE span % 3 > 0 AND duration_s >= 20",
    "known_fields": _R + """x AS (SELECT 1) SELECT host, pid, ts_us AS started, service, CASE WHEN pid % 2 = 0 THEN unit WHEN pid % 3 <> 0 THEN 'kept.service' END AS unit, CASE WHEN pid % 3 <> 0 AND pid % 4 > 0 THEN '/bin/' || service END AS path, CASE WHEN pid % 3 <> 0 THEN service || ' -x' END AS cmdline, CAST(NULL AS VARCHAR) AS started_as FROM records""",
    "jobs_running_and_ended": _BOTH + f"""
, e AS (SELECT false AS running, CAST(trace AS VARCHAR) AS job, {_FIRST.format(cpu="duration_s", id="span", name="name")} FROM spans WHERE start_s <= {3600 * 60} GROUP BY trace HAVING count(*) > 1),
r AS (SELECT true AS running, CAST(pgid AS VARCHAR) AS job, coalesce(min(start_s) FILTER (pid = pgid), min(start_s)) AS started, count(*) AS processes, CAST(sum(cpu_seconds) AS DOUBLE) AS cpu, arg_min(unit, (start_s, pid)) AS unit, arg_min(comm, (start_s, pid)) AS command FROM processes GROUP BY pgid)
SELECT * FROM e UNION ALL SELECT * FROM r WHERE {3600 * 30} - started <= {3600 * 20} AND processes >= 2""",
    "command_lines": _O + "SELECT 'h' || h AS host, k AS ts, k AS pid, 'app' || k7 || ' --token=*** -n ' || c AS cmdline FROM o",
}
