"""Queries on accounting records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.endings import core_dumped, exit_code, level, signal_name, span_ending, span_status, status_text
from ..operators import exits, read
from ..sources.model import records, samples, with_sql
from .samples import AT, DAY, T0, T1

US = 1_000_000


def exits_latest(spark, sf):
    return exits.last(exits.exits(records(spark, sf)), 200)


def exits_filtered(spark, sf):
    return exits.exits(records(spark, sf), T0 * US, T1 * US, comm="click", status="SIGSEGV", host="h1")


def exits_by_user_and_unit(spark, sf):
    return exits.last(exits.exits(records(spark, sf), user="u13", unit="u3.service"), 50)


def exits_page_keyset(spark, sf):
    """Two pages that overlap at the cursor, each record once."""
    first = exits.page(records(spark, sf), None, 100)
    cursor = first.agg(F.min("ts_us")).first()[0]
    return exits.once(first.unionByName(exits.page(records(spark, sf), cursor, 100)))


def exits_message_contains(spark, sf):
    return exits.saying(records(spark, sf), "sigsegv")


def exits_search_fields(spark, sf):
    return exits.saying(records(spark, sf), "U13", ("message", "user", "unit"))


def _summary(by, total=True, n=None):
    return lambda spark, sf: _rounded(exits.summary(exits.exits(records(spark, sf)), by, n, total))


def _rounded(df):
    return df.withColumn("cpu", F.round("cpu", 4)).withColumn("elapsed", F.round("elapsed", 4))


def incidents(spark, sf):
    return exits.incidents(records(spark, sf), T0 * US, T1 * US)


def incident_marks(spark, sf):
    return read.marks(exits.incidents(records(spark, sf), T0 * US, T1 * US), T0, T1, 240)


def record_asof_forward(spark, sf):
    return exits.first_since(records(spark, sf), "view", AT * US, ("user",))


def unit_cpu_join_exits(spark, sf):
    units = read.latest(samples(spark, sf), AT, DAY, "view", by=(), keys=("unit",)).select("unit", F.col("value").alias("cpu"))
    out = exits.beside_exits(units, records(spark, sf), AT * US, (AT + DAY) * US)
    return out.withColumn("cpu_seconds", F.round("cpu_seconds", 4))


def wait_status_decode(spark, sf):
    raw = records(spark, sf).select("pid", (F.col("pid") * 37 % 65_536).cast("int").alias("wait"))
    return raw.select("pid", "wait", exit_code("wait").alias("code"), status_text("wait").alias("status"), core_dumped("wait").alias("core"), level(status_text("wait")).alias("level"))


def level_of_ending(spark, sf):
    return records(spark, sf).groupBy("status").agg(F.first(level("status")).alias("level"), F.first(span_status("status")).alias("span_status"), F.first(span_ending("status")).alias("ending"), F.count("*").alias("n"))


def signal_names(spark, sf):
    return records(spark, sf).select((F.col("pid") % 40).cast("int").alias("number")).distinct().select("number", signal_name("number").alias("signal"))


QUERIES = {
    "exits_latest": exits_latest, "exits_filtered": exits_filtered, "exits_by_user_and_unit": exits_by_user_and_unit, "exits_page_keyset": exits_page_keyset, "exits_message_contains": exits_message_contains, "exits_search_fields": exits_search_fields,
    "exits_summary_comm": _summary("service", False), "exits_summary_unit": _summary("unit", False), "exits_summary_user": _summary("user", True, 10), "exits_summary_total": _summary("service"), "incidents": incidents, "incident_marks": incident_marks,
    "record_asof_forward": record_asof_forward, "unit_cpu_join_exits": unit_cpu_join_exits, "wait_status_decode": wait_status_decode, "level_of_ending": level_of_ending, "signal_names": signal_names,
}

_R = with_sql("records")
_ALL = 'ts_us, kind, service, status, host, usr AS "user", unit, pid, elapsed_seconds, cpu_seconds, peak_rss_bytes, io_read_bytes, io_write_bytes, level, message'


def _summary_sql(by: str) -> str:
    return f"SELECT {by} AS name, count(*) AS exits, count(*) FILTER (status NOT IN ('0', 'unknown')) AS failed, sum(cpu_seconds) AS cpu, sum(elapsed_seconds) AS elapsed, max(peak_rss_bytes) AS peak_rss, CAST(sum(io_read_bytes) AS BIGINT) AS read, CAST(sum(io_write_bytes) AS BIGINT) AS write FROM records GROUP BY 1"


_OUT = "name, exits, failed, round(cpu, 4) AS cpu, round(elapsed, 4) AS elapsed, peak_rss, read, write"
_TOTAL = "SELECT '(all ' || count(*) || ')' AS name, CAST(sum(exits) AS BIGINT) AS exits, CAST(sum(failed) AS BIGINT) AS failed, sum(cpu) AS cpu, sum(elapsed) AS elapsed, max(peak_rss) AS peak_rss, CAST(sum(read) AS BIGINT) AS read, CAST(sum(write) AS BIGINT) AS write FROM g HAVING count(*) > 1"
_SIGNALS = "['SIGHUP','SIGINT','SIGQUIT','SIGILL','SIGTRAP','SIGABRT','SIGBUS','SIGFPE','SIGKILL','SIGUSR1','SIGSEGV','SIGUSR2','SIGPIPE','SIGALRM','SIGTERM','SIGSTKFLT','SIGCHLD','SIGCONT','SIGSTOP','SIGTSTP','SIGTTIN','SIGTTOU','SIGURG','SIGXCPU','SIGXFSZ','SIGVTALRM','SIGPROF','SIGWINCH','SIGIO','SIGPWR','SIGSYS']"
_NAME = f"CASE WHEN n BETWEEN 1 AND 31 THEN {_SIGNALS}[n] ELSE 'SIG' || n END"
_LEVEL = "CASE WHEN status IN ('0', 'unknown') THEN 'info' WHEN status IN ('SIGSEGV', 'SIGBUS', 'SIGILL', 'SIGFPE', 'SIGABRT', 'SIGSYS') THEN 'error' WHEN status = 'SIGKILL' THEN 'warning' ELSE 'notice' END"
ORACLE = {
    "exits_latest": _R + f"x AS (SELECT 1) SELECT {_ALL} FROM records ORDER BY ts_us DESC, pid DESC LIMIT 200",
    "exits_filtered": _R + f"x AS (SELECT 1) SELECT {_ALL} FROM records WHERE ts_us BETWEEN {T0 * US} AND {T1 * US} AND service = 'click' AND status = 'SIGSEGV' AND host = 'h1'",
    "exits_by_user_and_unit": _R + f"x AS (SELECT 1) SELECT {_ALL} FROM records WHERE usr = 'u13' AND unit = 'u3.service' ORDER BY ts_us DESC, pid DESC LIMIT 50",
    "exits_page_keyset": _R + f"a AS (SELECT * FROM records ORDER BY ts_us DESC, pid DESC LIMIT 100), b AS (SELECT * FROM records WHERE ts_us <= (SELECT min(ts_us) FROM a) ORDER BY ts_us DESC, pid DESC LIMIT 100) SELECT {_ALL} FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "exits_message_contains": _R + f"x AS (SELECT 1) SELECT {_ALL} FROM records WHERE contains(lower(message), 'sigsegv')",
    "exits_search_fields": _R + f"x AS (SELECT 1) SELECT {_ALL} FROM records WHERE contains(lower(message), 'u13') OR contains(usr, 'u13') OR contains(unit, 'u13')",
    "exits_summary_comm": _R + f"g AS ({_summary_sql('service')}) SELECT {_OUT} FROM g",
    "exits_summary_unit": _R + f"g AS ({_summary_sql('unit')}) SELECT {_OUT} FROM g",
    "exits_summary_user": _R + f"g AS ({_summary_sql('usr')}), s AS (SELECT * FROM g ORDER BY cpu DESC, name LIMIT 10) SELECT {_OUT} FROM (SELECT * FROM s UNION ALL {_TOTAL})",
    "exits_summary_total": _R + f"g AS ({_summary_sql('service')}) SELECT {_OUT} FROM (SELECT * FROM g UNION ALL {_TOTAL})",
    "incidents": _R + f"x AS (SELECT 1) SELECT {_ALL} FROM records WHERE level IN ('error', 'warning') AND ts_us BETWEEN {T0 * US} AND {T1 * US}",
    "incident_marks": _R + f"i AS (SELECT level, CAST(least(floor((ts_us / 1e6 - {T0}) / ({T1} - {T0}) * 240), 239) AS INTEGER) AS col FROM records WHERE level IN ('error', 'warning') AND ts_us BETWEEN {T0 * US} AND {T1 * US}) SELECT col AS \"column\", CASE WHEN bool_or(level = 'error') THEN 'fault' ELSE 'killed' END AS mark FROM i GROUP BY col",
    "record_asof_forward": _R + f"x AS (SELECT 1) SELECT usr AS \"user\", min(ts_us) AS ts_us, arg_min(status, ts_us) AS status FROM records WHERE service = 'view' AND ts_us >= {AT * US} GROUP BY usr",
    "unit_cpu_join_exits": "WITH " + ",\n".join(with_sql(n).removeprefix("WITH ").rstrip().rstrip(",") for n in ("samples", "records")) + f""",
u AS (SELECT unit, arg_max(value, (ts, id)) AS cpu FROM samples WHERE name = 'view' AND ts BETWEEN {AT - DAY} AND {AT} GROUP BY unit),
e AS (SELECT unit, count(*) AS ended, count(*) FILTER (status <> '0') AS not_zero, sum(cpu_seconds) AS cpu_seconds FROM records WHERE ts_us BETWEEN {AT * US} AND {(AT + DAY) * US} GROUP BY unit)
SELECT unit, cpu, coalesce(ended, 0) AS ended, coalesce(not_zero, 0) AS not_zero, round(coalesce(cpu_seconds, 0.0), 4) AS cpu_seconds FROM u LEFT JOIN e USING (unit)""",
    "wait_status_decode": _R + f"""w AS (SELECT pid, CAST(pid * 37 % 65536 AS INTEGER) AS wait FROM records), n AS (SELECT *, wait & 127 AS n FROM w),
s AS (SELECT *, CASE WHEN n = 0 THEN (wait >> 8) & 255 END AS code, CASE WHEN n = 0 THEN CAST((wait >> 8) & 255 AS VARCHAR) ELSE {_NAME} END AS status, CASE WHEN n <> 0 THEN wait & 128 <> 0 END AS core FROM n)
SELECT pid, wait, code, status, core, {_LEVEL} AS level FROM s""",
    "level_of_ending": _R + f"x AS (SELECT 1) SELECT status, {_LEVEL} AS level, CASE status WHEN '0' THEN 'ok' WHEN 'unknown' THEN 'unset' ELSE 'error' END AS span_status, CASE WHEN status IN ('0', 'unknown') THEN '' WHEN regexp_matches(status, '^[0-9]+$') THEN 'exited ' || status ELSE 'killed by ' || status END AS ending, count(*) AS n FROM records GROUP BY status",
    "signal_names": _R + f"w AS (SELECT DISTINCT CAST(pid % 40 AS INTEGER) AS n FROM records) SELECT n AS number, {_NAME} AS signal FROM w",
}
