"""Queries on what a collector reads: processes and control groups in several captures, exec events, lost counts, bodies of spans. The SQL says from the columns what must come out."""

from __future__ import annotations

import re
import uuid
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import groups, processes, reconcile
from ..sources import encode, execs
from ..sources.model import epoch_us, records, spans, table, with_sql
from ..sources.shared import folder
from ..streaming import live
from .kernel import NUMBERS, _text

US = 1_000_000


def _captures(spark, sf, files: dict[int, dict[str, str]]) -> DataFrame:
    """host, ts, path, content: for each order and each moment the files of templates.

    Numbers become text once for an order, and each moment is a branch of its own: in one branch the method made of all templates is too long to be compiled, and runs 10 times slower.
    Orders are dealt to a number of tasks that is given, which adaptive execution leaves: by the size of orders it would make a few, and each becomes many files.
    """
    orders = table(spark, sf, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    texts = orders.select(_text("h{h}").alias("host"), *[F.expr(f"cast({v} as string)").alias(k) for k, v in NUMBERS.items()])
    out = None
    for t, of in files.items():
        for some in batched(of.items(), 8):
            each = F.array(*[F.struct(_filled(path).alias("path"), _filled(content).alias("content")) for path, content in some])
            rows = texts.select("host", F.explode(each).alias("_file")).select("host", F.lit(t).cast("bigint").alias("ts"), "_file.*")
            out = rows if out is None else out.unionByName(rows)
    return out


def _filled(template: str):
    """``template`` with each {name} replaced by the column of that name."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def _stat(minflt: str, majflt: str, utime: str, stime: str, threads: str, vsize: int, rss: str, blkio: str) -> str:
    return f"{{k}} (cmd{{k7}}) S {{c}} {{k}} 1 0 -1 {{fl}} {minflt} 0 {majflt} 0 {utime} {stime} 0 0 20 0 {threads} 0 {{ck}} {vsize} {rss}" + " 0" * 17 + f" {blkio} 0 0"


def _status(uid: str, rss: str, swap: str, switches: str) -> str:
    return f"Name:\tx\nUid:\t0\t{uid}\t0\t0\nVmRSS:\t {rss} kB\nVmSwap:\t {swap} kB\nvoluntary_ctxt_switches:\t{switches}\nnonvoluntary_ctxt_switches:\t0\n"


#: The second capture could not read status; the third neither I/O, waiting time nor the group.
PROCESSES = {
    0: {"{k}/stat": _stat("{k7}", "{h}", "{c}", "{c9}", "3", 4096, "{c}", "{h}"), "{k}/status": _status("{c9}", "{k}", "1", "{k}"), "{k}/io": "read_bytes: {c}\nwrite_bytes: {k}\n", "{k}/schedstat": "1 {k} 1", "{k}/cgroup": "0::/system.slice/app{h}.service\n"},
    10: {"{k}/stat": _stat("{k}", "{c9}", "{c2}", "{c}", "{k4}", 8192, "{c2}", "{k4}"), "{k}/io": "read_bytes: {c2}\nwrite_bytes: {k3}\n", "{k}/schedstat": "1 {k2} 1"},
    20: {"{k}/stat": _stat("{k2}", "{c9}", "{c3}", "{c}", "{h}", 4096, "{c}", "{k4}"), "{k}/status": _status("{c9}", "{k2}", "{c}", "{k3}")},
}


def _of_processes(spark, sf):
    c = _captures(spark, sf, PROCESSES)
    boots = spark.range(4).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit(-1e6).alias("boot"))
    return c, boots, table(spark, sf, "nation").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("user"))


def _shown(samples: DataFrame) -> DataFrame:
    label = lambda k: F.col("labels")[k].alias(k)
    return samples.select("name", "host", label("pid"), label("comm"), label("user"), label("proc"), label("unit"), "ts", F.round("value", 6).alias("value"))


def process_gauges(spark, sf):
    c, boots, users = _of_processes(spark, sf)
    return _shown(processes.gauges(processes.admitted(c.where("ts < 20"), boots, users)))


def once_report(spark, sf):
    return _shown(processes.once(*_of_processes(spark, sf), kernel_threads=True))


_U = "/s{k7}.slice/u{k}.service"
_PSI = "some avg10=0.00 avg60=0.00 avg300=0.00 total=%s\nfull avg10=0.00 avg60=0.00 avg300=0.00 total=1\n"
GROUPS = {
    0: {
        f"{_U}/pids.current": "{h}\n", f"{_U}/memory.current": "{c2}", f"{_U}/memory.stat": "anon {c}\nfile {k}\n", f"{_U}/memory.events": "low 0\noom_kill {c9}\n", f"{_U}/cpu.stat": "usage_usec {k}\nuser_usec {c}\nsystem_usec 0\nnr_periods {h}\nthrottled_usec {c}\n",
        f"{_U}/io.stat": "8:0 rbytes={k} wbytes={c}\n", f"{_U}/cpu.pressure": _PSI % "{k}", f"{_U}/memory.pressure": _PSI % "{c}", f"{_U}/inner.scope/pids.current": "1", f"{_U}/inner.scope/memory.current": "{k}", f"{_U}/sub/pids.current": "7",
    },
    10: {
        f"{_U}/pids.current": "{h}\n", f"{_U}/memory.current": "{c3}", f"{_U}/memory.events": "low 0\noom_kill {c}\n", f"{_U}/cpu.stat": "usage_usec {k3}\nuser_usec {c2}\nsystem_usec {k}\nnr_periods {h}\nthrottled_usec {c2}\n",
        f"{_U}/io.stat": "8:0 rbytes={k2} wbytes={c3}\n", f"{_U}/cpu.pressure": _PSI % "{k2}", f"{_U}/memory.pressure": _PSI % "{c3}", f"{_U}/inner.scope/pids.current": "1",
    },
}


def groups_walked(spark, sf):
    """A unit of each fourth order has no tasks, so nothing below it is read."""
    return groups.walked(_captures(spark, sf, GROUPS))


def unit_gauges(spark, sf):
    users = table(spark, sf, "nation").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("user"))
    out = groups.unit_gauges(_captures(spark, sf, GROUPS), users)
    return out.select("name", "host", F.col("labels")["unit"].alias("unit"), F.col("labels")["kind"].alias("kind"), "ts", F.round("value", 6).alias("value"))


def _happened(spark, sf) -> DataFrame:
    """Events as what the process connector says; views are forks. A file has ten days of a host."""
    e, us = table(spark, sf, "events"), epoch_us(F.col("ts"))
    return e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"), F.concat(F.lit("d"), F.lpad(F.floor(us / (10 * 86_400 * US)).cast("string"), 6, "0")).alias("file"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("what"), (F.col("user_id") % 8).alias("cpu"), (us * 1000).alias("when"),
        (F.col("event_id") + 1).alias("thread"), F.col("event_id").alias("pid"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("comm"),
    )


_EXEC = ("host", "file", "since_boot_ns", "cpu", "thread", "pid")


def exec_events(spark, sf):
    at = f"{folder(spark)}/execs-{uuid.uuid4().hex}"
    execs.write_captures(_happened(spark, sf), at).collect()  # a row for each file
    return execs.read_execs(spark, at).select(*_EXEC)


def streaming_exec_events(spark, sf):
    """The later files come after the stream has stopped once."""
    at = f"{folder(spark)}/execs-{uuid.uuid4().hex}"
    rows = _happened(spark, sf)
    first = rows.agg(F.min("file")).first()[0]
    for run, piece in enumerate((rows.where(F.col("file") <= first), rows.where(F.col("file") > first))):
        execs.write_captures(piece, f"{at}/in").collect()  # a row for each file
        stream = execs.stream_execs(spark, f"{at}/in")
        live.run_once(stream, lambda df, batch, run=run: df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}"), f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(execs.SCHEMA).parquet(f"{at}/out").select(*_EXEC)


def execs_described(spark, sf):
    """A reading is a stat, a command line and a stat; of one in five the number was used again before the second, one in seven is already gone."""
    h = _happened(spark, sf).withColumn("t", F.col("when") / 1e9)
    heard = h.where("what = 2").select("host", "pid", F.col("when").alias("since_boot_ns"))
    who = lambda ticks: (ticks.alias("start_ticks"), F.col("comm"), (F.col("pid") - 1).alias("ppid"), (F.col("pid") % 7).alias("pgid"))
    none = F.lit(None).cast("string")
    a = h.select("host", "pid", (F.col("t") + 0.1).alias("ts"), *who(F.col("pid") * 2), none.alias("cmdline"))
    b = h.select("host", "pid", (F.col("t") + 0.2).alias("ts"), *who(F.lit(None).cast("bigint")), F.when(F.col("k") % 7 != 0, F.concat(F.lit("run "), F.col("pid").cast("string"))).alias("cmdline"))
    c = h.select("host", "pid", (F.col("t") + 0.3).alias("ts"), *who(F.col("pid") * 2 + (F.col("k") % 5 == 0).cast("int")), none.alias("cmdline"))
    boots = spark.range(4).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit(0.0).alias("boot"))
    return execs.described_execs(heard, boots, a.unionByName(b).unionByName(c)).drop("at")


def known_parents(spark, sf):
    e = records(spark, sf).select("host", (F.col("pid") % 500).alias("pid"), (F.col("ts_us") / 1e6).alias("start"), F.col("pid").alias("pgid"))
    kind = F.element_at(F.array(*map(F.lit, reconcile.EVIDENCE)), (F.col("pgid") % 5 + 1).cast("int"))
    children = e.where("pgid % 3 = 0").select("host", F.col("pgid").alias("id"), "start", ((F.col("pid") + 3) % 500).alias("ppid"))
    return reconcile.known_parents(children, e.withColumn("kind", kind)).select("id", "parent_kind", "parent_pgid")


QUEUE = 1500


def lost_counts(spark, sf):
    """A file for each week, a batch for each file, and a queue of 1500: what was kept, and what the samples say of what was lost, in one row."""
    at = f"{folder(spark)}/lost-{uuid.uuid4().hex}"
    rows = _happened(spark, sf).withColumn("week", F.floor(F.col("when") / (7 * 86_400 * 1e9)))
    for (week,) in sorted(rows.select("week").distinct().collect()):  # five of a month
        rows.where(F.col("week") == week).drop("week").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.drop("week").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    take = live.bounded(lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}"), QUEUE, lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/samples/batch={batch}"))
    live.run_once(stream, take, f"{at}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{at}/out").agg(F.count("*").alias("kept"))
    told = spark.read.parquet(f"{at}/samples").groupBy("name").agg(F.sum("value").alias("lost"), F.count_if(F.col("value") > 0).alias("overflows"))
    return told.crossJoin(kept)  # one row and one row


def otlp_bodies(spark, sf):
    """Spans with attributes of four types, in bodies of 20 000 bytes at most."""
    s = spans(spark, sf)
    named = s.select(
        "host", "unit", F.md5(F.col("trace").cast("string")).alias("trace_id"), F.substring(F.md5(F.concat_ws("-", "trace", "span")), 1, 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), "name", "status", F.lit("").alias("ending"),
        (F.col("start_s") * 1_000_000_000).alias("start_ns"), (F.col("duration_s") * 1_000_000_000).alias("duration_ns"), F.when(F.col("span") > 0, F.col("span")).alias("turn"), (F.col("duration_s") + 0.5).alias("half"), (F.col("span") % 2 == 0).alias("even"), F.col("name").alias("role"),
    )
    return encode.otlp_json(named, ("turn", "half", "even", "role"), 20_000)


QUERIES = {f.__name__: f for f in (process_gauges, once_report, groups_walked, unit_gauges, exec_events, streaming_exec_events, execs_described, known_parents, lost_counts, otlp_bodies)}

_O = "WITH o AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in NUMBERS.items()) + " FROM orders) "


def _named(columns: str, figures: dict[str, str], where: str, tables: str) -> str:
    """A row for each figure that is not null."""
    return " UNION ALL ".join(f"SELECT '{name}' AS name, {columns}, round(CAST({value} AS DOUBLE), 6) AS value FROM {tables} WHERE ({where}) AND ({value}) IS NOT NULL" for name, value in figures.items())


_P = """'h' || h AS host, CAST(k AS VARCHAR) AS pid, 'cmd' || k7 AS comm, n_name AS "user", 'cmd' || k7 || '[' || k || ']' AS proc, {unit} AS unit, CAST({ts} AS BIGINT) AS ts"""
_SECOND = {
    "proc_cpu_pct": "(c + c - c9) / 10", "proc_cpu_user_pct": "c / 10", "proc_cpu_system_pct": "(c - c9) / 10", "proc_cpu_seconds": "3 * c / 100", "proc_threads": "k4", "proc_minor_faults_per_sec": "(k - k7) / 10", "proc_major_faults_per_sec": "CASE WHEN c9 >= h THEN (c9 - h) / 10 END", "proc_context_switches_per_sec": "0",
    "proc_rss_bytes": "c2 * 4096", "proc_vsize_bytes": "8192", "proc_io_read_bytes_per_sec": "c / 10", "proc_io_write_bytes_per_sec": "k2 / 10", "proc_cpu_wait_pct": "k / 10 / 1e7", "proc_io_wait_pct": "(k4 - h) / 10",
}
_THIRD = {
    "proc_cpu_pct": "c / 10", "proc_cpu_user_pct": "c / 10", "proc_cpu_system_pct": "0", "proc_cpu_seconds": "(c3 + c) / 100", "proc_threads": "h", "proc_minor_faults_per_sec": "k / 10", "proc_major_faults_per_sec": "0", "proc_context_switches_per_sec": "k3 / 10",
    "proc_rss_bytes": "CASE WHEN fl = 0 THEN k2 * 1024 END", "proc_vsize_bytes": "CASE WHEN fl = 0 THEN 4096 END", "proc_swap_bytes": "CASE WHEN fl = 0 THEN c * 1024 END", "proc_io_wait_pct": "0",
}
_UNIT = "'h' || h AS host, 'u' || k || '.service' AS unit, 'service' AS kind, CAST({} AS BIGINT) AS ts"
_INNER = "'h' || h AS host, 'inner.scope' AS unit, 'scope' AS kind, CAST({} AS BIGINT) AS ts"
_GAUGES = {
    "unit_cpu_pct": "k2 / 1e5", "unit_cpu_user_pct": "c / 1e5", "unit_cpu_system_pct": "k / 1e5", "unit_cpu_throttled_pct": "c / 1e5", "unit_io_read_bytes_per_sec": "k / 10", "unit_io_write_bytes_per_sec": "c2 / 10", "unit_oom_kills_per_sec": "(c - c9) / 10", "unit_pressure_cpu_pct": "least(k / 1e5, 100)", "unit_pressure_memory_pct": "least(c2 / 1e5, 100)",
}
_LEVELS = {0: {"unit_tasks": "h", "unit_memory_bytes": "c2", "unit_memory_anon_bytes": "c", "unit_memory_file_bytes": "k"}, 10: {"unit_tasks": "h", "unit_memory_bytes": "c3"}}
_BELOW = (("unit_tasks", "count(*)", 0), ("unit_memory_bytes", "sum(k)", 0), ("unit_tasks", "count(*)", 10), ("unit_cpu_pct", "0", 10), ("unit_cpu_user_pct", "0", 10), ("unit_cpu_system_pct", "0", 10))
_EV = "WITH h AS (SELECT 'h' || (user_id % 4) AS host, 'd' || lpad(CAST(epoch_us(ts) // 864000000000 AS VARCHAR), 6, '0') AS file, epoch_us(ts) * 1000 AS since_boot_ns, user_id % 8 AS cpu, event_id + 1 AS thread, event_id AS pid, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) "
_EVENTS = _EV + "SELECT host, file, since_boot_ns, cpu, thread, pid FROM h WHERE event_type <> 'view'"


def _attribute(key: str, tag: str, value: str) -> str:
    return f"""'{{"key":"{key}","value":{{"{tag}":' || {value} || '}}}}'"""


def _bodies(attributes: str, half: int) -> str:
    """Bodies of spans, as text put together piece by piece."""
    return with_sql("spans") + """j AS (SELECT host, unit, start_s, substr(md5(trace || '-' || span), 1, 16) AS span_id, '{"traceId":"' || md5(CAST(trace AS VARCHAR)) || '","spanId":"' || substr(md5(trace || '-' || span), 1, 16) || '","name":"' || name || '","kind":1,"startTimeUnixNano":"' || start_s * 1000000000 || '","endTimeUnixNano":"' || (start_s + duration_s) * 1000000000
  || '","status":{"code":' || CASE status WHEN 'error' THEN 2 ELSE 1 END || '}'""" + attributes + f""" || '}}' AS s FROM spans),
b AS (SELECT *, sum(strlen(s) + 1) OVER (PARTITION BY host, unit ORDER BY start_s, span_id ROWS UNBOUNDED PRECEDING) // {half} AS p FROM j), g AS (SELECT host, unit, p, string_agg(s, ',' ORDER BY start_s, span_id) AS spans FROM b GROUP BY ALL)
""" + """SELECT host, unit, CAST(row_number() OVER (PARTITION BY host, unit ORDER BY p) - 1 AS INTEGER) AS part, '{"resourceSpans":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"' || host || '"}},{"key":"service.name","value":{"stringValue":"' || unit || '"}}]},"scopeSpans":[{"scope":{"name":"tidemark"},"spans":[' || spans || ']}]}]}' AS body FROM g"""


ORACLE = {
    "process_gauges": _O + _named(_P.format(unit="'app' || h || '.service'", ts=10), _SECOND, "fl = 0", "o JOIN nation ON n_nationkey = c9"),
    "once_report": _O + _named(_P.format(unit="CAST(NULL AS VARCHAR)", ts=20), _THIRD, "true", "o JOIN nation ON n_nationkey = 0"),
    "groups_walked": _O + "SELECT 'h' || h AS host, CAST(ts AS BIGINT) AS ts, '/s' || k7 || '.slice/u' || k || '.service' || p AS path, CASE p WHEN '' THEN h WHEN '/sub' THEN 7 ELSE 1 END AS tasks FROM o, (VALUES (0, ''), (0, '/inner.scope'), (0, '/sub'), (10, ''), (10, '/inner.scope')) v(ts, p) WHERE h > 0",
    "unit_gauges": _O + " UNION ALL ".join((
        _named(_UNIT.format(10), _GAUGES, "h > 0", "o"), *[_named(_UNIT.format(t), f, "h > 0", "o") for t, f in _LEVELS.items()], *[f"SELECT '{n}' AS name, {_INNER.format(ts)}, CAST({v} AS DOUBLE) AS value FROM o WHERE h > 0 GROUP BY h" for n, v, ts in _BELOW],
    )),
    "exec_events": _EVENTS, "streaming_exec_events": _EVENTS,
    "execs_described": _EV + "SELECT host, pid, pid * 2 AS start_ticks, event_type AS comm, pid - 1 AS ppid, pid % 7 AS pgid, 'run ' || pid AS cmdline FROM h WHERE event_type <> 'view' AND k % 5 <> 0 AND k % 7 <> 0",
    "known_parents": with_sql("records") + "e AS (SELECT host, pid % 500 AS pid, ts_us / 1e6 AS start, pid AS id FROM records), j AS (SELECT a.id, x.id AS pgid, x.id % 5 AS r, row_number() OVER (PARTITION BY a.id ORDER BY x.id % 5, x.start DESC, x.id DESC) AS n FROM e a LEFT JOIN e x ON x.host = a.host AND x.pid = (a.pid + 3) % 500 AND x.start <= a.start + 5 WHERE a.id % 3 = 0) "
    + f"SELECT id, CASE WHEN r IS NOT NULL THEN {list(reconcile.EVIDENCE)!r}[r + 1] END AS parent_kind, pgid AS parent_pgid FROM j WHERE n = 1",
    "lost_counts": f"WITH w AS (SELECT count(*) AS n FROM events GROUP BY epoch_us(ts) // 604800000000) SELECT 'acct_lost' AS name, CAST(sum(greatest(n - {QUEUE}, 0)) AS DOUBLE) AS lost, count(*) FILTER (n > {QUEUE}) AS overflows, CAST(sum(least(n, {QUEUE})) AS BIGINT) AS kept FROM w",
    "otlp_json": _bodies("", 2 << 20),
    "otlp_bodies": _bodies(""" || ',"attributes":[' || CASE WHEN span > 0 THEN """ + _attribute("turn", "intValue", "span") + " || ',' ELSE '' END || " + _attribute("half", "doubleValue", "duration_s || '.5'") + " || ',' || " + _attribute("even", "boolValue", "CASE WHEN span % 2 = 0 THEN 'true' ELSE 'false' END") + " || ',' || " + _attribute("role", "stringValue", """'"' || name || '"'""") + " || ']'", 10_000),
}
