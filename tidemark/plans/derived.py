"""Queries that derive gauges from counters, and records from what several sources saw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import MODES, await_ms, committed_pct, disk_util, filesystem_pct, measured, next_tick, percent, pressure_pct, queue_depth, rate, swap_pct, watts
from ..operators import derive, reconcile, threads
from ..sources.model import counters, records, spans, table, with_sql


def counter_rate(spark, sf):
    return derive.rates(counters(spark, sf), tie="id").select("host", "subject", "ts", "counter", F.round("rate", 9).alias("rate"))


def counter_rate_measured(spark, sf):
    return derive.rates(counters(spark, sf), tie="id").select("subject", "ts", measured("rate").alias("value"))


def _line_readings(spark, sf) -> DataFrame:
    """Order lines as readings of many counters: one for each order, in order of time."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("l_partkey", "l_suppkey", "l_linenumber")], F.sum(F.col("l_quantity").cast("bigint")).alias("l_quantity"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("host"), F.col("o_orderkey").alias("ts"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


def wide_rates(spark, sf):
    return derive.wide_rates(_line_readings(spark, sf), ("host",), "ts", {"l_partkey": "parts", "l_suppkey": "suppliers", "l_quantity": "quantity"}, {"l_quantity": 512.0})


def cpu_mode_shares(spark, sf):
    r = _line_readings(spark, sf)
    modes = {m: (F.col(("l_partkey", "l_suppkey", "l_quantity")[i % 3]) * (i + 1) % 10_007) for i, m in enumerate(MODES)}
    shares = derive.cpu_modes(r.select("host", F.lit("all").alias("cpu"), "ts", *[v.alias(m) for m, v in modes.items()]))
    return shares.select("host", "ts", *[F.round(m, 6).alias(m) for m in (*MODES, "busy")])


def prefix_rate_sums(spark, sf):
    keys = counters(spark, sf).withColumn("key", F.concat(F.lit("pgscan_"), F.col("subject")))
    at = keys.withColumn("ts", F.floor(F.col("ts") / 86_400).cast("bigint")).groupBy("host", "key", "ts").agg(F.max("counter").alias("value"))
    return derive.prefix_rates(at, "pgscan_u1").select("host", "ts", F.round("rate", 9).alias("rate"))


def unit_delta_totals(spark, sf):
    """Users are control groups, read once a day where they did anything."""
    c = counters(spark, sf).withColumn("unit", F.concat(F.lit("unit"), (F.substring("subject", 2, 9).cast("int") % 7).cast("string")))
    daily = c.withColumn("ts", F.floor(F.col("ts") / 86_400).cast("bigint")).groupBy("host", "unit", F.col("subject").alias("path"), "ts").agg(F.max("counter").alias("usage"))
    return derive.unit_deltas(daily)


def group_totals_with_exited(spark, sf):
    live_ = records(spark, sf).where("status in ('0', '1')").select("service", "cpu_seconds")
    gone = records(spark, sf).where("status not in ('0', '1')").select("service", (F.col("cpu_seconds") / 2).alias("cpu_seconds"))
    return derive.totals(live_, gone, "service").withColumn("cpu_seconds", F.round("cpu_seconds", 4))


def processes_under(spark, sf):
    groups = table(spark, sf, "nation").select(F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit(".slice/n"), F.col("n_nationkey").cast("string"), F.lit(".service")).alias("path")).unionByName(table(spark, sf, "region").select(F.concat(F.lit("/r"), F.col("r_regionkey").cast("string"), F.lit(".slice")).alias("path")))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    running = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit(".slice/n"), F.col("n_nationkey").cast("string"), F.lit(".service")).alias("path"))
    return derive.under(groups, running)


def physical_totals(spark, sf):
    d = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 == 0, "dm-0").when(F.col("p_partkey") % 5 == 1, "md1").when(F.col("p_partkey") % 5 == 2, "sda").otherwise("nvme0n1").alias("device"), (F.col("p_partkey") % 10).alias("host"), F.col("p_partkey").alias("reads"))
    return derive.physical_totals(d, ("host",), "device", ("reads",))


def gauges(spark, sf):
    """The arithmetic of host gauges over order lines."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("a"), F.min("l_partkey").alias("b"), F.max("l_suppkey").alias("c"), F.min("l_suppkey").alias("d"))
    s = F.col("l_orderkey") % 10
    back = F.col("l_orderkey") % 3 == 0  # of some the counter goes back
    now, before = F.when(back, F.col("b")).otherwise(F.col("a")), F.when(back, F.col("a")).otherwise(F.col("b"))
    r = lambda c: F.round(c, 10)
    return l.select("l_orderkey", r(rate("a", "b", s)).alias("rate"), r(percent("d", "c")).alias("pct"), r(disk_util("a", "b", s)).alias("util"), r(queue_depth("a", "b", s)).alias("queue"), r(await_ms("c", "d", "a", "b")).alias("await"), r(pressure_pct(now, before, s, 100.0)).alias("stall"), r(pressure_pct(now, before, s)).alias("stall_rate"), r(watts("a", "b", s)).alias("watts"), r(swap_pct(F.col("c") * s, "d")).alias("swap"), r(committed_pct("a", "c", "d")).alias("committed"), r(filesystem_pct("a", "d", "d")).alias("disk"), next_tick("a", 30).alias("tick"))


def _exits(spark, sf):
    return records(spark, sf).select("host", (F.col("pid") % 500).alias("pid"), (F.col("ts_us") / 1e6).alias("start"), F.col("pid").alias("id"))


def exit_band_join(spark, sf):
    """Exits with the nearest sample of their pid within a day."""
    e = _exits(spark, sf)
    return reconcile.nearest(e.where("id % 2 = 0"), e.where("id % 2 = 1"), tolerance=86_400.0, keep=("id",)).select("id", "near_id")


def describe_priority(spark, sf):
    e = _exits(spark, sf)
    kind = F.col("id") % 3
    text = F.concat(F.lit("run "), F.col("id").cast("string"))
    noted = e.select("host", "pid", "start", F.when(F.col("id") % 5 > 0, text).alias("cmdline"), F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("unit"), F.concat(F.lit("c"), (F.col("pid") % 3).cast("string")).alias("comm"), kind.alias("kind"))
    asks = e.where("id % 3 = 0").select("host", "pid", "start", "id", F.concat(F.lit("c"), (F.col("pid") % 3).cast("string")).alias("comm"), ((F.col("pid") + 3) % 500).alias("ppid"), (F.col("id") % 2 == 0).alias("forked"))
    return reconcile.described(asks, noted.where("kind = 1"), noted.where("kind = 2"), 43_200.0).select("id", "cmdline", "described_by")


def vanished_antijoin(spark, sf):
    e = _exits(spark, sf).withColumn("last_seen", F.floor(F.col("start") / 86_400).cast("bigint"))
    sweeps = e.select("host", F.col("last_seen").alias("ts")).distinct()
    return reconcile.vanished(e.where("id % 4 = 0"), e.where("id % 4 <> 0"), sweeps, 3600.0).select("host", "id", "last_seen", "noticed")


def _tasks(spark, sf):
    """Turns of conversations as threads; the last one ends its process."""
    s = spans(spark, sf)
    n = s.groupBy("trace").agg(F.max("span").alias("_n"))
    t = s.join(n, "trace")
    base = F.col("trace") * 100
    figures = {c: F.col("duration_s") * (k + 1) for k, c in enumerate((*threads.SUMS, *threads.PEAKS))}
    return t.select("host", base.alias("tgid"), (base + F.col("span")).alias("pid"), (F.col("start_s") + F.col("duration_s") / 1000).cast("double").alias("at"), F.lit(12).alias("version"), (F.when(F.col("span") == F.col("_n"), 32).otherwise(0) + F.when(F.col("trace") % 3 == 0, 1).otherwise(0)).alias("flag"), F.col("name").alias("comm"), F.lit(1).alias("ppid"), F.lit(1000).alias("uid"), F.lit(1000).alias("gid"), F.lit(0).alias("nice"), F.when(F.col("status") == "error", 256).otherwise(0).alias("exit_status"), (F.col("duration_s") * 1000).alias("elapsed_us"), (F.col("duration_s") * 2000).alias("group_elapsed_us"), *[v.alias(c) for c, v in figures.items()])


def thread_merge(spark, sf):
    m = threads.merge_threads(_tasks(spark, sf))
    return m.select("tgid", "threads", "user_us", "read_bytes", "peak_rss_kb", "comm", "forked", "exit_status", F.round("elapsed_seconds", 6).alias("elapsed_seconds"), F.round("start_epoch", 6).alias("start_epoch"))


def exit_records(spark, sf):
    """Merged threads, beside what was sampled of them, as records."""
    m = threads.merge_threads(_tasks(spark, sf)).withColumn("sampled_user_seconds", F.col("tgid") / 1e5)
    return reconcile.exit_records(m).select("pid", "ts_us", "level", "status", "started", "elapsed_seconds", "cpu_seconds", "cpu_pct", "peak_rss_bytes")


def exit_messages(spark, sf):
    """With the words for durations and sizes, which Python makes."""
    return reconcile.exit_records(threads.merge_threads(_tasks(spark, sf))).select("pid", "message")


def span_from_record(spark, sf):
    r = records(spark, sf).withColumn("start_us", F.col("ts_us"))
    ids = r.select("host", "pid", "start_us", F.substring(F.md5(F.col("pid").cast("string")), 1, 32).alias("trace_id"), F.substring(F.md5(F.col("pid").cast("string")), 1, 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"))
    return reconcile.spans_of(r, ids)


def residual_cpu(spark, sf):
    return reconcile.residual_cpu(records(spark, sf).withColumn("sampled_seconds", F.when(F.col("pid") % 3 > 0, F.col("pid") / 100))).select("pid", F.round("residual_seconds", 6).alias("residual_seconds"))


def started_as(spark, sf):
    r = records(spark, sf)
    line = F.when(F.col("pid") % 4 == 0, "/usr/lib/systemd/systemd-executor --x").otherwise(F.concat(F.lit("run "), F.col("service")))
    return reconcile.started_as(r.select("host", F.col("user").alias("pid"), F.lit(0).alias("start"), F.col("ts_us").alias("at"), line.alias("cmdline")))


def gone_since_sweep(spark, sf):
    """Users of the first half of the month who did nothing in the second."""
    r = records(spark, sf).select("host", "user", F.col("service"), (F.col("ts_us") > 1_706_000_000_000_000).alias("late"))
    return r.where("not late").select("host", "user", "service").distinct().join(r.where("late").select("host", "user", "service"), ["host", "user", "service"], "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        counter_rate, counter_rate_measured, wide_rates, cpu_mode_shares, prefix_rate_sums, unit_delta_totals, group_totals_with_exited, processes_under, physical_totals, gauges, exit_band_join, describe_priority, vanished_antijoin, thread_merge, exit_records, exit_messages, span_from_record, residual_cpu, started_as, gone_since_sweep,
    )
}

_C, _R, _S = with_sql("counters"), with_sql("records"), with_sql("spans")
_RATES = _C + "p AS (SELECT *, lag(counter) OVER w AS b, lag(ts) OVER w AS bt FROM counters WINDOW w AS (PARTITION BY host, subject ORDER BY ts, id)), r AS (SELECT host, subject, ts, counter, (counter - b) / (ts - bt) AS v FROM p WHERE counter >= b AND ts > bt) "
_M = "CASE WHEN abs(v) >= 1000 THEN round(v) ELSE round(v * 1000) / 1000 END + 0.0"
_LINES = "WITH l AS (SELECT l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS l_partkey, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS l_quantity FROM lineitem GROUP BY 1), q AS (SELECT 'c' || (o_custkey % 50) AS host, o_orderkey AS ts, l_partkey, l_suppkey, l_quantity FROM l JOIN orders ON o_orderkey = l_orderkey),\n"
_WIDE = " UNION ALL ".join(f"SELECT host, ts, '{m}' AS metric, (({c} - lag({c}) OVER w) / (ts - lag(ts) OVER w)) * {k} AS v, {c} >= lag({c}) OVER w AS up FROM q WINDOW w AS (PARTITION BY host ORDER BY ts)" for c, m, k in (("l_partkey", "parts", "1.0"), ("l_suppkey", "suppliers", "1.0"), ("l_quantity", "quantity", "512.0")))
_COLS = ["l_partkey", "l_suppkey", "l_quantity"]
_MODES_SQL = ", ".join(f"{_COLS[i % 3]} * {i + 1} % 10007 AS {m}" for i, m in enumerate(MODES))
_SPENT = ", ".join(f"greatest({m} - lag({m}) OVER w, 0) AS {m}" for m in MODES)
_SUM = " + ".join(MODES)
_TASKS = _S + "n AS (SELECT trace, max(span) AS n FROM spans GROUP BY 1), k AS (SELECT s.*, s.span = n.n AS last, trace * 100 AS tgid FROM spans s JOIN n USING (trace)), "
_MERGED = _TASKS + "m AS (SELECT tgid, count(*) AS threads, CAST(sum(duration_s) AS BIGINT) AS d, max(duration_s) AS peak, coalesce(max(name) FILTER (span = 0), max(name) FILTER (last)) AS comm, trace % 3 = 0 AND bool_or(span = 0) AS forked, max(CASE WHEN status = 'error' THEN 256 ELSE 0 END) FILTER (last) AS exit_status, max(start_s + duration_s / 1000) FILTER (last) AS fin, max(duration_s * 2000) FILTER (last) / 1e6 AS el FROM k GROUP BY tgid, trace) "
_E = _R + "e AS (SELECT host, pid % 500 AS pid, ts_us / 1e6 AS start, pid AS id FROM records) "
_NEAR = "(SELECT {a}.id AS id, arg_min({b}, (abs({a}.start - x.start), x.start)) AS v, min(x.start) IS NOT NULL AS there FROM {a} LEFT JOIN {t} x ON x.host = {a}.host AND x.pid = {a}.pid AND abs(x.start - {a}.start) <= {tol} GROUP BY {a}.id)"
ORACLE = {
    "counter_rate": _RATES + "SELECT host, subject, ts, counter, round(v, 9) AS rate FROM r",
    "counter_rate_measured": _RATES + f"SELECT subject, ts, {_M} AS value FROM r",
    "wide_rates": _LINES + f"w AS ({_WIDE}) SELECT host, ts, metric, {_M} AS value FROM w WHERE up",
    "cpu_mode_shares": _LINES + f"c AS (SELECT host, ts, {_MODES_SQL} FROM q), d AS (SELECT host, ts, lag(ts) OVER w AS b, {_SPENT} FROM c WINDOW w AS (PARTITION BY host ORDER BY ts)), t AS (SELECT *, {_SUM} AS total FROM d WHERE b IS NOT NULL) SELECT host, ts, {', '.join(f'round(100.0::DOUBLE * {m} / total, 6) AS {m}' for m in MODES)}, round(greatest(0, 100 - 100.0::DOUBLE * idle / total - 100.0::DOUBLE * iowait / total), 6) AS busy FROM t WHERE total > 0",
    "prefix_rate_sums": _C + "d AS (SELECT host, subject, CAST(floor(ts / 86400) AS BIGINT) AS ts, max(counter) AS v FROM counters WHERE starts_with(subject, 'u1') GROUP BY ALL), p AS (SELECT *, lag(v) OVER w AS b, lag(ts) OVER w AS bt FROM d WINDOW w AS (PARTITION BY host, subject ORDER BY ts)) SELECT host, ts, round(sum((v - b) / (ts - bt)), 9) AS rate FROM p WHERE v >= b GROUP BY host, ts",
    "unit_delta_totals": _C + """d AS (SELECT host, 'unit' || (CAST(substr(subject, 2) AS INTEGER) % 7) AS unit, subject, CAST(floor(ts / 86400) AS BIGINT) AS ts, max(counter) AS v FROM counters GROUP BY ALL),
m AS (SELECT host, ts, lag(ts) OVER (PARTITION BY host ORDER BY ts) AS earlier FROM (SELECT DISTINCT host, ts FROM d)),
p AS (SELECT *, lag(v) OVER w AS b, lag(ts) OVER w AS bt FROM d WINDOW w AS (PARTITION BY host, subject ORDER BY ts))
SELECT host, unit, ts, CAST(sum(greatest(v - CASE WHEN bt = earlier THEN b ELSE 0 END, 0)) AS BIGINT) AS usage FROM p JOIN m USING (host, ts) WHERE earlier IS NOT NULL GROUP BY host, unit, ts""",
    "group_totals_with_exited": _R + "x AS (SELECT 1) SELECT service, count(*) FILTER (status IN ('0', '1')) AS n_live, round(sum(CASE WHEN status IN ('0', '1') THEN cpu_seconds ELSE cpu_seconds / 2 END), 4) AS cpu_seconds FROM records GROUP BY service",
    "processes_under": "WITH g AS (SELECT '/r' || n_regionkey || '.slice/n' || n_nationkey || '.service' AS path, n_nationkey AS n, NULL AS r FROM nation UNION ALL SELECT '/r' || r_regionkey || '.slice', NULL, r_regionkey FROM region) SELECT path, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = g.n OR n_regionkey = g.r) AS processes FROM g",
    "physical_totals": "SELECT p_partkey % 10 AS host, CAST(sum(p_partkey) AS BIGINT) AS reads FROM part WHERE p_partkey % 5 >= 2 GROUP BY 1",
    "gauges": """WITH l AS (SELECT l_orderkey, max(l_partkey) AS a, min(l_partkey) AS b, max(l_suppkey) AS c, min(l_suppkey) AS d, l_orderkey % 10 AS s FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, CASE WHEN s > 0 THEN (a - b) / s END AS v, CASE WHEN c * s > 0 THEN 100.0::DOUBLE * (c * s - d) / (c * s) ELSE 0 END AS swap FROM l)
SELECT l_orderkey, round(v, 10) AS rate, CASE WHEN c > 0 THEN round(100.0::DOUBLE * d / c, 10) END AS pct, CASE WHEN v IS NULL THEN 100.0 ELSE round(least(v / 10, 100), 10) END AS util, round(v / 1000, 10) AS queue, round(CASE WHEN c > d THEN (a - b) / (c - d) ELSE 0 END, 10) AS await, CASE WHEN s > 0 THEN round(least(greatest(CASE WHEN l_orderkey % 3 = 0 THEN b - a ELSE a - b END, 0) / s / 10000, 100), 10) END AS stall, CASE WHEN s > 0 AND (l_orderkey % 3 > 0 OR a = b) THEN round((a - b) / s / 10000, 10) END AS stall_rate, round(v / 1e6, 10) AS watts, round(swap, 10) AS swap, CASE WHEN c + d > 0 THEN round(100.0::DOUBLE * a / (c + d), 10) END AS committed, round(CASE WHEN a > 0 THEN 100.0::DOUBLE * (a - d) / a END, 10) AS disk, (a // 30 + 1) * 30 AS tick FROM r""",
    "exit_band_join": _E + ", a AS (SELECT * FROM e WHERE id % 2 = 0), t AS (SELECT * FROM e WHERE id % 2 = 1) SELECT id, v AS near_id FROM " + _NEAR.format(a="a", t="t", b="x.id", tol="86400"),
    "describe_priority": _E + ", o AS (SELECT host, pid, start, id, CASE WHEN id % 5 > 0 THEN 'run ' || id END AS cmdline, 'c' || (pid % 3) AS comm FROM e), a AS (SELECT * FROM e WHERE id % 3 = 0), s AS (SELECT * FROM o WHERE id % 3 = 1), t AS (SELECT * FROM o WHERE id % 3 = 2), "
    + "p AS (SELECT a.id, arg_max({'c': s.cmdline}, s.start) AS st FROM a JOIN s ON s.host = a.host AND s.pid = (a.pid + 3) % 500 AND s.comm = 'c' || (a.pid % 3) AND s.start <= a.start + 43200 GROUP BY a.id), p2 AS (SELECT a.id, arg_max({'c': t.cmdline, 's': t.start}, t.start) AS st FROM a JOIN t ON t.host = a.host AND t.pid = (a.pid + 3) % 500 AND t.comm = 'c' || (a.pid % 3) AND t.start <= a.start + 43200 GROUP BY a.id), n1 AS " + _NEAR.format(a="a", t="s", b="{'c': x.cmdline}", tol="43200") + ", n2 AS " + _NEAR.format(a="a", t="t", b="{'c': x.cmdline}", tol="43200")
    + ", j AS (SELECT a.id, n1.v.c AS x, n2.v.c AS y, CASE WHEN a.id % 2 = 0 THEN coalesce(p.st.c, CASE WHEN p2.st.s >= a.start - 43200 THEN p2.st.c END) END AS z FROM a JOIN n1 USING (id) JOIN n2 USING (id) LEFT JOIN p ON p.id = a.id LEFT JOIN p2 ON p2.id = a.id) SELECT id, coalesce(x, y, z) AS cmdline, CASE WHEN x IS NOT NULL THEN 'sample' WHEN y IS NOT NULL THEN 'exec' WHEN z IS NOT NULL THEN 'parent' END AS described_by FROM j",
    "vanished_antijoin": _E + ", f AS (SELECT *, CAST(floor(start / 86400) AS BIGINT) AS day FROM e), w AS (SELECT host, day, lead(day, 2) OVER (PARTITION BY host ORDER BY day) AS noticed FROM (SELECT DISTINCT host, day FROM f)) SELECT f.host, f.id, f.day AS last_seen, noticed FROM f JOIN w USING (host, day) WHERE f.id % 4 = 0 AND noticed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e x WHERE x.id % 4 <> 0 AND x.host = f.host AND x.pid = f.pid AND abs(x.start - f.start) <= 3600)",
    "thread_merge": _MERGED + "SELECT tgid, threads, d AS user_us, 5 * d AS read_bytes, 16 * peak AS peak_rss_kb, comm, forked, exit_status, round(el, 6) AS elapsed_seconds, round(fin - el, 6) AS start_epoch FROM m".replace("5 * d AS read_bytes", f"{threads.SUMS.index('read_bytes') + 1} * d AS read_bytes").replace("16 * peak", f"{len(threads.SUMS) + 1} * peak"),
    "exit_records": _MERGED + f", c AS (SELECT *, greatest(d / 1e6, tgid / 1e5) + 2 * d / 1e6 AS cpu FROM m) SELECT tgid AS pid, CAST(trunc(fin * 1e6) AS BIGINT) AS ts_us, CASE WHEN exit_status = 0 THEN 'info' ELSE 'notice' END AS level, CAST(exit_status // 256 AS VARCHAR) AS status, round((fin - el) * 1e6) / 1e6 AS started, round(el * 1e6) / 1e6 AS elapsed_seconds, round(cpu * 1e6) / 1e6 AS cpu_seconds, CASE WHEN el > 0 THEN round(1000.0::DOUBLE * cpu / el) / 10 END AS cpu_pct, {len(threads.SUMS) + 1} * peak * 1024 AS peak_rss_bytes FROM c",
    "span_from_record": _R + "x AS (SELECT 1) SELECT md5(CAST(pid AS VARCHAR)) AS trace_id, substr(md5(CAST(pid AS VARCHAR)), 1, 16) AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, service AS name, host || '/' || unit AS service, unit, CASE status WHEN '0' THEN 'ok' WHEN 'unknown' THEN 'unset' ELSE 'error' END AS status, CASE WHEN status IN ('0', 'unknown') THEN '' WHEN status = '1' THEN 'exited 1' ELSE 'killed by ' || status END AS ending, ts_us * 1000 AS start_ns, CAST(round(elapsed_seconds * 1e9) AS BIGINT) AS duration_ns FROM records",
    "residual_cpu": _R + "x AS (SELECT 1) SELECT pid, round(greatest(cpu_seconds - CASE WHEN pid % 3 > 0 THEN pid / 100 ELSE 0 END, 0), 6) AS residual_seconds FROM records",
    "started_as": _R + "l AS (SELECT host, usr AS pid, 0 AS start, ts_us, CASE WHEN pid % 4 = 0 THEN '/usr/lib/systemd/systemd-executor --x' ELSE 'run ' || service END AS line, pid % 4 > 0 AS real FROM records), g AS (SELECT host, pid, start, arg_max(line, ts_us) AS cmdline, arg_min(line, ts_us) FILTER (real) AS f FROM l GROUP BY ALL) SELECT host, pid, start, cmdline, CASE WHEN f <> cmdline THEN f END AS started_as FROM g",
    "gone_since_sweep": _R + "x AS (SELECT 1) SELECT DISTINCT host, usr AS \"user\", service FROM records r WHERE ts_us <= 1706000000000000 AND NOT EXISTS (SELECT 1 FROM records q WHERE q.ts_us > 1706000000000000 AND q.host = r.host AND q.usr = r.usr AND q.service = r.service)",
}
