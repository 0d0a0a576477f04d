"""Queries on spans, processes and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage, traces
from ..sources.shared import cut
from ..sources.model import processes, spans, with_sql


def jobs_list(spark, sf):
    return traces.jobs(spans(spark, sf), n=200)


def jobs_search(spark, sf):
    return traces.jobs(spans(spark, sf), since=7200, until=360_000, text="THAT", fields=("name", "command"))


def jobs_of_host(spark, sf):
    return traces.jobs(spans(spark, sf), host="h1")


def trace_nodes(spark, sf):
    some = spans(spark, sf).where("status = 'error' and name = 'user'").select("trace")
    return traces.nodes(spans(spark, sf), some).select("trace", "span", "parent", "name", "start_s", "duration_s")


def trace_tree_rows(spark, sf):
    return traces.tree_rows(spans(spark, sf)).select("trace", "span", "parent", "depth", "place", "last_sibling")


def trace_tree_capped(spark, sf):
    return traces.tree_rows(spans(spark, sf), most=3).select("trace", "span", "place", "more")


def trace_depths_recursive(spark, sf):
    spans(spark, sf).createOrReplaceTempView("tidemark_spans")
    return traces.tree_rows_recursive(spark, "tidemark_spans")


def trees_failed(spark, sf):
    return traces.trees(spans(spark, sf), failed=True, comm="assistant", n=20)


def trees_min_processes(spark, sf):
    return traces.trees(spans(spark, sf), least=6, n=10)


def running_jobs(spark, sf):
    return traces.running_jobs(processes(spark, sf), 3600 * 30, 3600 * 20)


MAX_AGE = 30


def _seen(spark, sf):
    """Groups are known of every process but each fourth, which has its parent's."""
    p = processes(spark, sf)
    return p.select(F.lit("h0").alias("host"), "pid", F.col("start_s").cast("double").alias("start"), F.when(F.col("pid") % 4 != 3, F.col("pgid")).alias("pgid"), F.col("ppid").alias("parent"))


def lineage_trace_ids(spark, sf):
    return lineage.place(_seen(spark, sf), "boot", MAX_AGE, cut=cut).select("pid", "pgid", "span_id", "trace_id", "parent_span_id")


def incarnations(spark, sf):
    """Two accounts of each process, a second apart, are one."""
    a = _seen(spark, sf)
    b = a.select("host", "pid", (F.col("start") + 1).alias("start"), F.lit(None).cast("bigint").alias("pgid"), "parent")
    return lineage.incarnations(a.unionByName(b))


QUERIES = {f.__name__: f for f in (jobs_list, jobs_search, jobs_of_host, trace_nodes, trace_tree_rows, trace_tree_capped, trace_depths_recursive, trees_failed, trees_min_processes, running_jobs, lineage_trace_ids, incarnations)}

_P, _PR = with_sql("spans"), with_sql("processes")
_FIGURES = "trace, min(start_s) AS started, max(start_s + duration_s) AS ended, count(*) AS processes, count(*) FILTER (status = 'error') AS failed, CAST(sum(duration_s) AS BIGINT) AS cpu, arg_min(unit, (start_s, span)) AS unit, arg_min(name, (start_s, span)) AS command"
_TREES = "trace, max(start_s) FILTER ({}) AS matched, count(*) AS processes, min(start_s) AS started, max(start_s + duration_s) AS ended, count(*) FILTER (status = 'error') AS failed, array_to_string(list_sort(list(DISTINCT unit)), ',') AS units"
_FAILED = _TREES.format("name = 'assistant' AND status = 'error'")
_TREE = """k AS (SELECT s.*, CASE WHEN p.span IS NOT NULL THEN s.parent END AS up FROM spans s LEFT JOIN spans p ON p.trace = s.trace AND p.span = s.parent),
r AS (SELECT *, row_number() OVER w AS rank, lead(span) OVER w IS NULL AS last_sibling FROM k WINDOW w AS (PARTITION BY trace, up ORDER BY start_s, span)),
t AS (SELECT trace, span, parent, last_sibling, 0 AS depth, [rank] AS path FROM r WHERE up IS NULL UNION ALL SELECT r.trace, r.span, r.parent, r.last_sibling, t.depth + 1, list_append(t.path, r.rank) FROM t JOIN r ON r.trace = t.trace AND r.up = t.span),
d AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace ORDER BY path) AS INTEGER) AS place, count(*) OVER (PARTITION BY trace) AS n FROM t)
"""
_REC = _P.replace("WITH ", "WITH RECURSIVE ", 1)
_LINEAGE = _PR.replace("WITH ", "WITH RECURSIVE ", 1) + f"""i AS (SELECT pid, CAST(start_s AS DOUBLE) AS start, CASE WHEN pid % 4 <> 3 THEN pgid END AS own, ppid FROM processes),
u AS (SELECT i.*, p.pid AS up, p.start AS up_start FROM i LEFT JOIN i p ON p.pid = i.ppid AND p.start <= i.start + 5 AND i.ppid NOT IN (0, i.pid)),
g AS (SELECT pid, own AS pgid FROM u WHERE own IS NOT NULL OR up IS NULL UNION ALL SELECT u.pid, g.pgid FROM u JOIN g ON u.up = g.pid WHERE u.own IS NULL),
h AS (SELECT u.*, g.pgid FROM u JOIN g USING (pid)),
l AS (SELECT h.*, x.start AS leader FROM h LEFT JOIN i x ON x.pid = h.pgid AND x.start <= h.start + 5),
o AS (SELECT *, coalesce(leader, min(start) OVER (PARTITION BY pgid, leader)) AS origin FROM l),
z AS (SELECT o.*, substr(md5('h0|boot|s|' || pid || '|' || CAST(round(start * 1000000) AS BIGINT)), 1, 16) AS span_id, substr(md5('h0|boot|p|' || pid || '|' || CAST(round(start * 1000000) AS BIGINT)), 1, 32) AS mine,
  CASE WHEN pgid IS NOT NULL AND start - origin <= {MAX_AGE} THEN substr(md5('h0|boot|g|' || pgid || '|' || CAST(round(origin * 1000000) AS BIGINT)), 1, 32) END AS grp FROM o),
y AS (SELECT z.*, p.pgid AS up_pgid, p.span_id AS up_span, z.grp IS NULL AND z.up IS NOT NULL AND z.pgid IS NOT DISTINCT FROM p.pgid AND z.start - z.up_start <= {MAX_AGE} AS asks FROM z LEFT JOIN z p ON p.pid = z.up),
t AS (SELECT pid, coalesce(grp, mine) AS trace_id FROM y WHERE NOT coalesce(asks, false) UNION ALL SELECT y.pid, t.trace_id FROM y JOIN t ON y.up = t.pid WHERE y.asks)
SELECT y.pid, y.pgid, y.span_id, t.trace_id, CASE WHEN q.trace_id = t.trace_id THEN y.up_span END AS parent_span_id FROM y JOIN t USING (pid) LEFT JOIN t q ON q.pid = y.up"""
ORACLE = {
    "jobs_list": _P + f"j AS (SELECT {_FIGURES} FROM spans GROUP BY trace HAVING count(*) > 1) SELECT * FROM j ORDER BY started DESC, trace DESC LIMIT 200",
    "jobs_search": _P + f"j AS (SELECT {_FIGURES} FROM spans WHERE start_s BETWEEN 7200 AND 360000 GROUP BY trace HAVING count(*) > 1 AND bool_or(contains(lower(name), 'that') OR contains(lower(command), 'that'))) SELECT * FROM j",
    "jobs_of_host": _P + f"j AS (SELECT {_FIGURES} FROM spans WHERE host = 'h1' GROUP BY trace HAVING count(*) > 1) SELECT * FROM j",
    "trace_nodes": _P + "w AS (SELECT DISTINCT trace FROM spans WHERE status = 'error' AND name = 'user') SELECT trace, span, parent, name, start_s, duration_s FROM spans SEMI JOIN w USING (trace)",
    "trace_tree_rows": _REC + _TREE + "SELECT trace, span, parent, depth, place, last_sibling FROM d",
    "trace_tree_capped": _REC + _TREE + "SELECT trace, span, place, greatest(0, n - 3) AS more FROM d WHERE place <= 3",
    "trace_depths_recursive": _REC + _TREE + "SELECT trace, span, depth FROM d",
    "trees_failed": _P + f"f AS (SELECT {_FAILED} FROM spans GROUP BY trace) SELECT * FROM f WHERE matched IS NOT NULL AND processes >= 2 ORDER BY matched DESC, trace DESC LIMIT 20",
    "trees_min_processes": _P + f"f AS (SELECT {_TREES.format('true')} FROM spans GROUP BY trace) SELECT * FROM f WHERE processes >= 6 ORDER BY matched DESC, trace DESC LIMIT 10",
    "running_jobs": _PR + f"j AS (SELECT pgid, coalesce(min(start_s) FILTER (pid = pgid), min(start_s)) AS started, count(*) AS processes, sum(cpu_seconds) AS cpu, arg_min(unit, (start_s, pid)) AS unit, arg_min(comm, (start_s, pid)) AS command FROM processes GROUP BY pgid) SELECT * FROM j WHERE {3600 * 30} - started <= {3600 * 20} AND processes >= 2",
    "lineage_trace_ids": _LINEAGE,
    "incarnations": _PR + "x AS (SELECT 1) SELECT 'h0' AS host, pid, CAST(start_s AS DOUBLE) AS start, CASE WHEN pid % 4 <> 3 THEN pgid END AS pgid, ppid AS parent FROM processes",
}
