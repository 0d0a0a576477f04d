"""Queries on samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import heat, measured
from ..operators import read
from ..sources.model import samples, with_sql

#: A moment in the events, and the day around it.
AT, DAY = 1_704_700_000, 86_400
T0, T1 = AT - 5 * DAY, AT + 5 * DAY
COLUMNS = {"cpu": "view", "rss": "click", "read": "purchase", "write": "signup", "threads": "error"}

_LAST = "max_by(value, (ts, id))"


def _last_sql(column: str, metric: str) -> str:
    return f"arg_max(value, (ts, id)) FILTER (name = '{metric}') AS {column}"


def latest_per_series(spark, sf):
    return read.latest(samples(spark, sf), AT, DAY, keys=("proc",))


def latest_within_label_filter(spark, sf):
    return read.latest(samples(spark, sf), AT, 3 * DAY, ["view", "click"], keys=("user",), unit="u3.service")


def latest_by_label_set(spark, sf):
    return read.latest(samples(spark, sf), AT, DAY, "error")


def top_by_cpu(spark, sf):
    return read.top(_by_user(samples(spark, sf)), AT, 5 * DAY, "cpu", 20, columns=COLUMNS)


def top_by_rss(spark, sf):
    return read.top(_by_user(samples(spark, sf)), AT, 5 * DAY, "rss", 20, columns=COLUMNS)


def top_by_io(spark, sf):
    return read.top(_by_user(samples(spark, sf)), AT, 5 * DAY, "io", 20, host="h1", columns=COLUMNS)


def _by_user(df):
    """All metrics of a user are of one process."""
    return df.withColumn("labels", F.create_map(F.lit("proc"), F.col("labels")["user"]))


def _top_sql(order: str, host: str = "") -> str:
    every = ", ".join(_last_sql(c, m) for c, m in COLUMNS.items())
    return with_sql("samples") + f"w AS (SELECT host, usr AS proc, {every} FROM samples WHERE ts BETWEEN {AT - 5 * DAY} AND {AT} {host} GROUP BY ALL) SELECT * FROM w WHERE cpu IS NOT NULL ORDER BY {order} DESC, host, proc LIMIT 20"


def snapshot_units(spark, sf):
    return read.snapshot_units(samples(spark, sf), AT, DAY, {"tasks": "error", "cpu": "view", "memory": "click", "read": "purchase"})


def snapshot_host(spark, sf):
    return read.snapshot_host(samples(spark, sf), AT, DAY, {"net": ("view", "unit", "u0.service"), "power": ("click", "", "")}, {"temp": ("error", "", "")})


def unlabelled_and_whole_host(spark, sf):
    rows = samples(spark, sf).withColumn("labels", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("host"), F.col("host"))).when(F.col("id") % 3 == 1, F.create_map(F.lit("cpu"), F.lit("all"))).otherwise(F.create_map(F.lit("cpu"), F.lit("0"))))
    return read.unlabelled(rows).agg(F.count("*").alias("unlabelled")).crossJoin(read.whole_host(rows).agg(F.count("*").alias("whole_host")))


def order_nulls_last(spark, sf):
    rows = read.wide(samples(spark, sf), AT, DAY, {"memory": "click", "cpu": "view"}, "user")
    return read.order_nulls_last(rows, "memory", "user").limit(60)


def series_history(spark, sf):
    return read.history(samples(spark, sf), "view", T0, T1, unit="u3.service").select("host", "ts", "value", "id")


def store_range(spark, sf):
    return read.store_range(samples(spark, sf))


def sample_spacing(spark, sf):
    return read.spacing(samples(spark, sf), AT, 7200, 5 * DAY, ("name", "host"))


def rollup_5m_max(spark, sf):
    return read.rollup(samples(spark, sf), 300).select("name", "host", "bucket", "highest")


def rollup_1h_all_aggs(spark, sf):
    r = read.rollup(samples(spark, sf), 3600, ("name", "labels.unit"))
    return r.select("name", "unit", "bucket", "highest", "lowest", F.round("mean", 6).alias("mean"), F.round("total", 6).alias("total"), "n")


def timeline_rollup_plus_tail(spark, sf):
    one = read.pick(samples(spark, sf), "view", host="h1")
    kept = read.rollup(read.pick(one, None, T0, AT), 3600, ()).where(F.col("bucket") < AT - 3600).select("bucket", "highest")
    return read.timeline(one, kept, T0, T1, 3600)


def column_downsample(spark, sf):
    return read.columns(read.pick(samples(spark, sf), host="h2"), AT, 2 * DAY, 96, 900)


def every_nth_tick(spark, sf):
    return read.every_nth(read.pick(samples(spark, sf), None, AT - DAY, AT), 5).select("id", "name", "ts", "value")


def series_peak(spark, sf):
    return read.peak(samples(spark, sf), "view", T0, T1)


def measured_values(spark, sf):
    return samples(spark, sf).select("id", measured(F.col("value") * 7 / 3).alias("measured"), heat(F.col("value"), "cpu").alias("heat"))


def sample_asof_backward(spark, sf):
    """Each error with the last view of its user at most a day before."""
    s = samples(spark, sf).withColumn("user", F.col("labels")["user"])
    asks = s.where("name = 'error'").select("id", "user", "ts")
    return read.as_of(asks, s.where("name = 'view'"), ["user"], "ts", "ts", "value", DAY)


def running_peak(spark, sf):
    s = samples(spark, sf).where("name = 'view'").select(F.col("labels")["user"].alias("user"), "ts", "id", "value")
    return read.running_peak(s, ("user",), ("ts", "id"), "value")


QUERIES = {
    f.__name__: f
    for f in (
        latest_per_series, latest_within_label_filter, latest_by_label_set, top_by_cpu, top_by_rss, top_by_io, snapshot_units, snapshot_host, unlabelled_and_whole_host, order_nulls_last, series_history, store_range, sample_spacing, rollup_5m_max, rollup_1h_all_aggs,
        timeline_rollup_plus_tail, column_downsample, every_nth_tick, series_peak, measured_values, sample_asof_backward, running_peak,
    )
}

_S = with_sql("samples")
_near = f"ts BETWEEN {AT - DAY} AND {AT}"
_MEASURED = "CASE WHEN abs(v) >= 1000 THEN round(v) ELSE round(v * 1000) / 1000 END + 0.0"
_each = 2 * DAY / 96
ORACLE = {
    "latest_per_series": _S + f"x AS (SELECT 1) SELECT name, host, proc, max(ts) AS last_ts, arg_max(value, (ts, id)) AS value FROM samples WHERE {_near} GROUP BY name, host, proc",
    "latest_within_label_filter": _S + f"x AS (SELECT 1) SELECT name, host, usr AS \"user\", max(ts) AS last_ts, arg_max(value, (ts, id)) AS value FROM samples WHERE ts BETWEEN {AT - 3 * DAY} AND {AT} AND name IN ('view', 'click') AND unit = 'u3.service' GROUP BY name, host, usr",
    "latest_by_label_set": _S + f"x AS (SELECT 1) SELECT name, host, 'proc=' || proc || ',unit=' || unit || ',user=' || usr AS series, max(ts) AS last_ts, arg_max(value, (ts, id)) AS value FROM samples WHERE {_near} AND name = 'error' GROUP BY ALL",
    "top_by_cpu": _top_sql("cpu"),
    "top_by_rss": _top_sql("coalesce(rss, 0)"),
    "top_by_io": _top_sql("coalesce(read, 0) + coalesce(write, 0)", "AND host = 'h1'"),
    "snapshot_units": _S + f"w AS (SELECT host, unit, {_last_sql('tasks', 'error')}, {_last_sql('cpu', 'view')}, {_last_sql('memory', 'click')}, {_last_sql('read', 'purchase')} FROM samples WHERE {_near} GROUP BY ALL) SELECT * FROM w WHERE tasks IS NOT NULL OR cpu IS NOT NULL",
    "snapshot_host": _S + f"l AS (SELECT name, host, proc, unit, arg_max(value, (ts, id)) AS value FROM samples WHERE {_near} AND name IN ('view', 'click', 'error') GROUP BY ALL) SELECT host, sum(value) FILTER (name = 'view' AND unit <> 'u0.service') AS net, sum(value) FILTER (name = 'click') AS power, max(value) FILTER (name = 'error') AS temp FROM l GROUP BY host",
    "unlabelled_and_whole_host": _S + "x AS (SELECT 1) SELECT count(*) FILTER (id % 3 = 0) AS unlabelled, count(*) FILTER (id % 3 <> 2) AS whole_host FROM samples",
    "order_nulls_last": _S + f"w AS (SELECT host, usr AS \"user\", {_last_sql('memory', 'click')}, {_last_sql('cpu', 'view')} FROM samples WHERE {_near} AND name IN ('click', 'view') GROUP BY ALL) SELECT * FROM w ORDER BY memory DESC NULLS LAST, \"user\" LIMIT 60",
    "series_history": _S + f"x AS (SELECT 1) SELECT host, ts, value, id FROM samples WHERE name = 'view' AND unit = 'u3.service' AND ts BETWEEN {T0} AND {T1}",
    "store_range": _S + "x AS (SELECT 1) SELECT min(ts) AS ts_min, max(ts) AS ts_max FROM samples",
    "sample_spacing": _S + f"""g AS (SELECT name, host, ts - lag(ts) OVER w AS gap, lag(ts) OVER w AS before FROM samples WHERE ts BETWEEN {AT - 5 * DAY} AND {AT} WINDOW w AS (PARTITION BY name, host ORDER BY ts, id)),
n AS (SELECT name, host, list_sort(list(gap) FILTER (before >= {AT - 7200})) AS a, list_sort(list(gap)) AS b FROM g WHERE gap > 0 GROUP BY name, host)
SELECT name, host, coalesce(CASE WHEN len(a) >= 2 THEN a[len(a) // 2 + 1] END, CASE WHEN len(b) >= 2 THEN b[len(b) // 2 + 1] END) AS spacing FROM n""",
    "rollup_5m_max": _S + "x AS (SELECT 1) SELECT name, host, ts // 300 * 300 AS bucket, max(value) AS highest FROM samples GROUP BY ALL",
    "rollup_1h_all_aggs": _S + "x AS (SELECT 1) SELECT name, unit, ts // 3600 * 3600 AS bucket, max(value) AS highest, min(value) AS lowest, round(avg(value), 6) AS mean, round(sum(value), 6) AS total, count(value) AS n FROM samples GROUP BY name, unit, bucket",
    "timeline_rollup_plus_tail": _S + f"""o AS (SELECT * FROM samples WHERE name = 'view' AND host = 'h1' AND ts BETWEEN {T0} AND {T1}),
k AS (SELECT ts // 3600 * 3600 AS bucket, max(value) AS highest FROM o WHERE ts <= {AT} GROUP BY 1 HAVING bucket < {AT - 3600} AND bucket >= {T0}),
e AS (SELECT max(bucket) + 3600 AS e FROM k)
SELECT * FROM k UNION ALL SELECT ts // 3600 * 3600 AS bucket, max(value) AS highest FROM o, e WHERE e IS NULL OR ts >= e GROUP BY 1""",
    "column_downsample": _S + f"""p AS (SELECT *, CASE WHEN ts >= {AT - 2 * DAY} THEN least(CAST(floor((ts - {AT - 2 * DAY}) / {_each}) AS INTEGER), 95) ELSE -1 END AS col FROM samples WHERE host = 'h2' AND ts <= {AT}),
c AS (SELECT name, col, max(value) AS highest, max(ts) AS seen, arg_max(value, (ts, id)) AS final FROM p GROUP BY name, col),
g AS (SELECT name, col FROM (SELECT DISTINCT name FROM p), range(-1, 96) r(col)),
s AS (SELECT g.name, g.col, highest, last_value(seen IGNORE NULLS) OVER w AS f, last_value(final IGNORE NULLS) OVER w AS v FROM g LEFT JOIN c ON g.name = c.name AND g.col = c.col WINDOW w AS (PARTITION BY g.name ORDER BY g.col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT name, CAST(col AS INTEGER) AS "column", coalesce(highest, CASE WHEN {AT - 2 * DAY} + col * {_each} - f < 1350 THEN v END) AS value FROM s WHERE col >= 0""",
    "every_nth_tick": _S + f"t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k FROM (SELECT DISTINCT ts FROM samples WHERE {_near})) SELECT id, name, ts, value FROM samples WHERE ts IN (SELECT ts FROM t WHERE k % 5 = 0)",
    "series_peak": _S + f"x AS (SELECT 1) SELECT host, max(value) AS peak FROM samples WHERE name = 'view' AND ts BETWEEN {T0} AND {T1} GROUP BY host",
    "measured_values": _S + f"m AS (SELECT id, value, value * 7 / 3 AS v FROM samples) SELECT id, {_MEASURED} AS measured, CASE WHEN value >= 85 THEN 'hot' WHEN value >= 60 THEN 'warm' ELSE 'calm' END AS heat FROM m",
    "sample_asof_backward": _S + f"""a AS (SELECT id, usr, ts FROM samples WHERE name = 'error'), v AS (SELECT usr, ts, max(value) AS value FROM samples WHERE name = 'view' GROUP BY ALL)
SELECT a.id, a.usr AS "user", a.ts, v.ts AS found_time, v.value AS found FROM a LEFT JOIN v ON v.usr = a.usr AND v.ts = (SELECT max(ts) FROM v x WHERE x.usr = a.usr AND x.ts <= a.ts) AND v.ts >= a.ts - {DAY}""",
    "running_peak": _S + "x AS (SELECT 1) SELECT usr AS \"user\", ts, id, value, max(value) OVER (PARTITION BY usr ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS peak FROM samples WHERE name = 'view'",
}
