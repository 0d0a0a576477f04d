"""Queries over hosts whose processes share numbers and times, and over labels with signs of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import exits, read
from ..sources.model import records, samples, with_sql
from .samples import AT, DAY


def exits_pages_of_hosts(spark, sf):
    """Six pages of 25; of each moment and number there are up to four hosts."""
    rows = records(spark, sf).select(F.expr("ts_us div 86400000000 * 86400000000").alias("ts_us"), (F.col("pid") % 20).alias("pid"), "host").distinct()
    pages, cursor = [], None
    for _ in range(6):
        pages.append(exits.page(rows, cursor, 25))
        last = pages[-1].collect()[-1]
        cursor = (last.ts_us, last.pid, last.host)
    return exits.once(reduce(lambda a, b: a.unionByName(b), pages))


def latest_odd_labels(spark, sf):
    s = samples(spark, sf)
    n = F.substring(F.col("labels")["user"], 2, 9).cast("int")
    one = F.create_map(F.lit("a"), F.concat(F.col("name"), F.lit(",b="), (n % 3).cast("string")))
    two = F.create_map(F.lit("b"), (n % 3).cast("string"), F.lit("a"), F.col("name"))
    return read.latest(s.withColumn("labels", F.when(n % 2 == 0, one).otherwise(two)), AT, DAY)


def host_totals_alike(spark, sf):
    """All users but u1, of whom u10 and so on are others."""
    out = read.snapshot_host(samples(spark, sf), AT, 3 * DAY, {"others": ("view", "user", "u1"), "all_": ("view", "", "")}, {"most": ("click", "user", "u1")})
    return out.select("host", F.round("others", 6).alias("others"), F.round("all_", 6).alias("all_"), "most")


QUERIES = {f.__name__: f for f in (exits_pages_of_hosts, latest_odd_labels, host_totals_alike)}

_S, _R = with_sql("samples"), with_sql("records")
ORACLE = {
    "exits_pages_of_hosts": _R + "x AS (SELECT DISTINCT ts_us // 86400000000 * 86400000000 AS ts_us, pid % 20 AS pid, host FROM records) SELECT * FROM x ORDER BY ts_us DESC, pid DESC, host DESC LIMIT 150",
    "latest_odd_labels": _S + rf"n AS (SELECT *, CAST(substr(usr, 2) AS INTEGER) AS n FROM samples WHERE ts BETWEEN {AT - DAY} AND {AT}), k AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'a=' || name || '\,b\=' || (n % 3) ELSE 'a=' || name || ',b=' || (n % 3) END AS series FROM n) SELECT name, host, series, max(ts) AS last_ts, arg_max(value, (ts, id)) AS value FROM k GROUP BY name, host, series",
    "host_totals_alike": _S + f"l AS (SELECT name, host, proc, usr, arg_max(value, (ts, id)) AS value FROM samples WHERE ts BETWEEN {AT - 3 * DAY} AND {AT} AND name IN ('view', 'click') GROUP BY name, host, proc, usr) SELECT host, round(sum(value) FILTER (name = 'view' AND usr <> 'u1'), 6) AS others, round(sum(value) FILTER (name = 'view'), 6) AS all_, max(value) FILTER (name = 'click' AND usr <> 'u1') AS most FROM l GROUP BY host",
}
