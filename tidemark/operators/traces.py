"""Questions about spans: which jobs ran what, and how processes come from one another.

Spans here are (trace, span, parent, name, unit, status, start_s, duration_s, ...); ``start`` and ``duration`` name the time columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import says
from ..sources.shared import cut


def jobs(spans: DataFrame, since=None, until=None, host=None, text: str = "", fields=("name",), n: int | None = None, start="start_s", duration="duration_s", cpu=None) -> DataFrame:
    """trace, started, ended, processes, failed, cpu, unit, command: traces of two or more spans that started in the reach.

    Of a search, the traces in which any span says it; figures are of all spans in the reach. The newest first; ties by trace, last first.
    """
    out = spans
    if since is not None:
        out = out.where(F.col(start) >= since)
    if until is not None:
        out = out.where(F.col(start) <= until)
    if host is not None:
        out = out.where(F.col("host") == host)
    first = F.struct(start, "span")
    found = out.groupBy("trace").agg(
        F.min(start).alias("started"), F.max(F.col(start) + F.col(duration)).alias("ended"), F.count("*").alias("processes"), F.count_if(F.col("status") == "error").alias("failed"), F.sum(F.col(cpu or duration)).alias("cpu"),
        F.min_by("unit", first).alias("unit"), F.min_by("name", first).alias("command"), F.bool_or(says(text, *fields) if text else F.lit(True)).alias("_wanted"),
    )
    found = found.where("_wanted and processes > 1").drop("_wanted")
    return found if n is None else found.orderBy(F.col("started").desc(), F.col("trace").desc()).limit(n)


def nodes(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """All spans of the given traces, without a bound in time."""
    return spans.join(traces.select("trace").distinct(), "trace", "left_semi")


def trees(spans: DataFrame, least: int = 2, n: int = 5, failed: bool = False, comm=None, unit=None, start="start_s", duration="duration_s") -> DataFrame:
    """The newest traces in which one span meets all conditions, of at least so many spans: trace, matched (its last such start) and the whole trace's figures."""
    wanted = F.lit(True)
    for column, value in (("name", comm), ("unit", unit)):
        if value is not None:
            wanted = wanted & (F.col(column) == value)
    if failed:
        wanted = wanted & (F.col("status") == "error")
    figures = spans.groupBy("trace").agg(
        F.max(F.when(wanted, F.col(start))).alias("matched"), F.count("*").alias("processes"), F.min(start).alias("started"), F.max(F.col(start) + F.col(duration)).alias("ended"),
        F.count_if(F.col("status") == "error").alias("failed"), F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("units"),
    )
    return figures.where(F.col("matched").isNotNull() & (F.col("processes") >= least)).orderBy(F.col("matched").desc(), F.col("trace").desc()).limit(n)


def tree_rows(spans: DataFrame, most: int | None = None, start="start_s") -> DataFrame:
    """Each span with its depth, its place in the order in which its trace's tree is drawn, and whether it is the last of its siblings.

    A root has no parent in its trace. Siblings are in order of start, then id. Of spans with one id in a trace the first to start counts. Trees may have any depth: every
    span jumps to its parent, then to its parent's parent, and so on over twice the way in each step, while numbers of descendants go the same ways upwards; so the rounds, each of two steps and one table in the
    shared folder, are as many as half the depth's binary digits, twice. A span's place is the sum, over itself and those above it, of what is drawn before it under its parent. most: of each trace only so many rows,
    with what is left out in ``more``. Spans in a cycle have no root: that is an error.
    """
    key = ["trace", "span"]
    one = spans.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(start), "parent"))).where("_first = 1").drop("_first")
    ids = one.select("trace", F.col("span").alias("parent"), F.lit(True).alias("_known"))
    known = one.select(*key, "parent", F.col(start).alias("_start")).join(ids, ["trace", "parent"], "left")
    nodes = cut(known.select(*key, "_start", F.when(F.col("_known"), F.col("parent")).alias("_up")))

    def up(rows: DataFrame, **sums: str) -> DataFrame:
        """All jump twice as far; columns of the one that is jumped to are added."""
        far = rows.select("trace", F.col("span").alias("_jump"), F.col("_jump").alias("_next"), *[F.col(c).alias(f"_far_{c}") for c in sums])
        both = rows.join(far, ["trace", "_jump"], "left")
        return both.select(*key, F.col("_next").alias("_jump"), *[(F.col(c) + F.coalesce(f"_far_{c}", F.lit(0))).alias(c) for c in sums], *[c for c in rows.columns if c not in (*key, "_jump", *sums)])

    def down(rows: DataFrame) -> DataFrame:
        """All add their descendants' number, as far as it is known, to that of the span they jump to."""
        told = rows.where("_jump is not null").groupBy("trace", F.col("_jump").alias("span")).agg(F.sum("_size").alias("_more"))
        return rows.join(told, key, "left").withColumn("_size", F.col("_size") + F.coalesce("_more", F.lit(0))).drop("_more")

    def settled(rows: DataFrame, step) -> DataFrame:
        rows, reach, longest = cut(rows), 1, None
        while not rows.where("_jump is not null").isEmpty():
            if longest is None and reach >= 64:
                longest = rows.groupBy("trace").count().agg(F.max("count")).first()[0]
            if longest is not None and reach > longest:
                raise ValueError("spans that are each other's parents: a cycle has no root")
            rows, reach = cut(step(step(rows))), reach * 4
        return rows

    linked = nodes.select(*key, F.col("_up").alias("_jump"), F.when(F.col("_up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("_size"))
    sized = settled(linked, lambda rows: up(down(rows), depth="")).select(*key, "depth", "_size")
    siblings = Window.partitionBy("trace", "_up").orderBy("_start", "span")
    before = F.coalesce(F.sum("_size").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(nodes.join(sized, key).select(*key, F.col("_up").alias("_jump"), "depth", (before + 1).alias("_place"), F.lead("span").over(siblings).isNull().alias("last_sibling")))
    placed = settled(offsets.select(*key, "_jump", "_place"), lambda rows: up(rows, _place="")).select(*key, F.col("_place").cast("int").alias("place"))
    drawn = one.join(offsets.select(*key, F.col("depth").cast("int").alias("depth"), "last_sibling"), key).join(placed, key)
    if most is not None:
        size = nodes.groupBy("trace").agg(F.count("*").alias("_all"))
        drawn = drawn.where(F.col("place") <= most).join(size, "trace").withColumn("more", F.greatest(F.lit(0), F.col("_all") - most)).drop("_all")
    return drawn


def tree_rows_recursive(spark, view: str, start="start_s") -> DataFrame:
    """trace, span, depth by one recursive query, for trees of any depth that the session's limits allow."""
    return spark.sql(f"""
        WITH RECURSIVE k AS (SELECT s.trace, s.span, CASE WHEN p.span IS NOT NULL THEN s.parent END AS up FROM {view} s LEFT JOIN {view} p ON p.trace = s.trace AND p.span = s.parent),
        t(trace, span, depth) AS (SELECT trace, span, 0 FROM k WHERE up IS NULL UNION ALL SELECT k.trace, k.span, t.depth + 1 FROM t JOIN k ON k.trace = t.trace AND k.up = t.span)
        SELECT trace, span, depth FROM t""")


def running_jobs(processes: DataFrame, now: float, max_age: float) -> DataFrame:
    """pgid, started, processes, cpu, unit, command: process groups of two or more, as old as their leader, or as the first that is left of them."""
    leader = F.min(F.when(F.col("pid") == F.col("pgid"), F.col("start_s")))
    first = F.struct("start_s", "pid")
    found = processes.groupBy("pgid").agg(F.coalesce(leader, F.min("start_s")).alias("started"), F.count("*").alias("processes"), F.sum("cpu_seconds").alias("cpu"), F.min_by("unit", first).alias("unit"), F.min_by("comm", first).alias("command"))
    return found.where((F.lit(now) - F.col("started") <= max_age) & (F.col("processes") >= 2))


def jobs_now(processes: DataFrame, spans: DataFrame, now: float, max_age: float, live: bool = True, **reach) -> DataFrame:
    """Jobs that run, the newest first, and then those that have ended, in their order: place, running and what both have. At any other moment than now (``live`` false) only what has ended."""
    ended = jobs(spans, **reach).select(F.lit(False).alias("running"), F.col("trace").cast("string").alias("job"), "started", "processes", "cpu", "unit", "command")
    if live:
        runs = running_jobs(processes, now, max_age).select(F.lit(True).alias("running"), F.col("pgid").cast("string").alias("job"), "started", "processes", "cpu", "unit", "command")
        ended = runs.unionByName(ended)
    order = [F.col("running").desc(), F.col("started").desc(), F.col("job").desc()]
    return ended.orderBy(*order)
