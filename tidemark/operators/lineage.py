"""Which process came from which, and which job it was part of.

Identities are digests of host, boot, kind, number and start, so they are the same wherever and whenever they are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import _c

#: Seconds by which two sources may differ on when one process started, and the most ancestors that are followed.
TOLERANCE, DEPTH = 5, 32
MAX_AGE = 3600


def identity(host, boot, kind: str, number, start_us, digits: int = 32) -> Column:
    text = F.concat_ws("|", _c(host), _c(boot), F.lit(kind), _c(number).cast("string"), _c(start_us).cast("string"))
    return F.substring(F.md5(text), 1, digits)


def incarnations(seen: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, pid, start, pgid, parent) evidence -> one row for each process: starts of one pid within the tolerance are the same process.

    The earliest start is its start; of pgid and parent, the first that is known.
    """
    w = Window.partitionBy("host", "pid").orderBy("start")
    new = (F.col("start") - F.lag("start").over(w) > tolerance) | F.lag("start").over(w).isNull()
    life = seen.withColumn("_new", new.cast("int")).withColumn("_life", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("start"))).alias(c)
    return life.groupBy("host", "pid", "_life").agg(F.min("start").alias("start"), known("pgid"), known("parent")).drop("_life")


def _there(rows: DataFrame, all_: DataFrame, key: str, tolerance: float) -> DataFrame:
    """``rows`` with found: the start of the last process with pid = key that began no later than the row did (give or take); no pairs are made."""
    asked = rows.withColumn("_pid", F.col(key)).withColumn("_t", F.col("start") + tolerance).withColumn("_ask", F.lit(1))
    told = all_.select("host", F.col("pid").alias("_pid"), F.col("start").alias("_t"), F.lit(0).alias("_ask"), F.col("start").alias("_start"))
    w = Window.partitionBy("host", "_pid").orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(told, allowMissingColumns=True).withColumn("found", F.last("_start", True).over(w))
    return both.where("_ask = 1").select(*rows.columns, F.when(F.col(key).isNotNull(), F.col("found")).alias("found"))


def place(seen: DataFrame, boot: str = "boot", max_age: float = MAX_AGE, tolerance: float = TOLERANCE, cut=None) -> DataFrame:
    """host, pid, start, pgid, parent, span_id, trace_id, parent_span_id of each process.

    The parent is the last process with its pid that began no later than the child. A process without a known group is in its parent's. It is part
    of its group's trace if it began within max_age of the group's origin: the leader's start, if the leader is known, else the first
    member's. Else it is part of its parent's trace, if that is of the same group and no more than max_age older; else it begins one of its own.

    Groups and traces that come from parents are found by rounds of joins, each of which goes one generation further. ``cut`` (a function of a
    DataFrame) cuts the lineage of the plan between rounds.
    """
    cut = cut or (lambda df: df)
    micros = lambda c: F.round(_c(c) * 1_000_000).cast("bigint")
    all_ = cut(incarnations(seen, tolerance))
    real = F.when((F.col("parent") != 0) & (F.col("parent") != F.col("pid")), F.col("parent"))
    rows = _there(all_.withColumn("_parent", real), all_, "_parent", tolerance).withColumnRenamed("found", "parent_start")
    up = lambda df, *columns: df.select("host", F.col("pid").alias("_parent"), F.col("start").alias("parent_start"), *[F.col(c).alias(f"up_{c}") for c in columns])
    rows = cut(rows)
    for _ in range(DEPTH):  # groups of processes that do not say theirs
        open_ = rows.where("pgid is null and parent_start is not null").join(up(rows.where("pgid is not null"), "pgid"), ["host", "_parent", "parent_start"], "left_semi")
        if open_.isEmpty():
            break
        rows = cut(rows.join(up(rows, "pgid"), ["host", "_parent", "parent_start"], "left").withColumn("pgid", F.coalesce("pgid", "up_pgid")).drop("up_pgid"))
    led = _there(rows, all_, "pgid", tolerance).withColumnRenamed("found", "leader_start")
    origin = F.coalesce("leader_start", F.min("start").over(Window.partitionBy("host", "pgid", "leader_start")))
    rows = led.withColumn("origin", F.when(F.col("pgid").isNotNull(), origin))
    young = F.col("start") - F.col("origin") <= max_age
    own = identity("host", F.lit(boot), "p", "pid", micros("start"))
    trace = F.when(young, identity("host", F.lit(boot), "g", "pgid", micros("origin")))
    rows = rows.withColumn("span_id", identity("host", F.lit(boot), "s", "pid", micros("start"), 16)).withColumn("trace_id", trace)
    asks = F.col("trace_id").isNull() & F.col("up_start").isNotNull() & F.col("pgid").eqNullSafe(F.col("up_pgid")) & (F.col("start") - F.col("up_start") <= max_age)
    with_up = rows.join(up(rows, "start", "pgid", "span_id"), ["host", "_parent", "parent_start"], "left")
    rows = cut(with_up.withColumn("_asks", F.coalesce(asks, F.lit(False))).withColumn("trace_id", F.when(F.col("trace_id").isNull() & ~F.col("_asks"), own).otherwise(F.col("trace_id"))))
    for _ in range(DEPTH):  # traces of daemons' children
        if rows.where("trace_id is null").isEmpty():
            break
        rows = cut(rows.join(up(rows, "trace_id"), ["host", "_parent", "parent_start"], "left").withColumn("trace_id", F.coalesce("trace_id", "up_trace_id")).drop("up_trace_id"))
    rows = rows.withColumn("trace_id", F.coalesce("trace_id", own))
    out = rows.join(up(rows, "trace_id"), ["host", "_parent", "parent_start"], "left")
    return out.select("host", "pid", "start", "pgid", "parent", "span_id", "trace_id", F.when(F.col("up_trace_id") == F.col("trace_id"), F.col("up_span_id")).alias("parent_span_id"))
