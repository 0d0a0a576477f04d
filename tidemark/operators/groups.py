"""Control groups as captures show them: which are read, and the gauges of the units that they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite, percent
from ..functions.units import kind, normalize, unit_kind, unit_of
from ..sources.shared import cut
from .derive import ancestors, risen

#: What is counted up: over an interval its rise is a gauge.
COUNTERS = ("usage_usec", "user_usec", "system_usec", "throttled_usec", "oom_kills", "cpu_stalled", "memory_stalled", "io_stalled", "read_bytes", "write_bytes")
LEVELS = ("memory", "swap", "anon", "file")


def _files(captures: DataFrame) -> DataFrame:
    """host, ts, path (of the group), _file, content; io.stat by lines."""
    # a name after the last "/", and a second one before it
    whole = F.col("path").startswith("/") & ~F.col("path").endswith("/") & (F.locate("/", F.col("path"), 2) > 0)
    named = captures.where(whole).select("host", "ts", _above(F.col("path")).alias("path"), F.substring_index("path", "/", -1).alias("_file"), "content")
    lines = F.when(F.col("_file") == "io.stat", F.split("content", "\n")).otherwise(F.array("content"))
    return named.select("host", "ts", "path", "_file", F.explode_outer(lines).alias("content"))


def _root(path) -> Column:
    """The nearest service or scope to the root at or above a group, which is what is walked together; in slices and elsewhere the group itself."""
    # each is found after the path at the latest
    ends = [F.instr(F.concat(path, F.lit(f"/{k}/")), f"{k}/") + len(k) - 1 for k in (".service", ".scope")]
    return F.substr(path, F.lit(1), F.least(*ends))


def _slice(path) -> Column:
    """What a group's tree lies in: above its service or scope, or where there is none the group itself."""
    root = _root(path)
    return F.when(kind(root).isin("service", "scope"), _above(root)).otherwise(path)


def _above(path) -> Column:
    """All but the last part of a path; by bytes, which are not counted one by one."""
    return F.substr(path.cast("binary"), F.lit(1), F.octet_length(path) - F.octet_length(F.substring_index(path, "/", -1)) - 1).cast("string")


def _groups(files: DataFrame, figures: dict[str, dict[str, Column]]) -> DataFrame:
    """host, ts, path, tasks and ``figures`` of each group, from one pass over the files.

    Figures are structs: row by row they are one column each, and the methods made for what follows stay short enough to be compiled.
    """
    each = files.groupBy("host", "ts", "path").agg(_number("pids.current").alias("tasks"), *[c.alias(k) for of in figures.values() for k, c in of.items()])
    return each.select("host", "ts", "path", "tasks", *[F.struct(*of).alias(name) for name, of in figures.items()])


def _walk(groups: DataFrame, then=lambda groups: groups) -> DataFrame:
    """A table of the groups that a walk from the root reads, as ``then`` makes them; with _gone, slices that are themselves empty.

    pids.current counts what is in a group and below it. So where a unit's is 0, the whole subtree is left out; where it was not read, that says nothing of the groups
    below, and the walk goes on. What lies in one service or scope is put in the order of a walk, in which a subtree is without gaps: one sort, and no group is
    joined with those above it. Slices, which are few, are looked at by themselves; below them are too many groups for a key.
    A group without a host or a moment is in no known tree, and is kept.

    ``then`` gets the groups dealt by _key, so that it can look at a group's other readings without another exchange.
    """
    placed = groups.withColumn("_key", F.xxhash64("host", _root(F.col("path")))).repartition("_key").withColumn("_place", F.replace("path", F.lit("/"), F.lit("\0")))
    empty = (F.col("tasks") == 0) & kind("path").isNotNull() & F.col("host").isNotNull() & F.col("ts").isNotNull()
    # a subtree's names are between its group's and the group's with the character after the one that stands for "/"; an end that is further on is of a group above
    ends = F.max(F.when(empty, F.concat("_place", F.lit("\1")))).over(Window.partitionBy("_key", "host", "ts").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    left = placed.withColumn("_end", ends).withColumn("_gone", F.when(empty, _slice(F.col("path")) == F.col("path")).otherwise(False)).where("_end is null or _place >= _end or _gone").drop("_place", "_end")
    return cut(then(left).drop("_key"))


def _without_empty(groups: DataFrame) -> tuple[DataFrame, bool]:
    """A walk's table without what lies in empty slices, and whether there were any; as a rule none is empty, which one look at the table says."""
    none = groups.where("_gone").select("host", "ts", F.col("path").alias("_above"))
    if none.isEmpty():
        return groups, False
    placed = groups.withColumn("_slice", _slice(F.col("path")))
    slices = placed.select("host", "ts", "_slice").distinct()
    # as a table: its size is known before it is joined
    below = cut(slices.withColumn("_above", F.explode(ancestors("_slice"))).join(none, ["host", "ts", "_above"], "left_semi").select("host", "ts", "_slice").distinct())
    return placed.join(below, ["host", "ts", "_slice"], "left_anti"), True


def walked(captures: DataFrame) -> DataFrame:
    """host, ts, path, tasks of the groups that a walk from the root reads."""
    return _without_empty(_walk(_groups(_files(captures), {})))[0].select("host", "ts", "path", "tasks")


def _number(file: str) -> Column:
    return F.max(F.when(F.col("_file") == file, F.trim("content").try_cast("bigint")))


def _found(file: str, pattern: str) -> Column:
    """The number in the group; what is not there is null before it is cast."""
    return F.max(F.when(F.col("_file") == file, F.nullif(F.regexp_extract("content", pattern, 1), F.lit("")).try_cast("bigint")))


def _figures() -> dict[str, dict[str, Column]]:
    """What the files of a group say: levels, counters and stalls; null where a file was not read (CPU time 0), throttling also where the group has no limit."""
    of = lambda file, key: _found(file, rf"(?m)^{key}\s+([0-9]+)")
    io = F.when((F.col("_file") == "io.stat") & (F.trim("content") != ""), F.trim("content").rlike("^(253|9):"))
    # bytes of physical devices, or of stacked ones only where there are no others
    of_io = lambda key, stacked: F.sum(F.when(io == stacked, F.coalesce(F.nullif(F.regexp_extract("content", rf"\b{key}=([0-9]+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))))
    said = {
        "memory": _number("memory.current"), "swap": _number("memory.swap.current"), "anon": of("memory.stat", "anon"), "file": of("memory.stat", "file"), **{k: F.coalesce(of("cpu.stat", k), F.lit(0)) for k in ("usage_usec", "user_usec", "system_usec")},
        "throttled_usec": F.when(of("cpu.stat", "nr_periods") > 0, of("cpu.stat", "throttled_usec")), "oom_kills": of("memory.events", "oom_kill"), **{f"{r}_stalled": _found(f"{r}.pressure", r"(?m)^some .*\btotal=([0-9]+)") for r in ("cpu", "memory", "io")},
        **{f"{name}_bytes": F.coalesce(of_io(key, False), of_io(key, True)) for name, key in (("read", "rbytes"), ("write", "wbytes"))},
    }
    return {"levels": {k: said[k] for k in LEVELS}, "counters": {k: said[k] for k in COUNTERS}}


def _before(groups: DataFrame, *keys: str) -> DataFrame:
    """With the moment and the counters of a group's reading before, as _at and _before."""
    w = Window.partitionBy(*keys, "host", "path", "_gone").orderBy("ts")
    return groups.withColumns({"_at": F.lag("ts").over(w), "_before": F.lag("counters").over(w)})


def unit_gauges(captures: DataFrame, users: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """Samples (name, host, labels, ts, value) of each unit, of all its groups together: levels of each reading, and shares and rates since the host's reading before.

    A group's tasks are counted where it is a unit and says them. A group that was not there before has used all of its counters in the interval. Instances stall side by side; together for no more than all of the time.
    """

    def named(groups):
        units = unit_of(groups, users, containers)
        return _before(units.withColumn("unit", F.coalesce("unit", normalize(F.substring_index("path", "/", -1)))), "_key")

    # the group itself, if it is a unit: what lies below in no unit of its own is not reported, nor does it hide others
    # as one condition, for which tasks must be known: taken apart, the name would be looked at for each file
    units = _groups(_files(captures), _figures()).where(F.when(F.col("tasks").isNotNull(), kind("path")).isNotNull())
    # read, walked, named and set beside the reading before once, in a table
    groups, fewer = _without_empty(_walk(units, named))
    if fewer:  # the one before may be among those that are gone
        groups = _before(groups)
    groups = groups.where("unit <> ''")
    # a row for each reading of a host, and as a table of known size
    moments = groups.select("host", "ts").distinct().withColumn("_earlier", F.lag("ts").over(Window.partitionBy("host").orderBy("ts"))).where("_earlier is not null")
    timed = groups.join(cut(moments), ["host", "ts"], "left")
    used = {c: F.sum(F.when(F.col("_earlier").isNotNull(), risen(f"counters.{c}", f"_before.{c}", F.col("_at") == F.col("_earlier")))).alias(c) for c in COUNTERS}
    each = timed.groupBy("host", "unit", "ts").agg(F.sum("tasks").alias("tasks"), *[F.sum(f"levels.{c}").alias(c) for c in LEVELS], *used.values(), (F.col("ts") - F.max("_earlier")).cast("double").alias("_s"))
    share = lambda c: percent(F.col(c) / 1e6, "_s")
    gauges = {
        "unit_tasks": F.col("tasks"), "unit_memory_bytes": F.col("memory"), "unit_memory_anon_bytes": F.col("anon"), "unit_memory_file_bytes": F.col("file"), "unit_swap_bytes": F.col("swap"),
        "unit_cpu_pct": share("usage_usec"), "unit_cpu_user_pct": share("user_usec"), "unit_cpu_system_pct": share("system_usec"), "unit_cpu_throttled_pct": share("throttled_usec"), "unit_io_read_bytes_per_sec": F.col("read_bytes") / F.col("_s"),
        "unit_io_write_bytes_per_sec": F.col("write_bytes") / F.col("_s"), "unit_oom_kills_per_sec": F.col("oom_kills") / F.col("_s"), **{f"unit_pressure_{r}_pct": F.when(F.col(f"{r}_stalled").isNotNull(), F.least(share(f"{r}_stalled"), F.lit(100.0))) for r in ("cpu", "memory", "io")},
    }
    shown = each.select("host", "unit", unit_kind("unit").alias("_kind"), "ts", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in gauges.items()])).alias("_g"))
    return shown.where(finite("_g.value")).select("_g.name", "host", F.create_map(F.lit("unit"), F.col("unit"), F.lit("kind"), F.col("_kind")).alias("labels"), "ts", "_g.value")
