"""From counter readings to gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MODES, _c, cpu_shares, finite, measured, rate, saturating


def previous(readings: DataFrame, by, order, columns) -> DataFrame:
    """Each reading with the one before it of its subject, as before_<column>; a subject's first has nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    return readings.withColumns({f"before_{c}": F.lag(c).over(w) for c in columns})


def rates(readings: DataFrame, by=("host", "subject"), time: str = "ts", counter: str = "counter", tie: str | None = None) -> DataFrame:
    """With ``rate``, per second; no row for a subject's first reading, nor where the counter went back or no time passed."""
    with_before = previous(readings, by, [time, *([tie] if tie else [])], [time, counter])
    out = with_before.withColumn("rate", rate(counter, f"before_{counter}", F.col(time) - F.col(f"before_{time}")))
    return out.where("rate is not null").drop(f"before_{time}", f"before_{counter}")


def wide_rates(readings: DataFrame, by, time: str, counters: dict[str, str], scale: dict[str, float] | None = None) -> DataFrame:
    """by, time, metric, value: many counters of one reading at once, by one window; ``counters`` is column -> metric."""
    with_before = previous(readings, by, [time], [time, *counters])
    seconds = F.col(time) - F.col(f"before_{time}")
    pairs = [F.struct(F.lit(m).alias("metric"), measured(rate(c, f"before_{c}", seconds) * (scale or {}).get(c, 1.0)).alias("value")) for c, m in counters.items()]
    return with_before.select(*by, time, F.explode(F.array(*pairs)).alias("_x")).select(*by, time, "_x.metric", "_x.value").where(finite("value"))


def cpu_modes(readings: DataFrame, by=("host", "cpu"), time: str = "ts") -> DataFrame:
    """by, time and a column for each mode's percent of the interval, and busy. Counters that go back count 0."""
    with_before = previous(readings, by, [time], [time, *MODES]).where(F.col(f"before_{time}").isNotNull())
    shares = cpu_shares({m: F.col(m) for m in MODES}, {m: F.col(f"before_{m}") for m in MODES})
    return with_before.select(*by, time, *[v.alias(k) for k, v in shares.items()]).where("busy is not null")


def prefix_rates(readings: DataFrame, prefix: str, by=("host",), time: str = "ts", key: str = "key", value: str = "value") -> DataFrame:
    """by, time, rate: the sum of the rates of all counters whose name begins so; those that went back are left out, and no row if all did."""
    return rates(readings.where(F.col(key).startswith(prefix)), (*by, key), time, value).groupBy(*by, time).agg(F.sum("rate").alias("rate"))


def risen(counter: str, before: str, there) -> Column:
    """What a group's counter rose by since the reading before: all of it where the group was not there; null where it was not read."""
    return F.when(F.col(counter).isNotNull(), saturating(counter, F.when(there, F.coalesce(F.col(before), F.lit(0))).otherwise(F.lit(0))))


def unit_deltas(readings: DataFrame, by=("host", "unit"), group: str = "path", time: str = "ts", columns=("usage",)) -> DataFrame:
    """by, time and for each counter what all control groups of a unit used in the interval.

    A group that was not there at the reading before counts all it has used; a counter that went back counts 0; the first reading of all is no interval.
    What no group has read stays null.
    """
    moments = readings.select(*[b for b in by if b == "host"], time).distinct()
    earlier = moments.withColumn("_earlier", F.lag(time).over(Window.partitionBy(*[b for b in by if b == "host"]).orderBy(time)))
    w = Window.partitionBy("host", group).orderBy(time)
    both = readings.withColumn("_at", F.lag(time).over(w)).withColumns({f"_b_{c}": F.lag(c).over(w) for c in columns}).join(earlier, ["host", time])
    used = [F.sum(risen(c, f"_b_{c}", F.col("_at") == F.col("_earlier"))).alias(c) for c in columns]
    return both.where("_earlier is not null").groupBy(*by, time).agg(*used)


def totals(live: DataFrame, exited: DataFrame, by: str, columns=("cpu_seconds",)) -> DataFrame:
    """What live processes used in an interval, and what ended ones used since they were last seen, together: by, n_live and sums (null where never read)."""
    both = live.withColumn("_live", F.lit(1)).unionByName(exited.withColumn("_live", F.lit(0)), allowMissingColumns=True)
    return both.groupBy(by).agg(F.sum("_live").alias("n_live"), *[F.sum(c).alias(c) for c in columns])


def ancestors(path) -> Column:
    """The control group and all above it, for joins of processes with the groups they are under."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def under(groups: DataFrame, processes: DataFrame) -> DataFrame:
    """path, processes: how many processes each control group has in it and below; an equal join on the paths above each process."""
    counted = processes.select(F.explode(ancestors("path")).alias("path")).groupBy("path").agg(F.count("*").alias("processes"))
    return groups.join(counted, "path", "left").withColumn("processes", F.coalesce("processes", F.lit(0)))


def physical_totals(disks: DataFrame, by, device: str, columns) -> DataFrame:
    """Sums over whole devices; those that device-mapper and md make of others would count twice."""
    return disks.where(~F.col(device).rlike("^(dm-|md)")).groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def is_whole_disk(name) -> Column:
    """Not a loop or memory device, nor a partition."""
    n = _c(name)
    return ~n.rlike("^(loop|ram|zram)[0-9]") & ~n.rlike("^(sd|hd|vd|xvd)[a-z]+[0-9]+$") & ~n.rlike("^(nvme[0-9]+n[0-9]+|mmcblk[0-9]+)p[0-9]+$")


def is_counted_interface(name, excluded=("lo",)) -> Column:
    """Whether a host's network totals count an interface: all but those that are named, by their whole name."""
    return ~_c(name).isin(*excluded)


def interface_totals(readings: DataFrame, by=("host",), time: str = "ts", columns=("rx_bytes", "tx_bytes"), excluded=("lo",)) -> DataFrame:
    """by, time and for each counter the sum of all interfaces' rates; an interface's first reading, and a counter that went back, add nothing, and there is no figure where none was left."""
    counted = previous(readings.where(is_counted_interface("iface", excluded)), (*by, "iface"), [time], [time, *columns])
    seconds = F.col(time) - F.col(f"before_{time}")
    return counted.where(F.col(f"before_{time}").isNotNull()).groupBy(*by, time).agg(*[F.sum(rate(c, f"before_{c}", seconds)).alias(c) for c in columns])
