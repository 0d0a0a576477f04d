"""Questions about samples: what was so at a moment, and over a stretch of time.

All take samples (name, host, labels, ts, value); an ``id`` column breaks ties within a second where there is one.
Ranges hold both their ends. Time and name are conditions on plain columns, so they reach the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bucket
from ..functions.times import resolution


def label(key: str) -> Column:
    return F.col("labels")[key]


def series_key() -> Column:
    """The label set as text: the same for equal sets, whatever their order, and different for different ones. A backslash stands before a comma, an equals sign or a backslash of a label; a label without value has no equals sign."""
    plain = lambda c: F.regexp_replace(c, r"([\\,=])", r"\\$1")
    return F.concat_ws(",", F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.coalesce(F.concat(plain(e["key"]), F.lit("="), plain(e["value"])), plain(e["key"]))))


def pick(samples: DataFrame, names=None, since=None, until=None, host: str | None = None, **labels: str) -> DataFrame:
    """Samples of the named metrics with ts in [since, until], of one host, with all the labels given."""
    out = samples
    if names is not None:
        out = out.where(F.col("name").isin([names] if isinstance(names, str) else list(names)))
    if since is not None:
        out = out.where(F.col("ts") >= math.floor(since))
    if until is not None:
        out = out.where(F.col("ts") <= math.ceil(until))
    if host is not None:
        out = out.where(F.col("host") == host)
    for key, value in labels.items():
        out = out.where(label(key) == value)
    return out


def unlabelled(samples: DataFrame) -> DataFrame:
    """Series without labels of their own (the host is none)."""
    return samples.where(F.size(F.map_filter("labels", lambda k, _: k != "host")) <= 0)


def whole_host(samples: DataFrame) -> DataFrame:
    """Series that have no cpu label, or all CPUs in it."""
    return samples.where(label("cpu").isNull() | (label("cpu") == "all"))


def _last(samples: DataFrame) -> Column:
    order = [c for c in ("ts", "id") if c in samples.columns]
    return F.max_by("value", F.struct(*order))


def latest(samples: DataFrame, at: float, within: float, names=None, host=None, by=("host",), keys=(), **labels) -> DataFrame:
    """The last value of each series in [at - within, at]: name, ``by`` columns, ``keys`` of the labels, last_ts, value.

    Without keys a series is its whole label set (``series``).
    """
    near = pick(samples, names, at - within, at, host, **labels)
    groups = [label(k).alias(k) for k in keys] or [series_key().alias("series")]
    return near.groupBy("name", *by, *groups).agg(F.max("ts").alias("last_ts"), _last(near).alias("value"))


def wide(samples: DataFrame, at: float, within: float, columns: dict[str, str], key: str, host=None) -> DataFrame:
    """host, key, and a column for each of ``columns`` (column -> metric): the last values, side by side, in one aggregate."""
    near = pick(samples, list(columns.values()), at - within, at, host).where(label(key).isNotNull())
    order = F.struct(*[c for c in ("ts", "id") if c in samples.columns])
    return near.groupBy("host", label(key).alias(key)).agg(*[F.max_by(F.when(F.col("name") == m, F.col("value")), F.when(F.col("name") == m, order)).alias(c) for c, m in columns.items()])


def top(samples: DataFrame, at: float, within: float = 60, sort: str = "cpu", n: int = 20, host=None, columns=None) -> DataFrame:
    """The processes that used most at a moment. A process counts if its CPU was sampled; what else is missing is null, and 0 to sort by."""
    columns = columns or {"cpu": "proc_cpu_pct", "rss": "proc_rss_bytes", "threads": "proc_threads", "read": "proc_io_read_bytes_per_sec", "write": "proc_io_write_bytes_per_sec", "seconds": "proc_cpu_seconds"}
    rows = wide(samples, at, within, columns, "proc", host).where("cpu is not null")
    zero = F.lit(0.0)
    by = {"cpu": F.col("cpu"), "rss": F.coalesce("rss", zero), "io": F.coalesce("read", zero) + F.coalesce("write", zero)}[sort]
    return rows.orderBy(by.desc(), "host", "proc").limit(n)


def snapshot_units(samples: DataFrame, at: float, within: float, columns: dict[str, str], host=None) -> DataFrame:
    """A row for each unit that has tasks or CPU at the moment; figures of other kinds only beside those."""
    return wide(samples, at, within, columns, "unit", host).where("tasks is not null or cpu is not null")


def snapshot_host(samples: DataFrame, at: float, within: float, sums: dict, highest: dict, host=None) -> DataFrame:
    """Totals of a host at a moment: ``sums`` and ``highest`` are column -> (metric, label key, excluded value). Null where no series is."""
    every = {m for m, _, _ in [*sums.values(), *highest.values()]}
    near = pick(samples, list(every), at - within, at, host)
    last = near.groupBy("name", "host", series_key().alias("_series")).agg(_last(near).alias("value"), F.first("labels").alias("labels"))

    def of(metric, key, without):
        mine = F.col("name") == metric
        return F.when(mine & ~F.coalesce(label(key) == without, F.lit(False)) if without else mine, F.col("value"))

    return last.groupBy("host").agg(*[F.sum(of(*x)).alias(c) for c, x in sums.items()], *[F.max(of(*x)).alias(c) for c, x in highest.items()])


def order_nulls_last(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.orderBy(F.col(by).desc_nulls_last(), F.col(name))


def history(samples: DataFrame, name: str, since: float, until: float, host=None, **labels) -> DataFrame:
    return pick(samples, name, since, until, host, **labels).select("host", "ts", "value", *[c for c in ("id",) if c in samples.columns]).orderBy("ts")


def store_range(samples: DataFrame) -> DataFrame:
    return samples.agg(F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def spacing(samples: DataFrame, until: float, near: float = 300, far: float = 14_400, by=("name",)) -> DataFrame:
    """How far apart samples are: the upper median of the gaps over 0, of the last ``near`` seconds if they have two gaps, else of ``far``."""
    recent = pick(samples, None, until - far, until)
    order = Window.partitionBy(*by).orderBy("ts", *[c for c in ("id",) if c in samples.columns])
    gaps = recent.withColumn("_before", F.lag("ts").over(order)).withColumn("_gap", F.col("ts") - F.col("_before")).where("_gap > 0")
    is_near = F.col("_before") >= math.floor(until - near)

    # how often each gap is there; gaps are whole seconds, so there are at most ``far`` of a group
    counts = gaps.groupBy(*by, "_gap").agg(F.count("*").alias("_far"), F.count_if(is_near).alias("_near"))
    every = Window.partitionBy(*by)
    upto = every.orderBy("_gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in ("_near", "_far"):
        past = F.sum(n).over(upto) > F.floor(F.sum(n).over(every) / 2)
        counts = counts.withColumn(f"{n}_gap", F.when(past & (F.sum(n).over(every) >= 2), F.col("_gap")))
    return counts.groupBy(*by).agg(F.coalesce(F.min("_near_gap"), F.min("_far_gap")).alias("spacing"))


def rollup(samples: DataFrame, width: int, by=("name", "host")) -> DataFrame:
    """Epoch-aligned intervals of ``width`` seconds: the highest, lowest, mean, sum and count of each."""
    groups = [label(b[7:]).alias(b[7:]) if b.startswith("labels.") else F.col(b) for b in by]
    return samples.groupBy(*groups, bucket("ts", width).alias("bucket")).agg(F.max("value").alias("highest"), F.min("value").alias("lowest"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("n"))


def timeline(samples: DataFrame, rollups: DataFrame, since: float, until: float, width: int | None = None) -> DataFrame:
    """bucket, highest: kept rollups, then from where they end what the samples say, by the same width.

    ``rollups`` (bucket, highest) of that width, one row for each bucket. Without any in range, all comes from the samples; up to 2 hours
    (width 0) the samples are shown as they are.
    """
    width = resolution(until - since) if width is None else width
    raw = pick(samples, None, since, until)
    if width == 0:
        return raw.select(F.col("ts").alias("bucket"), F.col("value").alias("highest"))
    kept = rollups.where(F.col("bucket").between(math.floor(since), math.ceil(until))).select("bucket", "highest")
    end = kept.agg((F.max("bucket") + width).alias("_end"))
    tail = raw.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("ts") >= F.col("_end")))
    return kept.unionByName(tail.groupBy(bucket("ts", width).alias("bucket")).agg(F.max("value").alias("highest")))


def columns(points: DataFrame, until: float, span: float, width: int, step: float, by=("name",)) -> DataFrame:
    """by, column (0 to width - 1), value: the highest of each column; an empty one has what stood before it, for 1.5 steps.

    The last column holds the moment at the end. Columns without a value and nothing standing are null.
    """
    each, since = span / width, until - span
    before = points.where(F.col("ts") <= until).withColumn("column", F.when(F.col("ts") >= since, F.least(F.floor((F.col("ts") - since) / each), F.lit(width - 1))).otherwise(-1).cast("int"))
    cells = before.groupBy(*by, "column").agg(F.max("value").alias("highest"), F.max("ts").alias("_at"), F.max_by("value", F.struct("ts", *[c for c in ("id",) if c in points.columns])).alias("_last"))
    grid = before.select(*by).distinct().withColumn("column", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))))
    upto = Window.partitionBy(*by).orderBy("column").rowsBetween(Window.unboundedPreceding, -1)
    stood = grid.join(cells, [*by, "column"], "left").withColumn("_from", F.last("_at", True).over(upto)).withColumn("_standing", F.last("_last", True).over(upto))
    still = F.lit(since) + F.col("column") * each - F.col("_from") < step * 1.5
    return stood.where("column >= 0").select(*by, "column", F.coalesce("highest", F.when(still, F.col("_standing"))).alias("value"))


def marks(incidents: DataFrame, since: float, until: float, width: int) -> DataFrame:
    """column, mark: what went wrong in the time of each column of a timeline; a fault is not hidden by a kill."""
    at = F.col("ts_us") / 1e6
    place = F.least(F.floor((at - since) / (until - since) * width), F.lit(width - 1)).cast("int")
    worst = F.max(F.when(F.col("level") == "error", 2).otherwise(1))
    return incidents.where((at >= since) & (at <= until)).groupBy(place.alias("column")).agg(F.when(worst == 2, "fault").otherwise("killed").alias("mark"))


def every_nth(samples: DataFrame, n: int, piece: int = 86_400) -> DataFrame:
    """The samples of each n-th tick, the first among them. A tick is a moment at which anything was sampled.

    Ticks are counted by day first; each day then numbers its own from where those before it end, so no task holds all ticks.
    """
    ticks = samples.select("ts").distinct().withColumn("_day", F.floor(F.col("ts") / piece))
    days = ticks.groupBy("_day").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # over days
    starts = days.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = ticks.join(starts, "_day").withColumn("_k", F.col("_start") + F.row_number().over(Window.partitionBy("_day").orderBy("ts")) - 1)
    return samples.join(numbered.where(F.col("_k") % n == 0).select("ts"), "ts", "left_semi")


def peak(samples: DataFrame, name: str, since: float, until: float, by=("host",)) -> DataFrame:
    return pick(samples, name, since, until).groupBy(*by).agg(F.max("value").alias("peak"))


def running_peak(readings: DataFrame, by, order, value: str) -> DataFrame:
    """The highest so far of each subject."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return readings.withColumn("peak", F.max(value).over(upto))


def as_of(left: DataFrame, right: DataFrame, on, left_time: str, right_time: str, value: str, within: float | None = None, forward: bool = False) -> DataFrame:
    """``left`` with the value of the last row of ``right`` at or before its time (or the first at or after), and that row's time.

    One union and one window by the keys, so no pair of rows is ever made; ties in time go to the greatest value (the smallest, forward).
    """
    on = list(on)
    asked = left.withColumn("_t", F.col(left_time)).withColumn("_ask", F.lit(True)).withColumn("_row", F.monotonically_increasing_id())
    told = right.select(*on, F.col(right_time).alias("_t"), F.col(value).alias("_v")).where("_t is not null")
    both = asked.unionByName(told, allowMissingColumns=True)
    known = F.when(F.col("_ask").isNull(), F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    last = F.col("_ask").isNull().desc() if forward is None else F.col("_ask").asc_nulls_first()
    order = Window.partitionBy(*on).orderBy(F.col("_t").desc() if forward else F.col("_t").asc(), last, (F.col("_v").desc() if forward else F.col("_v").asc())).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last(known, True).over(order)).where("_ask")
    gap = F.abs(F.col("_found")["t"] - F.col("_t"))
    found = found if within is None else found.withColumn("_found", F.when(gap <= within, F.col("_found")))
    return found.select(*left.columns, F.col("_found")["t"].alias("found_time"), F.col("_found")["v"].alias("found"))
