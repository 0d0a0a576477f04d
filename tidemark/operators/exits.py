"""Questions about accounting records: what ended, when and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.endings import failed
from ..functions.text import says
from ..functions.times import check_range


def exits(records: DataFrame, since_us: int | None = None, until_us: int | None = None, comm=None, status=None, host=None, user=None, unit=None, levels=None) -> DataFrame:
    """Exit records in [since, until] that meet all conditions. They are equalities on plain columns, so the scan takes them."""
    if since_us is not None and until_us is not None:
        check_range(since_us, until_us)
    out = records.where("kind = 'exit'")
    if since_us is not None:
        out = out.where(F.col("ts_us") >= since_us)
    if until_us is not None:
        out = out.where(F.col("ts_us") <= until_us)
    for column, value in (("service", comm), ("status", status), ("host", host), ("user", user), ("unit", unit)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out if levels is None else out.where(F.col("level").isin(list(levels)))


#: What tells records apart: two hosts may have a process of one number end at one moment.
RECORD = ("ts_us", "pid", "host")


def last(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(*[F.col(c).desc() for c in RECORD]).limit(n)


def page(records: DataFrame, cursor, n: int) -> DataFrame:
    """The next n by time, then pid, then host. The cursor is the last page's oldest (time, pid, host), which is not read again however many share its time; or its oldest
    time alone, which is read again: once() then takes out what was seen before, and a page must be longer than the records of a moment.
    """
    if cursor is None:
        return last(records, n)
    if isinstance(cursor, tuple):
        at, pid, host = cursor
        same = F.col("ts_us") == at
        return last(records.where((F.col("ts_us") < at) | (same & (F.col("pid") < pid)) | (same & (F.col("pid") == pid) & (F.col("host") < host))), n)
    return last(records.where(F.col("ts_us") <= cursor), n)


def once(rows: DataFrame) -> DataFrame:
    """Each record once, over pages that overlap."""
    return rows.dropDuplicates(list(RECORD))


def saying(records: DataFrame, text: str, fields=("message",)) -> DataFrame:
    """Records of which any field holds the text, in small or capital letters."""
    return records.where(says(text, *fields))


def incidents(records: DataFrame, since_us: int, until_us: int, host=None) -> DataFrame:
    """Faults and kills, by time."""
    return exits(records, since_us, until_us, host=host, levels=("error", "warning")).orderBy("ts_us", "pid")


def summary(rows: DataFrame, by: str = "service", n: int | None = None, total: bool = True) -> DataFrame:
    """name, exits, failed, cpu, elapsed, peak_rss, read, write for each command, unit or user, by CPU; a missing name is "-".

    total: also one row for all, named (all N), if there is more than one group; it is of all groups, not only those shown.
    """
    figures = dict(exits=F.count("*"), failed=F.count_if(failed("status")), cpu=F.sum("cpu_seconds"), elapsed=F.sum("elapsed_seconds"), peak_rss=F.max("peak_rss_bytes"), read=F.sum("io_read_bytes"), write=F.sum("io_write_bytes"))
    groups = rows.groupBy(F.coalesce(F.col(by), F.lit("-")).alias("name")).agg(*[f.alias(k) for k, f in figures.items()])
    shown = groups if n is None else groups.orderBy(F.col("cpu").desc(), "name").limit(n)
    if not total:
        return shown
    again = dict(exits=F.sum("exits"), failed=F.sum("failed"), cpu=F.sum("cpu"), elapsed=F.sum("elapsed"), peak_rss=F.max("peak_rss"), read=F.sum("read"), write=F.sum("write"))
    whole = groups.agg(F.count("*").alias("_n"), *[f.alias(k) for k, f in again.items()]).where("_n > 1")
    return shown.unionByName(whole.select(F.concat(F.lit("(all "), F.col("_n").cast("string"), F.lit(")")).alias("name"), *again))


def first_since(records: DataFrame, service: str, since_us: int, by=("pid",)) -> DataFrame:
    """The first record of a service at or after a moment, for each pid."""
    return records.where((F.col("service") == service) & (F.col("ts_us") >= since_us)).groupBy(*by).agg(F.min("ts_us").alias("ts_us"), F.min_by("status", "ts_us").alias("status"))


def beside_exits(units: DataFrame, records: DataFrame, since_us: int, until_us: int) -> DataFrame:
    """Units at a moment (unit, cpu), each with what ended in it in a stretch of time; units in which nothing ended have zeros."""
    ended = exits(records, since_us, until_us).groupBy("unit").agg(F.count("*").alias("ended"), F.count_if(F.col("status") != "0").alias("not_zero"), F.sum("cpu_seconds").alias("cpu_seconds"))
    zero: Column = F.lit(0)
    return units.join(ended, "unit", "left").select("unit", "cpu", F.coalesce("ended", zero).alias("ended"), F.coalesce("not_zero", zero).alias("not_zero"), F.coalesce("cpu_seconds", F.lit(0.0)).alias("cpu_seconds"))
