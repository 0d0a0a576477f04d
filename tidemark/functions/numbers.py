"""Arithmetic on counters and gauges, as column expressions. Absent stays null; nothing is made zero that was not read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(now, before, seconds) -> Column:
    """Per second between two readings; null if the counter went back or no time passed."""
    now, before, seconds = _c(now), _c(before), _c(seconds)
    return F.when((now >= before) & (seconds > 0), (now - before) / seconds)


def saturating(now, before) -> Column:
    """What a counter rose by, 0 if it went back (shares of CPU time are taken like this)."""
    return F.greatest(_c(now) - _c(before), F.lit(0))


def percent(part, whole) -> Column:
    """Null where the whole is not over 0."""
    return F.when(_c(whole) > 0, F.lit(100.0) * _c(part) / _c(whole))


def measured(value) -> Column:
    """A thousandth under 1000 and whole numbers from there on; no negative zero. Not finite is null."""
    v = _c(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return F.when(F.abs(finite) >= 1000, F.round(finite)).otherwise(F.round(finite * 1000) / 1000) + F.lit(0.0)


def finite(value) -> Column:
    """Whether a sample is kept."""
    v = _c(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def micros(seconds) -> Column:
    """Seconds to the microsecond."""
    return F.round(_c(seconds) * 1e6) / 1e6


def percent_text(part, whole) -> Column:
    """A percentage to one decimal; null without a whole."""
    return F.when(_c(whole) > 0, F.round(F.lit(1000.0) * _c(part) / _c(whole)) / 10)


def add(a, b) -> Column:
    """Null only if both are; else what is missing counts as 0."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


MODES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest")


def cpu_total(times: dict[str, Column] | None = None) -> Column:
    """The sum of a CPU's nine modes."""
    t = times or {m: F.col(m) for m in MODES}
    out = t[MODES[0]]
    for m in MODES[1:]:
        out = out + t[m]
    return out


def cpu_shares(now: dict[str, Column], before: dict[str, Column]) -> dict[str, Column]:
    """Percent of the interval in each mode, and busy: what is neither idle nor waiting for a disk."""
    spent = {m: saturating(now[m], before[m]) for m in MODES}
    total = cpu_total(spent)
    shares = {m: percent(spent[m], total) for m in MODES}
    return shares | {"busy": F.when(total > 0, F.greatest(F.lit(0.0), F.lit(100.0) - shares["idle"] - shares["iowait"]))}


def disk_util(busy_now, busy_before, seconds) -> Column:
    """Percent of the time with work in flight, from milliseconds; 100 at most, and 100 too over an interval that gives no rate (the counter went back)."""
    return F.least(rate(busy_now, busy_before, seconds) / 10, F.lit(100.0))


def queue_depth(weighted_now, weighted_before, seconds) -> Column:
    return rate(weighted_now, weighted_before, seconds) / 1000


def await_ms(done_now, done_before, waited_now, waited_before) -> Column:
    """Milliseconds for each request that was completed, 0 if none was."""
    done = saturating(done_now, done_before)
    return F.when(done > 0, saturating(waited_now, waited_before) / done).otherwise(F.lit(0.0))


def pressure_pct(stalled_now, stalled_before, seconds, most: float | None = None) -> Column:
    """Percent of the time stalled, from microseconds; null where the counter went back. With ``most``, no more than that, and 0 where it went back."""
    if most is None:
        return rate(stalled_now, stalled_before, seconds) / 10_000
    return F.when(_c(seconds) > 0, F.least(saturating(stalled_now, stalled_before) / _c(seconds) / 10_000, F.lit(most)))


def watts(energy_now, energy_before, seconds) -> Column:
    """From microjoules; null over the interval in which the counter wraps."""
    return rate(energy_now, energy_before, seconds) / 1e6


def memory(total, available) -> dict[str, Column]:
    used = _c(total) - _c(available)
    return {"used": used, "used_pct": percent(used, total)}


def swap_pct(total, free) -> Column:
    """0 on a host without swap."""
    return F.when(_c(total) > 0, percent(_c(total) - _c(free), total)).otherwise(F.when(_c(total).isNotNull(), F.lit(0.0)))


def committed_pct(committed, memory_total, swap_total) -> Column:
    return percent(committed, _c(memory_total) + _c(swap_total))


def filesystem_pct(blocks, free, available) -> Column:
    """As df counts: what is used of what is used or available to users."""
    used = _c(blocks) - _c(free)
    return percent(used, used + _c(available))


def inodes_pct(inodes, free) -> Column:
    """Null on filesystems that don't count them."""
    return percent(_c(inodes) - _c(free), inodes)


def hugepages(total, free) -> dict[str, Column]:
    """Both null on a host that has set none aside."""
    some = _c(total) > 0
    return {"total": F.when(some & _c(free).isNotNull(), _c(total)), "free": F.when(some, _c(free))}


def bucket(ts, width: int) -> Column:
    """The start of the epoch-aligned interval that holds ts."""
    return (F.floor(_c(ts) / width) * width).cast("bigint")


def next_tick(after, step: int) -> Column:
    """The next moment after ``after`` that is a multiple of the step."""
    return ((F.floor(_c(after) / step) + 1) * step).cast("bigint")


#: (warm, hot) of what is coloured.
THRESHOLDS = {"cpu": (60.0, 85.0), "memory": (80.0, 92.0), "temperature": (80.0, 92.0), "stall": (10.0, 40.0), "row_cpu": (50.0, 150.0)}


def heat(value, kind: str) -> Column:
    warm, hot = THRESHOLDS[kind]
    v = _c(value)
    return F.when(v.isNull(), "none").when(v >= hot, "hot").when(v >= warm, "warm").otherwise("calm")
