"""What is kept: rollups, retention and a cap on size. Days of partitions are dropped whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bucket
from ..sources.store import TABLES, TIERS, Store

DAY, HOUR = 86_400, 3600
#: Days that are kept of each, and the ladder of rollups.
KEEP = {"samples": 7, "records": 30, "spans": 30}
LADDER = tuple(zip(TIERS, (30 * DAY, 180 * DAY)))


def kept(rows: DataFrame, time: str, now: float, days: float, scale: int = 1) -> DataFrame:
    """Rows no older than so many days."""
    return rows.where(F.col(time) >= int((now - days * DAY) * scale))


def rollups(samples: DataFrame, resolution: int) -> DataFrame:
    """All tiers' figures of each series and interval."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    groups = samples.groupBy("name", "host", key.alias("_labels"), bucket("ts", resolution).alias("bucket"))
    out = groups.agg(F.max("value").alias("highest"), F.min("value").alias("lowest"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("n"))
    return out.select("name", "host", F.from_json("_labels", "map<string,string>").alias("labels"), F.lit(resolution).alias("resolution"), "bucket", "highest", "lowest", "mean", "total", "n")


def write_rollups(store: Store, day: int, ladder=LADDER) -> None:
    """A day's rollups, from its samples, each tier in its own table and as a batch that may be written again."""
    day_samples = store.read("samples", (day, day)).drop("day")
    for resolution, _ in ladder:
        store.append(f"rollups-{resolution}", rollups(day_samples, resolution), batch=day)


def retain(store: Store, now: float, keep=None) -> list[tuple[str, int]]:
    """Drops days that are wholly older than their table is kept, each tier of rollups by its own age; says which."""
    gone = []
    for table, days in {**KEEP, **{f"rollups-{r}": k // DAY for r, k in LADDER}, **(keep or {})}.items():
        for day, _ in store.days(table):
            if (day + 1) * DAY <= now - days * DAY:
                store.drop(table, day)
                gone.append((table, day))
    return gone


@dataclass(frozen=True)
class Held:
    """A part of the store that can go: kind, first and last moment (epoch seconds), bytes."""

    kind: str
    first: int
    last: int
    bytes: int


#: What goes first: what costs most to hold for what it tells. Rollups go finest first, before the records.
ORDER = ("samples", "spans", *(f"rollups-{t}" for t in TIERS), "records")


def prune_plan(held: list[Held], limit: int | None, now: float) -> list[Held]:
    """What to drop to come under the limit: kind by kind, the oldest first, never what reaches into the last hour."""
    over = sum(h.bytes for h in held) - (limit if limit is not None else float("inf"))
    gone = []
    for h in sorted((h for h in held if h.last <= now - HOUR), key=lambda h: (ORDER.index(h.kind), h.first)):
        if over <= 0:
            break
        gone.append(h)
        over -= h.bytes
    return gone


def fit(store: Store, limit: int | None, now: float) -> list[Held]:
    """Drops days until the store is within its limit."""
    held = [Held(table, day * DAY, (day + 1) * DAY, size) for table in TABLES for day, size in store.days(table)]
    gone = prune_plan(held, limit, now)
    for h in gone:
        store.drop(h.kind, h.first // DAY)
    return gone


def cutoffs(first: float, last: float, freed, least: float = 60) -> float | None:
    """How far a kind is given up, round by round: a tenth of what is held at a time (a minute at least), twice as much after a round that freed nothing, never into its last hour.

    ``freed`` (moment) gives up all before a moment and says (enough, the first moment held now). Returns the last such moment, None if there was none.
    """
    reached, step = None, None
    while True:
        held = last - first
        this = step if step is not None else max(held / 10, least)
        if held <= HOUR or this >= held:
            return reached
        moment = min(first + this, last - HOUR)
        enough, begins = freed(moment)
        if begins is not None and begins > first:
            reached, first, step = moment, begins, None
        elif moment >= last - HOUR:
            return reached
        else:
            step = this * 2
        if enough:
            return reached


def fit_by_rounds(store: Store, limit: int | None) -> tuple[list[tuple[str, float]], bool]:
    """([(kind, the moment before which it is gone)], whether the store is within its limit now): the same order, cut within days, so that it lands near the limit."""
    gone: list[tuple[str, float]] = []
    if limit is None or store.bytes() <= limit:
        return gone, True
    for kind in ORDER:
        if (held := store.range(kind)) is None:
            continue

        def freed(moment: float, kind: str = kind) -> tuple[bool, float | None]:
            store.drop_before(kind, moment)
            left = store.range(kind)
            return store.bytes() <= limit, left[0] if left else None

        if (moment := cutoffs(*held, freed)) is not None:
            gone.append((kind, moment))
        if store.bytes() <= limit:
            return gone, True
    return gone, store.bytes() <= limit
