"""The registered queries and their SQL, area by area."""

from __future__ import annotations

from . import collect, derived, hosts, jobs, kernel, levels, lifecycle, records, samples, texts, upkeep

QUERIES, ORACLE = {}, {}
for _area in (samples, records, jobs, derived, kernel, levels, lifecycle, hosts, collect, texts, upkeep):
    QUERIES |= _area.QUERIES
    ORACLE |= _area.ORACLE
