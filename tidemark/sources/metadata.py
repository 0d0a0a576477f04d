"""Metadata of records and spans as VARIANT: keys with points in them, values with their own types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import _c

#: What spans' attributes are called and what they are, where they are made columns of their own.
TYPES = {"process.pid": "bigint", "process.unit": "string", "process.cpu_seconds": "double", "process.forked": "boolean"}


def parsed(text) -> Column:
    """JSON text as VARIANT; null where it is no JSON."""
    return F.try_parse_json(_c(text))


def path(key: str) -> str:
    """A key as it stands, with its points, as the only step of a path. Paths have no escapes, so a key cannot hold both kinds of quotes."""
    if "'" in key and '"' in key:
        raise ValueError(f"no path for a key with both kinds of quotes: {key}")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def get(attributes, key: str, kind: str = "string") -> Column:
    """The value under a key, as a type; null where there is none, or one that is not of the type."""
    return F.try_variant_get(_c(attributes), path(key), kind)


def packed(**columns) -> Column:
    """Columns as one VARIANT, under their names with points for double underscores; nulls are left out."""
    return parsed(F.to_json(F.struct(*[_c(c).alias(k.replace("__", ".")) for k, c in columns.items()])))


def typed(rows: DataFrame, types: dict[str, str] | None = None, attributes: str = "attributes") -> DataFrame:
    """``rows`` with a column for each key, with underscores for points: written like that once, filters on them reach the scan as on any column; what else is in the attributes stays there."""
    return rows.withColumns({k.replace(".", "_"): get(attributes, k, t) for k, t in (types or TYPES).items()})
