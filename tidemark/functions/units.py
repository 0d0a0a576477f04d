"""Names of systemd units: what kind they are, and what of a name outlives an instance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import _c
from .text import unescaped

#: What marks one instance of a unit: a number, or hexadecimal digits with a decimal one among them. Where names carry numbers of their own only long ones count.
_NUMBER, _RANDOM = "[0-9]{%d,}", "(?=[a-f]*[0-9])[0-9a-f]{%d,}"


def _mark(number: int, random: int) -> str:
    return f"(?:{_NUMBER % number}|{_RANDOM % random})"


#: What a name keeps, the first that fits: instances of templates (not a user's manager) by counter or by the two ends of a connection; transient units; launches at the name's end.
STABLE = (
    (rf"^(?!user@)([^@]*)@{_mark(1, 6)}(?:[-_]{_mark(1, 6)})*\.(service|scope|slice)$", "$1@.$2"),
    (r"^(?!user@)([^@]*)@(?:[0-9]+-)+[^-]*:[^-]*-[^-]*:[^-]*\.(service|scope|slice)$", "$1@.$2"),
    (r"^run-[^@]*\.(service|scope|slice)$", "run.$1"),
    (rf"^([^@]*?)(?:(?:^|-){_mark(1, 4)})+\.(scope)$", "$1.$2"),
    (rf"^([^@]*?)(?:(?:^|-){_mark(6, 8)})+\.(service)$", "$1.$2"),
)


def stable_name(name) -> Column:
    """A unit's name without what marks one instance of it: one launch of an application, one connection, one container."""
    n = _c(name)
    fits = lambda *numbers: reduce(lambda out, i: F.regexp_replace(out, *STABLE[i]), numbers, n)
    bare = lambda out: F.regexp_replace(out, r"^\.(service|scope)$", "transient.$1")
    # which can fit: a template's name has an @, a mark a digit; what one of them has left, none of the others fits
    return F.when(n.contains("@"), fits(0, 1)).when(n.startswith("run-"), fits(2)).when(n.rlike("[0-9]"), bare(fits(3, 4))).when(n.startswith("."), bare(n)).otherwise(n)


def normalize(name) -> Column:
    return stable_name(unescaped(name))


def kind(name) -> Column:
    """service, scope, slice or null."""
    n = _c(name)
    return F.when(n.endswith(".service"), "service").when(n.endswith(".scope"), "scope").when(n.endswith(".slice"), "slice")


def unit_kind(unit) -> Column:
    """The kind label of a reported unit; a user's manager is a kind of its own."""
    last = F.element_at(F.split(_c(unit), "/"), -1)
    return F.when((kind(last) == "service") & last.startswith("user@"), "manager").otherwise(F.coalesce(kind(last), F.lit("service")))


def is_sum(unit) -> Column:
    """Whether a unit's figures are those of other units."""
    return unit_kind(unit).isin("slice", "manager")


def container_id(component) -> Column:
    """64 hexadecimal digits between dashes and points; null if there are none."""
    return F.nullif(F.regexp_extract(_c(component), "(?:^|[-.])([0-9a-f]{64})(?=[-.]|$)", 1), F.lit(""))


def nearest_unit(path) -> Column:
    """The path up to the nearest service or scope at or above a control group; null in slices and the root."""
    p = _c(path)
    found = F.nullif(F.regexp_extract(p, r"^(/.*?[^/]*\.(?:service|scope))(?:/(?!.*\.(?:service|scope)(?:/|$)).*)?$", 1), F.lit(""))
    # most groups that are asked for are units themselves, which their end says without a search
    itself = p.startswith("/") & (p.endswith(".service") | p.endswith(".scope")) & ~p.rlike(r"[\n\r\x{85}\x{2028}\x{2029}]")
    return F.when(itself, p).otherwise(found)


def owners(paths: DataFrame) -> DataFrame:
    """path -> container, owner: containers, and the unit inside which each one's group lies.

    One row for each id; should there be more, the owner that sorts first.
    """
    last = F.element_at(F.split("path", "/"), -1)
    above = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    found = paths.select(container_id(last).alias("container"), kind(last).alias("_kind"), nearest_unit(above).alias("owner"))
    return found.where("container is not null and _kind is null and owner is not null").groupBy("container").agg(F.min("owner").alias("owner"))


def unit_of(groups: DataFrame, users: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """``groups`` (path, ...) with unit: what each control group's processes are reported under.

    ``users`` (uid, user); an unknown uid is its number. ``containers`` as owners() gives them: a unit that is named for
    a container is reported as the unit that runs it. A unit under a user's manager has the user before its name.
    """
    at = groups.withColumn("_unit", nearest_unit("path"))
    if containers is not None:
        at = at.withColumn("_container", container_id(F.element_at(F.split("_unit", "/"), -1))).join(containers.withColumnRenamed("container", "_container"), "_container", "left")
        at = at.withColumn("_unit", F.coalesce("owner", "_unit")).drop("owner", "_container")
    above = F.regexp_extract("_unit", "^(.*)/[^/]*$", 1)
    uid = F.when(F.col("_unit").contains("/user@"), F.nullif(F.regexp_extract(above, r"/user@([0-9]+)\.service", 1), F.lit("")).cast("bigint"))
    named = at.withColumn("_uid", uid).join(users.select(F.col("uid").alias("_uid"), F.col("user").alias("_user")), "_uid", "left")
    # one after the other: each is mentioned more than once in the next
    named = named.withColumn("_name", F.substring_index("_unit", "/", -1)).withColumn("_name", unescaped("_name")).withColumn("_name", stable_name("_name"))
    owner = F.coalesce("_user", F.col("_uid").cast("string"))
    return named.withColumn("unit", F.when(F.col("_uid").isNotNull(), F.concat(owner, F.lit("/"), "_name")).otherwise(F.col("_name"))).drop("_unit", "_uid", "_user", "_name")
