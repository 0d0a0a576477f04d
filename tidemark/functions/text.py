"""Text for readers, and text that must not be kept. Functions of plain values; columns by the pandas UDFs below them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numbers import _c

ELLIPSIS, WITHHELD = "…", "***"
# Words that make an argument's value a secret.
SECRET_WORDS = ("password", "passwd", "passphrase", "secret", "token", "cookie", "credential", "apikey", "api-key", "api_key")
_SIZES = ("B", "KiB", "MiB", "GiB", "TiB")


def duration_text(seconds: float) -> str:
    """340ms, 12.5s, 4m07s, 2h03m, 1d01h; decimals of the exact value, halves to even."""
    s = max(0.0, seconds)
    if s < 60:
        return f"{s:.1f}s" if s >= 1 else f"{s * 1000:.0f}ms"
    for size, unit, part, name in ((3600, 60, 1, "ms"), (86_400, 3600, 60, "hm"), (float("inf"), 86_400, 3600, "dh")):
        if s < size:
            return f"{int(s / unit)}{name[0]}{int(s % unit / part):02d}{name[1]}"
    raise AssertionError


def bytes_text(n: int) -> str:
    """512 B, 12.0 KiB, 340 MiB: binary units, a decimal under 100 of any but bytes."""
    value, unit = float(n), 0
    while value >= 1024 and unit + 1 < len(_SIZES):
        value, unit = value / 1024, unit + 1
    return f"{value:.{int(unit > 0 and value < 100)}f} {_SIZES[unit]}"


def is_secret_name(name: str) -> bool:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)
    return any(word in low for word in SECRET_WORDS)


_URL = re.compile(r"(?s)(.*?://)([^/?#]*)(.*)")


def withhold(arguments: list[str]) -> list[str]:
    """A command line's arguments without what is plainly a secret: named values, the argument after a named option, passwords in URLs."""
    out, after_name = [], False
    for argument in arguments:
        name, sign, value = argument.partition("=")
        was, after_name = after_name, False
        if was:
            out.append(WITHHELD)
        elif sign and value and is_secret_name(name):
            out.append(f"{name}={WITHHELD}")
        elif not sign and argument.startswith("-") and is_secret_name(argument):
            out.append(argument)
            after_name = True
        else:
            out.append(without_password(argument))
    return out


def without_password(argument: str) -> str:
    found = _URL.fullmatch(argument)
    if not found:
        return argument
    before, authority, rest = found.groups()
    account, at, host = authority.rpartition("@")
    user, colon, _ = account.partition(":")
    return f"{before}{user}:{WITHHELD}@{host}{rest}" if at and colon else argument


def command_line(raw: str, most: int) -> str:
    """Arguments parted by NUL, joined by spaces, secrets withheld, at most ``most`` bytes of UTF-8 and then an ellipsis."""
    line = " ".join(withhold([a for a in raw.split("\0") if a]))
    encoded = line.encode()
    return line if len(encoded) <= most else encoded[:most].decode(errors="ignore") + ELLIPSIS


def _decoded(text, escape: str, byte) -> Column:
    """``text`` with each escape put back as the byte that ``byte`` makes of it (as two hexadecimal digits); bytes that are no UTF-8 become U+FFFD."""
    pieces = F.split(_c(text), f"(?={escape})")
    of = lambda p: F.when(p.rlike(f"^{escape}"), F.concat(F.unhex(byte(p)), F.encode(F.regexp_replace(p, f"^{escape}", ""), "UTF-8"))).otherwise(F.encode(p, "UTF-8"))
    joined = F.aggregate(pieces, F.lit("").cast("binary"), lambda so_far, p: F.concat(so_far, of(p)))
    return F.make_valid_utf8(joined.cast("string"))


def unescaped(name) -> Column:
    r"""systemd's \xNN, byte by byte; what is not hexadecimal stays. Names without a backslash, nearly all, are not cut in pieces."""
    decoded = _decoded(name, r"\\x[0-9a-fA-F]{2}", lambda p: F.substring(p, 3, 2))
    return F.when(_c(name).contains("\\"), decoded).otherwise(F.make_valid_utf8(name))


def octal_unescaped(path) -> Column:
    r"""The \040 of mount tables."""
    return _decoded(path, r"\\[0-3][0-7]{2}", lambda p: F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"))


def fold(text: str, width: int) -> list[str]:
    """Lines of at most ``width`` characters, cut between words where that can be."""
    lines, line = [], ""
    for word in text.split():
        while len(word) > width:
            room = width - len(line) - bool(line)
            if line and room <= 0:
                lines.append(line)
                line = ""
                continue
            line += (" " if line else "") + word[:room]
            word = word[room:]
            lines.append(line)
            line = ""
        if len(line) + bool(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += (" " if line and word else "") + word
    return [*lines, line] if line or not lines else lines


def ago_text(now: float, at: float) -> str:
    return f"{duration_text(now - at)} ago"


@F.pandas_udf(StringType())
def human_duration(seconds: pd.Series) -> pd.Series:
    return seconds.map(duration_text, na_action="ignore")


@F.pandas_udf(StringType())
def human_bytes(n: pd.Series) -> pd.Series:
    return n.map(bytes_text, na_action="ignore")


def command_lines(most: int):
    """command_line of a column."""
    return F.pandas_udf(lambda raw: raw.map(lambda r: command_line(r, most), na_action="ignore"), StringType())


@F.pandas_udf(StringType())
def redact(line: pd.Series) -> pd.Series:
    """Secrets withheld in arguments parted by single spaces."""
    return line.map(lambda s: " ".join(withhold(s.split(" "))), na_action="ignore")


@F.pandas_udf(StringType())
def float_text(value: pd.Series) -> pd.Series:
    """The shortest text that reads back as the same number; whole numbers without a point."""
    return value.map(lambda v: repr(int(v)) if v == int(v) and abs(v) < 1e16 else repr(v), na_action="ignore")


def shorten(text, width: int) -> Column:
    """At most ``width`` characters, the last an ellipsis; 0 is no limit."""
    t = _c(text)
    return t if width == 0 else F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 1), F.lit(ELLIPSIS))).otherwise(t)


def says(needle: str, *fields) -> Column:
    """Whether any of the fields holds the text, in small or capital letters."""
    wanted = F.lit(needle.lower())
    test = F.lit(False)
    for f in fields:
        test = test | F.coalesce(F.contains(F.lower(_c(f)), wanted), F.lit(False))
    return test


def said(*fields) -> Column:
    """What a process said of itself, to search in; empty fields left out."""
    return F.concat_ws(" ", *[F.nullif(_c(f), F.lit("")) for f in fields])


def command(first, now, name) -> Column:
    """``first → now`` where a process became something else; its name where neither is known."""
    a, b = F.nullif(_c(first), F.lit("")), F.nullif(_c(now), F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(a, F.lit(" → "), b)).otherwise(F.coalesce(b, a, _c(name)))


def is_launcher(line) -> Column:
    """Whether the program's only purpose is to become another."""
    program = F.element_at(F.split(_c(line), " "), 1)
    return F.coalesce(F.element_at(F.split(program, "/"), -1) == "systemd-executor", F.lit(False))


def group_name(comm, kernel_thread) -> Column:
    """Kernel threads by their kind: the part before the first / or :."""
    kind = F.regexp_extract(_c(comm), "^([^/:]+)", 1)
    return F.when(_c(kernel_thread) & (kind != ""), kind).otherwise(_c(comm))
