"""Fill-in-middle: documents cut in three at unit borders, found in runs of character classes, and put together in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

# What marks the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts that hold a mark of their own, and PLAIN of 100 others, stay as they are; of the rest SPM of 100 begin with the suffix.
PLAIN, SPM = 10, 20


class Runs:
    """A text (UTF-8) as maximal runs of letters A-Z, a-z and of other characters, with the units before each: a run of letters is one unit, any other character is one."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        letter = ((b | 32) - 97).astype(np.uint8) < 26
        #: First byte of each run, and the text's end.
        self.start = np.r_[np.flatnonzero(np.r_[len(b) > 0, letter[1:] != letter[:-1]][: len(b)]), len(b)]
        self.letters = letter[self.start[:-1]]
        #: Bytes at which a character begins.
        self.place = np.flatnonzero((b & 0xC0) != 0x80)
        #: Characters before each run.
        self.chars = np.searchsorted(self.place, self.start)
        #: Units before each run; the last is all of them.
        self.units = np.r_[0, np.cumsum(np.where(self.letters, 1, np.diff(self.chars)))]

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """(characters, bytes) of the first ``units`` units: the run is found by binary search, the place in it by subtraction."""
        if units >= self.n:
            return int(self.chars[-1]), int(self.start[-1])
        k = int(np.searchsorted(self.units, units, "right")) - 1
        chars = int(self.chars[k] + units - self.units[k])
        return chars, int(self.start[k] if chars == self.chars[k] else self.place[chars])


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that belong to a document, alike in each run; a null id is written as nothing."""
    hexa = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(hexa[k : k + 8], 16) for k in (0, 8, 16, 24))  # type: ignore[return-value]


def rearranged(text: bytes, draw: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix, of the middle, output)."""
    runs = Runs(text)
    h1, h2, h3, h4 = draw
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN:
        return runs.n, "plain", None, None, text
    (chars_a, a), (chars_b, b) = (runs.cut(u) for u in sorted((h1 % (runs.n + 1), h2 % (runs.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM:
        return runs.n, "spm", chars_a, chars_b - chars_a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return runs.n, "psm", chars_a, chars_b - chars_a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text that was rearranged. The first of each mark is the one that was put in, as the text holds none."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    m = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : m], output[m + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, choose: Callable[[int | None], tuple[int, int, int, int]] = draws) -> DataFrame:
    """-> doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256; one row for each input row.

    A text is n units: runs of letters A-Z and a-z, and each other character. ``choose`` gives four numbers for a doc_id, from which the two cuts and
    the form come: plain (the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part after its mark. Null and
    empty texts, and those that hold a mark, are plain; prefix_chars and middle_chars are null then. restored_sha256 is that of the text rebuilt from the output
    and its form alone. A null doc_id counts as an empty number; repeated rows stand each by itself; other columns are
    ignored. Texts are taken whole, as bytes, a few MB at a time; nothing is shuffled.
    """

    def run(batch):
        ids = batch.column("doc_id").to_pylist()
        rows = [rearranged(t, choose(i)) for i, t in zip(ids, texts_of(batch))]
        out = dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), map(list, zip(*rows))))
        out["restored_sha256"] = [hashlib.sha256(restored(o, f)).hexdigest() for o, f in zip(out["output"], out["form"])]
        return out | {"doc_id": ids, "output_sha256": [hashlib.sha256(o).hexdigest() for o in out["output"]]}

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string, restored_sha256 string"
    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema, pieces=2 << 20).withColumn("output", F.col("output").cast("string"))


#: The same in SQL, by the list of units instead of runs.
ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hexa FROM documents
), numbered AS (
  SELECT doc_id, t, u, len(u) AS n, [CAST(list_sum([(strpos('0123456789abcdef', hexa[i + k]) - 1) * CAST(pow(16, 7 - k) AS BIGINT) for k in range(8)]) AS BIGINT) for i in [1, 9, 17, 25]] AS h FROM drawn
), cuts AS (
  SELECT doc_id, t, u, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM numbered
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
