"""Token counts by prefix dynamic programming over byte-level BPE."""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
from pyspark.sql import DataFrame

from .common import arrow_map

#: Words that one worker remembers; beyond that it begins anew.
REMEMBERED = 400_000
SPACES = "\t-\r \x85\xa0"
#: The pre-tokeniser's classes over code points up to 255, where Python's own classes differ from Unicode's.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class Totals(dict):
    """Token counts of words, found when first asked for."""

    def __init__(self, owner):
        self.owner = owner

    def __missing__(self, word: str) -> int:
        n = self.owner.prefixes(word.encode())[-1]
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class PrefixCounter:
    """Exact token counts of every prefix.

    BPE has one property that makes this a dynamic program: the tokens of a byte string are the only sequence of
    vocabulary entries in which all neighbours are stable, meaning that encoding the two together gives the two. So
    the last token of each prefix is the one entry that ends there and is stable beside the last token of the prefix
    before it, and its count is one more than that prefix's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.special = [t["content"] for t in model["added_tokens"]]
        names = {t for t in model["model"]["vocab"]} - set(self.special)
        self.id_of = {raw(t): model["model"]["vocab"][t] for t in names}
        self.merges: dict[tuple[int, int], int] = {}
        #: parts[t]: what token t is merged from, and by the merge of which rank
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y = self.id_of[a], self.id_of[b]
            self.merges[x, y] = rank
            self.parts.setdefault(self.id_of[a + b], (x, y, rank))
        self.ends = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.stable: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.totals = Totals(self)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.path, self.library = path, None

    def _edge(self, whole: int, side: int) -> list[tuple[int, float]]:
        """The tokens that lie at one edge of ``whole`` while it is merged, each with the rank at which it is used up."""
        if whole in self.edges[side]:
            return self.edges[side][whole]
        out, until, token = [], float("inf"), whole
        while True:
            out.append((token, until))
            if token not in self.parts:
                self.edges[side][whole] = out
                return out
            *both, until = self.parts[token]
            token = both[side]

    def beside(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart: no merge across their border comes before the ones that use up its parts."""
        key = a << 20 | b
        got = self.stable.get(key)
        if got is None:
            got, right, merge = True, self._edge(b, 0), self.merges.get
            for x, x_until in self._edge(a, 1):
                for y, y_until in right:
                    rank = merge((x, y))
                    # of equal merges the leftmost is done first
                    if rank is not None and rank < x_until and rank <= y_until:
                        got = False
            if len(self.stable) >= 2 * REMEMBERED:
                self.stable.clear()
            self.stable[key] = got
        return got

    def prefixes(self, word: bytes) -> array:
        """Token counts of word[:0], word[:1] and so on, for bytes that the pre-tokeniser keeps together."""
        n = len(word)
        last, count = [-1] * (n + 1), array("i", bytes(4 * (n + 1)))
        stable, beside = self.stable.get, self.beside
        for end, (token, size) in self.ends.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                k = end - size
                if k == 0:
                    last[end], count[end] = token, 1
                else:
                    before = last[k]
                    fit = stable(before << 20 | token)
                    if fit or fit is None and beside(before, token):
                        last[end], count[end] = token, count[k] + 1
        return count

    def words(self, text: str) -> list[str]:
        """What the pre-tokeniser keeps together. Beyond U+00FF the library's own pre-tokeniser says."""
        if text.isascii() or max(text) <= "\xff":
            return WORDS.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Text between special strings, and those strings (True)."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [(text, False)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def count(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and the most characters whose own encoding has ``limit`` tokens at most."""
        if self.special and any(s in text for s in self.special):
            words = [w for s, special in self.segments(text) for w in ([s] if special else self.words(s))]
            each = [1 if w in self.special else self.totals[w] for w in words]
        else:
            words = self.words(text)
            each = [*map(self.totals.__getitem__, words)]
        n = sum(each)
        if n <= limit:
            return n, len(text)
        # near the word where the limit is passed, the exact prefix counts say which prefix is the last that fits
        sums = list(accumulate(each))
        k = bisect_right(sums, limit)
        lo = max(0, k - 2)
        base, done = (sums[lo - 1] if lo else 0), sum(map(len, words[:lo]))
        local = self.every_prefix("".join(words[lo : k + 3]))
        return n, done + max(i for i, c in enumerate(local) if base + c <= limit)

    def every_prefix(self, text: str) -> array:
        """Exact token counts of text[:0], text[:1] ... text[:n], as the library would count each of them.

        Where a prefix ends within a word, the pre-tokeniser would cut it as it cuts the word's beginning, but for two
        cases: in white space before a word, of which the whole run stays together at an end of text; and in
        contractions, whose beginnings are an apostrophe and a word.
        """
        out = array("i", [0])
        base = 0
        for segment, special in self.segments(text):
            if special:
                # a beginning of a special string is ordinary text
                out.extend(self.every_prefix_plain(segment[:-1], base, self.tail(text, len(out) - 1))[1:])
                base += 1
                out.append(base)
                continue
            out.extend(self.every_prefix_plain(segment, base, "")[1:])
            base = out[-1]
        return out

    def tail(self, text: str, at: int) -> str:
        """What of the text before ``at`` may be one word with what follows it."""
        before = text[:at]
        cut = max((before.rfind(s) + len(s) for s in self.special if s in before), default=0)
        return before[cut:]

    def every_prefix_plain(self, text: str, base: int, before: str) -> array:
        if before:  # count the joined text and take away what stood before
            whole, head = self.every_prefix_plain(before + text, 0, ""), len(before)
            had = whole[head]
            return array("i", [base + c - had for c in whole[head:]])
        out, done = array("i", [base]), base
        words = self.words(text)
        for i, w in enumerate(words):
            raw = w.encode()
            counts = self.prefixes(raw)
            ends = list(accumulate(len(c.encode()) for c in w))
            if w[0] == "'" and w in ("'re", "'ve", "'ll"):
                a = self.totals["'"]
                out.extend([done + a, done + a + self.totals[w[1]], done + counts[-1]])
            else:
                out.extend(done + counts[e] for e in ends)
            # white space cut before its last character: seen from its end, the run is whole
            if i and words[i - 1].isspace() and w[0].isspace():
                run = words[i - 1] + w[0]
                at = len(out) - len(w)
                out[at] = done - self.totals[words[i - 1]] + self.prefixes(run.encode())[-1]
            done += counts[-1]
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's own counter for a vocabulary; it is read once in each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """-> doc_id, n_bytes, n_tokens, over_limit, fit_chars; one row for each input row.

    ``path``: the vocabulary's .json, on every executor. fit_chars: characters of the longest prefix that has ``limit``
    tokens at most, which answers where to truncate. Null texts are empty (0 tokens). Nothing is shuffled. Repeated rows
    and null doc_ids are counted as they stand; other columns are ignored.
    """

    def run(batch):
        import pyarrow.compute as pc

        c = counter(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        got = [c.count(t, limit) for t in texts]
        n = [x[0] for x in got]
        return {"doc_id": batch.column("doc_id"), "n_bytes": pc.fill_null(pc.binary_length(batch.column("text")), 0).cast("int64"), "n_tokens": n, "over_limit": [x > limit for x in n], "fit_chars": [x[1] for x in got]}

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """-> doc_id, counts: token counts of every prefix, by characters (n + 1 values), to be stored with the text.

    A budget question is then a look at counts[n]; a truncation to a limit is the last place whose count is no more.
    """

    def run(batch):
        c = counter(path)
        return {"doc_id": batch.column("doc_id"), "counts": [c.every_prefix(t or "").tolist() for t in batch.column("text").to_pylist()]}

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, counts array<int>", pieces=1 << 20)
