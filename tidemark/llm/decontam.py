"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_filter, arrow_map, count_pieces, cut

#: Characters of a q-gram, at most; a power of 2. Items that are too short for it take shorter ones.
Q = 16
#: Items of fewer compared characters are looked for as whole words, without edits.
SHORT = 16
#: Edits allowed, as a share of the item's characters.
EDITS = 0.05
#: Characters of benchmark items that are searched for in one pass over the documents.
BLOCK = 4 << 20
#: Shared q-grams that are counted at a time.
COUNTED = 2 << 20
#: Short q-grams by which regions are looked at once more, and the bits of their hashes.
FINE, FINE_BITS = 4, 16
_BASE = 0x9E3779B97F4A7C15


def _table() -> np.ndarray:
    """Code point -> what is compared: letters and digits in small letters, all else a space. Beyond U+FFFF nothing changes."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def normalised(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Comparable code points without runs of spaces, and where each stood."""
    if not _TABLE:
        _TABLE.append(_table())
    out = np.where(codes < 1 << 16, _TABLE[0][np.minimum(codes, (1 << 16) - 1)], codes)
    keep = out != 32
    keep[1:] |= (out[1:] == 32) & (out[:-1] != 32)
    at = np.flatnonzero(keep)
    return out[at], at


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, q a power of 2, by doubling."""
    h, size, base = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    while size < q:
        h = h[:-size] * np.uint64(base) + h[size:] if len(h) > size else h[:0]
        size, base = size * 2, base * base % (1 << 64) | 1
    return h


def short_grams(codes: np.ndarray) -> np.ndarray:
    """The q-grams of FINE characters as numbers of FINE_BITS bits; equal ones have the same number."""
    return (grams(codes, FINE) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FINE_BITS)).astype(np.uint16)


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 and so on, sizes[0] of them, then those of first[1] and so on."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Grams:
    """q-grams of some items, sorted, with the item (its number) and the place of each."""

    def __init__(self, q: int, numbers: list[int], codes: list[np.ndarray], rarest: bool):
        g = [grams(c, q) for c in codes]
        n = np.array([len(x) for x in g], np.int64)
        all_, owner = np.concatenate(g), np.repeat(np.array(numbers, np.int32), n)
        place = ragged(np.zeros(len(n), np.int64), n).astype(np.int32)
        if rarest:
            # one for each item, that which the fewest items have
            _, code, count = np.unique(all_, return_inverse=True, return_counts=True)
            first = np.cumsum(n) - n
            best = np.lexsort((place, count[code], np.repeat(np.arange(len(n)), n)))[first]
            all_, owner, place = all_[best], owner[best], place[best]
        order = np.argsort(all_, kind="stable")
        self.q, self.g, self.owner, self.place = q, all_[order], owner[order], place[order]
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.slot(self.g)] = True

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the text, where their q-gram stands first in the sorted ones, how often it does)."""
        g = grams(codes, self.q)
        hit = np.flatnonzero(self.seen[self.slot(g)])
        lo, hi = np.searchsorted(self.g, g[hit], "left"), np.searchsorted(self.g, g[hit], "right")
        real = hi > lo
        return hit[real], lo[real], (hi - lo)[real]


def pieces(n: np.ndarray, most: int):
    """(a, b): runs of n of about ``most`` in sum."""
    upto, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


class Index:
    """A block of items to search for: those that allow edits by counts of shared q-grams, the others by their rarest q-gram."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, edits: float = EDITS):
        self.items: list[tuple[int | None, np.ndarray, int, int]] = []
        of: dict[tuple[int, bool], list[int]] = {}
        for item_id, text in items:
            c = normalised(codes_of(text))[0]
            c = c[(c != 32).argmax() if len(c) else 0 :]
            c = c[:-1] if len(c) and c[-1] == 32 else c
            m = len(c)
            if not m:
                continue
            k, size = int(edits * m), q
            while size * (k + 1) > m:
                size //= 2
            # the lemma: of m - size + 1 q-grams, k edits leave all but k * size
            of.setdefault((size, k == 0), []).append(len(self.items))
            self.items.append((item_id, c, k, m - size + 1 - k * size))
        self.grams = [(exact, Grams(size, numbers, [self.items[i][1] for i in numbers], exact)) for (size, exact), numbers in sorted(of.items())]
        column = lambda k, none: np.array([i[k] for i in self.items] or [none], np.int64)
        self.k, self.least = column(2, 0), column(3, 1)
        self.length = np.array([len(i[1]) for i in self.items] or [1], np.int64)
        self.half = np.maximum(4, self.k)
        fine = [short_grams(c) for _, c, _, _ in self.items]
        self.n_fine = np.array([len(f) for f in fine] or [0], np.int64)
        self.first_fine, self.fine = np.cumsum(self.n_fine) - self.n_fine, np.concatenate([*fine, np.empty(0, np.uint16)])

    def search(self, texts: list[str]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item_id, start, end, edits): the regions within each item's edit budget, the best one of those that overlap."""
        if not self.grams or not texts:
            return []
        parts = [codes_of(t + "\n\n\n") for t in texts]
        codes, at = normalised(np.concatenate(parts))
        bounds = np.cumsum([0, *map(len, parts)])
        starts = np.searchsorted(at, bounds)
        found = []
        for exact, part in self.grams:
            found += self._exact(part, codes, starts) if exact else self._banded(part, codes, starts)
        return [(d, self.items[i][0], int(at[s] - bounds[d]), int(at[e - 1] - bounds[d]) + 1, cost) for d, i, s, e, cost in best(found)]

    def _exact(self, part: Grams, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        pos, lo, n = part.hits(codes)
        out = []
        for a, b in pieces(n, COUNTED // 8):
            take = ragged(lo[a:b], n[a:b])
            item, begin = part.owner[take], np.repeat(pos[a:b], n[a:b]) - part.place[take]
            doc = np.searchsorted(starts, np.repeat(pos[a:b], n[a:b]), "right") - 1
            size = self.length[item]
            inside = (begin >= starts[doc]) & (begin + size < starts[doc + 1])
            # short items begin and end where words do
            inside[inside] &= (size[inside] >= SHORT) | (((begin[inside] == 0) | (codes[begin[inside] - 1] == 32)) & (codes[(begin + size)[inside]] == 32))
            item, begin, doc, size = item[inside], begin[inside], doc[inside], size[inside]
            for m in np.unique(size).tolist():
                mine = np.flatnonzero(size == m)
                same = (codes[begin[mine, None] + np.arange(m)] == np.array([self.items[i][1] for i in item[mine].tolist()])).all(1)
                out += [(d, i, s, s + m, 0) for d, i, s in zip(doc[mine][same].tolist(), item[mine][same].tolist(), begin[mine][same].tolist())]
        return out

    def _banded(self, part: Grams, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        pos, lo, n = part.hits(codes)
        reach = int((self.length + 2 * self.half)[np.unique(part.owner)].max())
        out, i, upto = [], 0, np.cumsum(n)
        while i < len(pos):
            # a stretch of the text; the next begins so far before its end that each match lies in one of them
            j = max(int(np.searchsorted(upto, (upto[i - 1] if i else 0) + COUNTED, "right")), int(np.searchsorted(pos, pos[i] + reach, "right")))
            out += self._verified(*self._regions(part, pos[i:j], lo[i:j], n[i:j], starts), codes, starts)
            i = int(np.searchsorted(pos, pos[j] - reach)) if j < len(pos) else j
        return out

    def _regions(self, part: Grams, pos, lo, n, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, band, document) of the regions that share as many q-grams with the item as the lemma asks for; a band of diagonals overlaps half of the next."""
        counted = []
        for a, b in pieces(n, COUNTED):
            take = ragged(lo[a:b], n[a:b])
            item, at = part.owner[take].astype(np.int64), np.repeat(pos[a:b], n[a:b])
            band = (at - part.place[take]) // self.half[item]
            doc = np.searchsorted(starts, at, "right") - 1
            counted.append(self._counts(np.r_[item, item], np.r_[band, band - 1], np.r_[doc, doc], np.ones(2 * len(item), np.int64)))
        item, band, doc, count = counted[0] if len(counted) == 1 else self._counts(*(np.concatenate(x) for x in zip(*counted)))
        kept = count >= self.least[item]
        return item[kept], band[kept], doc[kept]

    @staticmethod
    def _counts(item, band, doc, count):
        lows = [x.min() for x in (doc, band, item)]
        spans = [int(x.max() - low) + 1 for x, low in zip((doc, band, item), lows)]
        if spans[0] * spans[1] * spans[2] < 1 << 62:
            order = np.argsort(((doc - lows[0]) * spans[1] + (band - lows[1])) * spans[2] + (item - lows[2]), kind="stable")
        else:
            order = np.lexsort((item, band, doc))
        item, band, doc = item[order], band[order], doc[order]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (doc[1:] != doc[:-1])])
        return item[new], band[new], doc[new], np.add.reduceat(count[order], new)

    def _verified(self, item, band, doc, codes, starts) -> list[tuple[int, int, int, int, int]]:
        """Of those regions the ones that the lemma leaves with short q-grams too, by banded alignment.

        Items that share a template meet in one region by the hundred; what sets them apart shows in their short q-grams, which are looked up
        for all items of a region at once.
        """
        half, k = self.half[item], self.k[item]
        left = np.maximum(band * half - k, starts[doc])
        right = np.minimum(starts[doc + 1] - 1, band * half + 2 * half + self.length[item] + k)
        order = np.lexsort((left, doc))
        near = np.flatnonzero(np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(left[order] // 256) != 0)]) if len(order) else []
        out, flag = [], np.zeros(1 << FINE_BITS, bool)
        for a, b in zip(near, [*near[1:], len(order)]):
            those = order[a:b]
            there = short_grams(codes[left[those].min() : right[those].max()])
            flag[there] = True
            for c, d in pieces(self.n_fine[item[those]], COUNTED):
                some = those[c:d]
                sizes = self.n_fine[item[some]]
                shared = np.add.reduceat(flag[self.fine[ragged(self.first_fine[item[some]], sizes)]].astype(np.int32), np.cumsum(sizes) - sizes)
                some = some[shared >= sizes - FINE * k[some]]
                some = some[self._covered(item[some], flag) <= k[some]]
                for r in some[self._within(item[some], codes, left[some], right[some])].tolist():
                    hit = aligned(self.items[item[r]][1], codes[left[r] : right[r]], int(k[r]))
                    if hit is not None:
                        out.append((int(doc[r]), int(item[r]), int(left[r]) + hit[0], int(left[r]) + hit[1], hit[2]))
            flag[there] = False
        return out

    def _covered(self, item: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """The fewest edits that can have taken from each item the short q-grams that are not there: each takes FINE successive ones."""
        n, free = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        sizes, first = self.n_fine[item], self.first_fine[item]
        for at in range(int(sizes.max()) if len(item) else 0):
            gone = (at < sizes) & (at >= free) & ~flag[self.fine[first + np.minimum(at, sizes - 1)]]
            n += gone
            free[gone] = at + FINE
        return n

    def _within(self, item, codes, left, right) -> np.ndarray:
        """Whether the text from left to right holds each item within its budget: banded alignments, many at a time, for their costs alone."""
        out = np.zeros(len(item), bool)
        order, m, k = np.argsort(self.length[item], kind="stable"), self.length[item], self.k[item]
        span = right - left - m + 2 * k + 1
        for a, b in pieces(np.maximum(span[order], 1), COUNTED // 2):
            some = order[a:b]
            some = some[span[some] > k[some]]  # others have too little text
            if not len(some):
                continue
            edge, most = int(k[some].max()), int((right - left)[some].max())
            width = int((right - left - m)[some].max()) + 2 * edge + 1
            # the text, with as much that nothing equals before it as there are diagonals to the left
            j = np.arange(edge + int(m[some].max()) + width)[None] - edge
            real = (j >= 0) & (j < (right - left)[some, None])
            text = np.where(real, codes[np.minimum(left[some, None] + np.clip(j, 0, most), len(codes) - 1)], 0)
            pattern = np.zeros((len(some), int(m[some].max())), np.uint32)
            for r, i in enumerate(item[some].tolist()):
                pattern[r, : m[some[r]]] = self.items[i][1]
            place = np.arange(width, dtype=np.int32)
            j = place[None] - edge
            cost = np.where((j >= 0) & (j <= (right - left)[some, None]), 0, 1 << 20).astype(np.int32)
            for i in range(1, pattern.shape[1] + 1):
                here = cost + (text[:, i - 1 : i - 1 + width] != pattern[:, i - 1 : i])
                np.minimum(here[:, :-1], cost[:, 1:] + 1, out=here[:, :-1])
                cost = np.minimum.accumulate(here - place, axis=1) + place
                ends = np.flatnonzero(m[some] == i)
                if len(ends):
                    inside = place[None] - edge + i <= (right - left)[some[ends], None]
                    out[some[ends]] = np.where(inside, cost[ends], 1 << 20).min(1) <= k[some[ends]]
                if i % 16 == 0:
                    go = (m[some] > i) & (cost.min(1) <= k[some])
                    if 2 * go.sum() < len(some):
                        some, cost, text, pattern = some[go], cost[go], text[go], pattern[go]
                        if not len(some):
                            break
        return out


def best(found):
    """Of overlapping regions of one item in one text, the one with the fewest edits, then the first."""
    out, kept, of = [], [], None
    for x in sorted(set(found), key=lambda r: (r[0], r[1], r[4], r[2], r[3])):
        if x[:2] != of:
            kept, of = [], x[:2]  # of this item in this text, apart from one another, in order
        at = bisect.bisect_left(kept, (x[2], x[3]))
        if (at == 0 or kept[at - 1][1] <= x[2]) and (at == len(kept) or x[3] <= kept[at][0]):
            kept.insert(at, (x[2], x[3]))
            out.append(x)
    return out


def aligned(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the pattern's best place in the text with at most k edits, or None. Ends of the text are free.

    The text is a band of a few diagonals, so a row of the alignment is as long as the band and no longer.
    """
    raw, whole = pattern.tobytes(), text.tobytes()
    at = whole.find(raw)
    while at >= 0 and at % 4:
        at = whole.find(raw, at + 1)
    if at >= 0:
        return at // 4, at // 4 + len(pattern), 0
    n, m = len(text), len(pattern)
    if n < m - k:
        return None
    width = n - m + 2 * k + 1 if n > m else 2 * k + 1 + (m - n)
    # diagonals from -k to n - m + k: cell (i, j) is at place j - i + k
    big = 1 << 20
    place = np.arange(width)
    j = place - k
    cost = np.where((j >= 0) & (j <= n), 0, big)
    start = np.clip(j, 0, n)
    for i in range(1, m + 1):
        j = place - k + i
        inside = (j >= 1) & (j <= n)
        same = np.zeros(width, bool)
        same[inside] = text[j[inside] - 1] == pattern[i - 1]
        diag = cost + np.where(inside, ~same, big)
        up = np.r_[cost[1:], big] + 1
        up_start = np.r_[start[1:], 0]
        take = diag <= up
        here, from_ = np.where(take, diag, up), np.where(take, start, up_start)
        here = np.where((j < 0) | (j > n), big, here)
        # insertions: the least of cost - place so far, carried along the row
        slack = here - place
        least = np.minimum.accumulate(slack)
        moved = least + place
        source = np.maximum.accumulate(np.where(slack == least, place, 0))
        cost, start = np.where(moved < here, moved, here), np.where(moved < here, from_[source], from_)
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    if cost[end] > k:
        return None
    s, e = int(start[end]), end - k + m
    return (s, e, int(cost[end])) if e > s else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, q: int = Q) -> DataFrame:
    """-> doc_id, item_id, start, end, n_edits: where a document holds a benchmark item, give or take its edit budget.

    Compared are letters and digits in small letters, with one space for anything between. An item of m such characters
    may differ by 5 % of them in edits, rounded down. Its q-grams have 16 characters, or the largest smaller power of 2 with which the lemma
    leaves some at that budget. Items of fewer than 20 characters allow no edit, and those of fewer than 16 are looked for as whole words. Items without any letter or digit hold nothing. start
    and end are characters of the text. A document without leaks has no row. Null texts and
    items hold nothing; a null doc_id or item_id is reported as such; repeated rows are reported each, repeated items once; other columns are ignored.

    The items are a query set: they go to the executors in blocks of about 4 M characters, one pass over
    the documents for each block, one after the other; and no item is left out. Nothing is shuffled.
    """
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks, out = list(_blocks(benchmark)), None
    for part in blocks:
        shared = _shared(rows, part)
        found = _search(rows, shared, edits, q)
        if len(blocks) > 1:
            found = cut(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, q: int = Q) -> DataFrame:
    """The documents in which find_leaks finds nothing, each row by itself, whatever its doc_id, with all their columns. Nothing is shuffled.

    Each block of items is a filter of its own, and each after the first reads what the one before it left from a table.
    """
    for k, part in enumerate(_blocks(benchmark)):
        docs = _clean(cut(docs, "clean") if k else docs, _shared(docs, part), edits, q)
    return docs


def _clean(docs: DataFrame, shared, edits: float, q: int) -> DataFrame:
    made: dict[str, Index] = {}

    def keep(batch):
        if "index" not in made:
            made["index"] = Index(shared.value, q, edits)
        clean = np.ones(batch.num_rows, bool)
        clean[[x[0] for x in made["index"].search([t or "" for t in batch.column("text").to_pylist()])]] = False
        return clean

    return arrow_filter(docs, keep, 1 << 20)


def _blocks(benchmark: DataFrame):
    """The items, each once, in blocks of about BLOCK characters."""
    kept = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = kept.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = count_pieces(chars, BLOCK)
    for b in range(blocks):
        yield kept if blocks == 1 else kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)


def _shared(docs: DataFrame, part: DataFrame):
    items = sorted({(r["item_id"], r["text"]) for r in part.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return docs.sparkSession.sparkContext.broadcast(items)


def _search(rows: DataFrame, shared, edits: float, q: int) -> DataFrame:
    made: dict[str, Index] = {}

    def run(batch):
        if "index" not in made:
            made["index"] = Index(shared.value, q, edits)
        ids = batch.column("doc_id").to_pylist()
        found = made["index"].search(batch.column("text").to_pylist())
        if not found:
            return None
        return {"doc_id": [ids[x[0]] for x in found], "item_id": [x[1] for x in found], "start": [x[2] for x in found], "end": [x[3] for x in found], "n_edits": [x[4] for x in found]}

    return arrow_map(rows, run, "doc_id long, item_id long, start int, end int, n_edits int", pieces=1 << 20)
