"""Periodic runs: stretches of words that repeat with a fixed lag, found by bit-parallel comparison of a text with itself."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, mix64, texts_of, windows

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3
#: Lags under this are compared over the whole text; longer ones where hashed blocks say that they may match.
SHORT = 16
_BASE = 0xD1B54A32D192ED03


def replayed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that are looked at: in one of ten documents, by crc32 of the id, those from a place on repeat a piece of themselves. Null ids change nothing."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def planes(ids: np.ndarray) -> list[int]:
    """Bit k of all ids as one integer, for each k; the lowest bit is the first word's."""
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(max(1, int(ids.max()).bit_length()))]


def stretches(bits: list[int], low: int, high: int, q: int) -> list[tuple[int, int]]:
    """Maximal [a, b) within [low, high) in which each word is that of q words on, of those long enough for a run of period q.

    The planes are XORed with themselves shifted by q, and what differs in any plane is ORed. Of the rest a bit stays in ``all_`` if all of
    the ``least`` from it on are set: ANDing with itself shifted doubles what a bit stands for.
    """
    whole = (1 << (high - low)) - 1
    differ = 0
    for plane in bits:
        differ |= (plane >> low) ^ (plane >> (low + q))
    all_ = ~differ & whole
    least = max(LEAST - q, (PERIODS - 1) * q)
    have = 1
    while have < least and all_:
        step = min(have, least - have)
        all_ &= all_ >> step
        have += step
    if not all_:
        return []
    flags = np.unpackbits(np.frombuffer(all_.to_bytes((high - low + 7) // 8, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return [(low + a, low + b - 1 + least) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]


def _places(hashes: np.ndarray, block: int, n: int, reach: np.ndarray):
    """(lag, first, last) for lags of 2 to under 4 blocks: three blocks in a row, and more, that begin with the block ``first`` and are again one lag on.

    A run of such a lag has them, as its stretch is twice the lag. Blocks that lie, with where they are again, in a run of a period up to three
    blocks (reach: the end of such a run over each block's start) are of that run and no other: two runs overlap by less than both periods.
    """
    count = n // block - 2
    if count < 3:
        return
    view = np.lib.stride_tricks.sliding_window_view(np.r_[hashes, np.zeros(2 * block, np.uint64)], 2 * block)
    starts = np.arange(count) * block
    same = view[starts + 2 * block] == hashes[starts][:, None]
    # what begins past the last window is padding
    same &= starts[:, None] + 2 * block + np.arange(2 * block) <= n - block
    row = same[:-2] & same[1:-1] & same[2:]
    row &= starts[:-2, None] + 5 * block + np.arange(2 * block) > reach[starts[:-2], None]
    at, lag = np.nonzero(row)
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    new = np.flatnonzero(np.r_[len(at) > 0, (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + 1)][: len(at)])
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
        yield 2 * block + int(lag[a]), int(at[a]), int(at[b - 1]) + 2


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal run with its smallest period, by start, then period.

    ``ids`` are numbers of words, equal where the words are. Lags under 16 are compared over the whole text. For longer ones hashes of aligned blocks of 8, 16, 32 and so on
    words say which lags can match where, so the work grows with the text times its logarithm, whatever its length; a hash never
    misses a match, and what it proposes is compared in the planes.
    """
    n = len(ids)
    if n < LEAST:
        return []
    bits = planes(ids)
    found: dict[tuple[int, int], int] = {}

    def note(spans, q):
        for a, b in spans:
            # the same stretch at a smaller lag: that is the smallest period
            found.setdefault((a, b + q), q)

    for q in range(1, min(SHORT, n // PERIODS + 1)):
        note(stretches(bits, 0, n - q, q), q)
    block = SHORT // 2
    values = mix64(ids.astype(np.uint64) + np.uint64(1)) if n >= PERIODS * SHORT else None
    while PERIODS * 2 * block <= n:
        reach = np.zeros(n, np.int64)
        for (a, b), q in found.items():
            if q <= 3 * block:
                reach[a] = max(reach[a], b)
        np.maximum.accumulate(reach, out=reach)
        for q, first, last in _places(windows(values, block, _BASE), block, n, reach):
            if PERIODS * q > n:
                continue
            low, high = max(0, (first - 1) * block), min(n - q, (last + 2) * block)
            spans = stretches(bits, low, high, q)
            if any((a == low and low) or (b == high and high < n - q) for a, b in spans):
                spans = stretches(bits, 0, n - q, q)
            note(spans, q)
        block *= 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, compared exactly; of equal ones the first, then the one with the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


def periodic_runs(docs: DataFrame, transform=replayed) -> DataFrame:
    """-> doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed; one row for each input row.

    A run is a stretch of words with smallest period q, of at least 24 words and three periods, that goes on neither way. start to exponent_milli are those of the run with
    the most periods, null where there is none. collapsed holds the words that no run has after its first period, joined by one space.
    Null, empty and blank texts have no words and no runs. ``transform`` (words, doc_id) gives the words that are looked at. Repeated rows stand
    each by itself; other columns are ignored. Texts are taken whole, a few MB at a time; nothing is shuffled.
    """

    def run(batch):
        ids = batch.column("doc_id").to_pylist()
        out = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed")}
        for i, text in zip(ids, texts_of(batch)):
            words = transform(text.split(), i)
            number: dict[bytes, int] = {}
            coded = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            runs = find_runs(coded)
            start, length, q = strongest(runs) or (None, None, None)
            stay = b" ".join(words[k] for k in np.flatnonzero(kept(len(words), runs)).tolist()) if runs else b" ".join(words)
            row = len(runs), start, length, q, 1000 * length // q if runs else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(stay).hexdigest(), stay
            for k, v in zip(out, row):
                out[k].append(v)
        return out | {"doc_id": ids}

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema, pieces=2 << 20)
