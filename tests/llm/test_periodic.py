import hashlib
import random
import zlib

import numpy as np

from tidemark.llm.periodic import find_runs, kept, periodic_runs, replayed, strongest

from .data import TEXTS, frame, odd_rows


def plainly(w):
    """All runs by comparing each word with the one a lag on, for each lag; a stretch found at a smaller lag has that as its period."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, length, q) for (a, length), q in out.items())


def row(text, i):
    """What the query says of a text, from its definition."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plainly(words)
    gone = {k for a, length, q in runs for k in range(a + q, a + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()


def fields(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def test_runs_are_those_of_all_lags():
    rng, total = random.Random(1), 0
    for _ in range(500):
        w = []
        while len(w) < rng.randrange(1, 500):
            piece = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 17, 20, 33, 40, 70, 100]))]
            w += piece * rng.randrange(1, 6)
            if rng.random() < 0.5:
                w = w[: len(w) - rng.randrange(4)] + [rng.randrange(60) for _ in range(rng.randrange(5))]
        if w:
            got = find_runs(np.array(w))
            total += len(got)
            assert got == plainly(w)
    assert total > 500


def test_two_letters_and_words_of_fibonacci():
    rng = random.Random(3)
    for n in (30, 200, 600):
        w = [rng.randrange(2) for _ in range(n)]
        assert find_runs(np.array(w)) == plainly(w)
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert find_runs(np.array(b)) == plainly(b)


def test_shortest_run_and_its_borders():
    assert find_runs(np.zeros(23, int)) == [] and find_runs(np.zeros(24, int)) == [(0, 24, 1)]
    eight = list(range(8)) * 3
    assert find_runs(np.array(eight)) == [(0, 24, 8)] and find_runs(np.array(eight[:-1])) == []
    assert find_runs(np.array([9, *range(20), *range(20), *range(20), 0, 1, 9])) == [(1, 62, 20)]


def test_strongest_and_kept():
    assert strongest([]) is None
    assert strongest([(0, 24, 8), (5, 30, 10), (7, 31, 10), (9, 62, 20)]) == (7, 31, 10)
    assert kept(10, [(0, 6, 2), (3, 7, 3)]).tolist() == [True, True] + [False] * 8


def test_whole_table(spark):
    docs = spark.read.parquet(TEXTS)
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert sum(r.n_runs > 0 for r in got.values()) >= 10
    seen = 0
    for r in docs.collect():
        if len((r.text or "").split()) < 3000:
            assert fields(got[r.doc_id]) == row(r.text, r.doc_id)
            seen += 1
    assert seen > 150


def test_odd_rows_and_long_texts(spark):
    rows = odd_rows() + [(20, "a " * 200_000, "a"), (21, " ".join(f"w{k % 30_000}" for k in range(100_000)), "a"), (22, "\x0b\x0c\r", "b"), (23, "x" * 2_000_000, "b")]
    got = periodic_runs(frame(spark, rows, clashing=True), transform=lambda words, _: words).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[20].start, by[20].length, by[20].period, by[20].exponent_milli, by[20].collapsed) == (0, 200_000, 1, 200_000_000, "a")
    assert (by[21].n_runs, by[21].length, by[21].period) == (1, 100_000, 30_000)
    for i in (1, 2, 3, 22):
        assert (by[i].n_runs, by[i].start, by[i].collapsed) == (0, None, "") and by[i].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic_runs(frame(spark, rows).where("false")).count() == 0
    assert replayed([b"a", b"b"], None) == [b"a", b"b"] and replayed([], 8) == []
