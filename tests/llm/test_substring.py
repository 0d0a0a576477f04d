import hashlib
import random
import re

import pytest

from tidemark.llm.substring import remove_repeated

from .data import TEXTS, frame, odd_rows, random_words


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        if i is not None:
            for k in range(len(ws) - window + 1):
                key = tuple(ws[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        dead = set()
        for k in range(len(ws) - window + 1) if i is not None else ():
            if first[tuple(ws[k : k + window])] < i:
                dead.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in dead)
        out.append((i, len(ws), len(dead), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [50, 7, 120])
def test_against_all_windows(spark, window):
    rng = random.Random(window)
    passages = [random_words(rng, rng.randint(window - 2, window + 60), 30) for _ in range(6)]
    rows = []
    for k in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.5 else random_words(rng, rng.randint(1, 80), 3000)
        rows.append((rng.randrange(60), "  ".join(parts)))
    assert result(remove_repeated(frame(spark, [(i, t, "s") for i, t in rows]), window)) == brute(rows, window)


def test_table(spark):
    docs = spark.read.parquet(TEXTS.replace("0.001", "0.01"))
    assert result(remove_repeated(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_odd_rows(spark):
    rows = odd_rows()
    assert result(remove_repeated(frame(spark, rows, clashing=True))) == brute([r[:2] for r in rows], 50)
    assert remove_repeated(frame(spark, [])).count() == 0
