import random
from collections import Counter

import numpy as np

from tidemark.llm import near_dup
from tidemark.llm.near_dup import bags, near_duplicates, signatures

from .data import frame, odd_rows, random_words


def bag(text):
    words = [w for w in (text or "").replace("\x0b", " ").split()]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    """Brute force: all pairs, then components."""
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts.setdefault(i, t)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    b = {i: bag(t) for i, t in texts.items()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if b[i] and b[j]:
                common = sum((b[i] & b[j]).values())
                if common >= 0.8 * (sum(b[i].values()) + sum(b[j].values()) - common) - 1e-9:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: find(i) for i in ids}


def test_signatures_are_unbiased():
    r, errors = np.random.default_rng(1), []
    for q in range(150):
        words = [b"%d-%d" % (q, i) for i in range(60)]
        x, y = (b" ".join(r.choice(words[: r.integers(5, 60)], 200)) for _ in range(2))
        owner, shingle, count = bags([x, y], 1)
        sig = signatures(owner, shingle, count, 2, 1024)
        a, b = (Counter(dict(zip(shingle[owner == k].tolist(), count[owner == k].tolist()))) for k in (0, 1))
        errors.append((sig[0] == sig[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5


def test_classes_against_all_pairs(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for k in range(30):
        base = random_words(rng, rng.randint(30, 150))
        for c in range(rng.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 997, " ".join(words), "s"))
    want = classes(rows)
    for together in (512, 4):  # with 4, groups are cut into chunks
        monkeypatch.setattr(near_dup, "TOGETHER", together)
        got = near_duplicates(frame(spark, rows)).collect()
        assert {r.doc_id: r.class_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.class_id) for r in got)
        assert {r.class_id: r.n_class for r in got} == Counter(want.values())


def test_odd_rows(spark):
    rows = odd_rows()
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows, clashing=True)).collect()}
    assert got == classes(rows) and got[5] == 4 and got[7] == 6
    assert near_duplicates(frame(spark, [])).count() == 0
