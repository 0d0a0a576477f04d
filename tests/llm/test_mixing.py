import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import mixing
from tidemark.llm.mixing import mix_sources
from tidemark.llm.queries import QUERIES

from .data import frame, odd_rows


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By rounds: share, cap, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def served_by_a_loop(rows, packet):
    """{row: words}: all packets of all sources in one list, in order of finish time, until the budget is spent."""
    sizes, queue = defaultdict(int), defaultdict(list)
    for n, (i, t, s) in enumerate(rows):
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += size
        key = "null" if i is None else i
        queue[s].append((hashlib.md5(f"mix|{key}|{size}".encode()).hexdigest(), n, size))
    want, packets = targets(sizes), []
    for rank, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        place = 0
        for copy in (0, 1):
            for _, n, size in sorted(queue[s]):
                for j in range(0, size, packet):
                    words = min(packet, size - j)
                    packets.append(((place + words) / want[s], rank, place, words, n, copy))
                    place += words
    left, out = int(1.5 * sum(sizes.values())), defaultdict(int)
    for _, _, _, words, n, copy in sorted(packets):
        out[n, copy] += min(left, words)
        left -= min(left, words)
    return out, want


@pytest.mark.parametrize("bucket, packet", [(4096, 256), (5, 7)])
def test_against_a_loop(spark, monkeypatch, bucket, packet):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "LEVELS", bucket)
    monkeypatch.setattr(mixing, "SORTED", bucket)
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "B", "é", None] + ["a"] * 5)) for i in range(300)]
    out, want = served_by_a_loop(rows, packet)
    got = mix_sources(frame(spark, rows), packet=packet).collect()
    assert {(r.doc_id, r.copy): r.taken for r in got if r.taken} == {k: v for k, v in out.items() if v}
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[s] - want[s]) <= 2 * packet for s in want)


def repeated_rows():
    """Null and repeated ids, with equal and other texts and sources."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, i]), " ".join(["w"] * rng.choice([0, 1, 5, 5, 300, 700])), rng.choice(["a", "b", "c", None])) for i in range(400)]
    return rows + [(None, "the same row", "a")] * 50 + [(7, "x y", "tied")] * 3 + [(8, "x y z", "tied too")] * 2


@pytest.mark.parametrize("bucket", [4096, 8])
def test_rows_that_repeat_ids_each_count(spark, tmp_path, monkeypatch, bucket):
    """The query has a row for each input row, and the same as its SQL, however the input is cut up."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = repeated_rows()
    out, _ = served_by_a_loop(rows, mixing.PACKET)
    want = Counter((i, len((t or "").split()), out[n, 0] + out[n, 1]) for n, (i, t, _) in enumerate(rows))
    found = []
    for parts in (1, 5):
        frame(spark, rows).repartition(parts).write.parquet(f"{tmp_path}/{parts}/documents.parquet")
        found.append([tuple(r) for r in QUERIES["op8_source_mix"](spark, f"{tmp_path}/{parts}").select("doc_id", "size", "source_size", "target", "taken").collect()])
        assert Counter((r[0], r[1], r[4]) for r in found[-1]) == want
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/1/documents.parquet/*.parquet'")
    sql = db.execute(mixing.ORACLE).fetchall()
    assert Counter(found[0]) == Counter(found[1]) == Counter(sql)


def test_odd_rows(spark):
    rows = odd_rows()
    got = mix_sources(frame(spark, rows, clashing=True)).collect()
    assert sum(r.copy == 0 for r in got) == len(rows)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert abs(sum(r.taken for r in got) - min(1.5 * words, 2 * words)) <= 3
    assert mix_sources(frame(spark, [])).count() == 0
    assert {r.taken for r in mix_sources(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()} == {0}
