import random
import time

import duckdb
import pytest

from tidemark.llm import decontam
from tidemark.llm.decontam import Index, codes_of, find_leaks, normalised

from .data import TEXTS, frame, odd_rows


def nearest(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j - 1] + (c != d), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_regions_are_those_within_the_budget():
    rng = random.Random(3)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(12, 40)))) for k in range(8)]
    index = Index(items)
    for _ in range(60):
        item, text = rng.choice(items)
        chars = list(text)
        for _ in range(int(len(text) * rng.choice([0, 0.02, 0.04, 0.06, 0.09]))):
            at, op = rng.randrange(len(chars)), rng.random()
            if op < 0.3:
                chars[at] = "q"
            elif op < 0.6:
                del chars[at]
            else:
                chars.insert(at, "z")
        text = " ".join(["begin of text"] * rng.randint(0, 5) + ["".join(chars)] + ["end of it"] * rng.randint(0, 5))
        pattern, k = next((c, k) for i, c, k, _ in index.items if i == item)
        true = nearest(pattern.tolist(), normalised(codes_of(text))[0].tolist())
        got = min((x[4] for x in index.search(["other", text, "more"]) if x[0] == 1 and x[1] == item), default=None)
        assert (got == true) if true <= k else got is None


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at, op = rng.randrange(len(chars)), rng.random()
        if op < 0.3:
            chars[at] = "q"
        elif op < 0.6:
            del chars[at]
        else:
            chars.insert(at, "z")
    return "".join(chars)


@pytest.mark.parametrize("counted", [decontam.COUNTED, 40])
def test_items_of_any_length(monkeypatch, counted):
    """Each item, from one character up, against all texts by a full alignment; also where texts are searched in many small stretches."""
    monkeypatch.setattr(decontam, "COUNTED", counted)
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))
    items = [(k, words(25)[:m].strip()) for k, m in enumerate([1, 2, 3, 4, 5, 7, 8, 11, 15, 16, 18, 20, 23, 31, 32, 39, 40, 47, 60, 63, 64, 79, 80, 99])] + [(None, "what is 2+2?"), (-1, "capital of peru"), (98, "?!"), (99, "")]
    items = [(i, t) for i, t in items if t or i == 99]
    texts = [words(rng.randint(0, 20)) + " " + edited(rng, t, rng.choice([0, 0, 1, 2, 3])) + " " + words(rng.randint(0, 20)) if t else "" for _, t in items for _ in range(3)]
    got = {}
    for d, i, _, _, cost in Index(items).search(texts):
        got[d, i] = min(cost, got.get((d, i), 99))
    want = {}
    for i, t in items:
        p = normalised(codes_of(t))[0].tolist()
        p = "".join(map(chr, p)).strip()
        for d, text in enumerate(texts):
            n = " " + "".join(map(chr, normalised(codes_of(text))[0])).strip() + " "
            if p and len(p) < 16 and f" {p} " in n:
                want[d, i] = 0
            elif len(p) >= 16 and (cost := nearest(p, n[1:-1])) <= int(0.05 * len(p)):
                want[d, i] = cost
    assert got == want and sum(v > 0 for v in want.values()) > 5


def test_templates():
    """Thousands of items that share most of their text: those that are there are found, and the others cost little."""
    rng = random.Random(1)
    about = "Answer the following question about the city that is named at the end of it: what is the capital of "
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(24))
    items = [(k, about + name()) for k in range(5_000)]
    index = Index(items)
    texts = [f"{about} nowhere that we know of, as it was written here" for _ in range(5)] + [f"so {items[77][1]} and"]
    began = time.monotonic()
    found = index.search(texts)
    assert [x[:2] for x in found] == [(5, 77)] and time.monotonic() - began < 60


def test_a_text_that_repeats_an_item_many_times():
    item = "the passage that comes again and again in one long text of repeats"
    found = Index([(1, item)]).search([(item + " . ") * 300])
    assert len(found) == 300 and all(x[4] == 0 for x in found)


def test_blocks(spark, monkeypatch):
    docs, bench = spark.read.parquet(TEXTS), spark.read.parquet(TEXTS.replace("documents", "benchmark"))
    whole = sorted(map(tuple, find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 20_000)
    assert sorted(map(tuple, find_leaks(docs, bench).collect())) == whole and whole


def test_repeated_items_are_collected_once(spark, monkeypatch):
    """However often an item is repeated, it is one of its block, and blocks stay small."""
    monkeypatch.setattr(decontam, "BLOCK", 3000)
    rows = [(7, "the same item of a benchmark that somebody copied many times")] * 3000 + [(i, f"item number {i} with words of its own, and some more") for i in range(100)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    sizes = [part.count() for part in decontam._blocks(bench)]
    assert sum(sizes) == 101 and len(sizes) > 1 and max(sizes) < 101
    docs = frame(spark, [(1, "so it is the same item of a benchmark that somebody copied many times over", "a")])
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()] == [(1, 7)]


def test_table_holds_all_verbatim_leaks(spark):
    folder = TEXTS.rpartition("/")[0].replace("sf0.001", "sf0.01")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    plain = lambda t: "".join(map(chr, normalised(codes_of(t))[0])).strip()
    docs = [(i, plain(t)) for i, t in duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet' where text is not null").fetchall()]
    items = [(i, plain(t)) for i, t in duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()]
    assert {(d, i) for d, t in docs for i, p in items if p in t} <= got
    text = dict(docs)
    assert all(nearest(dict(items)[i].encode(), text[d].encode()) <= 0.06 * len(dict(items)[i].encode()) for d, i in got if len(text[d]) < 8000)


def test_odd_rows(spark):
    item = "a passage that a benchmark asks about and that nobody should learn by heart"
    rows = [*odd_rows(), (9, "Before. A passage, that a benchmark asks about\nand that nobody should learn by heart", "a"), (None, item, "a")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "short"), (None, "null id, here!")], "item_id long, text string")
    got = find_leaks(frame(spark, rows, clashing=True), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.n_edits) for r in got) == [("9", "1", 0), ("None", "1", 0), ("None", "None", 0)]
    assert next(r for r in got if r.doc_id == 9).start == 8
    assert find_leaks(frame(spark, []), bench).count() == 0
    assert find_leaks(frame(spark, rows), bench.limit(0)).count() == 0
