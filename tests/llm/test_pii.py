import hashlib
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import pii
from tidemark.llm.pii import KINDS, WINDOW, Tagger, all_spans, base_spans, default_model, find_personal_data, labelled_examples

from .data import TEXTS, frame, odd_rows


def test_gradients():
    r, t = np.random.default_rng(0), Tagger(4)
    x = pii._classes([e[0][:20] for e in labelled_examples(6)], 24)
    y = np.zeros_like(x)
    y[:, :20] = r.integers(0, 5, (6, 20))

    def loss():
        e, total = t.emissions(x)[0], 0.0
        for k in range(6):
            a = e[0, k]
            for s in range(1, 20):
                q = a[:, None] + t.p["T"]
                a = np.log(np.exp(q).sum(0)) + e[s, k]
            total += np.log(np.exp(a).sum()) - sum(e[s, k, y[k, s]] for s in range(20)) - sum(t.p["T"][y[k, s], y[k, s + 1]] for s in range(19))
        return total / 6

    g = t.gradients(x, y)
    for name, p in t.p.items():
        at = (1, 2)[: p.ndim]
        kept = p[at]
        p[at] = kept + 1e-5
        up = loss()
        p[at] = kept - 1e-5
        assert abs(g[name][at] - (up - loss()) / 2e-5) < 1e-5
        p[at] = kept


def test_held_out_characters():
    right = total = 0
    examples = labelled_examples(200, seed=99)
    for (text, spans), row in zip(examples, default_model().decode(pii._classes([e[0] for e in examples], WINDOW))):
        want = np.zeros(len(text))
        for k, a, b in spans:
            want[a:b] = KINDS.index(k) + 1
        right, total = right + (want == row[: len(text)]).sum(), total + len(text)
    assert right / total > 0.98


def test_base():
    text = "x.34@mail7.example.com 10.0.0.999 10.1.2.3 +1 (826) 555-7388 4111 1111 1111 1111 1234567890123456"
    assert base_spans(text) == [("email", 0, 22), ("ip", 34, 42)]  # the phone takes all digits after it, and the numbers run together
    assert base_spans("4111111111111111 a +1 (826) 555-7388") == [("card", 0, 16), ("phone", 19, 36)]


def test_base_is_what_the_patterns_give():
    """By the patterns as they stand, on texts of the pieces that they are made of."""
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["1", "2", "0", "000", ".", ".", "@", "a", "b-", "_", "%", "+", " ", "-", "(", ")", "255", "256", "4111", "é", "\n"]) for _ in range(rng.randrange(40)))
        assert base_spans(text) == [(k, *m.span()) for k in KINDS for m in pii.PATTERNS[k].finditer(text) if pii.valid(k, m[0])]


@pytest.mark.parametrize("piece", ["0", "1", "a", ".", "1.", "a@", "+", "1 ", "a.b@c.", "-"])
def test_long_texts_of_one_piece(piece):
    n = 2_000_000 // len(piece)
    base, spans = all_spans(default_model(), [piece * n + " x 10.1.2.3"])[0]
    assert base[-1] == ("ip", len(piece) * n + 3, len(piece) * n + 11) and set(base) <= set(spans)


def test_zeros_before_a_number():
    assert base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)] and base_spans("0" * 5000 + "256.2.3.4") == []


def test_model_adds_what_runs_together():
    text = "and the oreth was here +1 (826) 555-7388 4111111111111111 and so on with more of it"
    base, spans = all_spans(default_model(), [text])[0]
    assert ("phone", 23, 40) in spans and set(base) <= set(spans)


@pytest.mark.parametrize("plain, least", [(True, 0.97), (False, 0.9)])
def test_planted_in_documents(plain, least):
    """Data written into clean documents, in the forms of the patterns and in forms that they don't know: how much is found whole, and what else is."""
    r, rng = np.random.default_rng(5), random.Random(5)
    docs = [t for (t,) in duckdb.sql(f"select text from '{TEXTS.replace('sf0.001', 'sf0.01')}' where length(text) between 200 and 6000 order by doc_id limit 400").fetchall()]
    clean = [t for t, (_, spans) in zip(docs, all_spans(default_model(), docs)) if not spans]
    words = [w.lower() for t in clean for w in t.split() if w.isascii() and w.isalpha() and len(w) > 2]
    texts, planted = [], []
    for t in clean:
        parts, kind = t.split(" "), rng.choice(KINDS)
        k, s = rng.randrange(len(parts)), pii.written(kind, r, lambda: rng.choice(words), plain)
        before = " ".join(parts[:k]) + " " if k else ""
        texts.append(f"{before}{s} {' '.join(parts[k:])}")
        planted.append((kind, len(before), len(before) + len(s)))
    found = [spans for _, spans in all_spans(default_model(), texts)]
    right = sum(p in f for p, f in zip(planted, found))
    assert len(clean) > 200 and right >= least * len(planted)
    assert right >= 0.95 * sum(map(len, found))


def test_forms_beyond_the_patterns():
    for text, kind, span in [
        ("call (826) 555-7388 today", "phone", "(826) 555-7388"), ("paid with 4539.5787.6362.1486 last week", "card", "4539.5787.6362.1486"), ("the host 10[.]20[.]30[.]40 was down", "ip", "10[.]20[.]30[.]40"),
        ("write to jane at mailer dot org about it", "email", "jane at mailer dot org"), ("write to jane [at] mailer [dot] org about it", "email", "jane [at] mailer [dot] org"),
    ]:
        base, spans = all_spans(default_model(), [text])[0]
        assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, span)]
    for text in ("it began at 10:30 and the dot on the map", "version 3.14.15 of 2024-01-02", "4539.5787.6362.1487 is no card", "order 1234567890123 was sent"):
        assert all_spans(default_model(), [text])[0] == ([], [])


def test_harmless_numbers_and_forms_that_the_generator_does_not_know():
    harmless = [
        "ISBN 978-3-16-148410-0 of the book", "see ISBN 0-306-40615-2 there", "order 4711-0815-2024 was sent", "invoice 2024-001-123456 is due", "his number is 078-05-1120 so", "it cost 123.456.789 in all", "part 112-98-77-45 is out", "from 2024-01-02 to 2024-03-04", "at 48.858370, 2.294481 on the map",
        "account DE89 3704 0044 0532 0130 00 there", "the range 100-200-300 and 1000-2000", "case no. 19-cv-01234-567", "serial 555-12345-678", "pages 123-130, 145-167 and 201-210", "order no. 0471-1234567-89 of 2023", "item 0123456789012 in stock", "UUID 550e8400-e29b-41d4-a716-446655440000", "code 3.14159265358979",
    ]
    assert [h for h, (base, spans) in zip(harmless, all_spans(default_model(), harmless)) if spans != base] == []
    forms = [
        ("call me at (415) 555-0132 please", "phone"), ("call 415-555-0132 now", "phone"), ("ring 415.555.0132 today", "phone"), ("tel 030/1234567890", "phone"), ("0033 1 42 68 53 00 is hers", "phone"), ("jane(at)mail(dot)org", "email"), ("jane [at] mail [dot] net", "email"), ("bob AT mail DOT de", "email"),
        ("ip 10[.]1[.]2[.]3 seen", "ip"), ("ip 192 . 168 . 0 . 1 seen", "ip"), ("card 4111_1111_1111_1111 used", "card"), ("card 4111 - 1111 - 1111 - 1111", "card"), ("card 4111.1111.1111.1111 used", "card"), ("mobile (0171) 234 5678", "phone"),
    ]
    found = [any(k == kind for k, *_ in spans) for (_, kind), (_, spans) in zip(forms, all_spans(default_model(), [t for t, _ in forms]))]
    assert sum(found) >= 12


def test_a_model_that_is_stored(spark, tmp_path):
    pii.save_model(spark, default_model(), str(tmp_path / "model"))
    again = pii.load_model(spark, str(tmp_path / "model"))
    texts = ["call (826) 555-7388 today", "write to jane at mailer dot org about it", "4539.5787.6362.1486"]
    assert all_spans(again, texts) == all_spans(default_model(), texts)


def test_base_of_a_table_in_sql(spark):
    """Counts of the four base kinds, the second time by DuckDB."""
    path = TEXTS.replace("sf0.001", "sf0.01")
    digits = "list_filter(string_split(regexp_replace(x, '[^0-9]', '', 'g'), ''), lambda d: d <> '')"
    double = "list_sum(list_transform(list_reverse(" + digits + "), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END))"
    want = duckdb.sql(rf"""
        SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')),
          len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::HUGEINT)) <= 255)),
          len(list_filter(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: len({digits}) BETWEEN 13 AND 19 AND {double} % 10 = 0)),
          len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: len({digits}) BETWEEN 9 AND 15))
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM '{path}')""").fetchall()
    got = find_personal_data(spark.read.parquet(path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_spans").collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and sum(sum(r[1:]) for r in want) > 50
    assert all(r.n_spans >= r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)


def test_positions_and_digests_of_a_table(spark):
    """By the patterns as they stand, over whole texts."""
    docs = spark.read.parquet(TEXTS)
    got = {r.doc_id: r for r in find_personal_data(docs).collect()}
    for r in docs.collect():
        base = [(k, *m.span()) for k in KINDS for m in pii.PATTERNS[k].finditer(r.text or "") if pii.valid(k, m[0])]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and {x for x in said.split(",") if x} <= set(got[r.doc_id].spans.split(","))


def test_odd_rows(spark):
    rows = [*odd_rows(), (9, "a" * 5000 + " me@example.org " + "b" * 5000, "a")]
    got = find_personal_data(frame(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    assert next(r for r in got if r.doc_id == 9).spans == "email:5001:5015"
    assert next(r for r in got if r.doc_id == 1).base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert find_personal_data(frame(spark, [])).count() == 0
