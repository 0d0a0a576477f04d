import hashlib
import random
import re

import duckdb

from tidemark.llm.fim import ORACLE, Runs, draws, fill_in_middle, rearranged, restored
from tidemark.llm.queries import QUERIES

from .data import TEXTS, frame, odd_rows

PIECES = ["a", "Bc", "zzz", " ", "é", "☃", "😀", "<", "P", "S>", ">", "\x00", "\n", "9", "[", "`", "{", "@", "ſ"]


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)


def plainly(text, i):
    """(n, form, prefix, middle, output) from the list of units."""
    u = units(text)
    hexa = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexa[k : k + 8], 16) for k in (0, 8, 16, 24))
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_every_cut_is_that_of_the_units():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        runs, u = Runs(text.encode()), units(text)
        assert runs.n == len(u)
        for k in range(len(u) + 1):
            assert runs.cut(k) == (len("".join(u[:k])), len("".join(u[:k]).encode()))


def test_forms_and_round_trip():
    rng, seen = random.Random(2), set()
    for i in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20)))
        n, form, p, m, out = rearranged(text.encode(), draws(i))
        assert (n, form, p, m, out.decode()) == plainly(text, i)
        assert restored(out, form) == text.encode()
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}
    assert [rearranged(t, draws(3))[1] for t in (b"x <P> y", b"<S>", b"a<M>", b"")] == ["plain"] * 4


def test_whole_table_by_units_and_by_sql(spark):
    got = {r.doc_id: r for r in fill_in_middle(spark.read.parquet(TEXTS)).collect()}
    for r in spark.read.parquet(TEXTS).collect():
        n, form, p, m, out = plainly(r.text or "", r.doc_id)
        g = got[r.doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars, g.output) == (n, form, p, m, out)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TEXTS}'")
    sql = con.execute(ORACLE).fetch_df()
    one = QUERIES["op11_fill_in_middle"](spark, TEXTS.rsplit("/", 1)[0])
    assert sorted(map(str, one.select(*sql.columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(sql.columns, row))})" for row in con.execute(ORACLE).fetchall())


def test_odd_rows(spark):
    rows = odd_rows() + [(9, "<P> of its own", "a"), (10, "x" * 3_000_000, "a"), (11, "é" * 1_000_000, "a"), (12, "a1" * 400_000, "a")]
    got = fill_in_middle(frame(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n, by[1].form, by[1].output, by[1].prefix_chars) == (0, "plain", "", None) and by[9].form == "plain" and by[10].n == 1 and by[11].n == 1_000_000 and by[12].n == 800_000
    for i, text, _ in rows:
        if i in (6, 8, 10, 11, 12):
            assert by[i].output == plainly(text, i)[4] and by[i].restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.doc_id is None for r in got) == 2
    empty = frame(spark, rows).where("false")
    assert fill_in_middle(empty).count() == 0
