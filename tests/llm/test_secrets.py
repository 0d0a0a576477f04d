import numpy as np

from tidemark.llm.secrets import features, fit_forest, labelled_findings, mask_secrets, scan_secrets

from .data import frame, odd_rows

KEY = "9fb1ecab5a43ebe9e8f8ce17ceff21e10f09c0877"[:40]


def test_held_out_findings(spark):
    from pyspark.ml.functions import array_to_vector

    forest, language = fit_forest(spark)
    rows = labelled_findings(600, seed=77)
    data = spark.createDataFrame([(float(f[5]), features(language, *f[:5])) for f in rows], "label double, x array<double>")
    got = forest.transform(data.select("label", array_to_vector("x").alias("features"))).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.95


def test_a_session_in_which_something_was_observed(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation("rows before a scan")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    docs = frame(spark, [(1, f'The token = "{KEY}" and more', "src1")])
    assert seen.get == {"n": 3} and scan_secrets(docs).where("is_secret").count() == 1 and mask_secrets(docs).first().text == 'The token = "[SECRET]" and more'


def test_found_and_masked(spark):
    rows = [
        (1, f'The token = "{KEY}" and more', "src1"),
        (2, 'The token = "your_token_here" and more', "docs/example.md"),
        (3, "plain prose of the usual kind with nothing in it", "src1"),
        (4, f"api_key: {KEY} twice {KEY}", None),
        *[(i + 10 if i is not None else i, t, s) for i, t, s in odd_rows()],
        (None, f'secret = "{KEY}"', None),
    ]
    docs = frame(spark, rows, clashing=True)
    found = scan_secrets(docs).where("is_secret").collect()
    assert {r.doc_id for r in found} >= {1, 4, None} and not {2, 3} & {r.doc_id for r in found}
    masked = {r.doc_id: r for r in mask_secrets(docs).collect()}
    assert masked[1].text == 'The token = "[SECRET]" and more' and masked[1].n_chars == len(masked[1].text)
    assert masked[3].text == rows[2][1] and masked[2].text == rows[1][1]
    assert mask_secrets(docs).columns == docs.columns and mask_secrets(docs).count() == len(rows)
    assert scan_secrets(frame(spark, [])).count() == 0


def test_whole_runs(spark):
    import random

    from tidemark.llm.secrets import HEAD, candidates

    r = random.Random(4)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    keys = [key(n) for n in (150, 201, 400, 1500, 5000)]
    rows = [(k, f'The token = "{s}" and more', "src1") for k, s in enumerate(keys)] + [(k + 10, f"prose of the usual kind {s} and more", "src1") for k, s in enumerate(keys)]
    found = {(r.doc_id, r.start, r.end) for r in scan_secrets(frame(spark, rows)).where("is_secret").collect()}
    assert found == {(i, t.index(keys[i % 10]), t.index(keys[i % 10]) + len(keys[i % 10])) for i, t, _ in rows}
    assert {r.text for r in mask_secrets(frame(spark, rows)).collect()} == {'The token = "[SECRET]" and more', "prose of the usual kind [SECRET] and more"}
    # the digit may come late, and what begins far into a value is still seen
    assert candidates("a " + "k" * 90 + "7xyz b") == [(2, 96, False)]
    text = "token=" + "v" * (HEAD + 50) + f",password={KEY}"
    assert candidates(text) == [(6, len(text), True), (len(text) - len(KEY), len(text), True)]


def test_scored_as_by_spark(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tidemark.llm.secrets import Scorer

    forest, language = fit_forest(spark)
    x = [features(language, *f[:5]) for f in labelled_findings(200, seed=5)]
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x array<double>").withColumn("features", array_to_vector("x"))
    want = [r.p for r in forest.transform(data).orderBy("i").select(vector_to_array("probability")[1].alias("p")).collect()]
    assert np.abs(Scorer(forest)(np.array(x)) - want).max() < 1e-12


def test_masked_row_by_row(spark):
    clean = "plain prose of the usual kind that is long enough to hold the span of any other row " * 2
    rows = [(None, f'The token = "{KEY}" and more', "src1"), (None, clean, "src1"), (None, "short", "src1"), (7, f'in the middle the token = "{KEY}"', "src1"), (7, clean, "src1"), (7, f'The token = "{KEY}" and more', "src1")]
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in mask_secrets(frame(spark, rows)).collect())
    want = sorted((i or 0, t.replace(KEY, "[SECRET]"), len(t.replace(KEY, "[SECRET]"))) for i, t, _ in rows)
    assert got == want


def test_many_in_one_text():
    import random
    import time

    from tidemark.llm import secrets

    text, began = "".join(f'token = "abcd{i}efghijkl0123456789"\n{i}abcdefghijklmnopqrstuvw and more\n' for i in range(60_000)), time.perf_counter()
    got = secrets.candidates(text)
    assert time.perf_counter() - began < 20 and sum(a for *_, a in got) == 60_000 and len(got) == 120_000
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(['token = "', "secret:", "x" * 30 + "1", "a1" * 15, " ", '"', "\n", "key", "/" * 12, "z9" * 120]) for _ in range(rng.randrange(20)))
        got = secrets.candidates(text)
        heads = [(a, min(b, a + secrets.HEAD)) for a, b, assigned in got if assigned]
        runs = [m.span() for m in secrets._LONG.finditer(text)]
        assert [(a, b) for a, b, assigned in got if not assigned] == [(a, b) for a, b in runs if not any(x < b and a < y for x, y in heads)]
