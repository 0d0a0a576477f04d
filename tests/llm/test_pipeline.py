from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, quality
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.queries import ORACLE, QUERIES

from .data import TEXTS

FOLDER = TEXTS.rpartition("/")[0]


def test_stages(spark):
    docs = spark.read.parquet(TEXTS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        rows = spark.createDataFrame(out.collect(), out.schema)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert rows.count() <= docs.count() and rows.select("doc_id").distinct().count() == rows.count()
        if name == "near-duplicates":
            assert near_duplicates(rows).where("not kept").count() == 0
        if name == "secret scans":
            assert rows.count() == docs.count() and rows.where("text rlike 'token = .[0-9a-f]{40}'").count() == 0
        docs = rows
    assert docs.count() > 0


def test_filters_agree_with_what_the_operators_find(spark, monkeypatch):
    docs, bench = spark.read.parquet(TEXTS), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaks = {r.doc_id for r in decontam.find_leaks(docs, bench).collect()}
    every = {r.doc_id for r in docs.collect()}
    assert leaks and {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == every - leaks
    monkeypatch.setattr(decontam, "BLOCK", 20_000)
    assert {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == every - leaks
    model = quality.fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    assert 0 < len(good) < len(every) and {r.doc_id for r in quality.keep_quality(docs, model).collect()} == good
    assert quality.keep_quality(docs, None).count() == len(every)


def test_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_rows_by_themselves(spark):
    """Rows that share a doc_id, or have none, are judged one by one."""
    from .data import frame

    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 150").first()["text"]
    clean = "quite other words that no item holds and no other row repeats"
    rows = [(None, f"before {item} after", "s"), (None, clean, "s"), (5, f"well {item} there", "s"), (5, clean + " at all", "s")]
    got = corpus_pipeline.decontamination_stage(spark, frame(spark, rows), FOLDER).collect()
    assert sorted(r.text for r in got) == [clean, clean + " at all"]
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, long, "s"), (None, long, "s"), (9, long, "s"), (4, long + " end", "s"), (4, "one of its own", "s"), (None, "alone", "s"), (None, None, "s")]
    got = corpus_pipeline.near_dup_stage(spark, frame(spark, rows), FOLDER).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("4", long + " end"), ("4", "one of its own"), ("None", "alone"), ("None", "None")])
    docs = spark.read.parquet(TEXTS)
    want = {r.text for r in corpus_pipeline.quality_stage(spark, docs, FOLDER).collect()}
    model = quality.fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scored = quality.score_quality(docs, model).where("predicted = 1").select("doc_id")
    assert want == {r.text for r in docs.join(scored, "doc_id").collect()}


def similar(a, b):
    """Weighted Jaccard similarity of two multisets."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_whole_pipeline_against_plain_python(spark, tmp_path):
    """All stages over the smallest table, with a secret in each ninth document, each done again for one document, pair or packet at a time."""
    import re
    from collections import Counter

    import duckdb
    import numpy as np
    import pandas as pd
    from pyspark.ml.linalg import Vectors

    from tidemark.llm import mixing, secrets
    from tidemark.llm.decontam import EDITS, codes_of, normalised

    def nearest(pattern, text):
        """The least edit distance of the pattern from any region of the text; each row of the table at once."""
        t, place = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
        row = np.zeros(len(text) + 1, np.int64)
        for i, c in enumerate(pattern, 1):
            best = np.minimum(row[:-1] + (t != c), row[1:] + 1)
            row = np.minimum.accumulate(np.r_[i, best] - place) + place
        return int(row.min())

    folder = str(tmp_path)
    planted = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('" and so on'))).otherwise(F.col("text"))
    spark.read.parquet(TEXTS).withColumn("text", planted).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = lambda t: model.forward(*quality.passages([(t or "").encode()]), 1)["score"][0]
    left = {i: r.text for i, r in rows.items() if score(r.text) >= 0.3}
    # near-duplicates: all pairs
    words = {i: (t or "").encode().split() for i, t in left.items()}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items() if w}
    group = {i: i for i in left}
    for a in sorted(bags):
        for b in sorted(bags):
            if a < b and group[a] != group[b] and similar(bags[a], bags[b]) >= 0.8:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    left = {i: left[i] for i in left if group[i] == i}
    # contamination: the nearest region of each document by dynamic programming, in the items' own characters
    plain = lambda t: bytes(normalised(codes_of(t))[0].astype("uint8")).strip()
    items = [p for p in (plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()) if p]

    def leaks(text):
        t = plain(text)
        some = [p for p in items if p in t]
        pieces = {t[k : k + 8] for k in range(len(t))}
        # an item within its budget of some region shares at least one of its pieces of 8 that don't overlap with the text, if it has more pieces than edits
        near = [p for p in items if len(p) // 8 <= int(EDITS * len(p)) or any(p[k : k + 8] in pieces for k in range(0, len(p) - 7, 8))]
        return bool(some) or any(nearest(p, t) <= int(EDITS * len(p)) for p in near)

    left = {i: t for i, t in left.items() if t is None or not leaks(t)}
    # secrets: each candidate by Spark's own forest
    forest, language = secrets.fit_forest(spark)
    for i, t in left.items():
        out, at = [], 0
        for a, b, assigned in secrets.candidates(t) if t else ():
            x = secrets.features(language, t[a:b], t[max(0, a - secrets.AROUND) : a], t[b : b + secrets.AROUND], rows[i].source, assigned)
            if forest.predictProbability(Vectors.dense(x))[1] >= 0.5:
                if a >= at:
                    out += [t[at:a], secrets.MASK]
                at = max(at, b)
        left[i] = "".join(out) + t[at:] if out else t
    assert 50 < len(left) < len(rows) and sum(secrets.MASK in (t or "") for t in left.values()) > 5
    # the mix: all packets in one order, by SQL
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, rows[i].source) for i, t in left.items()], columns=["doc_id", "text", "source"]))
    want = {i: n for i, n in con.execute(f"SELECT doc_id, taken FROM ({mixing.ORACLE})").fetchall() if n}
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.taken
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", left[r.doc_id] or ""))
    assert got == want and np.mean(list(got.values())) > 10
