import zlib

import numpy as np

from tidemark.llm.quality import WIDTH, GatedAttention, fit_quality, passages, score_quality

from .data import TEXTS, frame, odd_rows


def test_gradients():
    r = np.random.default_rng(0)
    x, owner, y = r.normal(size=(9, WIDTH)) / 2, np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    m = GatedAttention()
    weight = np.array([1.0, 2, 1, 2])

    def loss():
        s = m.forward(x, owner, 4)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    for name, g in m.step(x, owner, y, weight).items():
        at = (1, 2)[: g.ndim] if g.size > 1 else (0,)
        kept = m.p[name][at]
        m.p[name][at] = kept + 1e-6
        up = loss()
        m.p[name][at] = kept - 1e-6
        assert abs(g[at] - (up - loss()) / 2e-6) < 1e-5
        m.p[name][at] = kept


def test_passages_do_not_depend_on_the_batch():
    texts = [b"one two two THREE!!", b"", b"x" * 3000, "é ☃ a|b".encode()]
    x, owner = passages(texts)
    for i, t in enumerate(texts):
        assert np.allclose(passages([t])[0], x[owner == i])


def test_held_out_accuracy(spark):
    folder = TEXTS.rpartition("/")[0].replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, 1500)
    rows = score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.99


def test_attention_finds_a_bad_passage(spark):
    """Junk of held-out bad documents, planted in long held-out good ones: found by where attention looks, and not without it."""
    folder = TEXTS.rpartition("/")[0].replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    rows = docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("text", "quality").collect()
    good, bad = [r.text for r in rows if r.quality == 1 and len(r.text) > 6000], [r.text for r in rows if r.quality == 0 and len(r.text) > 1500]
    r = np.random.default_rng(0)
    texts, places = [], []
    for g in good:
        b, at = bad[int(r.integers(len(bad)))], int(r.integers(len(g)))
        texts.append(f"{g[:at]} {b[:1500]} {g[at:]}".encode())
        places.append((len(g[:at].encode()), len(g[:at].encode()) + 1500))
    x, owner = passages(texts)
    f = model.forward(x, owner, len(texts))
    assert np.mean(f["score"] < 0.3) > 0.9
    first = np.searchsorted(owner, np.arange(len(texts)))
    top = [int(f["a"][owner == i].argmax()) * 1024 for i in range(len(texts))]
    assert len(first) > 20 and np.mean([a - 1024 < t < b + 600 for t, (a, b) in zip(top, places)]) > 0.8
    whole = model.forward(*passages([g.encode() for g in good]), len(good))
    assert np.mean(whole["score"] >= 0.3) > 0.98
    model.p["w"] = model.p["w"] * 0
    assert np.mean(model.forward(x, owner, len(texts))["score"] < 0.3) < 0.5


def test_an_id_with_many_rows_is_learned_from_once(spark, monkeypatch):
    from tidemark.llm import quality

    seen = []
    monkeypatch.setattr(quality.GatedAttention, "fit", lambda self, x, owner, y, **_: seen.append((len(x), len(y))) or self)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], f"text {k}", "a") for k in range(3000)] + [(i, "word " * (3_000 if i == ids[1] else 60 * 1024), "a") for i in ids[1:]]
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)] + [(ids[1], 1, 0)] * 5, "doc_id long, quality int, toxic int")
    fit_quality(frame(spark, rows), labels)
    fit_quality(frame(spark, rows), labels, 12)
    for (n_passages, n_bags), most in zip(seen, (len(ids), 12)):
        assert n_bags <= most + most and n_passages <= n_bags * (quality.BAG + 1)
    assert len(seen) == 2 and seen[0][1] >= len(ids)


def test_odd_rows(spark):
    rows = odd_rows()
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (None, 1, 0), (6, None, None), (7, 1, 0), (7, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, clashing=True)
    got = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all((r.held_out is None) == (r.doc_id is None) for r in got)
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert score_quality(frame(spark, []), None).count() == 0
