"""Quality classifier: gated attention over passages (multiple-instance learning), trained in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_filter, arrow_map, mix64, powers, texts_of

#: Bytes of a passage; the last of a text is shorter.
PASSAGE = 1024
#: At most so many labelled documents are learned from, those whose id hashes lowest, and of each so many passages, spread evenly: it bounds what the driver gets to 70 MB.
SAMPLE, BAG = 3000, 64
#: Words are hashed into so many features.
HASHED = 64
_CLASSES = ["a-z", "A-Z", "0-9", " ", "\n", ".,;", "!", "?", "|", "#", "$", "%", "&", "*", "'\"", "()[]{}<>", "@+=_/\\-", "other ASCII", "beyond ASCII", "aeiou"]


def _table() -> np.ndarray:
    """Class of each byte."""
    table = np.full(256, 17, np.uint8)
    table[128:] = 18
    for k, chars in enumerate(_CLASSES[:17]):
        members = [*range(ord(chars[0]), ord(chars[2]) + 1)] if len(chars) == 3 and chars[1] == "-" else [ord(c) for c in chars]
        table[members] = k
    return table


TABLE = _table()
SHAPES = 18 + 1 + 5
WIDTH = SHAPES + HASHED


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What is known of each passage (rows of features) and the text that it is from. An empty text has one, all zeros but the last.

    Features: shares of the byte classes, of words that are said again, and the like; and the words themselves, hashed with a sign into HASHED sums. All are counted for all passages at once.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-lengths // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), n)
    # a space after each text, so that no word runs on into the next; it is counted nowhere
    b = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.empty(0, np.uint8)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(PASSAGE, np.repeat(lengths, n) - place * PASSAGE)
    kind = TABLE[b]
    out = np.zeros((len(owner), WIDTH))
    if len(b) > len(texts):
        after = size.copy()
        after[np.cumsum(n) - 1] += 1
        rows = np.repeat(np.arange(len(owner)), after)
        counts = np.bincount(rows * 20 + kind, minlength=len(owner) * 20).reshape(-1, 20)[:, :19]
        counts[np.cumsum(n) - 1, 3] -= 1
        out[:, :19] = np.sqrt(counts / np.maximum(size, 1)[:, None])
        space = kind == 3
        edge = np.flatnonzero(np.diff((space | (kind == 4)).view(np.int8), prepend=np.int8(1)))
        s, e = edge[0::2], edge[1::2]
        up, down = powers(0x9E3779B97F4A7C15, len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        words = mix64((sums[e] - sums[s]) * down[s])
        at = rows[s]
        n_words = np.maximum(np.bincount(at, minlength=len(owner)), 1)
        again = np.zeros(len(s), bool)
        again[1:] = words[1:] == words[:-1]
        out[:, 19] = np.bincount(at, again, len(owner)) / n_words
        # different words of a passage
        order = np.lexsort((words, at))
        new = np.ones(len(s), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (at[order][1:] != at[order][:-1])
        out[:, 20] = np.bincount(at[order], new, len(owner)) / n_words
        out[:, 21] = np.minimum(4, np.bincount(at, e - s, len(owner)) / n_words / 8)
        last = kind[e - 1]
        bucket = at * HASHED + (words & np.uint64(HASHED - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((words >> np.uint64(40)) & np.uint64(1)).astype(float)
        out[:, SHAPES:] = np.bincount(bucket, sign, len(owner) * HASHED).reshape(-1, HASHED) / np.sqrt(n_words)[:, None] / 4
        out[:, 22] = np.bincount(at, (last >= 8) & (last <= 13), len(owner)) / n_words
    out[:, 23] = np.log1p(np.maximum(size, 0)) / 8
    return out, owner


class GatedAttention:
    """h = tanh(W x); attention over a document's passages = softmax of w . (tanh(V h) * sigmoid(U h)); score = sigmoid(c . sum a h + d)."""

    def __init__(self, width: int = WIDTH, hidden: int = 12, gate: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"W": r.normal(0, 0.4, (width, hidden)), "b": np.zeros(hidden), "V": r.normal(0, 0.4, (hidden, gate)), "U": r.normal(0, 0.4, (hidden, gate)), "w": r.normal(0, 0.4, gate), "c": r.normal(0, 0.4, hidden), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        z = (t * s) @ p["w"]
        first = np.searchsorted(owner, np.arange(n))
        top = np.maximum.reduceat(z, first)
        a = np.exp(z - top[owner])
        a /= np.add.reduceat(a, first)[owner]
        pooled = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "a": a, "pooled": pooled, "score": 1 / (1 + np.exp(-(pooled @ p["c"] + p["d"])))}

    def step(self, x, owner, y, weight) -> dict:
        """Gradients of the weighted log loss."""
        f, p = self.forward(x, owner, len(y)), self.p
        d = (f["score"] - y) * weight / len(y)
        g = {"c": f["pooled"].T @ d, "d": d.sum(keepdims=True)}
        back = np.outer(d, p["c"])[owner]
        da = (back * f["h"]).sum(1)
        mean = np.bincount(owner, f["a"] * da, len(y))
        dz = f["a"] * (da - mean[owner])
        g["w"] = (f["t"] * f["s"]).T @ dz
        dts = np.outer(dz, p["w"])
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * back + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        return g

    def fit(self, x, owner, y, rounds: int = 240, rate: float = 0.02, decay: float = 1e-4, share: float | None = None) -> GatedAttention:
        """Adam over all documents at once; both labels weigh the same in sum, but the scale is set back to the share of the labels (that of y where none is given) afterwards."""
        y = np.asarray(y, float)
        own = min(max(y.mean(), 1e-3), 1 - 1e-3)
        share = own if share is None else min(max(share, 1e-3), 1 - 1e-3)
        weight = np.where(y == 1, 0.5 / own, 0.5 / (1 - own))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, rounds + 1):
            for k, g in self.step(x, owner, y, weight).items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.99**i)) + 1e-8)
        # half of the shift to the labels' own odds
        self.p["d"] = self.p["d"] + 0.5 * np.log(share / (1 - share))
        return self


def mixed(x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags, and for each of label 0 one more of that label: its passage that is most unlike those of label 1, among the passages of a document of label 1.

    Such a bag's label hangs on one passage, so attention has to find it; without them all passages of a bag say the same and it would learn nothing.
    """
    r, first = np.random.default_rng(seed), np.searchsorted(owner, np.arange(len(y) + 1))
    bad, good = np.flatnonzero(y == 0), np.flatnonzero((y == 1) & (np.diff(first) > 1))
    if not len(bad) or not len(good):
        return x, owner, y
    of_good = x[(y == 1)[owner]]
    mean, spread = of_good.mean(0), of_good.std(0) + 1e-2
    xs, owners = [x], [owner]
    for k, (b, g) in enumerate(zip(bad, r.choice(good, len(bad)))):
        passages_of = x[first[b] : first[b + 1]]
        odd = passages_of[int(((((passages_of - mean) / spread) ** 2)[:, :SHAPES]).sum(1).argmax())]
        bag = np.insert(x[first[g] : first[g + 1]], int(r.integers(first[g + 1] - first[g] + 1)), odd, axis=0)
        xs.append(bag)
        owners.append(np.full(len(bag), len(y) + k))
    return np.concatenate(xs), np.concatenate(owners), np.r_[y, np.zeros(len(bad), y.dtype)]


def held_out_column():
    return (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedAttention | None:
    """Learns from labelled documents that are not held out; None where there are none with either label.

    A document with contrary labels, or a null label or id, is left out; of an id with several rows one text is taken. ``sample`` bounds the documents learned from, ``BAG`` the passages of each.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_most")).where("_y = _most")
    chosen = known.where(~held_out_column()).select(F.col("doc_id").cast("long").alias("doc_id"), "_y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batch):
        x, owner = passages(texts_of(batch))
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        some = [np.unique(np.linspace(a, b - 1, min(BAG, b - a)).round().astype(np.int64)) for a, b in zip(first, first[1:])]
        return {"doc_id": batch.column("doc_id"), "y": batch.column("_y"), "x": [x[k].astype(np.float32).tobytes() for k in some]}

    each_id = arrow_map(rows, run, "doc_id long, y int, x binary", pieces=4 << 20).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = sorted(each_id.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    each = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH).astype(float) for r in got]
    return GatedAttention().fit(*mixed(np.concatenate(each), np.repeat(np.arange(len(each)), [len(e) for e in each]), y), share=float(y.mean()))


def score_quality(docs: DataFrame, model: GatedAttention | None, threshold: float = 0.3) -> DataFrame:
    """-> doc_id, held_out, score, predicted, n_passages; one row for each input row, and nothing is shuffled.

    The score sees the text alone, the whole of it. Null is as empty; an empty text has one passage without content and so a
    score too. Without a model (no labels to learn from) each score is 0.5. held_out is null for a null doc_id. Other columns are ignored.
    """

    def run(batch):
        x, owner = passages(texts_of(batch))
        n = np.bincount(owner, minlength=batch.num_rows)
        score = model.forward(x, owner, batch.num_rows)["score"] if model else np.full(batch.num_rows, 0.5)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= threshold).astype(np.int32), "n_passages": n.astype(np.int64)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), "text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int, n_passages long", pieces=1 << 20)


def keep_quality(docs: DataFrame, model: GatedAttention | None, threshold: float = 0.3) -> DataFrame:
    """The documents that score_quality does not reject, each row by itself, whatever its doc_id; all without a model. Nothing is shuffled."""
    if model is None:
        return docs

    def keep(batch):
        x, owner = passages(texts_of(batch))
        return model.forward(x, owner, batch.num_rows)["score"] >= threshold

    return arrow_filter(docs, keep, 1 << 20)
