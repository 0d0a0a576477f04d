"""Substring dedup by level-wise doubling: only windows that are repeated at one length are looked at at twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, bounded_batches, cut, drop_cut, spread_join, texts_of, windows

WINDOW = 50
#: Past the end of any document.
_END = 1 << 30
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def levels(window: int) -> list[int]:
    """Lengths from the shortest to the window's; each is twice the one before, the last as long as the window."""
    out = [window]
    while len(out) < 2 or out[0] > 25:
        out.insert(0, (out[0] + 1) // 2)
    return out


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """-> doc_id, n_words, n_removed, kept_sha256, kept_text: words that are covered by a window which a smaller doc_id has too are removed.

    Words are what ASCII white space parts, unchanged. Windows are judged on the input. kept_text is the kept words,
    joined by one space, for documents that lost words and null for the rest, which are kept as they are (but for the
    white space that kept_sha256 is made of). Null texts have no words. Rows with a null doc_id are never removed
    from and remove nothing. Rows of one doc_id are each judged against smaller ids (were
    their texts to differ, each by itself). Other columns are ignored.

    Of rows with equal texts all but those of the smallest doc_id lose every word, if there are as many as a window has, and need no windows of
    their own. Level 1: of the windows of half the length within each full window, the one with the smallest hash stands for it. Equal
    windows choose alike, wherever they are, so a full window can only be repeated if its choice is; and as neighbours mostly choose the same,
    there are 13 times fewer choices than windows. Choices that only one text has end here. Next level, twice as long: windows around the
    choices that are left are hashed in full (128 bits), and the smallest doc_id of each is found. Longer windows than 50 go through more levels,
    each of which keeps only windows whose two halves are repeated. Groups are aggregated before they are shuffled, and joins back deal the rows of a frequent window over many tasks (spread_join).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # equal texts, and rows of one doc_id, are told apart by a hash of their texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_t"))
    steps = levels(window)
    of_text = cut(rows.where("doc_id is not null").select("doc_id", "_t", F.md5("text").alias("_md5")).distinct(), "texts")
    first = cut(of_text.groupBy("_md5").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "first")
    copies = cut(spread_join(of_text, first, ["_md5"], "doc_id", of_text.count()).where("doc_id > _first").select("doc_id", "_t"), "copies")
    drop_cut(of_text)
    drop_cut(first)
    ranges = _level_one(rows.where("doc_id is not null"), steps).join(copies, ["doc_id", "_t"], "left_anti")
    for length in steps[1:]:
        ranges = _level(rows, ranges, length, last=length == window)
    covered = ranges.unionByName(copies.select("doc_id", "_t", F.array(F.struct(F.lit(0).alias("first"), F.lit(_END).alias("last"))).alias("_ranges")))

    def cutting(batch):
        n, gone, sha, kept, same = [], [], [], [], []
        for t, ranges_ in zip(texts_of(batch), batch.column("_ranges").to_pylist()):
            words = t.split()
            off = np.zeros(len(words) + 1, np.int32)
            for r in ranges_:
                if r["first"] + window <= len(words):
                    off[r["first"]] += 1
                    off[min(len(words), r["last"] + window)] -= 1
            dead = np.cumsum(off)[:-1] > 0
            left = b" ".join(w for w, d in zip(words, dead.tolist()) if not d)
            n.append(len(words))
            gone.append(int(dead.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "replace"))
        return {"doc_id": batch.column("doc_id"), "n_words": n, "n_removed": gone, "kept_sha256": sha, "kept_text": kept}

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def untouched(batch):
        texts = [b" ".join(t.split()) for t in texts_of(batch)]
        return {"doc_id": batch.column("doc_id"), "n_words": [t.count(b" ") + 1 if t else 0 for t in texts], "n_removed": [0] * len(texts), "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "kept_text": [None] * len(texts)}

    def both(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        hit = pc.is_valid(batch.column("_ranges"))
        parts = [(f(batch.filter(m)) if pc.any(m).as_py() else None) for f, m in ((cutting, hit), (untouched, pc.invert(hit)))]
        out = {}
        for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"):
            values = []
            for p in parts:
                if p:
                    values += p[c].to_pylist() if isinstance(p[c], pa.Array) else p[c]
            out[c] = values
        return out

    return arrow_map(rows.join(covered, ["doc_id", "_t"], "left"), both, schema, pieces=1 << 20)


def _level_one(rows: DataFrame, steps: list[int]) -> DataFrame:
    """doc_id, _t, _ranges: starts of windows of steps[1] words whose chosen part is in another text too."""
    half, full = steps[0], steps[1]

    def choose(batch):
        w = Words(texts_of(batch))
        h = windows(w.hashes(), half, _BASES[0])
        n, span = len(w.doc), full - half + 1
        if n < full:
            return None
        starts = np.flatnonzero(w.doc[: n - full + 1] == w.doc[full - 1 :])
        if not len(starts):
            return None
        at = starts + _argmin(h, span)[starts]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
        end = np.r_[new[1:], len(starts)] - 1
        doc = w.doc[starts[new]]
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        return {"key": h[at[new]].view(np.int64), "doc_id": ids[doc], "_t": batch.column("_t").to_numpy()[doc], "first": (starts[new] - w.first[doc]).astype(np.int32), "last": (starts[end] - w.first[doc]).astype(np.int32)}

    chosen = cut(arrow_map(rows, choose, "key long, doc_id long, _t long, first int, last int", pieces=1 << 20), "choices")
    repeated = cut(chosen.groupBy("key").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count("*").alias("_n")).where("_a < _b").select("key", "_n"), "repeated")
    out = cut(spread_join(chosen, repeated, ["key"], "_t", chosen.count(), "left_semi").groupBy("doc_id", "_t").agg(F.collect_set(F.struct("first", "last")).alias("_ranges")), "ranges")
    drop_cut(chosen)
    drop_cut(repeated)
    return out


def _argmin(h: np.ndarray, span: int) -> np.ndarray:
    """Offset of the leftmost smallest of the next ``span`` values, for each place; by doubling."""
    best, at, size = h.copy(), np.zeros(len(h), np.int64), 1
    while size < span:
        step = min(size, span - size)
        a, b = best[: len(best) - step], best[step:]
        later = b < a
        at = np.where(later, at[step:] + step, at[: len(at) - step])
        best = np.where(later, b, a)
        size += step
    return at


def _level(rows: DataFrame, ranges: DataFrame, length: int, last: bool) -> DataFrame:
    """doc_id, _t, _ranges: of the candidates ``ranges``, the starts of windows of ``length`` that are repeated: at the last level those that a smaller doc_id has, before it those that any other doc_id has."""

    def hash_all(batch):
        w = Words(texts_of(batch))
        base = w.hashes()
        a, b = windows(base, length, _BASES[0]), windows(base, length, _BASES[1])
        starts, owner = [], []
        for i, rs in enumerate(batch.column("_ranges").to_pylist()):
            flags = np.zeros(int(w.first[i + 1] - w.first[i]) + 1, np.int32)
            most = len(flags) - 1 - length
            for r in rs:
                if r["first"] <= most:
                    flags[r["first"]] += 1
                    flags[min(r["last"], most) + 1] -= 1
            s = np.flatnonzero(np.cumsum(flags) > 0)
            starts.append(s + w.first[i])
            owner.append(np.full(len(s), i))
        s, o = np.concatenate(starts).astype(np.int64), np.concatenate(owner).astype(np.int64)
        ids, t = batch.column("doc_id").to_numpy(), batch.column("_t").to_numpy()
        # half of the text's hash and the start in one number
        return {"a": a[s].view(np.int64), "b": b[s].view(np.int64), "doc_id": ids[o], "at": (t[o] << 32) | (s - w.first[o])}

    hashed = cut(arrow_map(rows.join(ranges, ["doc_id", "_t"]), hash_all, "a long, b long, doc_id long, at long", pieces=1 << 20), "windows")
    seen = hashed.groupBy("a", "b").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"), F.count("*").alias("_n")).where("_least < _most").drop("_most")
    seen = cut(seen, "repeated")
    kept = spread_join(hashed, seen, ["a", "b"], "doc_id", hashed.count())
    if last:
        kept = kept.where("doc_id > _least")
    start = F.col("at").bitwiseAND(0xFFFFFFFF).cast("int")
    found = kept.groupBy("doc_id", F.shiftright("at", 32).alias("_half")).agg(F.collect_set(F.struct(start.alias("first"), start.alias("last"))).alias("_ranges"))
    named = ranges.select("doc_id", "_t", F.shiftright(F.shiftleft("_t", 32), 32).alias("_half"))
    out = cut(found.join(named, ["doc_id", "_half"]).select("doc_id", "_t", "_ranges"), "ranges")
    drop_cut(hashed)
    drop_cut(seen)
    return out
