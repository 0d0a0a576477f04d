"""MinHash near-dedup: BagMinHash signatures of word shingles, banded, then multiset overlap verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, arrow_map, bounded_batches, count_pieces, cut, drop_cut, mix64, spread_join, texts_of, windows
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: 26 bands of 5: two documents at similarity 0.8 share no band once in 30,000 pairs, at 0.9 once in 10**10.
BANDS, ROWS = 26, 5
#: Documents, and characters of text, that are verified against one another in one task, about.
TOGETHER, CHARS = 512, 4 << 20
_SHINGLE_BASE = 0xD6E8FEB86659FD93
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _times(n: int) -> np.uint64:
    """n times the golden constant, modulo 2**64."""
    return np.uint64(n * int(_GOLD) % (1 << 64))


def bags(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, count) of the multisets of k-word shingles, in the order of owner and shingle.

    A text of fewer than k words has one shingle of all of them; one without words has none.
    """
    w = Words(texts)
    hashes, n = w.hashes(), np.diff(w.first)
    all_ = windows(hashes, k, _SHINGLE_BASE)
    inside = w.doc[: len(all_)] == w.doc[k - 1 :] if len(all_) else np.empty(0, bool)
    owner, shingle = [w.doc[: len(all_)][inside]], [all_[inside]]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        owner.append(np.array([i]))
        shingle.append(windows(hashes[w.first[i] : w.first[i + 1]], int(n[i]), _SHINGLE_BASE) ^ np.uint64(n[i]))
    owner, shingle = np.concatenate(owner).astype(np.int64), np.concatenate(shingle)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.flatnonzero(np.r_[len(owner) > 0, (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])][: len(owner)])
    return owner[new], shingle[new], np.diff(np.r_[new, len(owner)])


def signatures(owner, shingle, count, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n, m) BagMinHash signatures; two agree in a place with the probability of the bags' weighted Jaccard similarity.

    Each shingle has a Poisson process of points over time and weight; a bag sees those under its count. Weights are
    discretised into [0, 1), [1, 2), [2, 4), [4, 8) and so on, each with its own process, so a count takes log2 of
    itself processes; of the last, only points under the count stay. A point falls on one of the m places at random, and each place keeps its first
    point. Processes are run by rounds, the next point of each, and only up to a time by which all
    places of the bag are likely to be hit; bags for which they are not go on to twice that time.
    """
    out = np.zeros((n, m), np.uint64)
    if not len(owner):
        return out
    level = [(owner, shingle, np.zeros(len(owner)), np.ones(len(owner)), count)]
    low = 1
    while (more := np.flatnonzero(count > low)).size:
        tag = mix64(shingle[more] + _times(low))
        level.append((owner[more], tag, np.full(len(more), float(low)), np.full(len(more), float(low)), count[more]))
        low *= 2
    owner, shingle, floor, width, most = (np.concatenate(x) for x in zip(*level))
    weight = np.bincount(owner, np.minimum(most - floor, width), n)
    until = (np.log(m) + 3.0) / np.maximum(weight, 1e-9)
    best = np.full(n * m, np.inf)
    todo = np.bincount(owner, minlength=n) > 0
    while todo.any():
        mine = todo[owner]
        o, s, fl, wd, mo = (x[mine] for x in (owner, shingle, floor, width, most))
        best.reshape(n, m)[todo] = np.inf
        time, r = np.zeros(len(o)), 0
        hits = []
        while len(o):
            r += 1
            h = mix64(s + _times(r))
            u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(u) / (wd * m)
            go = time <= until[o]
            o, s, fl, wd, mo, time, h = (x[go] for x in (o, s, fl, wd, mo, time, h))
            h2 = mix64(h + _GOLD)
            under = fl + (h2 >> np.uint64(32)).astype(np.float64) * 2.0**-32 * wd < mo
            place = o * m + ((h2 & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, place[under], time[under])
            hits.append((place[under], time[under], h[under]))
        for place, t, h in hits:
            first = best[place] == t
            out.reshape(-1)[place[first]] = h[first]
        todo &= ~np.isfinite(best.reshape(n, m)).all(1)
        until[todo] *= 2
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) 64-bit keys; documents with an equal key in a band are candidates."""
    with np.errstate(over="ignore"):
        h = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1).astype(np.uint64)
        for j in range(rows):
            h = mix64(h * _GOLD + sig[:, j::rows][:, :bands])
    return h.view(np.int64)


def links_within(texts: list[bytes], ids: np.ndarray, part: np.ndarray | None = None, similarity: float = SIMILARITY) -> tuple[list, list]:
    """Links that hold the groups of near-duplicates together: of all pairs that share a band and are similar, a spanning forest.

    Each document in turn is compared with all candidates that are not yet in its group, by one pass over their bags.
    part: 0 or 1 for each text; only pairs of different parts, or all where there is one part, are compared.
    """
    owner, shingle, count = bags(texts)
    n = len(texts)
    keys = band_keys(signatures(owner, shingle, count, n))
    total = np.bincount(owner, count, n)
    keys[total == 0] = 0
    first = np.searchsorted(owner, np.arange(n + 1))
    names, code = np.unique(shingle, return_inverse=True)
    flag = np.zeros(len(names), np.int64)
    group = np.arange(n)
    a, b = [], []
    for i in range(n):
        if not total[i]:
            continue
        near = (keys[i + 1 :] == keys[i]).any(1) & (group[i + 1 :] != group[i]) & (total[i + 1 :] > 0)
        least = np.minimum(total[i], total[i + 1 :]) >= similarity * np.maximum(total[i], total[i + 1 :])
        near &= least
        if part is not None:
            near &= part[i + 1 :] != part[i]
        others = np.flatnonzero(near) + i + 1
        if not len(others):
            continue
        flag[code[first[i] : first[i + 1]]] = count[first[i] : first[i + 1]]
        sizes = first[others + 1] - first[others]
        at = np.repeat(first[others] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        common = np.add.reduceat(np.minimum(flag[code[at]], count[at]), np.cumsum(sizes) - sizes)
        flag[code[first[i] : first[i + 1]]] = 0
        for j in others[common >= similarity * (total[i] + total[others] - common) - 1e-9].tolist():
            if group[j] != group[i]:
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                group[group == group[j]] = group[i]
    return a, b


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """-> doc_id, class_id, n_class, kept: a row per document; class_id is the smallest doc_id of its near-duplicates.

    Documents are linked if their multisets of 5-word shingles have a weighted Jaccard similarity of 0.8 or more; classes
    are the components of the links; kept marks one of each. Words are split at ASCII white space and not changed; a
    document of 1 to 4 words has one shingle. Documents without words, or with a null text, are alone. Rows of one doc_id
    are one document with the text whose md5 sorts first; rows with a null doc_id are left out. Other columns are ignored.

    Equal texts are put together by hash first, and bands of one of them go on. (All are signed where they are read: to part them
    before would move every text once.) Bands that more than one document has
    link those documents with the smallest of them; the components of that are candidate groups, far smaller than
    the input and sent, with their texts, to the tasks that verify them. A group over about 512 documents or 4 MB is cut
    into chunks, and each pair of chunks is a task of its own; so no group has to fit one task, and no pair is left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    said = own.where(F.col("text").rlike(WORD)).select("doc_id", "text", F.md5("text").alias("_md5"))
    # one document for each text
    of_text = cut(said.groupBy("doc_id").agg(F.min(F.struct("_md5", F.length("text").alias("_chars"))).alias("_of")).select("doc_id", "_of._md5", "_of._chars"), "texts")
    first = cut(of_text.groupBy("_md5").agg(F.min("doc_id").alias("_rep"), F.count("*").alias("_n")), "first")

    def sign(batch):
        texts = texts_of(batch)
        keys = band_keys(signatures(*bags(texts), len(texts)))
        return {"doc_id": np.repeat(batch.column("doc_id").to_numpy(), BANDS), "key": keys.reshape(-1)}

    # one document of each text goes on; were two rows of one doc_id to differ, the bands of both would only add candidates
    bands = cut(arrow_map(said.select("doc_id", "text"), sign, "doc_id long, key long", pieces=1 << 20).join(first.select(F.col("_rep").alias("doc_id")), "doc_id", "left_semi"), "bands")
    shared = cut(bands.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("_n")).where("least < most").select("key", "least", "_n"), "shared")
    candidate = connected_components(spread_join(bands, shared, ["key"], "doc_id", bands.count()).select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    drop_cut(bands)
    drop_cut(shared)
    chosen = cut(candidate.select(F.col("id").alias("doc_id"), F.col("component").alias("_group")).join(of_text, "doc_id"), "chosen")
    sizes = chosen.groupBy("_group").agg(F.count("*").alias("_n"), F.sum("_chars").alias("_sum"))
    sizes = cut(sizes.withColumn("_chunks", F.greatest(F.ceil(F.col("_n") / TOGETHER), F.ceil(F.col("_sum") / CHARS)).cast("int")), "sizes")
    small = sizes.where("_chunks = 1").agg(F.sum("_n"), F.sum("_sum")).first()
    packs = max(count_pieces(small[0] or 0, TOGETHER), count_pieces(small[1] or 0, CHARS))
    sized = spread_join(chosen, sizes.select("_group", "_chunks", "_n"), ["_group"], "doc_id", chosen.count()).withColumn("_c", F.pmod(F.xxhash64("doc_id"), F.col("_chunks")).cast("int"))
    task = lambda g, i, j, part: F.struct(g.cast("long").alias("_g"), i.alias("_i"), j.alias("_j"), part.alias("_part"))
    packed = F.array(task(F.pmod(F.xxhash64("_group"), F.lit(packs)), F.lit(-1), F.lit(-1), F.lit(0)))
    # chunk c meets every other: the tasks (i, j) with i <= j in which it is
    meets = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda o: task(F.col("_group"), F.least("_c", o), F.greatest("_c", o), F.when(F.col("_c") > o, 1).otherwise(0)))
    tasks = sized.select("doc_id", "_md5", F.when(F.col("_chunks") == 1, packed).otherwise(meets).alias("_tasks"))
    # the one join that moves texts; never by broadcast, as the number of candidates has no bound
    members = said.join(tasks.hint("shuffle_hash"), ["doc_id", "_md5"]).dropDuplicates(["doc_id", "_md5"]).select("doc_id", "text", F.inline("_tasks"))

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = (table.column(c)[0].as_py() for c in ("_i", "_j"))
        part = table.column("_part").to_numpy() if i != j else None
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        a, b = links_within(texts, table.column("doc_id").to_numpy(), part, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = members.groupBy("_g", "_i", "_j").applyInArrow(verify, "a long, b long")
    classes = connected_components(links).select(F.col("id").alias("_rep"), F.col("component").alias("_class"))
    by_text = cut(first.join(classes, "_rep", "left").select("_md5", "_n", F.coalesce("_class", "_rep").alias("class_id")), "by_text")
    n = cut(by_text.groupBy("class_id").agg(F.sum("_n").alias("n_class"), F.count("*").alias("_n")), "n")
    sized = spread_join(by_text.withColumnRenamed("_n", "_of_text"), n, ["class_id"], "_md5", by_text.count()).withColumnRenamed("_of_text", "_n")
    named = spread_join(of_text, cut(sized, "sized"), ["_md5"], "doc_id", of_text.count()).select("doc_id", "class_id", "n_class")
    out = cut(own.select("doc_id").distinct().join(named, "doc_id", "left"), "classes")
    for table in (of_text, first, by_text, n, chosen, sizes):
        drop_cut(table)
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"), (F.col("doc_id") == class_id).alias("kept"))
