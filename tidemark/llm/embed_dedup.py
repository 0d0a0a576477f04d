"""Embedding near-dedup: an exact metric range join over cells of pivots."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, count_pieces, cut
from .components import connected_components

#: Distinct vectors of a cell, about; pivots are as many as that asks for, up to PIVOTS.
CELL, PIVOTS = 8192, 64
#: Bytes of the vectors that a task compares, at most about: so many of natives with so many of members.
NATIVES, MEMBERS = 8 << 20, 16 << 20


def link_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """-> vec_id, n_links, component_id, kept: one row for each vector, compared with all others by cosine in double precision.

    Vectors of unit length lie within r = sqrt(2 - 2 cosine) of each other exactly if their cosine is high enough. Pivots, drawn
    from the vectors by hash, cut space into cells; a vector is native to the cell of its nearest pivot. By the triangle
    inequality, a vector y can lie within r of a native x of cell p only if d(y, p) <= R(p) + r, with R(p) the
    farthest native; and as x is no farther from p than from any other pivot q, y can lie no deeper than r beyond the plane between p and q: d(y, p)^2 - d(y, q)^2 <= 2 r d(p, q).
    y is sent to the cells for which all that holds, as a member, and to no others. Each cell
    then counts, for its natives, the members within reach; every pair is found in the cell of either end. Cells are cut
    into blocks of natives by blocks of members, so that a task holds a bounded number of bytes however many vectors fall in a cell.

    How far this prunes is up to the vectors. In clusters that are apart, a vector goes to one cell or a few. Of 64-dimensional vectors that point anywhere, all are about
    as far from any pivot as from any other, no triangle tells them apart, and most go to most cells; then the work is that of comparing all with all, in blocks.

    Equal vectors are one, with a count, until the end. What goes on to find components is one row for each
    vector and block, not pairs. Null vectors, those of length zero, and those with null or non-finite components link with nothing; so
    do vectors of different dimensions with one another. Rows with a null vec_id are left out; a repeated
    vec_id counts once, with the vector that sorts first. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    radius = math.sqrt(2 - 2 * cosine) * (1 + 1e-9) + 1e-9
    all_ = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    one = all_.groupBy("vec_id").agg(F.min("e").alias("e"))
    squares = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform("e", lambda x: F.abs(x)))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (largest > 0)
    # scaled by its largest component first, so that squares neither overflow nor vanish
    scaled = one.where(sound).withColumn("e", F.transform("e", lambda x: x / largest)).withColumn("_norm", F.sqrt(squares))
    unit = cut(scaled.select("vec_id", F.transform("e", lambda x: x / F.col("_norm")).alias("e")), "unit")
    same = cut(unit.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    n = same.count()
    wanted = min(PIVOTS, count_pieces(n, CELL))
    chosen = same.select(F.xxhash64("rep").alias("_h"), "e").orderBy("_h").limit(wanted).collect()
    pivots: dict[int, list] = {}
    for row in chosen:
        pivots.setdefault(len(row["e"]), []).append(row["e"])
    points = {dim: _pivots(np.array(p)) for dim, p in pivots.items()}

    def place(batch):
        """The native cell, and the cells that the vector may be a member of, with the distances to their pivots, the native one first; a dimension without pivots is one cell, 0."""
        e, out = batch.column("e").to_pylist(), {"rep": batch.column("rep"), "n": batch.column("n"), "e": batch.column("e")}
        cells = [_cells(np.asarray(x), points.get(len(x)), radius) for x in e]
        return out | {"dim": [len(x) for x in e], "home": [c[0][0] for c in cells], "cells": [c[0] for c in cells], "d": [c[1] for c in cells]}

    placed = cut(arrow_map(same.select("rep", "n", "e"), place, "rep long, n long, e array<double>, dim int, home int, cells array<int>, d array<double>"), "placed")
    blocks_of = lambda n, size: F.ceil(n * F.col("dim") * 8 / size).cast("int")
    reach = placed.groupBy("dim", "home").agg(F.max(F.element_at("d", 1)).alias("far"), F.count("*").alias("n_native"))
    cells = reach.select(F.col("dim").alias("_dim"), F.col("home").alias("_cell"), "far", blocks_of(F.col("n_native"), NATIVES).alias("n_i"))
    sent_to = placed.select("rep", "n", "e", "dim", "home", F.explode(F.arrays_zip(F.col("cells").alias("cell"), "d")).alias("_x")).select("*", "_x.cell", F.col("_x.d").alias("to_pivot")).drop("_x")
    every = sent_to.join(F.broadcast(cells), (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell")))  # at most PIVOTS cells for each dimension
    near = every.where((F.col("home") == F.col("cell")) | (F.col("to_pivot") <= F.col("far") + F.lit(radius)))
    counted = near.groupBy("dim", "cell").agg(blocks_of(F.count("*"), MEMBERS).alias("n_j"))
    blocks = counted.select(F.col("dim").alias("_d"), F.col("cell").alias("_c"), "n_j")
    sent = near.select("rep", "n", "e", "dim", "cell", "n_i", (F.col("home") == F.col("cell")).alias("native")).join(F.broadcast(blocks), (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c")))
    i, j = F.pmod(F.xxhash64("rep"), F.col("n_i")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n_j"))
    members = sent.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).select("rep", "n", "e", "dim", "cell", F.col("i").cast("long").alias("i"), j.cast("long").alias("j"), F.lit(False).alias("native"))
    natives = sent.where("native").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1))).select("rep", "n", "e", "dim", "cell", i.cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.lit(True).alias("native"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        native = table.column("native").to_numpy(zero_copy_only=False)
        rep, count = table.column("rep").to_numpy(), table.column("n").to_numpy()
        dim = table.column("dim")[0].as_py()
        e = table.column("e").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        mine, theirs = np.flatnonzero(native), np.flatnonzero(~native)
        return links_of(e[mine], rep[mine], e[theirs], rep[theirs], count[theirs], cosine)

    found = cut(natives.unionByName(members).groupBy("dim", "cell", "i", "j").applyInArrow(compare, "rep long, n_links long, least long"), "links")
    counts = found.where("n_links > 0").groupBy("rep").agg(F.sum("n_links").alias("_more"))
    groups = connected_components(found.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    classes = same.select("rep", "n", "e").join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    named = classes.select("e", (F.col("n") - 1 + F.coalesce("_more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = unit.join(named, "e").select("vec_id", "n_links", "component_id")
    out = one.select("vec_id").join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _pivots(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, and twice the distance between any two of them."""
    return points, 2 * np.sqrt(np.maximum(0, ((points[:, None] - points[None]) ** 2).sum(2)))


def _cells(x: np.ndarray, pivots: tuple[np.ndarray, np.ndarray] | None, radius: float) -> tuple[list[int], list[float]]:
    """(cells, distances to their pivots): the native cell, then those of which a vector within the radius may be native."""
    if pivots is None:
        return [0], [0.0]
    square = ((pivots[0] - x) ** 2).sum(1)
    home = int(square.argmin())
    within = (square[:, None] - square[None] <= radius * pivots[1] + 1e-9).all(1)
    within[home] = False
    cells = [home, *np.flatnonzero(within).tolist()]
    return cells, np.sqrt(square[cells]).tolist()


def links_of(e, rep, others, other_rep, other_n, cosine: float, rows: int = 128) -> pa.Table:
    """For natives: vectors linked (by their counts, without itself). For all: the smallest rep of those that are connected here.

    One block of products at a time; rows that link with something are joined by their groups.
    """
    ids = np.unique(np.r_[rep, other_rep])
    at, other_at = np.searchsorted(ids, rep), np.searchsorted(ids, other_rep)
    n, label = np.zeros(len(rep), np.int64), np.arange(len(ids))
    ends_a, ends_b = [], []
    for a in range(0, len(rep), rows):
        close = e[a : a + rows] @ others.T >= cosine
        i, j = np.nonzero(close)
        real = rep[a + i] != other_rep[j]
        i, j = i[real] + a, j[real]
        np.add.at(n, i, other_n[j])
        # a row's links hold together by the first of them
        if len(i):
            first = np.r_[True, i[1:] != i[:-1]]
            ends_a += [at[i[first]], other_at[j[~first]]]
            ends_b += [other_at[j[first]], other_at[j[np.flatnonzero(first)[np.cumsum(first) - 1]][~first]]]
            a_, b_ = np.concatenate(ends_a), np.concatenate(ends_b)
            if len(a_) > 4 * len(ids):
                label = _merge(label, a_, b_)
                ends_a, ends_b = [np.arange(len(ids))], [label]
    if ends_a:
        label = _merge(label, np.concatenate(ends_a), np.concatenate(ends_b))
    least = ids[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    linked = np.flatnonzero(n)
    return pa.table({"rep": np.r_[rep[linked], ids[moved]], "n_links": np.r_[n[linked], np.zeros(len(moved), np.int64)], "least": np.r_[rep[linked], least[moved]]})


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its group) after the links (a, b)."""
    label = label.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label
