"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop_cut, word_count

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Documents of one source that one task orders at a time, about; and rows of equal id and size that are written out at a time.
BUCKET = 4096
#: Words of a packet: what of a document is served at a time.
PACKET = 256
#: Levels of virtual time, from 0 to the targets' end at 1, in which words are counted before one level is sorted; a level of more packets than SORTED is parted into levels again.
LEVELS, SORTED = 4096, 500_000
#: The most sources that are broadcast.
BROADCAST = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size, n_docs), one row per source -> with weight, target.

    The targets share ``share`` times all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is shared again by weight. Filling in the order of most * size / weight gives this without rounds: the
    level after the first k full sources is what is left over the weight that is left.
    """
    named = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    capped = named.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = capped.withColumn("_level", left / weight_left).withColumn("_open", F.col("_level") * F.col("weight") < F.col("_cap"))
    at = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), "_rank", "_level"))).over(every)["_level"]
    return level.withColumn("_at", at).select("source", "source_size", "n_docs", "_rank", "weight", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at") * F.col("weight"))).alias("target"))


class Served:
    """Weighted fair queueing of ``docs``: where each row stands in its source's queue, and where the budget ends.

    Documents of a source are shuffled by ``md5(seed, doc_id, size)`` and queued over and over, ``most`` times at most. A document is sent in
    packets of 256 words. A packet's virtual finish time is the cumulative words of its source, itself included, over
    the source's target, which is in proportion to the weight that remains after full sources are capped. All packets, of all sources, are
    served in the order of finish time (then source, then place), until the total budget, ``share`` times all words, is spent; the last one is taken in part.

    Rows of equal id, source and size are one with a count until the end, so neither null nor repeated doc_ids gather in a
    task. A source is cut by hash into pieces of about 4096 different documents, which are summed first; each piece then runs its own cumulative sum
    from where the pieces before it end. The place at which the budget ends is found in two steps: words are counted by level of
    virtual time (8193 levels at most), and only the packets of the level in which it ends are sorted. So no task holds a source or the corpus.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", size=None, packet: int = PACKET):
        self.packet, self.passes = packet, int(-(-most // 1))
        sized = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).cast("long").alias("size"))
        key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
        same = cut(sized.withColumn("_md5", key).groupBy("doc_id", "source", "size", "_md5").agg(F.count("*").alias("_rows")), "sizes")
        sources = same.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"), F.count("*").alias("n_docs"))
        targets = cut(source_targets(sources, weights, share, most), "targets")
        n_sources, total = targets.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
        self.budget = int(min(total * share, total * most))
        named = targets.withColumnRenamed("source", "_source")
        known = F.broadcast(named) if n_sources <= BROADCAST else named
        joined = same.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        # the first 8 hex digits of the md5 are a place in the order of the shuffle
        pieces = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET)).cast("double")
        placed = joined.withColumn("_piece", F.floor(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * pieces))
        words = F.col("size") * F.col("_rows")
        sums = placed.groupBy("_rank", "_piece").agg(F.sum(words).alias("_sum"))
        earlier = Window.partitionBy("_rank").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("_rank", "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_begin"))
        inside = Window.partitionBy("_rank", "_piece").orderBy("_md5", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = F.col("_begin") + F.sum(words).over(inside) - words
        self.queued = cut(placed.join(starts, ["_rank", "_piece"]).withColumn("_at", at).select("doc_id", "source", "size", "source_size", "target", "_rank", "_rows", "_at"), "queued")
        drop_cut(same)
        drop_cut(targets)
        self.end = self._end()

    def rows(self) -> DataFrame:
        """One row for each input row, with _start, the words of its source before it in the first pass."""
        most_rows = self.queued.agg(F.max("_rows")).first()[0] or 0
        chunks = self.queued.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / BUCKET))))
        if most_rows > BUCKET:
            chunks = chunks.repartition("_rank", "_at", "_chunk")
        each = F.sequence(F.col("_chunk") * BUCKET, F.least("_rows", (F.col("_chunk") + 1) * BUCKET) - 1)
        return chunks.withColumn("_i", F.explode(each)).withColumn("_start", F.col("_at") + F.col("_i") * F.col("size")).drop("_rows", "_at", "_chunk", "_i")

    def start(self, copy):
        """Words of the source before a copy of a row."""
        return F.col("_start") + copy * F.col("source_size")

    def _end(self) -> tuple[float, int, int, int] | None:
        """(finish time, source, place, words taken) of the packet with which the budget ends."""
        if not self.budget:
            return None
        copies = self.rows().where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(self.passes - 1))))
        each = copies.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / self.packet))))
        place = self.start(F.col("copy")) + F.col("_j") * self.packet
        packets = each.select("_rank", place.alias("_place"), F.least(F.lit(self.packet), F.col("size") - F.col("_j") * self.packet).alias("_words"), "target")
        packets = packets.withColumn("_finish", (F.col("_place") + F.col("_words")) / F.col("target"))
        scale, before = F.col("_finish") * LEVELS, 0
        for _ in range(4):
            upto = Window.orderBy("_level").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over levels, a bounded number
            each = packets.withColumn("_level", F.least(F.floor(scale), F.lit(2 * LEVELS)))
            levels = each.groupBy("_level").agg(F.sum("_words").alias("_words"), F.count("*").alias("_n")).withColumn("_upto", F.lit(before) + F.sum("_words").over(upto))
            level, words, n, reached = levels.where(F.col("_upto") >= self.budget).orderBy("_level").select("_level", "_words", "_n", "_upto").first()
            packets, before = each.where(F.col("_level") == level).drop("_level"), reached - words
            if n <= SORTED:
                break
            scale = (scale - level) * LEVELS
        order = Window.orderBy("_finish", "_rank", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # within one level
        last = packets.withColumn("_upto", F.lit(before) + F.sum("_words").over(order)).where(F.col("_upto") >= self.budget)
        finish, rank, place, words, reached = last.orderBy("_upto").select("_finish", "_rank", "_place", "_words", "_upto").first()
        return finish, rank, place, int(words - (reached - self.budget))

    def finish(self, copy):
        """When the last word of a copy is served."""
        return F.when(F.col("target") > 0, (self.start(copy) + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))

    def taken(self, copy):
        """Words of a copy that are served before the budget ends."""
        if self.end is None:
            return F.lit(0).cast("long")
        finish, rank, place, words = self.end
        last = F.floor((F.col("size") - 1) / self.packet)

        def of(j):
            at = self.start(copy) + j * self.packet
            n = F.least(F.lit(self.packet), F.col("size") - j * self.packet)
            time = (at + n) / F.col("target")
            same = time == finish
            before = (time < finish) | (same & ((F.col("_rank") < rank) | ((F.col("_rank") == rank) & (at < place))))
            return F.when(before, n).when(same & (F.col("_rank") == rank) & (at == place), F.lit(words)).otherwise(F.lit(0)).cast("long")

        each = F.aggregate(F.sequence(F.lit(0).cast("long"), last), F.lit(0).cast("long"), lambda s, j: s + of(j))
        whole = (self.start(copy) + F.col("size")) / F.col("target") < finish
        none = (self.start(copy) + F.least(F.lit(self.packet), F.col("size"))) / F.col("target") > finish
        return F.when((F.col("size") == 0) | (F.col("target") == 0) | none, F.lit(0).cast("long")).when(whole, F.col("size")).otherwise(each)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", size=None, packet: int = PACKET) -> DataFrame:
    """Documents in the order in which weighted fair queueing (see Served) serves them, cut off at the total budget.

    Returns doc_id, source, size, source_size, target, copy (0 is the first pass), finish (of the copy's last word), taken (words of the copy in
    the mix), range-sorted by finish. Rows of zero words, and copies wholly after the end, have taken 0; each input row is there at
    least once (copy 0).

    A null text has no words; a null source is a source of its own, the last in order; rows with a null or repeated doc_id each
    count, and are each in the result. An empty table gives an empty one. Other columns are ignored. ``size``: another Column to measure by, then in its unit.
    """
    served = Served(docs, weights, share, most, seed, size, packet)
    copies = served.rows().withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(served.passes - 1))))
    timed = copies.withColumn("finish", served.finish(F.col("copy"))).withColumn("taken", served.taken(F.col("copy")))
    return timed.where("copy = 0 OR taken > 0").select("doc_id", "source", "size", "source_size", "target", "copy", "finish", "taken").orderBy("finish", "source", "doc_id", "copy")


def mixed_words(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", size=None, packet: int = PACKET) -> DataFrame:
    """-> doc_id, size, source_size, target, taken: one row for each input row, with the words that mix_sources takes of all its copies."""
    served = Served(docs, weights, share, most, seed, size, packet)
    taken = served.taken(F.lit(0))
    for copy in range(1, served.passes):
        taken = taken + served.taken(F.lit(copy))
    return served.rows().select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: All packets of all sources in one order, and one running sum over them.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
a AS (SELECT arg_min(lev, (cap / weight, r)) AS open_level FROM l WHERE lev * weight < cap),
t AS (SELECT source, source_size, r, CASE WHEN open_level IS NULL THEN cap ELSE least(cap, open_level * weight) END AS target FROM l, a),
q AS (SELECT d.doc_id, d.size, t.r, t.source_size, t.target, row_number() OVER () AS n,
        sum(d.size) OVER (PARTITION BY t.r ORDER BY md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || d.size), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS begun
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT n, r, target, size, begun + copy * source_size AS begun, unnest(range((size + {PACKET - 1}) // {PACKET})) AS j FROM q, (VALUES (0), (1)) v(copy)),
p AS (SELECT n, r, target, begun + j * {PACKET} AS place, least({PACKET}, size - j * {PACKET}) AS words FROM c),
f AS (SELECT n, words, sum(words) OVER (ORDER BY (place + words) / target, r, place ROWS UNBOUNDED PRECEDING) - words AS before FROM p),
b AS (SELECT floor(sum(size) * 1.5)::BIGINT AS budget FROM d),
k AS (SELECT n, sum(greatest(0, least(words, budget - before)))::BIGINT AS taken FROM f, b GROUP BY n)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN k USING (n)
"""
