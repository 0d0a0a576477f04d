import random

import pandas as pd

from tidemark.streaming import lifecycle as L
from tidemark.streaming import live

SWEEP = 10


def end(news, now=float("inf")):
    return L.follow([], news, now, SWEEP)


def test_an_exit_heard_a_sweep_late_finds_its_process():
    lives, ends, _ = end([("sample", 0.0, 10.0, "make", "make all", "u", 2.0), ("exit", 3.0, 23.0, "make", None, None, 1.5)], 24)
    assert ends == [(0.0, 23.0, True, "make", "make all", "u", "sample", 2.0)] and lives[0][7] == 23.0


def test_an_old_exit_takes_nothing_from_a_new_process_of_its_number():
    """The pid is used again before the old process's end is heard of."""
    news = [("sample", 0.0, 10.0, "old", "old cmd", "u", None), ("exec", 12.0, 12.0, "new", "new cmd", None, None), ("exit", 1.0, 14.0, "old", None, None, None), ("exit", 12.5, 15.0, "new", None, None, None)]
    assert [(e[0], e[3], e[4]) for e in end(news)[1]] == [(0.0, "old", "old cmd"), (12.0, "new", "new cmd")]


def test_gone_for_two_sweeps_without_a_word():
    lives, ends, due = end([("sample", 0.0, 10.0, "a", "a b", "u", 1.0)], 30.0)
    assert ends == [] and due == 30.0
    lives, ends, due = L.follow(lives, [], 30.1, SWEEP)
    assert ends == [(0.0, 30.0, False, "a", "a b", "u", "sample", 1.0)] and due == 55.0
    # its exit, later still, is not told again
    lives, ends, _ = L.follow(lives, [("exit", 0.0, 40.0, "a", None, None, 5.0)], 41.0, SWEEP)
    assert ends == [] and len(lives) == 1
    assert L.follow(lives, [], 55.1, SWEEP)[0] == []


def invented(rng, n):
    rows = []
    for i in range(n):
        host, pid, s = f"h{rng.randrange(2)}", rng.randrange(20), float(rng.randrange(3000))
        rows += [(host, pid, "sample", s + rng.random(), s + SWEEP * k + 3, f"c{i}", f"cmd {i}" if rng.random() < 0.7 else "", "u", float(k)) for k in range(rng.randrange(4))]
        if rng.random() < 0.5:
            rows.append((host, pid, "exec", s, s + 0.5, f"c{i}", f"exec {i}", None, None))
        if rng.random() < 0.7:
            rows.append((host, pid, "exit", s + rng.random(), s + 30 + rng.choice([0, 10]), f"c{i}", None, None, 4.0))
    return rows


def test_streamed_is_as_the_batch_over_shuffled_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted(invented(rng, 150), key=lambda r: r[4] + rng.random() * 40)
    odd = [("h0", 1, "odd kind", 1.0, 3000.0, None, None, None, None), (None, None, "exit", 2990.0, 3001.0, None, None, None, None), ("h0", 1, "exit", None, 3002.0, None, None, None, None)]
    rows += odd + [("-", 0, "tick", 0.0, 99_999.0, None, None, None, None)]
    pieces = [rows[k::1][len(rows) * k // 3 - k : len(rows) * (k + 1) // 3 - k] for k in range(3)]
    assert sum(pieces, []) == rows
    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, L.NEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k:  # the second run goes on from the first one's checkpoint
            stream = spark.readStream.schema(L.NEWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            with live.rocksdb(spark):
                live.run_once(L.ends(stream, SWEEP), lambda df, batch: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}")), str(tmp_path / "checkpoint")).awaitTermination()
    names = [c.split()[0] for c in L.ENDS.split(", ")]
    got = sorted(map(str, spark.read.schema(L.ENDS).parquet(str(tmp_path / "out")).select(*names).collect()))
    want = sorted(map(str, L.ends_of(spark.createDataFrame(rows, L.NEWS), SWEEP).collect()))
    assert got == want and len(got) > 100
    # all has ended and is forgotten
    lives = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "lives").load()
    assert lives.count() == 0
    assert L.ends_of(spark.createDataFrame([], L.NEWS), SWEEP).count() == 0


def test_what_is_unexplained_at_the_close_is_told_once(spark, tmp_path):
    """Of three processes one has ended, one was not seen by the last sweep, and one was."""
    rows = [("h", 1, "sample", 0.0, 100.0, "a", "a 1", "u", 1.0), ("h", 1, "exit", 0.0, 101.0, "a", None, None, 1.0), ("h", 2, "sample", 0.0, 100.0, "b", "b 2", "u", 2.0), ("h", 3, "sample", 0.0, 110.0, "c", "c 3", "u", 3.0)]
    spark.createDataFrame(rows, L.NEWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    # the watermark reaches the last sweep, and no further
    spark.createDataFrame([("-", 0, "tick", 0.0, 112.0, None, None, None, None)], L.NEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(L.NEWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with live.rocksdb(spark):
        live.run_once(L.ends(stream, SWEEP, "1 second"), lambda df, batch: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}")), str(tmp_path / "checkpoint")).awaitTermination()
    assert [r.pid for r in spark.read.schema(L.ENDS).parquet(str(tmp_path / "out")).collect()] == [1]
    left = L.leftover(spark, str(tmp_path / "checkpoint"), 115.0).collect()
    assert [(r.host, r.pid, r.noticed, r.heard, r.cmdline, r.described_by, r.cpu_seconds) for r in left] == [("h", 2, 115.0, False, "b 2", "sample", 2.0)]


class Kept:
    """A processor's handle and its list state, in memory; counts what is asked of it."""

    def __init__(self):
        self.rows, self.timers, self.reads, self.set = [], set(), 0, 0

    def getListState(self, name, schema):
        return self if name == "waiting" else Kept()

    def registerTimer(self, ms):
        self.set += 1
        self.timers.add(ms)

    def get(self):
        self.reads += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


def test_what_waits_is_read_once_for_a_batch(spark):
    """However much news of a process's number comes, there is one timer for it, and all that the watermark has passed is done when that expires."""

    class Moment:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    names = [c.split()[0] for c in L.NEWS.split(", ")][2:]
    news = [("sample", 100.0 * k, 100.0 * k + 10, f"c{k}", f"cmd {k}", "u", None) for k in range(300)] + [("exit", 100.0 * k + 1, 100.0 * k + 15, f"c{k}", None, None, float("nan")) for k in range(0, 300, 2)]
    lives, kept, got = L.Lives(SWEEP), Kept(), []
    for piece, watermark in ((news[:200], 0), (news[200:], 15_000_000), ([], 99_000_000)):
        kept.reads = kept.set = 0
        lives.init(kept)  # as each batch does
        if piece:
            assert list(lives.handleInputRows(("h", 1), iter([pd.DataFrame(piece, columns=names)]), None)) == []
        for ms in sorted(t for t in kept.timers if t <= watermark):
            got += [tuple(r) for frame in lives.handleExpiredTimer(("h", 1), Moment(watermark), ms) for r in frame.itertuples(index=False)]
            kept.timers.remove(ms)
        assert kept.reads == (watermark > 0) and kept.set <= 2
    assert [(*e[2:5], e[5]) for e in got] == [(*e[0:3], e[3]) for e in L.follow([], L._rows(pd.DataFrame(news, columns=names)), float("inf"), SWEEP)[1]] and len(got) == 300
