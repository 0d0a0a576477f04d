import io
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, processes, reconcile
from tidemark.sources import encode, execs
from tidemark.streaming import live


def test_messages_of_every_kind():
    """Other events and other messages are passed over; a message that is cut off ends the file."""
    exec_ = execs.message(2, 3, 5_000, 11, 10)
    other = execs.message(1, 0, 6_000, 12, 12)
    ack = execs.NETLINK.pack(18, 2, 0, 0, 0) + b"xx"  # 18 bytes, and two more up to the next multiple of 4
    foreign = bytearray(exec_)
    foreign[16] = 9
    data = exec_ + other + ack + b"\0\0" + bytes(foreign) + execs.message(2, 0, 7_000, 21, 20)
    assert [e[1:] for e in execs.events(data)] == [(5_000, 3, 11, 10), (7_000, 0, 21, 20)]
    assert [e[1:] for e in execs.events(data + exec_[:-1])] == [(5_000, 3, 11, 10), (7_000, 0, 21, 20)]
    assert list(execs.events(b"")) == list(execs.events(b"\0" * 64)) == []


def test_captures_are_held_in_blocks():
    """A file is never read whole, and wherever a block ends the events are the same."""

    class Stream(io.BytesIO):
        largest = 0

        def read(self, n):
            self.largest = max(self.largest, n)
            return super().read(n)

    data = b"".join(execs.message(2 - (p % 3 == 0), 0, 1000 * p, p, p) + execs.NETLINK.pack(18, 2, 0, 0, 0) + b"xx\0\0" for p in range(50))
    want = list(execs.events(data))
    assert len(want) == 33 and want[1][0] > want[0][0] == 96
    for block in (1, 7, 16, 77, 4096):
        stream = Stream(data)
        assert list(execs.events_of(stream, block)) == want and stream.largest <= max(block, 100)


def test_a_stream_of_captures_goes_on_where_it_was(spark, tmp_path):
    def add(host, name, *pids):
        (tmp_path / "in" / f"host={host}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"host={host}" / name).write_bytes(b"".join(execs.message(2, 0, 1000 * p, p, p) for p in pids))

    def run(k):
        live.run_once(execs.stream_execs(spark, str(tmp_path / "in")), lambda df, batch: df.write.mode("overwrite").parquet(str(tmp_path / f"out/run={k}/batch={batch}")), str(tmp_path / "checkpoint")).awaitTermination()

    add("a", "0001", 1, 2)
    add("b", "0005", 3)
    add("b", ".hidden", 99)
    run(0)
    add("a", "0002", 4)
    run(1)
    run(2)
    got = spark.read.schema(execs.SCHEMA).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.host, r.pid) for r in got) == [("a", 1), ("a", 2), ("a", 4), ("b", 3)]
    assert sorted((r.host, r.pid) for r in execs.read_execs(spark, f"file://{tmp_path}/in").collect()) == [("a", 1), ("a", 2), ("a", 4), ("b", 3)]
    assert execs.read_execs(spark, str(tmp_path / "nothing")).count() == 0


def test_each_kind_of_evidence_wins_once(spark):
    kinds = reconcile.EVIDENCE
    # parent 10 + i has the kinds from i on; the better ones begin after the child did
    rows = [("h", 10 + i, 100.0 if j >= i else 200.0, k, 1000 + 10 * i + j) for i in range(5) for j, k in enumerate(kinds)] + [("h", 10, 90.0, "sample", 1), ("h", 14, 103.0, "live", 2)]
    children = spark.createDataFrame([("h", 500 + i, 10 + i, 100.0) for i in range(6)], "host string, pid long, ppid long, start double")
    got = {r.ppid: (r.parent_kind, r.parent_pgid) for r in reconcile.known_parents(children, spark.createDataFrame(rows, "host string, pid long, start double, kind string, pgid long")).collect()}
    assert got == {**{10 + i: (kinds[i], 1000 + 10 * i + i) for i in range(4)}, 14: ("live", 2), 15: (None, None)}


def test_what_a_parent_was(spark):
    """A parent that began after the child is none; one that only called exec has to have begun when the child did."""
    schema = "host string, pid long, start double, comm string, cmdline string, unit string"
    exits = spark.createDataFrame([("h", 1, 100.0, "sh", 50, True), ("h", 2, 100.0, "sh", 51, True), ("h", 3, 100.0, "sh", 52, True), ("h", 4, 100.0, "sh", 50, False)], "host string, pid long, start double, comm string, ppid long, forked boolean")
    sampled = spark.createDataFrame([("h", 50, 20.0, "sh", "old", "u"), ("h", 50, 300.0, "sh", "new", "v"), ("h", 50, 60.0, "other", "x", "w")], schema)
    called = spark.createDataFrame([("h", 51, 97.0, "sh", "near", "u"), ("h", 52, 40.0, "sh", "far", "u")], schema)
    got = {r.pid: (r.cmdline, r.described_by) for r in reconcile.described(exits, sampled, called).collect()}
    assert got == {1: ("old", "parent"), 2: ("near", "parent"), 3: (None, None), 4: (None, None)}


def test_a_queue_that_overflows(spark, tmp_path):
    rows = spark.range(100).repartition(4)
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    told = []
    take = live.bounded(lambda df, batch: df.write.mode("overwrite").parquet(str(tmp_path / f"batch={batch}")), 20, lambda df, batch: told.extend(df.collect()))
    take(rows, 0)
    take(spark.range(3), 1)
    want = sum(max(0, n - 20) for n in sizes)
    assert (take.came, take.lost) == (103, want) and [r.value for r in told] == [want, 0.0] and told[0].labels == {"queue": "exits"}
    assert spark.read.parquet(str(tmp_path)).count() == 103 - want


def test_counts_of_a_stream_become_samples(spark, tmp_path):
    import time

    counted = live.Counted()
    spark.streams.addListener(counted)
    try:
        for k in range(2):
            spark.range(50 * (k + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("sweep", F.count(F.lit(1)).alias("came"), F.count_if(F.col("id") < 10).alias("lost"))
        live.run_once(stream, lambda df, batch: df.write.format("noop").mode("overwrite").save(), str(tmp_path / "checkpoint")).awaitTermination()
        until = time.time() + 30
        while counted.totals.get("sweep", {}).get("came") != 150 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counted)
    rows = counted.samples(spark, 7, "h").collect()
    assert [(r.name, r.host, r.labels, r.ts, r.value) for r in rows] == [("came", "h", {"observed": "sweep"}, 7, 150.0), ("lost", "h", {"observed": "sweep"}, 7, 20.0)]


@pytest.mark.parametrize("task", [1 << 30, 5_000])
def test_a_unit_of_many_spans_in_many_bodies(spark, task):
    rows = spark.range(3000).select(
        F.lit("h").alias("host"), F.lit("u").alias("unit"), F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit('a "name"').alias("name"), F.lit("ok").alias("status"), F.lit("").alias("ending"),
        (F.col("id") % 700).alias("start_ns"), F.lit(5).alias("duration_ns"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("number"), (F.col("id") / 2).alias("half"), (F.col("id") > 5).alias("flag"), F.lit("x\ny").alias("text"),
    )
    got = encode.otlp_json(rows, ("number", "half", "flag", "text"), 10_000, task).collect()
    assert len(got) > 50 and max(len(r.body.encode()) for r in got) < 10_500 and sorted(r.part for r in got) == list(range(len(got)))
    spans = [s for r in got for s in json.loads(r.body)["resourceSpans"][0]["scopeSpans"][0]["spans"]]
    assert sorted(int(s["spanId"]) for s in spans) == list(range(3000))
    one = next(s for s in spans if s["spanId"] == "8")
    assert one["name"] == 'a "name"' and one["attributes"] == [{"key": "number", "value": {"intValue": 8}}, {"key": "half", "value": {"doubleValue": 4.0}}, {"key": "flag", "value": {"boolValue": True}}, {"key": "text", "value": {"stringValue": "x\ny"}}]
    assert [a["key"] for a in next(s for s in spans if s["spanId"] == "9")["attributes"]] == ["half", "flag", "text"]


def test_a_number_that_is_used_again_is_another_process(spark):
    stat = "7 ({}) S 1 7 1 0 -1 {} 0 0 0 0 {} 0 0 0 20 0 1 0 {} 4096 2" + " 0" * 17 + " 0 0 0"
    files = [(0, "7/stat", stat.format("a", 0, 100, 50)), (10, "7/stat", stat.format("b", 0, 10, 900)), (20, "7/stat", stat.format("b", 0, 110, 900)), (20, "8/stat", stat.format("k", 2097152, 0, 1)), (30, "8/stat", stat.format("k", 2097152, 100, 1))]
    captures = spark.createDataFrame([("h", t, p, c) for t, p, c in files], "host string, ts long, path string, content string")
    boots, users = spark.createDataFrame([("h", -5.0)], "host string, boot double"), spark.createDataFrame([(0, "root")], "uid long, user string")
    rows = processes.admitted(captures, boots, users)
    got = {(r.name, r.ts): r.value for r in processes.gauges(rows).collect()}
    assert got["proc_cpu_pct", 20] == 10.0 and ("proc_cpu_pct", 10) not in got and ("proc_cpu_pct", 30) not in got
    assert {r.ts for r in processes.gauges(rows, kernel_threads=True).where("labels.pid = '8'").collect()} == {30}
    assert processes.gauges(rows, min_age=17).count() == 0 and ("proc_rss_bytes", 20) in got
    assert processes.once(captures.where("ts = 0"), boots, users).count() == 0


def test_files_of_a_process_are_read_in_one_pass(spark):
    """Only users and boots are joined, whatever the size of the captures."""
    captures = spark.createDataFrame([("h", 0, "7/stat", "7 (a) S 1 7 1 0")], "host string, ts long, path string, content string")
    boots, users = spark.createDataFrame([("h", -5.0)], "host string, boot double"), spark.createDataFrame([(0, "root")], "uid long, user string")
    plan = processes.admitted(captures, boots, users)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3


def test_groups_are_read_once(spark):
    """What the files say is a table before levels, moments and rises are made of it: the plan that follows has no captures in it."""
    captures = spark.createDataFrame([("h", t, f"/a.slice/b.service/{f}", c) for t in (0, 10) for f, c in (("pids.current", "2"), ("memory.current", "5"), ("cpu.stat", f"usage_usec {t}00000"))], "host string, ts long, path string, content string")
    out = groups.unit_gauges(captures, spark.createDataFrame([(0, "root")], "uid long, user string"))
    assert "pids.current" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.name, r.ts, r.value) for r in out.collect()} >= {("unit_tasks", 0, 2.0), ("unit_tasks", 10, 2.0), ("unit_memory_bytes", 10, 5.0), ("unit_cpu_pct", 10, 10.0)}


def test_a_walk_reads_the_captures_once(spark):
    """Groups are not joined with those above them: one join, with the empty slices, whose size is known. Empty units within others, in slices, and beside names that begin alike."""
    tasks = {
        "/a.service": "0", "/a.service/x": "3", "/a.service/x/b.service": None, "/a.service2": "1", "/a.service-b.service": "2", "/u.service": "4", "/u.service/e.scope": "0\n", "/u.service/e.scope/f.scope": "0", "/u.service/e.scope/g": "1", "/u.service/e.scope!": "5",
        "/u.service/h": "0", "/s.slice": "0", "/s.slice/t.slice/k.service": "1", "/s.slice/m": "1", "/s.slices/n.service": "1", "/p.slice": None, "/p.slice/q.service": "6", "/r": "0", "/r/v.service": "7",
    }
    rows = [(h, p + ("/pids.current" if n else "/cpu.stat"), n or "x") for p, n in tasks.items() for h in ("h", None)]
    captures = spark.createDataFrame([(h, 5, p, c) for h, p, c in rows], "host string, ts long, path string, content string")
    out = groups.walked(captures)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "pids.current" not in plan
    gone = {p for p in tasks for q, n in tasks.items() if n and int(n) == 0 and q.endswith((".service", ".scope", ".slice")) and (p + "/").startswith(q + "/")}
    got = out.collect()
    assert {r.path for r in got if r.host} == set(tasks) - gone and len(gone) == 9
    assert {(r.path, r.tasks) for r in got if r.host is None} == {(p, n and int(n)) for p, n in tasks.items()} and len(got) == 2 * len(tasks) - len(gone)


def test_gauges_of_units_take_one_pass(spark):
    """Each capture is made once, whatever is said of it; what is written is not dealt out again but by unit."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(content):
        made.add(1)
        return content

    files = lambda t: {"pids.current": "2", "memory.current": "5", "cpu.stat": f"usage_usec {t}00000", "io.stat": f"8:0 rbytes={t} wbytes={2 * t}\n\n253:0 rbytes=900\n", "cpu.pressure": f"some total={t}"}
    rows = [("h", t, f"/a.slice/{u}.service/{f}", c) for t in (0, 10) for u in "bc" for f, c in files(t).items()]
    captures = spark.createDataFrame(rows, "host string, ts long, path string, content string").withColumn("content", text("content"))
    out = groups.unit_gauges(captures, spark.createDataFrame([(0, "root")], "uid long, user string"))
    got = {(r.name, r.labels["unit"], r.ts): r.value for r in out.collect()}
    assert made.value == len(rows) == 20
    assert len(got) == 2 * (2 + 2 + 6) and got["unit_io_read_bytes_per_sec", "c.service", 10] == 1.0 and got["unit_io_write_bytes_per_sec", "c.service", 10] == 2.0 and got["unit_cpu_pct", "b.service", 10] == 10.0


def test_the_reading_before_a_slice_was_empty(spark):
    """Where only one slice was empty at the moment between, its units have used all of their counters; where the whole host was, the interval is from the reading before that."""
    rows = [(h, t, f"/{s}.slice/{s}.service/{f}", c) for h in "gh" for t in (0, 10, 20) for s in "ab" for f, c in (("pids.current", "1"), ("cpu.stat", f"usage_usec {t + 5}00000"))]
    rows += [(h, 10, f"/{s}.slice/pids.current", "0") for h, s in ("ga", "ha", "hb")]
    captures = spark.createDataFrame(rows, "host string, ts long, path string, content string")
    out = groups.unit_gauges(captures, spark.createDataFrame([(0, "root")], "uid long, user string")).where("name = 'unit_cpu_pct'")
    assert {(r.host, r.labels["unit"], r.ts): r.value for r in out.collect()} == {("g", "a.service", 20): 25.0, ("g", "b.service", 10): 10.0, ("g", "b.service", 20): 10.0, ("h", "a.service", 20): 10.0, ("h", "b.service", 20): 10.0}


def test_memory_of_a_group_without_a_host(spark):
    captures = spark.createDataFrame([(None, 5, f"/a.service/{f}", c) for f, c in (("pids.current", "2"), ("memory.current", "7"))], "host string, ts long, path string, content string")
    out = groups.unit_gauges(captures, spark.createDataFrame([(0, "root")], "uid long, user string"))
    assert {(r.name, r.value) for r in out.collect()} == {("unit_tasks", 2.0), ("unit_memory_bytes", 7.0)}
