import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import derive, exits, lineage, maintain, read, reconcile, threads, traces
from tidemark.sources import captures, encode, taskstats
from tidemark.sources.store import Store


def capture(spark, *rows):
    return spark.createDataFrame([("h", float(t), p, c) for t, p, c in rows], "host string, ts double, path string, content string")


def test_kernel_text(spark):
    c = capture(
        spark,
        (0, "stat", "cpu  130 10 20 50 5 0 1 0 30 4 9\ncpu0 1 2 3\nintr 77 1 2\nctxt 5\nbtime 9\n"),
        (0, "meminfo", "MemTotal:  1000 kB\nHugePages_Total:   0\nbad line\n"),
        (0, "vmstat", "pgscan_a 3\nodd x\n"),
        (0, "loadavg", "1.50 0.70 0.20 2/900 1234\n"),
        (0, "net/dev", "Inter-| Receive\n face |bytes\n  eth0: 1 2 3 4 0 0 0 0 9 10 11 12 0 0 0 0\n"),
        (0, "diskstats", " 8 0 sda 1 0 2 3 4 0 5 6 7 8 9 0 0\n 8 1 short 1\n"),
        (0, "pressure/io", "some avg10=2.50 avg60=1.00 avg300=0.10 total=123\n"),
        (0, "net/sockstat", "sockets: used 100\nTCP: inuse 12 orphan 0\n"),
        (0, "net/snmp", "Tcp: MaxConn RetransSegs\nTcp: -1 7\nUdp: InErrors\nUdp: 2\n"),
        (0, "sys/fs/file-nr", "50 0 1000\n"),
        (0, "self/mounts", "/dev/a /long/path ext4 rw 0 0\n/dev/a /x ext4 rw 0 0\n/dev/b /with\\040space xfs rw 0 0\nproc /proc proc rw 0 0\n"),
        (0, "12/stat", "12 (a) (b)) S 1 12 12 0 -1 4194304 5 0 6 0 70 30 0 0 20 0 3 0 999 4096 512 18446744073709551615 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 8 0\n"),
        (0, "12/status", "Name:\tx\nUid:\t1\t2\t3\t4\nvoluntary_ctxt_switches:\t5\nnonvoluntary_ctxt_switches:\t6\n"),
        (0, "12/cmdline", "app\0--token=abc\0"),
        (0, "12/cgroup", "1:name=x:/y\n0::/system.slice/a.service\n"),
        (0, "12/schedstat", "100 200 3\n"),
        (0, "/a.service/io.stat", "8:0 rbytes=10 wbytes=20\n253:0 rbytes=10 wbytes=20\n"),
    )
    all_ = captures.cpu_times(c).where("cpu = 'all'").first()
    assert (all_.user, all_.nice, all_.system, all_.guest) == (100, 6, 20, 34)
    assert captures.cpu_times(c).count() == 2
    assert {r.key: r.value for r in captures.stat_counters(c).collect()} == {"intr": 77, "ctxt": 5, "btime": 9}
    assert {r.key: r.value for r in captures.keyed(c).collect()} == {"MemTotal": 1000, "HugePages_Total": 0}
    assert {r.key: r.value for r in captures.pairs(c).collect()} == {"pgscan_a": 3}
    assert captures.loadavg(c).first().tasks == 900
    assert (captures.net_dev(c).first().iface, captures.net_dev(c).first().tx_dropped, captures.net_dev(c).count()) == ("eth0", 12, 1)
    assert (captures.diskstats(c).count(), captures.diskstats(c).first().busy_ms) == (1, 8)
    assert captures.pressure(c, "pressure/io").first()[2:] == ("some", 2.5, 1.0, 0.1, 123)
    assert {r.key: r.value for r in captures.sockstat(c).collect()} == {"sockets.used": 100, "TCP.inuse": 12, "TCP.orphan": 0}
    assert {r.key: r.value for r in captures.snmp(c).collect()} == {"Tcp.MaxConn": -1, "Tcp.RetransSegs": 7, "Udp.InErrors": 2}
    assert captures.numbers(c, "sys/fs/file-nr").first()["values"] == [50, 0, 1000]
    assert {(r.source, r.target) for r in captures.mounts(c).collect()} == {("/dev/a", "/x"), ("/dev/b", "/with space")}
    p = captures.pid_stat(c).first()
    assert (p.comm, p.state, p.utime, p.threads, p.start_ticks, p.blkio_ticks) == ("a) (b)", "S", 70, 3, 999, 8)
    s = captures.pid_status(c).first()
    assert (s.uid, s.rss_kb, s.voluntary_switches, s.involuntary_switches) == (2, None, 5, 6)
    assert captures.pid_cmdline(c).first().cmdline == "app --token=***"
    assert captures.pid_cgroup(c).first().cgroup == "/system.slice/a.service"
    assert captures.pid_schedstat(c).first().wait_ns == 200
    assert captures.pid_io(c).count() == 0
    assert captures.cgroup_io(c).first()[3:] == (10, 20)
    sizes = spark.createDataFrame([("0-3,8-11",), ("0",), ("3-1,x",), ("",)], "t string").select(captures.cpu_list_size(F.col("t")).alias("n")).collect()
    assert [r.n for r in sizes] == [8, 1, 0, 0]


def record(version=12, size=400, **values):
    raw = bytearray(size)
    struct.pack_into("=H", raw, 0, version)
    for name, at, form in taskstats.FIELDS:
        if name in values:
            struct.pack_into(f"={form}", raw, at, values[name])
    raw[80:84] = b"comm"
    return bytes(raw)


def test_binary_records_and_threads(spark):
    rows = [("h", 10.0, record(pid=8, tgid=7, user_us=5, peak_rss_kb=50, exit_status=9)), ("h", 11.0, record(pid=7, tgid=7, user_us=6, peak_rss_kb=40, flag=1)), ("h", 12.0, record(pid=9, tgid=7, user_us=7, peak_rss_kb=45, flag=32, exit_status=256, group_elapsed_us=4_000_000, elapsed_us=1)), ("h", 13.0, b"short"), ("h", 14.0, record(pid=5, tgid=5, user_us=1)), ("h", 15.0, record(version=8, size=350, pid=3, elapsed_us=2_000_000))]
    tasks = taskstats.decode_records(spark.createDataFrame(rows, "host string, at double, record binary"))
    assert tasks.count() == 5
    got = {r.tgid: r for r in threads.merge_threads(tasks).collect()}
    assert set(got) == {7, 3}
    r = got[7]
    assert (r.threads, r.user_us, r.peak_rss_kb, r.forked, r.exit_status, r.start_epoch, r.comm) == (3, 18, 50, True, 256, 8.0, "comm")
    made = {r.pid: r for r in reconcile.exit_records(threads.merge_threads(tasks)).collect()}[7]
    assert made.message == "comm[7] exited 1 after 4.0s, cpu 0ms, peak rss 50.0 KiB"


def test_lineage(spark):
    rows = [("h", 100, 0.0, 100, 1), ("h", 101, 1.0, 100, 100), ("h", 102, 2.0, None, 101), ("h", 200, 50.0, 200, 9), ("h", 201, 5000.0, 200, 200), ("h", 202, 5001.0, 200, 201), ("h", 101, 1.5, None, None), ("h", 300, 10.0, 300, 301), ("h", 301, 900.0, 301, 1)]
    got = {(r.pid, r.start): r for r in lineage.place(spark.createDataFrame(rows, "host string, pid bigint, start double, pgid bigint, parent bigint")).collect()}
    assert len(got) == 8  # two accounts of 101 are one
    assert got[100, 0.0].trace_id == got[101, 1.0].trace_id == got[102, 2.0].trace_id
    assert got[102, 2.0].pgid == 100 and got[102, 2.0].parent_span_id == got[101, 1.0].span_id
    assert got[201, 5000.0].trace_id not in (got[200, 50.0].trace_id, got[100, 0.0].trace_id)  # a daemon's child is a job of its own
    assert got[202, 5001.0].trace_id == got[201, 5000.0].trace_id and got[202, 5001.0].parent_span_id == got[201, 5000.0].span_id
    assert got[300, 10.0].parent_span_id is None  # its parent's pid began later


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t bigint")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 7, 3.0)], "k string, t bigint, v double")
    back = {(r.k, r.t): (r.found_time, r.found) for r in read.as_of(left, right, ["k"], "t", "t", "v").collect()}
    assert back == {("a", 5): (5, 2.0), ("a", 1): (None, None), ("b", 9): (None, None)}
    ahead = {(r.k, r.t): (r.found_time, r.found) for r in read.as_of(left, right, ["k"], "t", "t", "v", forward=True).collect()}
    assert ahead == {("a", 5): (5, 2.0), ("a", 1): (2, 1.0), ("b", 9): (None, None)}
    assert read.as_of(left, right, ["k"], "t", "t", "v", within=0, forward=True).where("found is not null").count() == 1


def test_counters(spark):
    rows = spark.createDataFrame([("h", "a", 0.0, 10), ("h", "a", 10.0, 30), ("h", "a", 20.0, 5), ("h", "a", 30.0, 15)], "host string, subject string, ts double, counter bigint")
    assert sorted((r.ts, r.rate) for r in derive.rates(rows).collect()) == [(10.0, 2.0), (30.0, 1.0)]
    groups = spark.createDataFrame([("h", "u", "/a", 0, 100), ("h", "u", "/a", 10, 150), ("h", "u", "/b", 10, 30), ("h", "u", "/a", 20, 20)], "host string, unit string, path string, ts bigint, usage bigint")
    assert sorted((r.ts, r.usage) for r in derive.unit_deltas(groups).collect()) == [(10, 80), (20, 0)]


def test_trees(spark):
    spans = spark.createDataFrame([(1, 0, None, "make", "ok", 0), (1, 1, 0, "cc", "ok", 1), (1, 2, 0, "ld", "error", 2), (1, 3, 1, "as", "ok", 3), (1, 4, 77, "lost", "ok", 4)], "trace long, span long, parent long, name string, status string, start_s long")
    rows = sorted(((r.place, r.name, r.depth, r.last_sibling) for r in traces.tree_rows(spans).collect()))
    assert rows == [(1, "make", 0, False), (2, "cc", 1, False), (3, "as", 2, True), (4, "ld", 1, True), (5, "lost", 0, True)]
    assert [r.more for r in traces.tree_rows(spans, most=2).collect()] == [3, 3]


def test_trees_of_any_depth(spark, monkeypatch):
    schema, rounds = "trace long, span long, parent long, start_s long", []
    own = traces.cut
    monkeypatch.setattr(traces, "cut", lambda df: rounds.append(1) or own(df))
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, i) for i in range(5000)] + [(2, 7, None, 0)], schema)
    got = sorted((r.trace, r.span, r.depth, r.place) for r in traces.tree_rows(chain).collect())
    assert got == [(1, i, i, i + 1) for i in range(5000)] + [(2, 7, 0, 1)] and len(rounds) < 20
    cycle = spark.createDataFrame([(1, 0, None, 0), (1, 1, 2, 1), (1, 2, 1, 2)], schema)
    with pytest.raises(ValueError, match="cycle"):
        traces.tree_rows(cycle)


def test_trees_against_a_walk(spark):
    """Random forests with repeated spans, against a walk from the roots."""
    rng = random.Random(5)
    rows = [(t, i, rng.randrange(i) if i and rng.random() < 0.93 else rng.choice([None, 900]), rng.randrange(20)) for t in range(4) for i in range(rng.choice([1, 30, 120]))]
    rows += [(t, i, p, s + 30) for t, i, p, s in rows[:10]]
    first = {}
    for t, i, p, s in rows:
        if (t, i) not in first or s < first[t, i][1]:
            first[t, i] = (p, s)
    want = []
    for t in range(4):
        mine = {i: x for (u, i), x in first.items() if u == t}
        below = {}
        for i, (p, s) in mine.items():
            below.setdefault(p if p in mine else None, []).append((s, i))

        def walk(up, depth, place, t=t, below=below):
            for k, (s, i) in enumerate(ordered := sorted(below.get(up, []))):
                place += 1
                want.append((t, i, depth, place, k == len(ordered) - 1))
                place = walk(i, depth + 1, place)
            return place

        walk(None, 0, 0)
    got = traces.tree_rows(spark.createDataFrame(rows, "trace long, span long, parent long, start_s long")).select("trace", "span", "depth", "place", "last_sibling").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_paging_finds_each_record_once(spark):
    records = spark.createDataFrame([(i // 7, i, "h") for i in range(100)], "ts_us bigint, pid bigint, host string")
    seen, cursor = set(), None
    for _ in range(40):
        rows = exits.page(records, cursor, 20).collect()
        fresh = {(r.ts_us, r.pid) for r in rows} - seen
        seen |= fresh
        if not fresh:
            break
        cursor = min(r.ts_us for r in rows)
    assert len(seen) == 100


def test_paging_over_hosts_passes_full_ties(spark):
    """Two hosts have processes of the same numbers that ended at the same moments."""
    records = spark.createDataFrame([(5, i, h) for i in range(50) for h in ("a", "b")] + [(4, 1, "a")], "ts_us bigint, pid bigint, host string")
    seen, cursor = [], None
    while rows := exits.page(records, cursor, 13).collect():
        seen += [(r.ts_us, r.pid, r.host) for r in rows]
        cursor = seen[-1]
    assert seen == sorted(seen, reverse=True) and len(seen) == 101
    assert exits.once(records.unionByName(records)).count() == 101


def test_labels_with_signs_of_their_own(spark):
    sets = [{"a": "1,b=2"}, {"a": "1", "b": "2"}, {"a": "1\\,b=2"}, {"a=1,b": "2"}, {"a": None}, {}, {"a": ""}, {"b": "2", "a": "1"}]
    s = spark.createDataFrame([("m", "h", x, 5, float(k)) for k, x in enumerate(sets)], "name string, host string, labels map<string,string>, ts bigint, value double")
    got = read.latest(s, 5, 5).collect()
    assert len(got) == 7 and len({r.series for r in got}) == 7
    assert {r.series for r in got} >= {"a=1,b=2", "a=1\\,b\\=2", "a", "a=", ""}


def test_names_that_begin_alike(spark):
    s = spark.createDataFrame([("rx", "h", {"iface": i}, 5, v) for i, v in (("lo", 1.0), ("lora0", 2.0), ("eth0", 4.0))], "name string, host string, labels map<string,string>, ts bigint, value double")
    r = read.snapshot_host(s, 5, 5, {"net": ("rx", "iface", "lo")}, {"most": ("rx", "iface", "eth0")}).first()
    assert (r.net, r.most) == (6.0, 2.0)


def test_spacing_and_ticks(spark):
    s = spark.createDataFrame([("a", t) for t in (0, 10, 20, 50, 95, 100, 103)] + [("b", 1), ("b", 40)], "name string, ts bigint")
    assert {r.name: r.spacing for r in read.spacing(s, 103, near=10).collect()} == {"a": 5, "b": None}
    assert {r.name: r.spacing for r in read.spacing(s, 103, near=1).collect()} == {"a": 10, "b": None}
    assert sorted(r.ts for r in read.every_nth(s, 3, piece=25).collect()) == [0, 20, 95]


def test_nearest(spark):
    left = spark.createDataFrame([("h", 1, 10.0), ("h", 1, 30.0), ("h", 2, 10.0)], "host string, pid long, start double")
    right = spark.createDataFrame([("h", 1, 7.0, "x"), ("h", 1, 14.9, "y"), ("h", 1, 35.1, "z")], "host string, pid long, start double, c string")
    got = {(r.pid, r.start): r.near_c for r in reconcile.nearest(left, right, keep=("c",)).collect()}
    assert got == {(1, 10.0): "x", (1, 30.0): None, (2, 10.0): None}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("spans").count() == 0
    day = 20_000
    rows = spark.createDataFrame([("m", "h", {"a": "b"}, (day + d) * 86_400 + s * 400, float(s)) for d in range(3) for s in range(10)], "name string, host string, labels map<string,string>, ts bigint, value double")
    store.append("samples", rows, batch=1)
    store.append("samples", rows, batch=1)  # a batch that comes again
    assert store.read("samples").count() == 30
    assert store.between("samples", day * 86_400, day * 86_400 + 800).count() == 3
    maintain.write_rollups(store, day)
    maintain.write_rollups(store, day)
    assert store.read("rollups").where("resolution = 3600").count() == 1 + 1
    store.compact("samples", day, 1, ["name", "ts"])
    assert store.read("samples").count() == 30
    now = (day + 3) * 86_400
    assert maintain.retain(store, now, {"samples": 2}) == [("samples", day)]
    assert store.read("samples").count() == 20
    gone = maintain.fit(store, 1, now)
    assert gone and all(h.last <= now - 3600 for h in gone)


def day_of_samples(spark, day, first, n=10, name="m"):
    return spark.createDataFrame([(name, "h", {"a": "b"}, day * 86_400 + s * 400, float(s)) for s in range(first, first + n)], "name string, host string, labels map<string,string>, ts bigint, value double")


def test_compaction_touches_its_own_day_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for batch, (day, first) in enumerate([(100, 0), (100, 10), (101, 0), (101, 10)]):
        store.append("samples", day_of_samples(spark, day, first), batch)
    held = lambda: sorted((r.ts, r.value) for r in store.read("samples").collect())
    before = held()
    assert len(before) == 40
    for day in (100, 101, 100):
        store.compact("samples", day, 1, ["name", "ts"])
        assert held() == before
    # a batch comes again after it was compacted, once as it was and once with other rows
    store.append("samples", day_of_samples(spark, 100, 10), 1)
    assert held() == before
    store.append("samples", day_of_samples(spark, 101, 50, 3), 1)
    assert len(held()) == 33 and store.days("samples")[0][0] == 100
    store.append("samples", day_of_samples(spark, 100, 10), 1)
    assert held() == before


def test_a_change_that_stops_midway_leaves_all_as_it_was(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.append("samples", day_of_samples(spark, 100, 0), 0)
    store.append("samples", day_of_samples(spark, 100, 10))

    def dies(*_):
        raise RuntimeError("the maintainer was lost")

    for _ in range(2):  # twice: what the first left is there as well
        with monkeypatch.context() as m:
            m.setattr(Store, "_delete", dies)
            with pytest.raises(RuntimeError):
                store.compact("samples", 100)
        assert store.read("samples").count() == 20
    store.append("samples", day_of_samples(spark, 100, 0), 0)
    assert store.read("samples").count() == 20
    store.compact("samples", 100)
    assert store.read("samples").count() == 20 and len(store._partitions("samples")[100]) == 1
    store.drop("samples", 100)
    assert store.read("samples").count() == 0
    for k in range(10):
        store.append("samples", day_of_samples(spark, 102, 0), 7)
    assert store.read("samples").count() == 10 and store.read("samples").columns == ["name", "host", "labels", "ts", "value", "day"]


@pytest.mark.parametrize("change", ["compact", "drop", "cut"])
def test_an_append_meanwhile_is_kept(spark, tmp_path, monkeypatch, change):
    """A stream appends while maintenance has read what it changes and has not yet changed it."""
    store, stream = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    for batch, first in enumerate((0, 10)):
        store.append("samples", day_of_samples(spark, 100, first), batch)
    store.append("samples", day_of_samples(spark, 99, 0), 2)
    own, done = Store._delete, []

    def deletes(self, *args):
        if not done:
            done.append(1)
            stream.append("samples", day_of_samples(spark, 100, 20), 3)
        own(self, *args)

    monkeypatch.setattr(Store, "_delete", deletes)
    if change == "compact":
        store.compact("samples", 100)
        want = 40
    elif change == "drop":
        store.drop("samples", 99)
        want = 30
    else:
        store.drop_before("samples", 100 * 86_400 + 10 * 400)
        want = 20
    assert done and store.read("samples").count() == want
    stream.append("samples", day_of_samples(spark, 100, 20), 3)
    assert store.read("samples").count() == want


def test_rows_without_a_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = day_of_samples(spark, 100, 0).unionByName(spark.createDataFrame([("m", "h", {"a": "b"}, None, 1.0)], "name string, host string, labels map<string,string>, ts bigint, value double"))
    for _ in range(2):
        store.writer("samples")(rows, 5)
    assert store.read("samples").count() == 11 and store.read("samples").where("day is null").count() == 1
    assert [d for d, _ in store.days("samples")] == [100] and store.between("samples", 0, 1e9).count() == 10
    assert maintain.retain(store, 200 * 86_400) == [("samples", 100)] and store.read("samples").count() == 1


def test_the_cap_by_rounds(spark, tmp_path):
    """Samples are cut to what the limit leaves, within a day; records stay whole, and nothing reaches into the last hour."""
    store = Store(spark, str(tmp_path / "store"))
    rows = [("m", f"host{h}", {"a": f"{h}-{t * 7919 % 10007}"}, 100 * 86_400 + t * 60, float(t * 31 % 977)) for t in range(2000) for h in range(3)]
    store.append("samples", spark.createDataFrame(rows, "name string, host string, labels map<string,string>, ts bigint, value double"), 1)
    store.append("records", spark.createDataFrame([(100 * 86_400_000_000 + t, "exit", t) for t in range(50)], "ts_us bigint, kind string, pid bigint"), 1)
    whole, records = store.bytes(), store.read("records").count()
    gone, met = maintain.fit_by_rounds(store, whole * 6 // 10)
    assert met and [k for k, _ in gone] == ["samples"] and store.read("records").count() == records
    left = store.read("samples").select("ts").collect()
    assert min(r.ts for r in left) >= gone[0][1] > 100 * 86_400 + 600 * 60 and 0 < len(left) < len(rows)
    gone, met = maintain.fit_by_rounds(store, 1)
    last = 100 * 86_400 + 1999 * 60
    assert not met and min(r.ts for r in store.read("samples").select("ts").collect()) <= last - 3500 + 60 * 6


def test_rounds_of_the_cap():
    """Against a loop over moments: chunks of 100 s can only go whole."""
    held, calls = list(range(0, 36_000, 100)), []

    def freed(moment):
        calls.append(moment)
        held[:] = [c for c in held if c + 100 > moment]
        return len(held) <= 200, held[0]

    reached = maintain.cutoffs(0, 36_000, freed)
    assert len(held) <= 200 and reached == calls[-1] and calls[0] == 3600
    assert maintain.cutoffs(0, 3500, freed) is None
    moments = []
    assert maintain.cutoffs(0, 10_000, lambda m: (moments.append(m), (False, 0.0))[1]) is None and moments == [1000, 2000, 4000, 6400]


def test_each_tier_of_rollups_is_kept_for_its_own_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for day in (100, 140):
        store.append("samples", day_of_samples(spark, day, 0), day)
        maintain.write_rollups(store, day)
    assert {r.resolution for r in store.read("rollups").collect()} == {300, 3600}
    assert maintain.retain(store, 141 * 86_400, {"samples": 365}) == [("rollups-300", 100)]
    assert [d for d, _ in store.days("rollups-300")] == [140] and [d for d, _ in store.days("rollups-3600")] == [100, 140]
    gone = maintain.fit(store, 0, 200 * 86_400)
    assert [h.kind for h in gone] == ["samples", "samples", "rollups-300", "rollups-3600", "rollups-3600"] and store.bytes() == 0


def test_prune_order():
    held = [maintain.Held(k, f, f + 10, 100) for k in ("records", "samples", "spans") for f in (0, 10, 99_990)]
    gone = maintain.prune_plan(held, 450, 100_000)
    assert [(h.kind, h.first) for h in gone] == [("samples", 0), ("samples", 10), ("spans", 0), ("spans", 10), ("records", 0)]


def test_encoders(spark):
    s = spark.createDataFrame([("m", "h", {"z": 'q"\\', "a": "b"}, 5, 2.0)], "name string, host string, labels map<string,string>, ts bigint, value double")
    assert encode.prometheus_text(s).first().line == 'm{host="h",a="b",z="q\\"\\\\"} 2 5000'
    r = spark.createDataFrame([(1_500_000, "info", "hi", "h", 3, None)], "ts_us bigint, level string, message string, host string, pid bigint, unit string")
    assert encode.ndjson(r).first().line == '{"_msg":"hi","_time":"1970-01-01T00:00:01.500000Z","level":"info","host":"h","pid":3}'


@pytest.mark.parametrize("width", [0, 300])
def test_timeline(spark, width):
    s = spark.createDataFrame([(t, float(t)) for t in range(0, 1200, 100)], "ts bigint, value double")
    kept = spark.createDataFrame([(0, 9.0), (300, 8.0)], "bucket bigint, highest double")
    got = sorted(tuple(r) for r in read.timeline(s, kept, 0, 1200, width).collect())
    assert got == ([(t, float(t)) for t in range(0, 1200, 100)] if width == 0 else [(0, 9.0), (300, 8.0), (600, 800.0), (900, 1100.0)])


def test_rows_of_a_nearest_join_are_numbered_once(spark):
    """The numbers are read from a table, not made again for each side of the join."""
    from tidemark.operators import reconcile

    rows = spark.createDataFrame([("h", 1, 10.0)], "host string, pid long, start double")
    out = reconcile.nearest(rows, rows)
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString() and out.collect()[0].near_start == 10.0
