"""Queries on captured kernel text: files written from the rows of orders, read back by each reader.

The SQL beside them never parses: it says from the columns what a reader has to find in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import captures
from ..sources.model import table

#: Names that stand for numbers of an order in the templates below; the same expressions are valid in SQL.
NUMBERS = {"k": "o_orderkey", "c": "o_custkey", "h": "o_orderkey % 4", "k7": "o_orderkey % 7", "c9": "o_custkey % 9", "k2": "o_orderkey * 2", "k3": "o_orderkey * 3", "k4": "o_orderkey * 4", "c2": "o_custkey * 2", "c3": "o_custkey * 3", "ck": "o_custkey + o_orderkey", "fl": "CASE WHEN o_orderkey % 5 = 0 THEN 2097152 ELSE 0 END"}


def _text(template: str):
    """A column: ``template`` with each {name} replaced by that number."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.expr(f"cast({NUMBERS[p]} as string)") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def _captured(spark, sf, *files: tuple[str, str]) -> DataFrame:
    """host, ts, path, content: for each order the files (path, content), both templates."""
    each = F.explode(F.array(*[F.struct(_text(path).alias("path"), _text(content).alias("content")) for path, content in files]))
    return table(spark, sf, "orders").select(_text("h{h}").alias("host"), F.col("o_orderkey").alias("ts"), each.alias("_file")).select("host", "ts", "_file.*")


# Guests' time is part of user and nice; cpu0 has more of it than user, and the last CPU is of a kernel that knows four modes only.
STAT = "cpu  {k3} {c3} {k7} {k} {c9} 1 2 3 {k} {c}\ncpu0 {k} 0 5 6 7 8 9 10 {k2} 0\ncpu12 {c} 1 2 3\nintr {ck} 1 2 3\nctxt {k2}\nbtime 17\nprocesses {c}\nother {k}\nsoftirq x\n"


def capture_cpu_times(spark, sf):
    return captures.cpu_times(_captured(spark, sf, ("stat", STAT), ("meminfo", STAT)))


def capture_stat_counters(spark, sf):
    return captures.stat_counters(_captured(spark, sf, ("stat", STAT)))


def capture_meminfo(spark, sf):
    return captures.keyed(_captured(spark, sf, ("meminfo", "MemTotal:   {k} kB\nActive(anon): {c} kB\nHugePages_Total:  {k7}\nBad: none\nno colon {k}\n")))


def capture_vmstat(spark, sf):
    return captures.pairs(_captured(spark, sf, ("vmstat", "pgpgin {k}\npgpgout {c2}\nname x{k}\nalone\n\n")))


def capture_loadavg(spark, sf):
    return captures.loadavg(_captured(spark, sf, ("loadavg", "{k}.50 {c}.25 0.75 {k7}/{ck} {k}\n"), ("loadavg", "{k}.50 1.0\n")))


def capture_diskstats(spark, sf):
    line = "   8       {k7} sda{k7} {k} 1 {k2} {c} {c2} 2 {k3} {c3} {h} {k4} {ck} 0 0\n"
    return captures.diskstats(_captured(spark, sf, ("diskstats", line + "   8 1 short {k} 1 2\n")))


def capture_net_dev(spark, sf):
    head = "Inter-|   Receive  |  Transmit\n face |bytes packets errs drop|bytes\n"
    return captures.net_dev(_captured(spark, sf, ("net/dev", head + "  eth{h}:{k} {k2} {h} {k7} 0 0 0 0 {c} {c2} {c9} 4 0 0 0 0\n    lo: 1 2 3\n")))


def capture_pressure(spark, sf):
    rows = _captured(spark, sf, ("pressure/io", "some avg10={k7}.50 avg60={c9}.25 avg300=0.00 total={k}\nfull avg10=0.00 avg60={h}.75 avg300=1.00 total={c}\n"), ("pressure/cpu", "some avg10=9.00 avg60=9.00 avg300=9.00 total=9\n"))
    return captures.pressure(rows, "pressure/io")


def capture_sockstat(spark, sf):
    return captures.sockstat(_captured(spark, sf, ("net/sockstat", "sockets: used {k}\nTCP: inuse {c} orphan {h} mem x\nUDP:\n")))


def capture_snmp(spark, sf):
    return captures.snmp(_captured(spark, sf, ("net/snmp", "Ip: Forwarding DefaultTTL\nIp: {h} 64\nTcp: MaxConn RetransSegs\nTcp: -{k} {c}\n")))


def capture_file_nr(spark, sf):
    return captures.numbers(_captured(spark, sf, ("sys/fs/file-nr", "{k}\t0\t{c}\n"), ("sys/fs/file-nr", "{c} x {k}\n")), "sys/fs/file-nr").withColumn("values", F.concat_ws(",", F.col("values").cast("array<string>")))


def capture_mounts(spark, sf):
    text = "/dev/sd{h} /data/deep/er ext4 rw 0 0\n/dev/sd{h} /a\\040b{h} ext4 rw 0 0\nproc /proc proc rw 0 0\n/dev/md{k7} /x\\134{k7} xfs rw 0 0\n/dev/md{k7} /y\\134{k7} xfs rw 0 0\n"
    return captures.mounts(_captured(spark, sf, ("self/mounts", text)))


def capture_cpu_list(spark, sf):
    rows = _captured(spark, sf, ("online", "{k7}-{k},{ck},x,5-\n"))
    return rows.select("host", "ts", captures.cpu_list_size("content").alias("cpus"))


def capture_pid_stat(spark, sf):
    after = "S {c} {k2} 1 0 -1 {h} {k3} 0 {k7} 0 {c2} {c3} 0 0 20 -{c9} {k4} 0 {ck} 4096 {c}" + " 0" * 17 + " {h} 0 0"
    return captures.pid_stat(_captured(spark, sf, ("{k}/stat", "{k} (a) b{c} (x) " + after), ("{k}/stat", "{k} (short) S 1 2"), ("self/stat", "{k} (a) " + after)))


def capture_pid_status(spark, sf):
    text = "Name:\tx\nUid:\t{k}\t{c}\t0\t0\nVmRSS:\t  {k2} kB\nvoluntary_ctxt_switches:\t{k3}\nnonvoluntary_ctxt_switches:\t{c3}\n"
    return captures.pid_status(_captured(spark, sf, ("{k}/status", text)))


def capture_pid_io(spark, sf):
    return captures.pid_io(_captured(spark, sf, ("{k}/io", "rchar: {k}\nwchar: {c}\nsyscr: 9\nread_bytes: {k2}\ncancelled_write_bytes: 7\n")))


def capture_pid_schedstat(spark, sf):
    return captures.pid_schedstat(_captured(spark, sf, ("{k}/schedstat", "{k2} {c} 5\n"), ("{c}/schedstat", "{k2}\n")))


def capture_pid_cgroup(spark, sf):
    return captures.pid_cgroup(_captured(spark, sf, ("{k}/cgroup", "12:cpu:/old\n0::/user.slice/u{c}.scope\n"), ("{c}/cgroup", "1:name=systemd:/only\n")))


def capture_cgroup_io(spark, sf):
    both = "253:0 rbytes={k} wbytes={k}\n8:0 rbytes={c} wbytes={c2} rios=1\n8:16 rbytes=5 wbytes={h}\n"
    return captures.cgroup_io(_captured(spark, sf, ("/g{k}/io.stat", both), ("/m{k}/io.stat", "9:1 rbytes={k2} wbytes={k3}\n")))


def capture_cgroup_counters(spark, sf):
    cpu = "usage_usec {k3}\nuser_usec {k2}\nsystem_usec {k}\nnr_throttled 4\nthrottled_usec {c}\n"
    return captures.cgroup_counters(_captured(spark, sf, ("/g{k}/pids.current", "{h}\n"), ("/g{k}/memory.current", "{c2}\n"), ("/g{k}/cpu.stat", cpu), ("/g{k}/other", "1")))


def _readings(spark, sf, *columns: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("concat('h', o_orderkey % 4) AS host", "o_orderkey AS ts", *columns)


def capture_sensors(spark, sf):
    """A reading has a chip of one name once or twice, by the order's key."""
    device = "explode(if(o_orderkey % 2 = 0, array('d0', 'd1'), array('d0'))) AS device"
    rows = _readings(spark, sf, device, "'nvme' AS chip", "'Composite' AS label", "if(o_custkey % 2 = 0, 'temp', 'fan') AS kind", "o_custkey AS raw")
    return captures.sensors(rows).withColumn("value", F.round("value", 6))


def capture_frequencies(spark, sf):
    rows = _readings(spark, sf, "posexplode(array(o_orderkey * 4, o_custkey * 4)) AS (cpu, khz)")
    return captures.frequencies(rows).select("host", "ts", F.round("mean_mhz", 6).alias("mean_mhz"), F.round("max_mhz", 6).alias("max_mhz"))


def capture_energy(spark, sf):
    zones = "array(struct('intel-rapl:0' AS zone, 'package-0' AS name, o_orderkey AS energy_uj), struct('intel-rapl:0:1' AS zone, 'core' AS name, o_custkey AS energy_uj), struct('intel-rapl:1' AS zone, 'psys' AS name, 7L AS energy_uj))"
    return captures.energy_domains(_readings(spark, sf, f"inline({zones})"))


QUERIES = {
    f.__name__: f
    for f in (
        capture_cpu_times, capture_stat_counters, capture_meminfo, capture_vmstat, capture_loadavg, capture_diskstats, capture_net_dev, capture_pressure, capture_sockstat, capture_snmp, capture_file_nr, capture_mounts, capture_cpu_list,
        capture_pid_stat, capture_pid_status, capture_pid_io, capture_pid_schedstat, capture_pid_cgroup, capture_cgroup_io, capture_cgroup_counters, capture_sensors, capture_frequencies, capture_energy,
    )
}

_O = "WITH o AS (SELECT 'h' || (o_orderkey % 4) AS host, o_orderkey AS ts, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in NUMBERS.items()) + " FROM orders) "


def _each(*selects: str) -> str:
    return _O + " UNION ALL ".join(f"SELECT host, ts, {s} FROM o" for s in selects)


def _keys(**values: str) -> str:
    return _each(*[f"'{key.replace('__', '.')}' AS key, {value} AS value" for key, value in values.items()])


_MODES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest")


def _modes(cpu: str, *values: str) -> str:
    return f"'{cpu}' AS cpu, " + ", ".join(f'CAST({v} AS BIGINT) AS "{m}"' for m, v in zip(_MODES, values))


ORACLE = {
    "capture_cpu_times": _each(_modes("all", "k2", "c2", "k7", "k", "c9", "1", "2", "3", "ck"), _modes("0", "0", "0", "5", "6", "7", "8", "9", "10", "k2"), _modes("12", "c", "1", "2", "3", "0", "0", "0", "0", "0")),
    "capture_stat_counters": _keys(intr="ck", ctxt="k2", btime="CAST(17 AS BIGINT)", processes="c"),
    "capture_meminfo": _each("'MemTotal' AS key, k AS value", "'Active(anon)' AS key, c AS value", "'HugePages_Total' AS key, k7 AS value"),
    "capture_vmstat": _keys(pgpgin="k", pgpgout="c2"),
    "capture_loadavg": _each("k + 0.5::DOUBLE AS load1, c + 0.25::DOUBLE AS load5, 0.75::DOUBLE AS load15, ck AS tasks"),
    "capture_diskstats": _each("'sda' || k7 AS device, k AS reads, k2 AS sectors_read, c AS read_ms, c2 AS writes, k3 AS sectors_written, c3 AS write_ms, h AS in_flight, k4 AS busy_ms, ck AS weighted_ms"),
    "capture_net_dev": _each("'eth' || h AS iface, k AS rx_bytes, k2 AS rx_packets, h AS rx_errors, k7 AS rx_dropped, c AS tx_bytes, c2 AS tx_packets, c9 AS tx_errors, CAST(4 AS BIGINT) AS tx_dropped"),
    "capture_pressure": _each("'some' AS kind, k7 + 0.5::DOUBLE AS avg10, c9 + 0.25::DOUBLE AS avg60, 0.0::DOUBLE AS avg300, k AS total_us", "'full' AS kind, 0.0::DOUBLE AS avg10, h + 0.75::DOUBLE AS avg60, 1.0::DOUBLE AS avg300, c AS total_us"),
    "capture_sockstat": _keys(sockets__used="k", TCP__inuse="c", TCP__orphan="h"),
    "capture_snmp": _keys(Ip__Forwarding="h", Ip__DefaultTTL="CAST(64 AS BIGINT)", Tcp__MaxConn="-k", Tcp__RetransSegs="c"),
    "capture_file_nr": _each("k || ',0,' || c AS \"values\"", "CAST(c AS VARCHAR) AS \"values\""),
    "capture_mounts": _each("'/dev/sd' || h AS source, '/a b' || h AS target, 'ext4' AS fstype", "'/dev/md' || k7 AS source, '/x\\' || k7 AS target, 'xfs' AS fstype"),
    "capture_cpu_list": _each("greatest(k - k7 + 1, 0) + 1 AS cpus"),
    "capture_pid_stat": _each("k AS pid, 'a) b' || c || ' (x' AS comm, 'S' AS state, c AS ppid, k2 AS pgrp, h AS flags, k3 AS minflt, k7 AS majflt, c2 AS utime, c3 AS stime, -c9 AS nice, k4 AS threads, ck AS start_ticks, CAST(4096 AS BIGINT) AS vsize_bytes, c AS rss_pages, h AS blkio_ticks"),
    "capture_pid_status": _each("k AS pid, c AS uid, k2 AS rss_kb, CAST(NULL AS BIGINT) AS swap_kb, k3 AS voluntary_switches, c3 AS involuntary_switches"),
    "capture_pid_io": _each("k AS pid, k AS rchar, c AS wchar, k2 AS read_bytes, CAST(0 AS BIGINT) AS write_bytes"),
    "capture_pid_schedstat": _each("k AS pid, k2 AS run_ns, c AS wait_ns"),
    "capture_pid_cgroup": _each("k AS pid, '/user.slice/u' || c || '.scope' AS cgroup"),
    "capture_cgroup_io": _each("'/g' || k AS path, c + 5 AS read_bytes, c2 + h AS write_bytes", "'/m' || k AS path, k2 AS read_bytes, k3 AS write_bytes"),
    "capture_cgroup_counters": _each("'/g' || k AS path, h AS tasks, c2 AS memory, CAST(NULL AS BIGINT) AS swap, k3 AS usage_usec, k2 AS user_usec, k AS system_usec, c AS throttled_usec") + " WHERE h > 0",
    "capture_sensors": _O
    + "SELECT host, ts, CASE WHEN c % 2 = 0 THEN 'temp' ELSE 'fan' END AS kind, CASE WHEN k % 2 = 0 THEN 'nvme:' || d || '/Composite' ELSE 'nvme/Composite' END AS sensor, round(CASE WHEN c % 2 = 0 THEN c * 0.001::DOUBLE ELSE c END, 6) AS value FROM o, (VALUES ('d0'), ('d1')) t(d) WHERE k % 2 = 0 OR d = 'd0'",
    "capture_frequencies": _each("round(ck * 2 / 1000.0::DOUBLE, 6) AS mean_mhz, round(greatest(k, c) * 4 / 1000.0::DOUBLE, 6) AS max_mhz"),
    "capture_energy": _each("'package-0' AS domain, k AS energy_uj", "'package-0/core' AS domain, c AS energy_uj", "'psys' AS domain, CAST(7 AS BIGINT) AS energy_uj"),
}
