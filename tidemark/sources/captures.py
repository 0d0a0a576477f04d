"""Rows from captured kernel text: (host, ts, path, content), one row for each file that was read.

Every reader takes the captures of its own path and keeps host and ts. What a file does not say is null, not 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import MODES
from ..functions.text import command_lines, octal_unescaped

# Filesystems that hold data on a device or a server.
REAL_FILESYSTEMS = ("bcachefs", "btrfs", "exfat", "ext2", "ext3", "ext4", "f2fs", "jfs", "nfs", "nfs4", "ntfs", "ntfs3", "reiserfs", "vfat", "xfs", "zfs")


def _of(captures: DataFrame, path: str) -> DataFrame:
    return captures.where(F.col("path") == path)


def _lines(captures: DataFrame, *keep: str) -> DataFrame:
    return captures.select("host", "ts", *keep, F.posexplode(F.split("content", "\n")).alias("line_no", "line")).where("trim(line) <> ''")


def _fields(line="line") -> Column:
    return F.split(F.trim(F.col(line)), r"\s+")


def _n(text: Column, kind: str = "bigint") -> Column:
    return text.try_cast(kind)


def _at(fields: Column, i: int, kind: str = "bigint") -> Column:
    return _n(F.get(fields, i), kind)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def cpu_times(captures: DataFrame) -> DataFrame:
    """host, ts, cpu (all, 0, 1, ...) and the nine modes in ticks. What guests used is taken out of user and nice, down to 0; modes of a later kernel are 0."""
    rows = _lines(_of(captures, "stat")).where(F.col("line").rlike(r"^cpu([0-9]*)\s")).withColumn("_f", _fields())
    v = [_zero(_at(F.col("_f"), i)) for i in range(1, 11)]
    modes = dict(zip(MODES, [F.greatest(v[0] - v[8], F.lit(0)), F.greatest(v[1] - v[9], F.lit(0)), *v[2:8], v[8] + v[9]]))
    number = F.regexp_extract("line", "^cpu([0-9]*)", 1)
    return rows.select("host", "ts", F.when(number == "", "all").otherwise(number).alias("cpu"), *[modes[m].cast("bigint").alias(m) for m in MODES])


def stat_counters(captures: DataFrame) -> DataFrame:
    """host, ts, key, value of the other lines of /proc/stat: their first number."""
    rows = _lines(_of(captures, "stat")).withColumn("_f", _fields())
    key = F.get("_f", 0)
    return rows.where(key.isin("intr", "softirq", "ctxt", "processes", "btime", "procs_running", "procs_blocked")).select("host", "ts", key.alias("key"), _at(F.col("_f"), 1).alias("value")).where("value is not null")


def keyed(captures: DataFrame, path: str = "meminfo") -> DataFrame:
    """host, ts, key, value of ``Key: value [kB]`` lines, in the file's own unit."""
    rows = _lines(_of(captures, path)).where(F.contains("line", F.lit(":")))
    return rows.select("host", "ts", F.trim(F.substring_index("line", ":", 1)).alias("key"), _n(F.regexp_extract("line", r"^[^:]*:\s*([0-9]+)", 1)).alias("value")).where("value is not null")


def pairs(captures: DataFrame, path: str = "vmstat") -> DataFrame:
    """host, ts, key, value of ``key value`` lines whose value is a number."""
    rows = _lines(_of(captures, path)).withColumn("_f", _fields())
    return rows.select("host", "ts", F.get("_f", 0).alias("key"), _at(F.col("_f"), 1).alias("value")).where("value is not null")


def loadavg(captures: DataFrame) -> DataFrame:
    f = F.split(F.trim("content"), r"\s+")
    tasks = _n(F.get(F.split(F.get(f, 3), "/"), 1))
    return _of(captures, "loadavg").select("host", "ts", *[_at(f, i, "double").alias(c) for i, c in enumerate(("load1", "load5", "load15"))], tasks.alias("tasks")).where("load1 is not null and load5 is not null and load15 is not null and tasks is not null")


def diskstats(captures: DataFrame) -> DataFrame:
    """A row for each device of 14 fields or more, partitions too."""
    places = {"reads": 3, "sectors_read": 5, "read_ms": 6, "writes": 7, "sectors_written": 9, "write_ms": 10, "in_flight": 11, "busy_ms": 12, "weighted_ms": 13}
    rows = _lines(_of(captures, "diskstats")).withColumn("_f", _fields()).where(F.size("_f") >= 14)
    return rows.select("host", "ts", F.get("_f", 2).alias("device"), *[_zero(_at(F.col("_f"), i)).alias(c) for c, i in places.items()])


def net_dev(captures: DataFrame) -> DataFrame:
    """A row for each interface; the two header lines have no numbers."""
    places = {"rx_bytes": 0, "rx_packets": 1, "rx_errors": 2, "rx_dropped": 3, "tx_bytes": 8, "tx_packets": 9, "tx_errors": 10, "tx_dropped": 11}
    rows = _lines(_of(captures, "net/dev")).where(F.contains("line", F.lit(":")))
    rows = rows.withColumn("_f", F.split(F.trim(F.regexp_replace("line", "^[^:]*:", "")), r"\s+")).where((F.size("_f") >= 16) & _at(F.col("_f"), 0).isNotNull())
    return rows.select("host", "ts", F.trim(F.substring_index("line", ":", 1)).alias("iface"), *[_zero(_at(F.col("_f"), i)).alias(c) for c, i in places.items()])


def pressure(captures: DataFrame, path: str) -> DataFrame:
    """host, ts, kind (some, full), avg10, avg60, avg300, total_us; either line may be missing."""
    rows = _lines(_of(captures, path)).withColumn("kind", F.get(_fields(), 0)).where("kind in ('some', 'full')")
    part = lambda key, kind: _zero(_n(F.regexp_extract("line", rf"\b{key}=(\S+)", 1), kind))
    return rows.select("host", "ts", "kind", part("avg10", "double").alias("avg10"), part("avg60", "double").alias("avg60"), part("avg300", "double").alias("avg300"), part("total", "bigint").alias("total_us"))


def sockstat(captures: DataFrame) -> DataFrame:
    """host, ts, key (TCP.inuse), value."""
    rows = _lines(_of(captures, "net/sockstat")).where(F.contains("line", F.lit(":")))
    f = F.split(F.trim(F.regexp_replace("line", "^[^:]*:", "")), r"\s+")
    steps = F.expr("sequence(0, size(_f) div 2 - 1)")
    each = rows.withColumn("_f", f).where("size(_f) >= 2").withColumn("_i", F.explode(steps))
    key = F.concat(F.trim(F.substring_index("line", ":", 1)), F.lit("."), F.get("_f", F.col("_i") * 2))
    return each.select("host", "ts", key.alias("key"), _n(F.get("_f", F.col("_i") * 2 + 1)).alias("value")).where("value is not null")


def snmp(captures: DataFrame) -> DataFrame:
    """host, ts, key (Tcp.RetransSegs), value, which may be negative: a line of names and a line of values, by turns."""
    lines = _lines(_of(captures, "net/snmp")).withColumn("_proto", F.substring_index("line", ":", 1)).withColumn("_f", F.split(F.trim(F.regexp_replace("line", "^[^:]*:", "")), r"\s+"))
    both = lines.withColumn("_pair", F.floor(F.col("line_no") / 2)).groupBy("host", "ts", "_pair").agg(F.min_by("_proto", "line_no").alias("_proto"), F.min_by("_f", "line_no").alias("_names"), F.max_by("_f", "line_no").alias("_values"), F.count("*").alias("_n")).where("_n = 2")
    each = both.select("host", "ts", "_proto", F.explode(F.arrays_zip("_names", "_values")).alias("_x"))
    return each.select("host", "ts", F.concat("_proto", F.lit("."), F.col("_x._names")).alias("key"), _n(F.col("_x._values")).alias("value")).where("key is not null and value is not null")


def numbers(captures: DataFrame, path: str) -> DataFrame:
    """host, ts, values: the whole numbers that a one-line file begins with."""
    f = F.split(F.trim("content"), r"\s+")
    values = F.transform(f, lambda x: x.try_cast("bigint"))
    bad = F.array_position(F.transform(values, lambda x: x.isNull()), True)
    kept = F.when(bad > 0, F.slice(values, 1, (bad - 1).cast("int"))).otherwise(values)
    return _of(captures, path).select("host", "ts", kept.alias("values"))


def mounts(captures: DataFrame) -> DataFrame:
    """host, ts, source, target, fstype: real filesystems, each source once, at its shortest target (of equal ones the first)."""
    rows = _lines(_of(captures, "self/mounts")).withColumn("_f", _fields()).where(F.get("_f", 2).isin(*REAL_FILESYSTEMS))
    named = rows.select("host", "ts", "line_no", F.get("_f", 0).alias("source"), octal_unescaped(F.get("_f", 1)).alias("target"), F.get("_f", 2).alias("fstype"))
    return named.groupBy("host", "ts", "source").agg(F.min_by(F.struct("target", "fstype"), F.struct(F.octet_length("target"), "line_no")).alias("_m")).select("host", "ts", "source", "_m.target", "_m.fstype")


def cpu_list_size(text: Column) -> Column:
    """How many CPUs 0-3,8-11 names; a part that is no range counts none."""
    low, high = (lambda p, i=i: F.regexp_extract(p, "^([0-9]+)(?:-([0-9]+))?$", i).try_cast("bigint") for i in (1, 2))
    size = lambda p: F.when(low(p).isNull(), 0).when(high(p).isNull(), F.when(F.contains(p, F.lit("-")), 0).otherwise(1)).otherwise(F.greatest(high(p) - low(p) + 1, F.lit(0)))
    return F.aggregate(F.split(F.trim(text), ","), F.lit(0).cast("bigint"), lambda s, p: s + size(p))


def _pid_files(captures: DataFrame, file: str) -> DataFrame:
    return captures.withColumn("pid", F.regexp_extract("path", rf"^([0-9]+)/{file}$", 1)).where("pid <> ''").withColumn("pid", F.col("pid").cast("bigint"))


#: Field of stat -> its place.
_PLACES = {"ppid": 4, "pgrp": 5, "flags": 9, "minflt": 10, "majflt": 12, "utime": 14, "stime": 15, "nice": 19, "threads": 20, "start_ticks": 22, "vsize_bytes": 23, "rss_pages": 24}
_IN_BRACKETS, _NAME = r"(?s)\(.*\)", r"(?s)^[^(]*\((.*)\)"


def _after_name(content: str = "content") -> Column:
    return F.split(F.trim(F.regexp_extract(content, r"(?s)^.*\)(.*)$", 1)), r"\s+")


def _stat_fields(f: Column) -> list[Column]:
    return [F.get(f, 0).alias("state"), *[_at(f, n - 3).alias(c) for c, n in _PLACES.items()], _zero(_at(f, 39)).alias("blkio_ticks")]


_COMPLETE = " and ".join(f"{c} is not null" for c in _PLACES)


def pid_stat(captures: DataFrame) -> DataFrame:
    """A row for each process; its name, which may hold anything, ends at the last parenthesis."""
    rows = _pid_files(captures, "stat").withColumn("comm", F.regexp_extract("content", _NAME, 1)).withColumn("_f", _after_name())
    return rows.where(F.col("content").rlike(_IN_BRACKETS)).select("host", "ts", "pid", "comm", *_stat_fields(F.col("_f"))).where(_COMPLETE)


def _found(content: str, pattern: str) -> Column:
    """The number in the group; what is not there is null before it is cast, as a cast that fails raises inside, which is slow."""
    return _n(F.nullif(F.regexp_extract(content, pattern, 1), F.lit("")))


def _status(content: str = "content") -> list[Column]:
    """A text that is null says nothing; one that is not has switched 0 times where it does not say how often."""
    of = lambda pattern: _found(content, rf"(?m)^{pattern}")
    zero = lambda pattern: F.when(F.col(content).isNotNull(), _zero(of(pattern)))
    return [of(r"Uid:\s+\S+\s+([0-9]+)").alias("uid"), of(r"VmRSS:\s+([0-9]+)").alias("rss_kb"), of(r"VmSwap:\s+([0-9]+)").alias("swap_kb"), zero(r"voluntary_ctxt_switches:\s+([0-9]+)").alias("voluntary_switches"), zero(r"nonvoluntary_ctxt_switches:\s+([0-9]+)").alias("involuntary_switches")]


def _io(content: str = "content") -> list[Column]:
    return [F.when(F.col(content).isNotNull(), _zero(_found(content, rf"(?m)^{k}:\s*([0-9]+)"))).alias(k) for k in ("rchar", "wchar", "read_bytes", "write_bytes")]


def pid_status(captures: DataFrame) -> DataFrame:
    """Effective uid, resident and swapped kB (null for kernel threads) and context switches."""
    return _pid_files(captures, "status").select("host", "ts", "pid", *_status())


def pid_io(captures: DataFrame) -> DataFrame:
    """Bytes read and written. A file that could not be read is no capture, and so no row and no zeros."""
    return _pid_files(captures, "io").select("host", "ts", "pid", *_io())


def pid_schedstat(captures: DataFrame) -> DataFrame:
    f = F.split(F.trim("content"), r"\s+")
    return _pid_files(captures, "schedstat").select("host", "ts", "pid", _at(f, 0).alias("run_ns"), _at(f, 1).alias("wait_ns")).where("run_ns is not null and wait_ns is not null")


def pid_files(captures: DataFrame) -> DataFrame:
    """What pid_stat, pid_status, pid_io, pid_schedstat and pid_cgroup say of each process whose stat was read, in one row; null where the other files were not.

    One pass over the captures and one exchange, by (host, pid), which windows over a process's life need as well; nothing is joined, so nothing is sent to all.
    """
    named = captures.where(F.col("path").rlike("^[0-9]+/(stat|status|io|schedstat|cgroup)$"))
    rows = named.select("host", F.substring_index("path", "/", 1).cast("bigint").alias("pid"), "ts", F.substring_index("path", "/", -1).alias("_file"), "content").repartition("host", "pid")
    files = ("stat", "status", "io", "schedstat", "cgroup")
    each = rows.groupBy("host", "pid", "ts").agg(*[F.max(F.when(F.col("_file") == f, F.col("content"))).alias(f"_{f}") for f in files]).withColumn("_f", _after_name("_stat"))
    # the condition names the fields once: it is moved below them, and would split the text again for each mention
    whole = F.size(F.filter("_f", lambda x, i: i.isin(*[n - 3 for n in _PLACES.values()]) & x.try_cast("bigint").isNotNull())) == len(_PLACES)
    waited = each.where(F.col("_stat").rlike(_IN_BRACKETS) & whole).withColumn("_w", F.split(F.trim("_schedstat"), r"\s+"))
    run, wait = _at(F.col("_w"), 0), _at(F.col("_w"), 1)
    return waited.select(
        "host", "ts", "pid", F.regexp_extract("_stat", _NAME, 1).alias("comm"), *_stat_fields(F.col("_f")), *_status("_status"), *_io("_io"), F.when(wait.isNotNull(), run).alias("run_ns"), F.when(run.isNotNull(), wait).alias("wait_ns"),
        F.when(F.col("_cgroup").rlike("(?m)^0::"), _cgroup("_cgroup")).alias("cgroup"),
    )


def pid_cmdline(captures: DataFrame, most: int = 400) -> DataFrame:
    return _pid_files(captures, "cmdline").select("host", "ts", "pid", command_lines(most)(F.col("content")).alias("cmdline"))


def _cgroup(content: str = "content") -> Column:
    return F.regexp_extract(content, r"(?m)^0::(.*?)\s*$", 1)


def pid_cgroup(captures: DataFrame) -> DataFrame:
    """The path on the unified hierarchy's line."""
    return _pid_files(captures, "cgroup").where(F.col("content").rlike(r"(?m)^0::")).select("host", "ts", "pid", _cgroup().alias("cgroup"))


def cgroup_io(captures: DataFrame) -> DataFrame:
    """host, ts, path, read_bytes, write_bytes of io.stat files: physical devices, or stacked ones only where there are no others.

    ``devices`` are told apart by name (dm-, md), which io.stat gives as major:minor; 253 and 9 are the kernel's majors for them.
    """
    rows = _lines(captures.where(F.col("path").endswith("/io.stat")), "path").withColumn("_f", _fields())
    of = lambda key: _zero(_n(F.regexp_extract("line", rf"\b{key}=([0-9]+)", 1)))
    each = rows.select("host", "ts", F.regexp_extract("path", "^(.*)/io.stat$", 1).alias("path"), F.get("_f", 0).rlike("^(253|9):").alias("_stacked"), of("rbytes").alias("r"), of("wbytes").alias("w"))
    total = lambda c, stacked: F.sum(F.when(F.col("_stacked") == stacked, F.col(c)))
    return each.groupBy("host", "ts", "path").agg(F.coalesce(total("r", False), total("r", True)).alias("read_bytes"), F.coalesce(total("w", False), total("w", True)).alias("write_bytes"))


def cgroup_counters(captures: DataFrame) -> DataFrame:
    """host, ts, path and the counters of each group with processes in it: tasks, usage_us, memory and the like, null where a file was not read."""
    files = {"pids.current": "tasks", "memory.current": "memory", "memory.swap.current": "swap"}
    group, file = F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    rows = captures.withColumn("_g", group).withColumn("_file", file)
    single = [F.max(F.when(F.col("_file") == f, _n(F.trim("content")))).alias(c) for f, c in files.items()]
    keyed_ = [F.max(F.when(F.col("_file") == "cpu.stat", _n(F.regexp_extract("content", rf"(?m)^{k}\s+([0-9]+)", 1)))).alias(k) for k in ("usage_usec", "user_usec", "system_usec", "throttled_usec")]
    out = rows.where(file.isin(*files, "cpu.stat")).groupBy("host", "ts", F.col("_g").alias("path")).agg(*single, *keyed_)
    return out.where("tasks is null or tasks > 0")


def sensors(readings: DataFrame) -> DataFrame:
    """(host, ts, device, chip, label, kind, raw) -> sensor, value: a chip that a host has twice is named with its device; degrees from thousandths."""
    chips = readings.select("host", "ts", "chip", "device").distinct().groupBy("host", "ts", "chip").agg(F.count("*").alias("_n"))
    name = F.when(F.col("_n") > 1, F.concat("chip", F.lit(":"), "device")).otherwise(F.col("chip"))
    value = F.when(F.col("kind") == "temp", F.col("raw") * 0.001).otherwise(F.col("raw").cast("double"))
    return readings.join(chips, ["host", "ts", "chip"]).select("host", "ts", "kind", F.concat(name, F.lit("/"), "label").alias("sensor"), value.alias("value"))


def frequencies(readings: DataFrame) -> DataFrame:
    """(host, ts, cpu, khz) -> the mean and the highest in MHz."""
    return readings.groupBy("host", "ts").agg((F.avg("khz") / 1000).alias("mean_mhz"), (F.max("khz") / 1000).alias("max_mhz"))


def energy_domains(readings: DataFrame) -> DataFrame:
    """(host, ts, zone, name, energy_uj) -> domain: one within another (intel-rapl:0:1) is named parent/child."""
    parents = readings.select("host", "ts", F.col("zone").alias("_zone"), F.col("name").alias("_parent"))
    zone = F.when(F.size(F.split("zone", ":")) > 2, F.substring_index("zone", ":", 2))
    return readings.withColumn("_zone", zone).join(parents, ["host", "ts", "_zone"], "left").select("host", "ts", F.concat_ws("/", "_parent", "name").alias("domain"), "energy_uj")


def user_names(rows: DataFrame, users: DataFrame) -> DataFrame:
    """``rows`` (uid, ...) with user; an unknown uid is its number. No broadcast is forced: users are as many as they are."""
    named = users.groupBy(F.col("uid").alias("_uid")).agg(F.min("user").alias("user"))
    return rows.join(named, rows["uid"] == named["_uid"], "left").withColumn("user", F.coalesce("user", F.col("uid").cast("string"))).drop("_uid")
