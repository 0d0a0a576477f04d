"""Decoding the kernel's binary record of a task that ended (struct taskstats)."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

# Name, offset in bytes and struct format of the fields of <linux/taskstats.h> on x86-64 and aarch64.
FIELDS = (
    ("version", 0, "H"), ("exit_status", 4, "I"), ("flag", 8, "B"), ("nice", 9, "b"), ("cpu_delay_ns", 24, "Q"), ("blkio_delay_ns", 40, "Q"), ("swapin_delay_ns", 56, "Q"), ("uid", 120, "I"), ("gid", 124, "I"), ("pid", 128, "I"), ("ppid", 132, "I"), ("btime", 136, "I"),
    ("elapsed_us", 144, "Q"), ("user_us", 152, "Q"), ("system_us", 160, "Q"), ("minor_faults", 168, "Q"), ("major_faults", 176, "Q"), ("peak_rss_kb", 200, "Q"), ("peak_vm_kb", 208, "Q"), ("read_char", 216, "Q"), ("write_char", 224, "Q"), ("read_bytes", 248, "Q"), ("write_bytes", 256, "Q"),
    ("voluntary_switches", 272, "Q"), ("involuntary_switches", 280, "Q"), ("reclaim_delay_ns", 320, "Q"), ("thrashing_delay_ns", 336, "Q"), ("btime64", 344, "Q"), ("tgid", 368, "I"), ("group_elapsed_us", 376, "Q"), ("exe_dev", 384, "Q"), ("exe_inode", 392, "Q"),
)
COMM, COMM_SIZE, LEAST, GROUPED = 80, 32, 288, 12
_OUT = [n for n, _, _ in FIELDS if n not in ("btime", "btime64")]
SCHEMA = "host string, at double, comm string, start_epoch bigint, " + ", ".join(f"{n} bigint" for n in _OUT)


def decode(raw: bytes) -> dict | None:
    """None if the record ends before the fields that all versions have; what a shorter one does not hold is 0."""
    if len(raw) < LEAST:
        return None
    got = {n: struct.unpack_from(f"={f}", raw, at)[0] if at + struct.calcsize(f) <= len(raw) else 0 for n, at, f in FIELDS}
    got["comm"] = raw[COMM : COMM + COMM_SIZE].split(b"\0")[0].decode(errors="replace")
    if got["version"] < GROUPED:  # it does not say which process a thread was of
        got |= {"tgid": got["pid"], "group_elapsed_us": 0, "exe_dev": 0, "exe_inode": 0}
    got["start_epoch"] = got.pop("btime64") or got["btime"]
    got.pop("btime")
    return got


def decode_records(records: DataFrame) -> DataFrame:
    """(host, at, record binary) -> one row of figures for each whole record."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(h, at, decode(r)) for h, at, r in zip(*(b.column(c).to_pylist() for c in ("host", "at", "record"))) if r is not None]
            rows = [{"host": h, "at": at} | d for h, at, d in rows if d]
            columns = {n: [_signed(r[n]) for r in rows] for n in names}
            types = {"host": pa.string(), "at": pa.float64(), "comm": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], types.get(n, pa.int64())) for n in names], names)

    return records.select("host", "at", "record").mapInArrow(run, SCHEMA)


def _signed(v):
    """Counters over 2**63 do not fit a bigint; they are as large as it goes."""
    return min(v, 2**63 - 1) if isinstance(v, int) else v
