"""The three signals, as schemas, and the tables at hand projected onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "name string, host string, labels map<string,string>, ts bigint, value double"
RECORDS = "ts_us bigint, level string, message string, kind string, service string, status string, host string, user string, unit string, pid bigint, elapsed_seconds double, cpu_seconds double, peak_rss_bytes bigint, io_read_bytes bigint, io_write_bytes bigint, cmdline string"
SPANS = "trace_id string, span_id string, parent_span_id string, name string, service string, unit string, status string, ending string, start_ns bigint, duration_ns bigint, attributes string"
READINGS = "host string, ts double, subject string, counter string, value bigint"
CAPTURES = "host string, ts double, path string, content string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_us(ts) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_s(ts) -> Column:
    return F.floor(epoch_us(ts) / 1_000_000).cast("bigint")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Events as gauge samples. ``id`` breaks ties between samples of one second."""
    e = table(spark, folder, "events")
    u = F.col("user_id")
    labels = F.create_map(F.lit("proc"), _text(F.col("event_type"), "[", u.cast("string"), "]"), F.lit("user"), _text("u", u.cast("string")), F.lit("unit"), _text("u", (u % 10).cast("string"), ".service"))
    return e.select(F.col("event_type").alias("name"), _text("h", (u % 4).cast("string")).alias("host"), labels.alias("labels"), epoch_s(F.col("ts")).alias("ts"), "value", F.col("event_id").alias("id"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as accounting records of processes that ended."""
    e, u = table(spark, folder, "events"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = F.when(k % 10 == 0, "SIGSEGV").when(k % 10 == 1, "SIGKILL").when(k % 10 == 2, "1").when(k % 10 == 3, "unknown").otherwise("0")
    out = e.select(
        epoch_us(F.col("ts")).alias("ts_us"), F.lit("exit").alias("kind"), F.col("event_type").alias("service"), status.alias("status"), _text("h", (u % 4).cast("string")).alias("host"), _text("u", u.cast("string")).alias("user"), _text("u", (u % 10).cast("string"), ".service").alias("unit"),
        F.col("event_id").alias("pid"), F.col("value").alias("elapsed_seconds"), (F.col("value") / 2).alias("cpu_seconds"), F.round(F.col("value") * 1024).cast("bigint").alias("peak_rss_bytes"), (k * 4096).alias("io_read_bytes"), F.round(F.col("value")).cast("bigint").alias("io_write_bytes"),
    )
    level = F.when(F.col("status") == "SIGSEGV", "error").when(F.col("status") == "SIGKILL", "warning").when(F.col("status") == "1", "notice").otherwise("info")
    ended = F.when(F.col("status").rlike("^[0-9]+$"), _text("exited ", F.col("status"))).when(F.col("status") == "unknown", "gone").otherwise(_text("killed by ", F.col("status")))
    return out.withColumn("level", level).withColumn("message", _text(F.col("service"), "[", F.col("pid").cast("string"), "] ", ended))


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as traces: a turn is a span, and its parent is the turn at half its number."""
    c = table(spark, folder, "conversations")
    n = F.length("text").cast("bigint")
    return c.select(
        F.col("conv_id").alias("trace"), F.col("turn").alias("span"), F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")).alias("parent"), F.col("role").alias("name"),
        (F.col("conv_id") * 3600 + F.col("turn") * 10).alias("start_s"), n.alias("duration_s"), F.when(n % 7 == 0, "error").otherwise("ok").alias("status"), _text(F.col("role"), ".service").alias("unit"), _text("h", (F.col("conv_id") % 4).cast("string")).alias("host"), F.col("text").alias("command"),
    )


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of one counter for each user, which often goes backwards."""
    e = table(spark, folder, "events")
    return e.select(_text("h", (F.col("user_id") % 4).cast("string")).alias("host"), _text("u", F.col("user_id").cast("string")).alias("subject"), (epoch_us(F.col("ts")) / 1e6).alias("ts"), F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("bigint").alias("counter"))


def processes(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as processes that are still running, a process group for each."""
    c = table(spark, folder, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("pid"), (F.col("conv_id") * 100).alias("pgid"), (F.col("conv_id") * 3600 + F.col("turn") * 10).alias("start_s"), F.col("role").alias("comm"), _text(F.col("role"), ".service").alias("unit"), (F.length("text") / 10).alias("cpu_seconds"), F.when(F.col("turn") > 0, F.expr("conv_id * 100 + (turn - 1) div 2")).otherwise(F.lit(1)).cast("bigint").alias("ppid"))


#: The same projections in SQL, for the queries' oracles.
SQL = {
    "samples": "samples AS (SELECT event_id AS id, event_type AS name, 'h' || (user_id % 4) AS host, event_type || '[' || user_id || ']' AS proc, 'u' || user_id AS usr, 'u' || (user_id % 10) || '.service' AS unit, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS ts, value FROM events)",
    "records": """r0 AS (SELECT epoch_us(ts) AS ts_us, 'exit' AS kind, event_type AS service, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'h' || (user_id % 4) AS host, 'u' || user_id AS usr, 'u' || (user_id % 10) || '.service' AS unit, event_id AS pid, value AS elapsed_seconds, value / 2 AS cpu_seconds, CAST(round(value * 1024) AS BIGINT) AS peak_rss_bytes, CAST(round(value) AS BIGINT) AS io_write_bytes FROM events),
r1 AS (SELECT *, k * 4096 AS io_read_bytes, CASE k % 10 WHEN 0 THEN 'SIGSEGV' WHEN 1 THEN 'SIGKILL' WHEN 2 THEN '1' WHEN 3 THEN 'unknown' ELSE '0' END AS status FROM r0),
records AS (SELECT *, CASE status WHEN 'SIGSEGV' THEN 'error' WHEN 'SIGKILL' THEN 'warning' WHEN '1' THEN 'notice' ELSE 'info' END AS level, service || '[' || pid || '] ' || CASE WHEN regexp_matches(status, '^[0-9]+$') THEN 'exited ' || status WHEN status = 'unknown' THEN 'gone' ELSE 'killed by ' || status END AS message FROM r1)""",
    "spans": "spans AS (SELECT conv_id AS trace, turn AS span, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role AS name, conv_id * 3600 + turn * 10 AS start_s, length(text) AS duration_s, CASE WHEN length(text) % 7 = 0 THEN 'error' ELSE 'ok' END AS status, role || '.service' AS unit, 'h' || (conv_id % 4) AS host, text AS command FROM conversations)",
    "counters": "counters AS (SELECT 'h' || (user_id % 4) AS host, 'u' || user_id AS subject, epoch_us(ts) / 1e6 AS ts, event_id AS id, CAST(round(value * 100) AS BIGINT) AS counter FROM events)",
    "processes": "processes AS (SELECT conv_id * 100 + turn AS pid, conv_id * 100 AS pgid, conv_id * 3600 + turn * 10 AS start_s, role AS comm, role || '.service' AS unit, length(text) / 10 AS cpu_seconds, CASE WHEN turn > 0 THEN conv_id * 100 + (turn - 1) // 2 ELSE 1 END AS ppid FROM conversations)",
}


def with_sql(*names: str) -> str:
    """WITH and the named projections."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + ",\n"
