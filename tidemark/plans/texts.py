"""Queries on names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, units
from ..functions.endings import is_kernel_thread
from ..functions.numbers import add, bucket, micros, percent_text
from ..sources import encode
from ..sources.model import records, samples, spans, table, with_sql

_KINDS = ["a.service", "b.scope", "c.slice", "user@7.service", "plain", "u1/d.service"]


def _paths(spark, sf):
    """Control groups named for customers."""
    k = F.col("c_custkey").cast("string")
    forms = F.array(F.concat(F.lit("/system.slice/app-"), k, F.lit(".service")), F.concat(F.lit("/user.slice/user-7.slice/user@7.service/app.slice/run-"), k, F.lit(".scope")), F.concat(F.lit("/system.slice/x"), k, F.lit(".service/inner/deep")), F.concat(F.lit("/machine.slice/n"), k, F.lit(".slice")))
    return table(spark, sf, "customer").select("c_custkey", F.element_at(forms, (F.col("c_custkey") % 4 + 1).cast("int")).alias("path"))


def unit_kind(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", units.unit_kind(name).alias("kind"), units.is_sum(name).alias("is_sum"))


def nearest_unit(spark, sf):
    return _paths(spark, sf).select("c_custkey", units.nearest_unit("path").alias("unit"))


def container_ids(spark, sf):
    name = F.concat(F.lit("libpod-"), F.sha2(F.col("c_custkey").cast("string"), 256), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(".scope"))
    return table(spark, sf, "customer").select("c_custkey", units.container_id(name).alias("container"))


def unit_normalize(spark, sf):
    users = spark.createDataFrame([(7, "ann")], "uid bigint, user string")
    return units.unit_of(_paths(spark, sf), users).select("c_custkey", "path", "unit")


def group_name(spark, sf):
    comm = F.concat(F.lit("kworker"), F.when(F.col("p_partkey") % 3 == 0, "/").otherwise(":"), (F.col("p_partkey") % 8).cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.group_name(comm, is_kernel_thread((F.col("p_partkey") % 2) * 0x200000)).alias("name"))


def launchers(spark, sf):
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/usr/lib/systemd/systemd-executor "), F.col("o_orderstatus"))).otherwise(F.concat(F.lit("/bin/x systemd-executor "), F.col("o_orderstatus")))
    return table(spark, sf, "orders").select("o_orderkey", text.is_launcher(line).alias("launcher"))


def commands(spark, sf):
    a, b = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", text.shorten(text.command(a, b, F.lit("name")), 12).alias("command"), text.said(a, F.lit(""), b).alias("said"))


def documents_saying(spark, sf):
    return table(spark, sf, "documents").where(text.says("TOKEN", "text")).select("doc_id", "source")


def null_aware_sums(spark, sf):
    a, b = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 5 > 1, F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(add(a, b), 4).alias("total"), percent_text(b, a).alias("pct"), micros(F.col("o_totalprice") / 7).alias("micros"), bucket("o_orderkey", 60).alias("bucket"))


def user_names(spark, sf):
    from ..sources.captures import user_names as named

    users = table(spark, sf, "nation").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("user"))
    return named(table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") * 2).alias("uid")), users).select("c_custkey", "uid", "user")


def redact_secrets(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.redact(F.concat(F.lit("curl --token "), F.col("url"), F.lit(" --password="), F.col("url"))).alias("line"))


def redact_documents(spark, sf):
    """Words of documents as a command line: what is plainly a secret in them is withheld."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.redact("text")).alias("redacted"))


def human_text(spark, sf):
    r = records(spark, sf)
    return r.select("pid", text.human_duration(F.col("elapsed_seconds") * 100).alias("duration"), text.human_bytes(F.col("peak_rss_bytes") * 1000).alias("size"))


def prometheus_text(spark, sf):
    return encode.prometheus_text(samples(spark, sf))


def ndjson(spark, sf):
    return encode.ndjson(records(spark, sf))


def otlp_json(spark, sf):
    s = spans(spark, sf)
    return encode.otlp_json(s.select("host", "unit", F.md5(F.col("trace").cast("string")).alias("trace_id"), F.substring(F.md5(F.concat_ws("-", "trace", "span")), 1, 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), "name", "status", F.lit("").alias("ending"), (F.col("start_s") * 1_000_000_000).alias("start_ns"), (F.col("duration_s") * 1_000_000_000).alias("duration_ns")))


def wire_bytes(spark, sf):
    return encode.wire_bytes(encode.ndjson(records(spark, sf)))


QUERIES = {f.__name__: f for f in (unit_kind, nearest_unit, container_ids, unit_normalize, group_name, launchers, commands, documents_saying, null_aware_sums, user_names, redact_secrets, redact_documents, human_text, prometheus_text, ndjson, otlp_json, wire_bytes)}

_FORMS = "CASE c_custkey % 4 WHEN 0 THEN '/system.slice/app-' || c_custkey || '.service' WHEN 1 THEN '/user.slice/user-7.slice/user@7.service/app.slice/run-' || c_custkey || '.scope' WHEN 2 THEN '/system.slice/x' || c_custkey || '.service' END"
_FIELDS = {"_msg": "message", "_time": "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ')", "level": "level", "host": "host", "kind": "kind", "service": "service", "status": "status", "user": "usr", "unit": "unit"}
_AMOUNTS = ("pid", "elapsed_seconds", "cpu_seconds", "peak_rss_bytes", "io_read_bytes", "io_write_bytes")
_LINE = " || ',' || ".join([f"""'"{key}":"' || {value} || '"'""" for key, value in _FIELDS.items()] + [f"""'"{key}":' || {key}""" for key in _AMOUNTS])
_NDJSON = with_sql("records") + f"l AS (SELECT '{{' || {_LINE} || '}}' AS line FROM records) "
ORACLE = {
    "unit_kind": "SELECT c_custkey, ['service', 'scope', 'slice', 'manager', 'service', 'service'][c_custkey % 6 + 1] AS kind, c_custkey % 6 IN (2, 3) AS is_sum FROM customer",
    "nearest_unit": f"SELECT c_custkey, {_FORMS} AS unit FROM customer",
    "container_ids": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN sha256(CAST(c_custkey AS VARCHAR)) END AS container FROM customer",
    # numbers of six digits and more mark an instance of a service after a dash
    "unit_normalize": f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '/machine.slice/n' || c_custkey || '.slice' WHEN c_custkey % 4 = 2 THEN {_FORMS} || '/inner/deep' ELSE {_FORMS} END AS path, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey >= 100000 THEN 'app.service' ELSE 'app-' || c_custkey || '.service' END WHEN 1 THEN 'ann/run.scope' WHEN 2 THEN 'x' || c_custkey || '.service' END AS unit FROM customer",
    "prometheus_text": with_sql("samples") + "n AS (SELECT *, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS v FROM samples) SELECT name || '{host=\"' || host || '\",proc=\"' || proc || '\",unit=\"' || unit || '\",user=\"' || usr || '\"} ' || v || ' ' || ts * 1000 AS line FROM n",
    "ndjson": _NDJSON + "SELECT line FROM l",
    "wire_bytes": _NDJSON + "SELECT CAST(coalesce(sum(strlen(line) + 1), 0) AS BIGINT) AS bytes FROM l",
    "group_name": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'kworker' ELSE 'kworker' || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE ':' END || (p_partkey % 8) END AS name FROM part",
    "launchers": "SELECT o_orderkey, o_orderkey % 2 = 0 AS launcher FROM orders",
    "commands": """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 2 > 0 THEN o_orderstatus END AS b FROM orders), c AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN a || ' → ' || b ELSE coalesce(b, a, 'name') END AS c FROM a)
SELECT o_orderkey, CASE WHEN length(c) > 12 THEN substr(c, 1, 11) || '…' ELSE c END AS command, concat_ws(' ', a, b) AS said FROM c""",
    "documents_saying": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'token')",
    "null_aware_sums": """WITH a AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 5 > 1 THEN o_custkey END AS b FROM orders)
SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE round(coalesce(a, 0) + coalesce(b, 0), 4) END AS total, CASE WHEN a > 0 THEN round(1000.0::DOUBLE * b / a) / 10 END AS pct, round(o_totalprice / 7 * 1e6) / 1e6 AS micros, o_orderkey // 60 * 60 AS bucket FROM a""",
    "user_names": "SELECT c_custkey, c_nationkey * 2 AS uid, coalesce(n_name, CAST(c_nationkey * 2 AS VARCHAR)) AS \"user\" FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey * 2",
}
