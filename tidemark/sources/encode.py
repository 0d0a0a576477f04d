"""The three wire formats, a line or a body for each row or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import float_text


def _escaped(text: Column) -> Column:
    r"""\, " and line feeds as the exposition format has them."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus_text(samples: DataFrame) -> DataFrame:
    """line: name{host="...",k="..."} value milliseconds; the host first, then labels in order of their keys."""
    others = F.array_sort(F.filter(F.map_entries("labels"), lambda e: e["key"] != "host"))
    pairs = F.concat(F.array(F.concat(F.lit('host="'), _escaped(F.col("host")), F.lit('"'))), F.transform(others, lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"'))))
    return samples.select(F.concat(F.col("name"), F.lit("{"), F.array_join(pairs, ","), F.lit("} "), float_text("value"), F.lit(" "), (F.col("ts") * 1000).cast("string")).alias("line"))


def ndjson(records: DataFrame) -> DataFrame:
    """line: a JSON object of the record's fields that are not null, with _msg, _time, level and host."""
    fields = [c for c in records.columns if c not in ("ts_us", "message", "level", "host")]
    at = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return records.select(F.to_json(F.struct(F.col("message").alias("_msg"), at.alias("_time"), "level", "host", *fields)).alias("line"))


#: A body of spans has at most so many bytes, unless one span is longer; and a unit's spans are dealt over tasks of so many bytes.
BODY, TASK = 4 << 20, 64 << 20


def _typed(c: str, kind: str) -> Column:
    """A value tagged with its type; whole numbers go as numbers."""
    tag = "intValue" if kind in ("tinyint", "smallint", "int", "bigint") else "doubleValue" if kind in ("float", "double") or kind.startswith("decimal") else "boolValue" if kind == "boolean" else "stringValue"
    value = F.col(c) if tag in ("intValue", "boolValue") else F.col(c).cast("double" if tag == "doubleValue" else "string")
    return F.struct(value.alias(tag))


def otlp_json(spans: DataFrame, attributes=(), most: int = BODY, task: int = TASK) -> DataFrame:
    """host, unit, part, body: the spans of a unit as one resource, in as many bodies as their bytes ask for; ids in hexadecimal, times in nanoseconds as text, status 0 unset, 1 ok, 2 error.

    ``attributes`` are columns, which go by their types as int, double, bool or string; those that are null are left out. Within a body spans are in order of start, then id. A unit of many bytes is dealt by a hash
    of the span's id over tasks first, so no unit has to fit one.
    """
    kinds = dict(spans.dtypes)
    code = F.when(F.col("status") == "error", 2).when(F.col("status") == "ok", 1).otherwise(0)
    pair = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.lit(c).alias("key"), _typed(c, kinds[c]).alias("value"))))
    head = F.to_json(F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.lit(1).alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"), (F.col("start_ns") + F.col("duration_ns")).cast("string").alias("endTimeUnixNano"),
        F.struct(code.alias("code"), F.nullif("ending", F.lit("")).alias("message")).alias("status"),
    ))
    some = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"attributes":['), F.array_join(F.array_compact(F.array(*[pair(c) for c in attributes])), ","), F.lit("]}")) if attributes else head
    rows = spans.select("host", "unit", "start_ns", "span_id", some.alias("_json")).withColumn("_bytes", F.octet_length("_json") + 1)
    whole = rows.groupBy("host", "unit").agg(F.sum("_bytes").alias("_all"))
    pieces = F.ceil(F.col("_all") / task)
    dealt = rows.join(whole, (rows["host"].eqNullSafe(whole["host"])) & (rows["unit"].eqNullSafe(whole["unit"]))).select(rows["*"], F.pmod(F.xxhash64("span_id"), pieces).alias("_piece"))
    order = Window.partitionBy("host", "unit", "_piece").orderBy("start_ns", "span_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a span goes to the body in which it ends, so a body is under the limit and one span
    half = max(1, most // 2)
    cut = dealt.withColumn("_part", F.floor(F.sum("_bytes").over(order) / half))
    grouped = cut.groupBy("host", "unit", "_piece", "_part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ns", "span_id", "_json"))), lambda s: s["_json"]), ",").alias("_spans"))
    string = lambda c: F.struct(F.lit({"host": "host.name", "unit": "service.name"}[c]).alias("key"), F.struct(F.col(c).alias("stringValue")).alias("value"))
    resource = F.to_json(F.struct(F.array(string("host"), string("unit")).alias("attributes")))
    body = F.concat(F.lit('{"resourceSpans":[{"resource":'), resource, F.lit(',"scopeSpans":[{"scope":{"name":"tidemark"},"spans":['), F.col("_spans"), F.lit("]}]}]}"))
    part = F.row_number().over(Window.partitionBy("host", "unit").orderBy("_piece", "_part")) - 1  # over bodies
    return grouped.select("host", "unit", part.alias("part"), body.alias("body"))


def wire_bytes(lines: DataFrame, column: str = "line") -> DataFrame:
    """Bytes of UTF-8 with the line ends."""
    return lines.agg(F.coalesce(F.sum(F.octet_length(column) + 1), F.lit(0)).alias("bytes"))
