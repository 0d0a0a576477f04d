"""Queries on what is kept, and streams beside their batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maintain
from ..sources.model import counters, samples, with_sql
from ..sources.shared import folder
from ..streaming import live
from .samples import AT, DAY


def retention_keep(spark, sf):
    return maintain.kept(samples(spark, sf), "ts", AT, 3).groupBy("name").agg(F.count("*").alias("n"))


def series_rollups(spark, sf):
    r = maintain.rollups(samples(spark, sf), 86_400)
    return r.select("name", "host", F.col("labels")["proc"].alias("proc"), "bucket", "highest", F.round("mean", 6).alias("mean"), "n")


def prune_order(spark, sf):
    """What a cap of half the size would drop, of a manifest made from the days of samples."""
    days = samples(spark, sf).groupBy(F.floor(F.col("ts") / DAY).cast("int").alias("day")).agg((F.count("*") * 100).alias("bytes")).collect()
    held = [maintain.Held(kind, r["day"] * DAY, (r["day"] + 1) * DAY, r["bytes"]) for kind in ("samples", "records", "spans") for r in days]
    gone = maintain.prune_plan(held, sum(h.bytes for h in held) // 2, max(h.last for h in held))
    return spark.createDataFrame([(k, h.kind, h.first // DAY, h.bytes) for k, h in enumerate(gone)], "place int, kind string, day int, bytes bigint")


def _streamed(spark, rows: DataFrame, step, mode: str = "append") -> DataFrame:
    """``rows`` as a stream of files through ``step``, all that there is, and the table that it wrote."""
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    out = step(stream)
    with live.provider(spark, "HDFSBackedStateStoreProvider"):
        live.run_once(out, lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}"), f"{at}/checkpoint", mode).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").select(*out.columns)


def streaming_rollup(spark, sf):
    """The same as the batch of it: nothing in a day of files comes later than the watermark allows, which is wide here; the last hours stay open."""
    rows = samples(spark, sf).select("name", "host", "value", F.timestamp_seconds("ts").alias("at")).repartition(8, "name", "host")
    return _streamed(spark, rows, lambda s: live.rollup(s, "1 hour", "40 days"), "update").groupBy("name", "host", "bucket").agg(F.max("highest").alias("highest"), F.max("n").alias("n"))


def streaming_rates(spark, sf):
    """Each subject's readings in one file, in order, so no file has readings older than what was seen."""
    rows = counters(spark, sf).repartition(6, "host", "subject").sortWithinPartitions("ts")
    return _streamed(spark, rows.select("host", "subject", "ts", "counter"), live.rates).withColumn("rate", F.round("rate", 9))


QUERIES = {f.__name__: f for f in (retention_keep, series_rollups, prune_order, streaming_rollup, streaming_rates)}

_S = with_sql("samples")
ORACLE = {
    "retention_keep": _S + f"x AS (SELECT 1) SELECT name, count(*) AS n FROM samples WHERE ts >= {AT - 3 * DAY} GROUP BY name",
    "series_rollups": _S + "x AS (SELECT 1) SELECT name, host, proc, ts // 86400 * 86400 AS bucket, max(value) AS highest, round(avg(value), 6) AS mean, count(value) AS n FROM samples GROUP BY ALL",
    "prune_order": _S + f"""d AS (SELECT CAST(ts // {DAY} AS INTEGER) AS day, count(*) * 100 AS bytes FROM samples GROUP BY 1),
h AS (SELECT k.kind, k.o, day, bytes FROM d, (VALUES ('samples', 0), ('spans', 1), ('records', 5)) k(kind, o)),
c AS (SELECT *, row_number() OVER w AS r, CAST(coalesce(sum(bytes) OVER (ORDER BY o, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM h WHERE day < (SELECT max(day) FROM h) WINDOW w AS (ORDER BY o, day))
SELECT CAST(r - 1 AS INTEGER) AS place, kind, day, bytes FROM c WHERE before < (SELECT sum(bytes) - CAST(sum(bytes) AS BIGINT) // 2 FROM h)""",
    "streaming_rollup": _S + "x AS (SELECT 1) SELECT name, host, ts // 3600 * 3600 AS bucket, max(value) AS highest, count(value) AS n FROM samples GROUP BY ALL",
    "streaming_rates": with_sql("counters") + "p AS (SELECT *, lag(counter) OVER w AS b, lag(ts) OVER w AS bt FROM counters WINDOW w AS (PARTITION BY host, subject ORDER BY ts, id)) SELECT host, subject, ts, round((counter - b) / (ts - bt), 9) AS rate FROM p WHERE counter >= b AND ts > bt",
}
