"""Queries on processes from first sight to end, as a table and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import epoch_s, table
from ..sources.shared import folder
from ..streaming import lifecycle, live

SWEEP = 10


def news(spark, sf) -> DataFrame:
    """Each event begins a process: an exec if its k is even, samples by three sweeps at most, and for six of seven an exit, of which each fifth is heard of a sweep late."""
    e, k = table(spark, sf, "events"), F.get_json_object("props", "$.k").cast("int")
    base = e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"), (F.col("event_id") % 400).alias("pid"), epoch_s(F.col("ts")).cast("double").alias("s"), k.alias("k"), (k % 4).alias("n"), F.col("event_type").alias("comm"),
        F.concat(F.col("event_type"), F.lit(" --id="), F.col("event_id").cast("string")).alias("command"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit(".service")).alias("unit"),
    )
    none = F.lit(None)
    execs = base.where("k % 2 = 0").select("host", "pid", F.lit("exec").alias("kind"), F.col("s").alias("start"), F.col("s").alias("at"), "comm", "command", none.cast("string").alias("unit"), none.cast("double").alias("cpu"))
    seen = base.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    samples = seen.select("host", "pid", F.lit("sample").alias("kind"), (F.col("s") + 1).alias("start"), (F.col("s") + SWEEP * F.col("i")).alias("at"), "comm", F.when(F.col("k") % 3 != 0, F.upper("command")).alias("command"), "unit", F.col("i").cast("double").alias("cpu"))
    exits = base.where("k % 7 <> 0").select("host", "pid", F.lit("exit").alias("kind"), (F.col("s") + 2).alias("start"), (F.col("s") + SWEEP * F.col("n") + F.when(F.col("k") % 5 == 0, 13).otherwise(3)).alias("at"), "comm", none.cast("string").alias("command"), none.cast("string").alias("unit"), (F.col("k") / 20).alias("cpu"))
    return execs.unionByName(samples).unionByName(exits).withColumnsRenamed({"command": "cmdline", "cpu": "cpu_seconds"})


def process_ends(spark, sf):
    return lifecycle.ends_of(news(spark, sf), SWEEP)


def streaming_process_ends(spark, sf):
    """The same from a stream in which news comes up to 40 s out of order, in four pieces, each written by all tasks and read in one batch by a run that goes on from the checkpoint."""
    at = f"{folder(spark)}/lives-{uuid.uuid4().hex}"
    rows = news(spark, sf).withColumn("_due", F.col("at") + F.pmod(F.hash("pid", "kind", "at"), F.lit(40)))
    first, last = rows.agg(F.min("_due"), F.max("_due")).first()
    edges = [first + (last - first) * k / 4 for k in range(5)]
    # an hour later a clock's tick, so that the watermark passes all
    tick = spark.createDataFrame([("-", 0, "tick", 0.0, last + 3600, None, None, None, None)], lifecycle.NEWS)
    for k in range(4):
        piece = rows.where((F.col("_due") >= edges[k]) & ((F.col("_due") < edges[k + 1]) if k < 3 else F.lit(True))).drop("_due")
        (piece if k < 3 else piece.unionByName(tick)).write.mode("append").parquet(f"{at}/in")
        stream = lifecycle.ends(spark.readStream.schema(lifecycle.NEWS).parquet(f"{at}/in"), SWEEP, "1 minute")
        with live.rocksdb(spark):
            live.run_once(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}"), f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(lifecycle.ENDS).parquet(f"{at}/out").select(*[c.split()[0] for c in lifecycle.ENDS.split(", ")])


QUERIES = {f.__name__: f for f in (process_ends, streaming_process_ends)}

_ENDS = f"""WITH b AS (SELECT 'h' || (user_id % 4) AS host, event_id % 400 AS pid, floor(epoch_us(ts) / 1000000.0) AS s, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS comm, event_type || ' --id=' || event_id AS command, 'u' || (user_id % 10) || '.service' AS unit FROM events),
n AS (SELECT *, k % 4 AS n, s + {SWEEP} * (k % 4) AS seen, k % 2 = 0 AS called, k % 4 > 0 AND k % 3 <> 0 AS told FROM b),
x AS (SELECT *, k % 7 <> 0 AS heard FROM n WHERE k % 7 <> 0 OR n > 0 OR called)
SELECT host, pid, CAST(s + CASE WHEN called THEN 0 WHEN n > 0 THEN 1 ELSE 2 END AS DOUBLE) AS start, CAST(CASE WHEN NOT heard THEN seen + {2 * SWEEP} WHEN k % 5 = 0 THEN seen + 13 ELSE seen + 3 END AS DOUBLE) AS noticed, heard, comm,
  CASE WHEN told THEN upper(command) WHEN called THEN command END AS cmdline, CASE WHEN n > 0 THEN unit END AS unit, CASE WHEN told THEN 'sample' WHEN called THEN 'exec' END AS described_by,
  CASE WHEN heard AND n > 0 THEN greatest(n, k / 20) WHEN heard THEN k / 20 WHEN n > 0 THEN CAST(n AS DOUBLE) END AS cpu_seconds FROM x"""
ORACLE = {"process_ends": _ENDS, "streaming_process_ends": _ENDS}
