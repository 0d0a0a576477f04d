from pyspark.sql import functions as F

from tidemark.functions.numbers import hugepages, inodes_pct
from tidemark.operators import derive, reconcile
from tidemark.sources import metadata


def test_metadata_of_any_key(spark):
    rows = spark.createDataFrame([('{"process.unit": "a", "it\'s": 3, "x": {"y": 1}}',), ("no json",), (None,)], "t string").withColumn("attributes", metadata.parsed("t"))
    got = rows.select(metadata.get("attributes", "process.unit").alias("u"), metadata.get("attributes", "it's", "bigint").alias("n"), metadata.get("attributes", "process.unit", "double").alias("d"), metadata.get("attributes", "x.y", "bigint").alias("xy")).collect()
    assert [tuple(r) for r in got] == [("a", 3, None, None), (None,) * 4, (None,) * 4]


def test_filters_on_typed_columns_reach_the_scan(spark, tmp_path):
    rows = spark.range(20).select("id", metadata.packed(process__pid=F.col("id"), process__unit=F.lit("u")).alias("attributes"))
    metadata.typed(rows).drop("attributes").write.parquet(str(tmp_path / "t"))
    found = spark.read.parquet(str(tmp_path / "t")).where("process_pid = 7")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "PushedFilters" in plan and "EqualTo(process_pid,7)" in plan


def test_pages_and_inodes(spark):
    rows = spark.createDataFrame([(0, 0), (10, 4), (None, 3), (5, None)], "t long, f long")
    huge = hugepages("t", "f")
    assert [tuple(r) for r in rows.select(huge["total"], huge["free"], inodes_pct("t", "f")).collect()] == [(None, None, None), (10, 4, 60.0), (None, None, None), (None, None, None)]


def test_interfaces_by_their_whole_name(spark):
    rows = spark.createDataFrame([("h", i, t, r, r) for i in ("lo", "lo0", "eth0") for t, r in ((0, 0), (10, 50), (20, 20))], "host string, iface string, ts long, rx_bytes long, tx_bytes long")
    assert sorted((r.ts, r.rx_bytes) for r in derive.interface_totals(rows).collect()) == [(10, 10.0), (20, None)]


def test_fields_that_are_empty_are_not_put(spark):
    records = spark.createDataFrame([("h", 1, 5, None), ("h", 2, 5, "own")], "host string, pid long, started long, unit string")
    known = spark.createDataFrame([("h", 1, 5, "", "run", "", "u")], "host string, pid long, started long, exe string, cmdline string, started_as string, unit string")
    got = {r.pid: (r.path, r.cmdline, r.started_as, r.unit) for r in reconcile.with_known(records, known).collect()}
    assert got == {1: (None, "run", None, "u"), 2: (None, None, None, "own")}
