from pyspark.sql import functions as F

from filigree.streaming import landing


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a" if m % 20 else "b", float(m)) for h in range(3) for m in range(0, 60, 10)]
    table = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    table.repartition(3).write.parquet(src)
    stream = landing.windowed(landing.arriving(spark, src, table.schema), "ts", "value", "kind")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = {(r["window"]["start"], r["kind"], r["n"], r["total"]) for r in spark.table("windows").collect()}
    want = {(r["w"]["start"], r["kind"], r["n"], r["total"]) for r in table.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    assert got == want


def test_ledger_of_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("b",), ("a",)], "name string").repartition(2).write.parquet(src)
    jobs = landing.arriving(spark, src, spark.read.parquet(src).schema, 1)
    q = landing.into_ledger(jobs, lambda b: b.withColumn("status", F.lit("OK")), str(tmp_path / "ledger"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3
