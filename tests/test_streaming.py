from pyspark.sql import functions as F

from quarry.operators.serving import rate_gate as batch_gate
from quarry.sources.tables import ledger
from quarry.streaming import ledger as S


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_arrivals(spark, sf, tmp_path):
    e = ledger(spark, sf).select("response_id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), "cost_nano")
    got = run(S.first_arrivals(stream(spark, e.unionByName(e), str(tmp_path / "in")), "400 days"), "firsts")
    assert got.count() == e.count() and got.select("response_id").distinct().count() == e.count()


def test_spend_by_window(spark, sf, tmp_path):
    e = ledger(spark, sf).select(F.col("recorded_at").cast("timestamp").alias("recorded_at"), "operation", "cost_nano")
    got = run(S.spend_by_window(stream(spark, e, str(tmp_path / "in"))), "spend", "complete")
    want = e.groupBy(F.window("recorded_at", "1 hour").start.alias("start"), "operation").agg(F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("cost_nano"), F.count("*").alias("events"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x"), (1, 2, "b"), (2, 5, "y")], "k int, version int, v string")
    s = stream(spark, rows, str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(S.upsert_into(str(tmp_path / "out"), ["k"], "version")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / str(last))).collect()} == {(1, "c"), (2, "y")}


def test_rate_gate_agrees_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i % 2), float(i * 7 % 200)) for i in range(120)], "id long, client string, at double").orderBy("at")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    got = {r.id: r.admitted for r in run(S.rate_gate(spark.readStream.schema(rows.schema).parquet(path), 5), "gate").collect()}
    want = {r.id: r.decision == "admitted" for r in batch_gate(rows.withColumns({"category": F.lit("c"), "instance": F.lit(1), "seconds": F.lit(0.0)}), (None, 5, None), (None, None, None)).collect()}
    assert got == want and not all(got.values())
