"""Needles in chunks: few needles leave the chunks' words and texts where they are."""

import random

from pyspark.sql import functions as F

from quarry.operators import corpus as C


def test_chunks_are_not_dealt_out(spark, tmp_path):
    rnd = random.Random(4)
    words = ["red", "reddish", "ant", "Anti", "lay", "splay", "ing"]
    rows = [(f"c{i:04}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(400)]
    spark.createDataFrame(rows, "chunk_id string, text string").write.parquet(str(tmp_path / "chunks"))
    asked = [(0, "red ant lay"), (1, "ed an"), (2, "ANT"), (3, "lay splay ing red"), (4, "?"), (5, None), (5, "ing")]
    spark.createDataFrame(asked, "k int, needle string").write.parquet(str(tmp_path / "needles"))
    got = C.holding(spark.read.parquet(str(tmp_path / "chunks")), spark.read.parquet(str(tmp_path / "needles")), "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "Exchange hashpartitioning" not in plan
    want = sorted((k, c) for k, n in asked if n and any(x.isalnum() for x in n) for c, t in rows if n.lower() in t.lower())
    assert sorted(map(tuple, got.select("k", "chunk_id").collect())) == want and want
    assert got.filter(F.col("k") == 1).count()
