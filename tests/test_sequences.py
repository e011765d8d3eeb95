"""Strong matches alone: those of the scan, without its index and its partial matches."""

import random

from pyspark.sql import functions as F

from quarry.operators import evidence as E
from quarry.operators import facets as A
from quarry.plans import evidence, facets
from quarry.sources import stage


def test_sequences_are_strong_matches(spark):
    rnd = random.Random(8)
    words = ["Rede", "rede", "O’Brien's", "U.S.", "us", "A1b2", "a", "1", "b", "Straße", "—", "O'Brien"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    chunks = [(f"c{i:03}", text(rnd.randint(0, 12))) for i in range(300)] + [("n", None), ("e", "")]
    targets = [(i, text(rnd.randint(1, 3))) for i in range(40)] + [(40, ""), (41, None), (42, "us " * 20), (43, "—")]
    c, t = spark.createDataFrame(chunks, "chunk_id string, text string"), spark.createDataFrame(targets, "target_id long, surface string")
    index = c.select("chunk_id", E.anchor_tokens(F.col("text")).alias("tokens"), E.explicit_initialisms(F.col("text")).alias("shorts"))
    want = sorted(map(tuple, E.scan(t, index).filter("kind = 'strong'").select("target_id", "chunk_id").collect()))
    assert sorted(map(tuple, E.sequences(t, c).collect())) == want and len({k for k, _ in want}) > 20


def test_promotion_needs_no_scan(spark, sf, monkeypatch):
    monkeypatch.setattr(stage, "_kept", {})
    got = facets.anchor_promotion(spark, sf).collect()
    assert not {"anchor-index", "evidence-scan"} & {key[2] for key in stage._kept}
    plan = E.sequences(evidence._targets(spark, sf), facets.chunk_table(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    source = facets.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("source").alias("document"))
    placed = lambda df: df.withColumn("doc", F.regexp_extract("chunk_id", "^(.*)_", 1)).join(source, "doc")
    near = evidence.relationship(spark, sf).select(F.col("pair_id").alias("query_id"), F.lit(0).alias("tier"), "chunk_id")
    first = evidence.anchor_match(spark, sf).filter("kind = 'strong'").groupBy(F.col("target_id").alias("query_id")).agg(F.min("chunk_id").alias("chunk_id")).select("query_id", F.lit(1).alias("tier"), "chunk_id")
    lanes, anchors = placed(facets.facet_lanes(spark, sf)), placed(near.unionByName(first)).withColumn("place", F.struct("tier", "chunk_id"))
    want = A.promote(lanes.select("query_id", "chunk_id", "document", "source_number").distinct(), lanes.filter("facet_id <> 'F0'"), anchors.select("query_id", "chunk_id", "document", "place")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r.origin == "corpus_anchor" for r in got)
