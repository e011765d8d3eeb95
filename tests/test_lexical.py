"""Lexical ranking: what is dealt out, several scans, small slices, ties at the limit."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import scoring

WORDS = ["lay", "splay", "ing", "playing", "red", "reddish", "ant", "anti", "łodz"]


def tables(spark):
    rnd = random.Random(3)
    chunks = [(f"c{i:03}", i, [rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))]) for i in range(60)]
    chunks += [(f"d{i:03}", 60 + i, ["red", "ant"]) for i in range(30)]
    queries = [(q, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5)))) for q in range(12)] + [(20, "“lay ing red” splay"), (21, '"d" red ant'), (22, "the and of"), (23, None)]
    return spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(chunks, "chunk_id string, ordinal int, tokens array<string>"), chunks


def test_only_the_best_are_dealt_out(spark):
    q, index, _ = tables(spark)
    plan = R.lexical(q, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate explode" not in plan


def test_scans_and_limits(spark):
    q, index, _ = tables(spark)
    whole = [tuple(r) for r in R.lexical(q, index, 1000).orderBy("query_id", "rank").collect()]
    assert {r[0] for r in whole} == {*range(12), 20, 21}
    few = [tuple(r) for r in R.lexical(q, index.repartition(7), 4, at_once=5).orderBy("query_id", "rank").collect()]
    assert few == [r for r in whole if r[4] <= 4] and any(r[1] > "d" for r in few)
    assert R.lexical(q.filter("query_id = 22"), index).count() == 0 and R.lexical(q, index.filter(F.lit(False))).count() == 0


def test_slices_do_not_matter(spark, monkeypatch):
    q, _, chunks = tables(spark)
    batch = pa.RecordBatch.from_arrays([pa.array([c[i] for c in chunks]) for i in range(3)], ["chunk_id", "ordinal", "tokens"])
    asked = [(["lay", "red", "ant"], ["lay red", "red ant"], ["lay ing red", "d"]), (["splay", "łodz"], ["play łodz"], [])]
    patterns = scoring.Patterns(asked, 0.5, 2.0)

    def run():
        counted = {r["term"]: r for b in scoring.counts(patterns)(iter([batch])) for r in b.to_pylist()}
        weight = scoring.np.array([1.0 + counted[t]["n"] for t in range(len(patterns.number))])
        rows = [r for b in scoring.best(patterns, weight, 5.0, 1000, 1.2, 0.75, 0.2)(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
        return counted, sorted((r["query"], r["chunk_id"], r["raw"], r["matched"]) for r in rows)

    whole = run()
    for name, value in (("WORDS", 7), ("CELLS", 6), ("STEP", 3)):
        monkeypatch.setattr(scoring, name, value)
    assert run() == whole


def test_facets_are_ranked_in_one_scan(spark, sf):
    """The lanes' shuffles hold their candidates and the names of documents only."""
    from quarry.plans import facets

    got = {(r.query_id, r.facet_id): r.n for r in facets.facet_candidates(spark, sf).groupBy("query_id", "facet_id").agg(F.count("*").alias("n")).collect()}
    assert got and max(got.values()) == 10
    f = facets._facets(spark, sf).select(F.concat_ws(":", F.col("query_id").cast("string"), "facet_id").alias("query_id"), "text")
    plan = R.lexical(f, facets.chunk_index(spark, sf), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
