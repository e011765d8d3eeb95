"""Metric and evaluation queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.plans.corpus import tokens_sql
from quarry.sources.stage import kept
from quarry.sources.tables import read

STRATA = (*M.POSITIVE_STRATA, *M.EXHAUSTIVE_STRATA)
KS = (5, 10, 20)


def _pick(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that have a benchmark item's number."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("id")).distinct()
    return _vectors(spark, d).join(items, "id", "left_semi").select(F.col("id").alias("query_id"), "label", _pick(STRATA, F.col("id")).alias("stratum"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Relevant to an item: vectors of its label whose id leaves the same rest by 7; nothing is relevant out of corpus."""
    i = _items(spark, d).filter("stratum <> 'out_of_corpus'")
    return i.join(_vectors(spark, d).select("id", "label"), "label").filter((F.col("id") != F.col("query_id")) & (F.col("id") % 7 == F.col("query_id") % 7)).select("query_id", "id", (F.col("id") % 2 == 0).alias("essential"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Two arms: nearest vectors, and nearest ids (distance of one-dimensional vectors)."""
    def ranked() -> DataFrame:
        v, i = _vectors(spark, d), _items(spark, d).select("query_id")
        q = v.withColumnRenamed("id", "query_id").join(i, "query_id").select("query_id", F.col("v").cast("array<double>").alias("q"))
        place = lambda c: F.array(F.col(c).cast("double"))
        near = R.dense(q, v.select("id", "v")).select(F.lit("vector").alias("arm"), "query_id", "id", "rank")
        by_id = R.dense(i.withColumn("q", place("query_id")), v.select("id", place("id").alias("v")))
        return near.unionByName(by_id.select(F.lit("by_id").alias("arm"), "query_id", "id", "rank"))

    return kept(spark, d, ("embeddings", "benchmark"), "hits", ranked)


def label_pools(spark: SparkSession, d: str) -> DataFrame:
    """query_id, id, rank of the vector arm."""
    return _hits(spark, d).filter("arm = 'vector'").drop("arm")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    arms = F.explode(F.array(F.lit("vector"), F.lit("by_id"))).alias("arm")
    return M.recall_at(_hits(spark, d), _gold(spark, d), _items(spark, d).select(arms, "query_id"), KS)


def macro_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return M.macro(recall_at_k(spark, d), _items(spark, d).select("query_id", "stratum"))


def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    return M.micro_macro(recall_at_k(spark, d))


def noise_subset(spark: SparkSession, d: str) -> DataFrame:
    return M.first_per_stratum(_items(spark, d).select("query_id", "stratum"), {s: 1 + i % 3 for i, s in enumerate(STRATA)})


def calibration_subset(spark: SparkSession, d: str) -> DataFrame:
    return M.calibration(_items(spark, d).select(F.format_string("item-%03d", "query_id").alias("id"), "stratum"))


def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    r = recall_at_k(spark, d).filter("arm = 'vector' and recall is not null").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(5))))
    moved = F.col("recall") + (F.col("query_id") * F.col("repeat") % 3) * 0.01
    return M.noise_floor(r.select("repeat", F.col("query_id"), F.concat(F.lit("recall_at_"), "k").alias("metric"), moved.alias("value")), 5)


def metric_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Published metrics as rows, and by how much one arm exceeds the other."""
    long = macro_by_stratum(spark, d).filter("stratum is null").unpivot(["arm", "k"], ["recall", "hit_rate", "essential_coverage"], "metric", "value")
    wide = long.groupBy("k", "metric").pivot("arm", ["vector", "by_id"]).agg(F.first("value"))
    return wide.select("k", "metric", "vector", "by_id", F.round(F.col("vector") - F.col("by_id"), 9).alias("delta"))


def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("event_type")
    return e.agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


def latency_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 9).alias("p50"), F.round(F.percentile("value", 0.95), 9).alias("p95"), F.round(F.avg("value"), 9).alias("mean"))


def latency_median(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.round(F.median("value"), 9).alias("median"), F.max("value").alias("high"), F.count("*").alias("n"))


def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    """Attempts, successes, failure rate (6 places), eligible latencies, cost with a reserve for unknown outcomes."""
    e = read(spark, d, "events").select("value", (F.col("event_id") % 13 != 0).alias("ok"), (F.col("event_id") % 31 == 0).alias("unknown"))
    failed = F.count_if(~F.col("ok"))
    cost = F.sum(F.when(F.col("unknown"), 5_000_000).otherwise(F.round(F.col("value") * 1000))).cast("long")
    return e.agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.round(failed / F.count("*"), 6).alias("failure_rate"), F.expr("percentile_disc(0.95) within group (order by value) filter (where ok)").alias("p95"), cost.alias("cost_with_reserve"))


def paired_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Two arms of the same items: median of ratios, wins, two gates."""
    e = read(spark, d, "events").select((F.floor(F.col("event_id") / 2)).alias("item"), F.when(F.col("event_id") % 2 == 0, "standard").otherwise("fast").alias("arm"), "value")
    wide = e.groupBy("item").pivot("arm", ["standard", "fast"]).agg(F.first("value")).filter("standard > 0 and fast is not null")
    ratio = F.col("fast") / F.col("standard")
    return wide.agg(F.count("*").alias("pairs"), F.round(F.median(ratio), 9).alias("median_ratio"), F.count_if(F.col("fast") < F.col("standard")).alias("wins"), (F.median(ratio) <= 0.8).alias("ratio_gate"), (F.count_if(F.col("fast") < F.col("standard")) * 4 >= F.count("*") * 3).alias("wins_gate"))


def pairwise_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation against each other: highest token similarity, pairs, and how many texts differ."""
    t = read(spark, d, "conversations").filter("conv_id is not null").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    a, b = t.select("conv_id", F.col("turn").alias("i"), F.col("t").alias("x")), t.select("conv_id", F.col("turn").alias("j"), F.col("t").alias("y"))
    pairs = a.join(b, "conv_id").filter("i < j").select("conv_id", M.rate(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))).alias("s"))
    close = pairs.groupBy("conv_id").agg(F.max("s").alias("highest"), F.count("*").alias("pairs"))
    return t.groupBy("conv_id").agg(F.countDistinct("h").alias("different")).join(close, "conv_id", "left").select("conv_id", "different", "highest", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def displacement_totals(spark: SparkSession, d: str) -> DataFrame:
    """Gold of each item that an arm lacks, by how far it is missed."""
    got = _hits(spark, d)
    lost = _gold(spark, d).join(got.filter("arm = 'vector' and rank <= 5").select("query_id", "id"), ["query_id", "id"], "left_anti").join(got.filter("arm = 'vector'").select("query_id", "id", "rank"), ["query_id", "id"], "left")
    cause = F.when(F.col("rank").isNull(), "beyond_candidates").otherwise("rank_cutoff")
    return lost.select("query_id", cause.alias("cause")).groupBy("query_id").pivot("cause", ["beyond_candidates", "rank_cutoff"]).count().na.fill(0)


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as claims: a human label from the labels, a judge's from the text, a stratum by language."""
    t = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    human = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).when(F.col("n_chars") < 1000, 1).otherwise(0)
    judge = F.when(F.col("text") == F.upper("text"), 2).when(F.col("doc_id") % 11 == 0, 3).when(F.col("n_chars") < 900, 1).otherwise(0)
    return t.select("doc_id", F.col("lang").alias("stratum"), _pick(M.LABELS, human).alias("human"), _pick(M.LABELS, judge).alias("judge"), (F.col("doc_id") % 4).alias("cited"), (F.col("doc_id") % 3 == 0).alias("essential"), (F.col("doc_id") % 9).alias("item"))


def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    tails = ("[Source 1]", "[Source 2, Source 9] and [Source 3]", "[Source x] [", "] [Source 4,Source  5] [source 1]", "[Source 1; Source 2][Source 0]", "[Source\n7]")
    answer = F.concat(F.substring("text", 1, 40), F.lit(" "), _pick(tails, k), F.lit(" "), F.substring("text", 41, 20), F.lit(" [Source "), (k % 9).cast("string"), F.lit("]"))
    return M.audit_citations(read(spark, d, "documents").select("doc_id", answer.alias("answer"), (k % 6 + 1).cast("int").alias("source_count"))).drop("answer")


def citation_completeness(spark: SparkSession, d: str) -> DataFrame:
    cited = F.count_if(F.col("cited") > 0)
    return _claims(spark, d).groupBy("item").agg(F.count("*").alias("claims"), cited.alias("cited"), M.rate(cited, F.count("*")).alias("completeness"))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    wide = _claims(spark, d).groupBy("stratum").pivot("human", list(M.LABELS)).count().na.fill(0)
    total = sum(F.col(x) for x in M.LABELS)
    return wide.withColumn("full_support_rate", M.rate(F.col("supported"), total))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_claims(spark, d).filter("stratum = 'de'"))


def decision_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Human and judge decisions by key; a key that only one of them has is a violation."""
    c = _claims(spark, d)
    a, b = c.filter("doc_id % 17 <> 0").select("doc_id", "human"), c.filter("doc_id % 19 <> 0").select("doc_id", "judge")
    both = a.join(b, "doc_id", "full")
    n, same = F.count_if(F.col("human").isNotNull() & F.col("judge").isNotNull()), F.count_if(F.col("human") == F.col("judge"))
    return both.agg(n.alias("pairs"), same.alias("equal"), M.rate(same, n).alias("agreement"), F.count_if(F.col("human").isNull() | F.col("judge").isNull()).alias("violations"))


def abstention_rates(spark: SparkSession, d: str) -> DataFrame:
    i = read(spark, d, "documents").select(F.col("doc_id").alias("k"))
    expected = F.when((F.col("k") % 6).isin(4), "abstain").otherwise("answer")
    return M.abstention(i.select(_pick(STRATA, F.col("k")).alias("stratum"), expected.alias("expected"), _pick(("answer", "decline", "partial_decline", "premise_correction", "decline"), F.col("k")).alias("outcome")))


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers, one claim each: citations, labels, gold status, behaviour and release, by language."""
    k = F.col("doc_id")
    audit = citation_audit(spark, d).select("doc_id", F.col("references").alias("refs"), F.col("resolvable").alias("resolved"), "malformed", (F.col("malformed") + F.col("groups")).alias("brackets"))
    claims = _claims(spark, d).select("doc_id", "stratum", "human", "judge", F.col("cited").cast("long").alias("cited"), "essential")
    rows = claims.join(audit, "doc_id")
    mapped = k % 5 != 0
    return rows.select(
        "*", F.when(~((k % 50 == 49) & (F.col("stratum") == "fr")), F.col("human")).alias("faithful"), F.when(mapped, F.col("cited")).otherwise(0).alias("gold_pairs"), F.when(~mapped, F.col("cited")).otherwise(0).alias("judge_pairs"),
        F.when(mapped, F.least("cited", k % 3)).otherwise(0).alias("gold_grounded"), F.when(~mapped, F.least("cited", k % 2)).otherwise(0).alias("judge_grounded"),
        F.col("judge").isin("supported", "partially_supported").alias("present"), (k % 29 == 0).alias("asserted"), _pick(STRATA, k).alias("kind"), F.when(k % 6 == 4, "abstain").otherwise("answer").alias("expected"),
        F.when(~((k % 37 == 5) & (F.col("stratum") == "de")), _pick(("answer", "decline", "partial_decline", "premise_correction", "decline"), k)).alias("behaviour"), (k % 13 != 0).alias("released"), (k % 4 < 3).alias("located"))


def public_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The sixteen published metrics, overall and by stratum. Those that wait for a label or a behaviour have no value yet."""
    n, one, zero = F.count("*"), F.count_if, lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    labelled = F.bool_and(F.col("faithful").isNotNull())
    outside, premise = F.col("kind") == "out_of_corpus", F.col("kind") == "adversarial_premise"
    asked = (F.col("expected") == "answer") & ~outside
    known = lambda of: F.bool_and(~of | F.col("behaviour").isNotNull())
    acts = lambda of, how: one(of & (F.col("behaviour") == how))
    return M.metric_rows(_bundles(spark, d), ["stratum"], {
        "citation_resolvability": (zero("resolved"), zero("refs"), None),
        "citation_completeness": (one(F.col("cited") > 0), n, None),
        "malformed_citation_rate": (zero("malformed"), zero("brackets"), None),
        "citation_groundedness_gold_matched": (zero("gold_grounded"), zero("gold_pairs"), None),
        "citation_groundedness_judge_only": (zero("judge_grounded"), zero("judge_pairs"), None),
        **{f"faithfulness_{x}": (one(F.col("faithful") == x), n, labelled) for x in M.LABELS},
        "gold_claim_recall": (one("present"), n, None),
        "essential_gold_claim_recall": (one(F.col("essential") & F.col("present")), one("essential"), None),
        "must_not_claim_violation": (one("asserted"), n, None),
        "out_of_corpus_abstention": (acts(outside, "decline"), one(outside), known(outside)),
        "adversarial_premise_correction": (acts(premise, "premise_correction"), one(premise), known(premise)),
        "false_abstention": (acts(asked, "decline"), one(asked), known(asked)),
        "answer_success": (one("released"), n, None),
    })


def precalibration_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics that there are before anything is scored: five with values, eleven that only have a denominator."""
    n, one, zero = F.count("*"), F.count_if, lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    later = lambda of: (of, of, F.lit(False))
    outside, premise = F.col("kind") == "out_of_corpus", F.col("kind") == "adversarial_premise"
    return M.metric_rows(_bundles(spark, d), ["stratum"], {
        "citation_resolvability": (zero("resolved"), zero("refs"), None),
        "citation_completeness": (one(F.col("cited") > 0), n, None),
        "malformed_citation_rate": (zero("malformed"), zero("brackets"), None),
        "cited_source_gold_location_match": (zero("gold_grounded"), zero("cited"), None),
        "gold_location_retrieval_coverage": (one("located"), n, None),
        "citation_groundedness": later(zero("cited")),
        **{f"faithfulness_{x}": later(n) for x in M.LABELS},
        "gold_claim_recall": later(n), "essential_gold_claim_recall": later(one("essential")), "must_not_claim_violation": later(n),
        "out_of_corpus_abstention": later(one(outside)), "adversarial_premise_correction": later(one(premise)), "false_abstention": later(one((F.col("expected") == "answer") & ~outside)),
    })


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each item present, absent or contradicted, all and essential ones, and the outcome at a minimum."""
    c = _claims(spark, d)
    present, against = F.col("judge").isin("supported", "partially_supported"), F.col("judge") == "contradicted"
    share = M.rate(F.count_if(F.col("essential") & present), F.count_if(F.col("essential")))
    return c.groupBy("item").agg(F.count_if(present).alias("present"), F.count_if(~present & ~against).alias("absent"), F.count_if(against).alias("contradicted"), F.count_if(F.col("essential")).alias("essential"), share.alias("essential_share"), F.when(share.isNull(), "empty").when(share >= 0.8, "complete").when(share > 0, "partial").otherwise("missing").alias("outcome"))


def stability_variance(spark: SparkSession, d: str) -> DataFrame:
    """Population variance of claim counts over three repeats of an item; items with another number of repeats are left out."""
    c = _claims(spark, d).groupBy("item", "cited").agg(F.count("*").alias("claims")).filter("cited < 3")
    return c.groupBy("item").agg(F.count("*").alias("repeats"), F.round(F.var_pop("claims"), 9).alias("variance")).filter("repeats = 3")


QUERIES = {f.__name__: f for f in (
    recall_at_k, macro_by_stratum, micro_macro, noise_subset, calibration_subset, noise_floor, metric_unpivot, latency_nearest_rank, latency_interpolated, latency_median, cohort_summary,
    paired_ratio, pairwise_jaccard, displacement_totals, citation_audit, citation_completeness, label_distribution, confusion_matrix, decision_agreement, abstention_rates, public_metrics, precalibration_metrics,
    coverage_summary, stability_variance)}

# -- DuckDB ------------------------------------------------------------------------------------------------------------


def _list(names: tuple[str, ...], at: str) -> str:
    return "([" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + f"])[CAST({at} % {len(names)} + 1 AS INT)]"


_ITEMS = f"items AS (SELECT vec_id AS query_id, label, {_list(STRATA, 'vec_id')} AS stratum FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))"
_GOLD = "gold AS (SELECT query_id, vec_id AS id, vec_id % 2 = 0 AS essential FROM items JOIN embeddings v ON v.label = items.label AND v.vec_id <> query_id AND v.vec_id % 7 = query_id % 7 WHERE stratum <> 'out_of_corpus')"
_HITS = f"""gaps AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), 9) AS distance
  FROM embeddings v JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND q.vec_id <> v.vec_id
), hits AS (
  SELECT 'vector' AS arm, query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM gaps QUALIFY rank <= 20
  UNION ALL SELECT 'by_id', query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY abs(id - query_id), id) AS INT) AS rank FROM gaps QUALIFY rank <= 20
)"""
_DENSE_LABEL_SQL = f"{_HITS}, pools AS (SELECT query_id, id, rank FROM hits WHERE arm = 'vector')"
_SCORES = f"""{_ITEMS}, {_GOLD}, {_HITS}, ks(k) AS (VALUES (5), (10), (20)), arms(arm) AS (VALUES ('vector'), ('by_id')), per AS (
  SELECT query_id, count(*) AS relevant, count(*) FILTER (essential) AS essentials FROM gold GROUP BY query_id
), got AS (SELECT arm, h.query_id, k, count(*) AS found, count(*) FILTER (essential) AS fe FROM hits h JOIN gold g ON g.query_id = h.query_id AND g.id = h.id JOIN ks ON h.rank <= k GROUP BY ALL
), scores AS (
  SELECT arms.arm, i.query_id, ks.k, coalesce(relevant, 0) AS relevant, coalesce(found, 0) AS found, round(coalesce(found, 0) / nullif(coalesce(relevant, 0), 0)::DOUBLE, 9) AS recall,
         CASE WHEN relevant > 0 THEN CAST(coalesce(found, 0) > 0 AS INT) END AS hit, round(coalesce(fe, 0) / nullif(coalesce(essentials, 0), 0)::DOUBLE, 9) AS essential_coverage
  FROM items i CROSS JOIN arms CROSS JOIN ks LEFT JOIN per ON per.query_id = i.query_id LEFT JOIN got ON got.query_id = i.query_id AND got.arm = arms.arm AND got.k = ks.k
)"""
_MACRO = f"{_SCORES}, macro AS (SELECT arm, k, stratum, round(avg(recall), 9) AS recall, count(recall) AS items, round(avg(hit), 9) AS hit_rate, round(avg(essential_coverage), 9) AS essential_coverage FROM scores JOIN items USING (query_id) GROUP BY GROUPING SETS ((arm, k), (arm, k, stratum)))"
_CLAIMS = f"""claims AS (
  SELECT d.doc_id, lang AS stratum, {_list(M.LABELS, 'CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 WHEN n_chars < 1000 THEN 1 ELSE 0 END')} AS human,
         {_list(M.LABELS, "CASE WHEN text = upper(text) THEN 2 WHEN d.doc_id % 11 = 0 THEN 3 WHEN n_chars < 900 THEN 1 ELSE 0 END")} AS judge, d.doc_id % 4 AS cited, d.doc_id % 3 = 0 AS essential, d.doc_id % 9 AS item
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
)"""
_TAILS = _list(("[Source 1]", "[Source 2, Source 9] and [Source 3]", "[Source x] [", "] [Source 4,Source  5] [source 1]", "[Source 1; Source 2][Source 0]"), "0").split(")[CAST")[0][1:-1] + ", '[Source' || chr(10) || '7]']"
_METRIC = "SELECT stratum, {0!r} AS metric_id, CASE WHEN {3} THEN 'available' ELSE 'pending' END AS availability, CASE WHEN {3} THEN {1} END AS numerator, {2} AS denominator, CASE WHEN {3} THEN round({1} / nullif({2}, 0)::DOUBLE, 9) END AS value FROM claims GROUP BY GROUPING SETS ((), (stratum))"

SQL = {
    "recall_at_k": f"WITH {_SCORES} SELECT * FROM scores",
    "macro_by_stratum": f"WITH {_MACRO} SELECT * FROM macro",
    "micro_macro": f"WITH {_SCORES} SELECT arm, k, round(sum(found) / nullif(sum(relevant), 0)::DOUBLE, 9) AS micro, round(avg(recall), 9) AS macro, CAST(sum(found) AS BIGINT) AS found, CAST(sum(relevant) AS BIGINT) AS relevant FROM scores GROUP BY ALL",
    "noise_subset": f"WITH {_ITEMS} SELECT query_id, stratum FROM items QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY query_id) <= CASE stratum " + " ".join(f"WHEN '{s}' THEN {1 + i % 3}" for i, s in enumerate(STRATA)) + " END",
    "calibration_subset": f"WITH {_ITEMS} SELECT 'item-' || lpad(CAST(query_id AS VARCHAR), 3, '0') AS id, stratum FROM items QUALIFY stratum IN ('out_of_corpus', 'adversarial_premise') OR row_number() OVER (PARTITION BY stratum ORDER BY query_id) = 1",
    "noise_floor": f"WITH {_SCORES}, r AS (SELECT 'recall_at_' || k AS metric, rep, round(avg(recall + (query_id * rep % 3) * 0.01::DOUBLE), 9) AS v FROM scores, range(1, 6) t(rep) WHERE arm = 'vector' AND recall IS NOT NULL GROUP BY ALL) SELECT metric, min(v) AS low, max(v) AS high, round(stddev_pop(v), 9) AS stdev, true AS complete FROM r GROUP BY metric",
    "metric_unpivot": f"WITH {_MACRO}, l AS (SELECT arm, k, unnest(['recall', 'hit_rate', 'essential_coverage']) AS metric, unnest([recall, hit_rate, essential_coverage]) AS value FROM macro WHERE stratum IS NULL), w AS (SELECT k, metric, max(value) FILTER (arm = 'vector') AS vector, max(value) FILTER (arm = 'by_id') AS by_id FROM l GROUP BY ALL) SELECT *, round(vector - by_id, 9) AS delta FROM w",
    "latency_nearest_rank": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "latency_interpolated": "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(avg(value), 9) AS mean FROM events GROUP BY event_type",
    "latency_median": "SELECT event_type, min(value) AS low, round(median(value), 9) AS median, max(value) AS high, count(*) AS n FROM events GROUP BY event_type",
    "cohort_summary": "SELECT count(*) AS attempts, count(*) FILTER (event_id % 13 <> 0) AS successes, round(count(*) FILTER (event_id % 13 = 0) / count(*)::DOUBLE, 6) AS failure_rate, quantile_disc(value, 0.95) FILTER (event_id % 13 <> 0) AS p95, CAST(sum(CASE WHEN event_id % 31 = 0 THEN 5000000 ELSE round(value * 1000) END) AS BIGINT) AS cost_with_reserve FROM events",
    "paired_ratio": "WITH w AS (SELECT event_id // 2 AS item, max(value) FILTER (event_id % 2 = 0) AS s, max(value) FILTER (event_id % 2 = 1) AS f FROM events GROUP BY 1), x AS (SELECT * FROM w WHERE s > 0 AND f IS NOT NULL) SELECT count(*) AS pairs, round(median(f / s), 9) AS median_ratio, count(*) FILTER (f < s) AS wins, median(f / s) <= 0.8 AS ratio_gate, count(*) FILTER (f < s) * 4 >= count(*) * 3 AS wins_gate FROM x",
    "pairwise_jaccard": f"WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS h, list_distinct({tokens_sql('text')}) AS t FROM conversations WHERE conv_id IS NOT NULL), p AS (SELECT a.conv_id, round(len(list_intersect(a.t, b.t)) / nullif(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)), 0)::DOUBLE, 9) AS s FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn), c AS (SELECT conv_id, max(s) AS highest, count(*) AS pairs FROM p GROUP BY conv_id) SELECT u.conv_id, u.different, highest, coalesce(pairs, 0) AS pairs FROM (SELECT conv_id, count(DISTINCT h) AS different FROM t GROUP BY conv_id) u LEFT JOIN c ON c.conv_id = u.conv_id",
    "displacement_totals": f"WITH {_ITEMS}, {_GOLD}, {_HITS} SELECT g.query_id, count(*) FILTER (h.rank IS NULL) AS beyond_candidates, count(*) FILTER (h.rank IS NOT NULL) AS rank_cutoff FROM gold g LEFT JOIN hits h ON h.arm = 'vector' AND h.query_id = g.query_id AND h.id = g.id WHERE h.rank IS NULL OR h.rank > 5 GROUP BY 1",
    "citation_audit": f"""WITH a AS (SELECT doc_id, substr(text, 1, 40) || ' ' || ({_TAILS})[doc_id % 6 + 1] || ' ' || substr(text, 41, 20) || ' [Source ' || (doc_id % 9) || ']' AS a, CAST(doc_id % 6 + 1 AS INT) AS source_count FROM documents
), t AS (SELECT doc_id, source_count, regexp_extract_all(a, '(?s)\\[[^\\]]*\\]|\\[.*$|\\]') AS t FROM a), g AS (SELECT *, list_filter(t, lambda x: regexp_full_match(x, '{M.CITATION}')) AS g FROM t
), r AS (SELECT *, list_transform(g, lambda x: list_transform(regexp_extract_all(x, 'Source\\s+(\\d+)', 1), lambda n: CAST(n AS BIGINT))) AS r FROM g)
SELECT doc_id, source_count, len(g) AS groups, len(flatten(r)) AS references, len(t) - len(g) AS malformed, len(list_filter(r, lambda x: len(list_filter(x, lambda n: n < 1 OR n > source_count)) = 0)) AS resolvable_groups,
       len(list_filter(flatten(r), lambda n: n >= 1 AND n <= source_count)) AS resolvable, len(list_filter(flatten(r), lambda n: n < 1 OR n > source_count)) AS out_of_range FROM r""",
    "citation_completeness": f"WITH {_CLAIMS} SELECT item, count(*) AS claims, count(*) FILTER (cited > 0) AS cited, round(count(*) FILTER (cited > 0) / count(*)::DOUBLE, 9) AS completeness FROM claims GROUP BY item",
    "label_distribution": f"WITH {_CLAIMS} SELECT stratum, " + ", ".join(f"count(*) FILTER (human = '{x}') AS {x}" for x in M.LABELS) + ", round(count(*) FILTER (human = 'supported') / count(*)::DOUBLE, 9) AS full_support_rate FROM claims GROUP BY stratum",
    "confusion_matrix": f"WITH {_CLAIMS}, l(x) AS (VALUES " + ", ".join(f"('{x}')" for x in M.LABELS) + ") SELECT a.x AS human, b.x AS judge, count(doc_id) AS n FROM l a CROSS JOIN l b LEFT JOIN claims c ON c.human = a.x AND c.judge = b.x AND c.stratum = 'de' GROUP BY 1, 2",
    "decision_agreement": f"WITH {_CLAIMS}, p AS (SELECT CASE WHEN doc_id % 17 <> 0 THEN human END AS h, CASE WHEN doc_id % 19 <> 0 THEN judge END AS j FROM claims WHERE doc_id % 17 <> 0 OR doc_id % 19 <> 0) SELECT count(*) FILTER (h IS NOT NULL AND j IS NOT NULL) AS pairs, count(*) FILTER (h = j) AS equal, round(count(*) FILTER (h = j) / nullif(count(*) FILTER (h IS NOT NULL AND j IS NOT NULL), 0)::DOUBLE, 9) AS agreement, count(*) FILTER (h IS NULL OR j IS NULL) AS violations FROM p",
    "abstention_rates": f"WITH o AS (SELECT {_list(STRATA, 'doc_id')} AS s, CASE WHEN doc_id % 6 = 4 THEN 'abstain' ELSE 'answer' END AS e, {_list(('answer', 'decline', 'partial_decline', 'premise_correction', 'decline'), 'doc_id')} AS o FROM documents) SELECT " + ", ".join(
        f"count(*) FILTER ({of} AND {hit}) AS {n}_n, count(*) FILTER ({of}) AS {n}_of, round(count(*) FILTER ({of} AND {hit}) / nullif(count(*) FILTER ({of}), 0)::DOUBLE, 9) AS {n}_rate" for n, of, hit in (
            ("out_of_corpus_decline", "s = 'out_of_corpus'", "o = 'decline'"), ("false_abstention", "e = 'answer'", "o = 'decline'"), ("premise_correction", "s = 'adversarial_premise'", "o = 'premise_correction'"))) + " FROM o",
    "coverage_summary": f"WITH {_CLAIMS}, c AS (SELECT item, count(*) FILTER (judge IN ('supported', 'partially_supported')) AS present, count(*) FILTER (judge = 'unsupported') AS absent, count(*) FILTER (judge = 'contradicted') AS contradicted, count(*) FILTER (essential) AS essential, round(count(*) FILTER (essential AND judge IN ('supported', 'partially_supported')) / nullif(count(*) FILTER (essential), 0)::DOUBLE, 9) AS essential_share FROM claims GROUP BY item) SELECT *, CASE WHEN essential_share IS NULL THEN 'empty' WHEN essential_share >= 0.8 THEN 'complete' WHEN essential_share > 0 THEN 'partial' ELSE 'missing' END AS outcome FROM c",
    "stability_variance": f"WITH {_CLAIMS}, c AS (SELECT item, cited, count(*) AS n FROM claims WHERE cited < 3 GROUP BY ALL) SELECT item, count(*) AS repeats, round(var_pop(n), 9) AS variance FROM c GROUP BY item HAVING count(*) = 3",
}

_BUNDLES = f"""{_CLAIMS}, audit AS ({SQL['citation_audit']}), bundles AS (
  SELECT c.stratum, c.doc_id, cited, essential, judge, a."references" AS refs, a.resolvable AS resolved, a.malformed, a.malformed + a.groups AS brackets, CASE WHEN NOT (c.doc_id % 50 = 49 AND c.stratum = 'fr') THEN human END AS faithful,
         CASE WHEN c.doc_id % 5 <> 0 THEN cited ELSE 0 END AS gold_pairs, CASE WHEN c.doc_id % 5 = 0 THEN cited ELSE 0 END AS judge_pairs, CASE WHEN c.doc_id % 5 <> 0 THEN least(cited, c.doc_id % 3) ELSE 0 END AS gold_grounded,
         CASE WHEN c.doc_id % 5 = 0 THEN least(cited, c.doc_id % 2) ELSE 0 END AS judge_grounded, judge IN ('supported', 'partially_supported') AS present, c.doc_id % 29 = 0 AS asserted, {_list(STRATA, 'c.doc_id')} AS kind,
         CASE WHEN c.doc_id % 6 = 4 THEN 'abstain' ELSE 'answer' END AS expected, CASE WHEN NOT (c.doc_id % 37 = 5 AND c.stratum = 'de') THEN {_list(('answer', 'decline', 'partial_decline', 'premise_correction', 'decline'), 'c.doc_id')} END AS behaviour,
         c.doc_id % 13 <> 0 AS released, c.doc_id % 4 < 3 AS located
  FROM claims c JOIN audit a ON a.doc_id = c.doc_id
)"""
_MATCHED = _METRIC.replace("FROM claims", "FROM bundles")
_SUM, _OF, _ASKED = "CAST(coalesce(sum({0}), 0) AS BIGINT)".format, "count(*) FILTER ({0})".format, "expected = 'answer' AND kind <> 'out_of_corpus'"
_FIRST = [("citation_resolvability", _SUM("resolved"), _SUM("refs"), "true"), ("citation_completeness", _OF("cited > 0"), "count(*)", "true"), ("malformed_citation_rate", _SUM("malformed"), _SUM("brackets"), "true")]


def _acts(name: str, of: str, how: str) -> tuple[str, ...]:
    return (name, _OF(f"{of} AND behaviour = '{how}'"), _OF(of), f"bool_and(NOT ({of}) OR behaviour IS NOT NULL)")


SQL["public_metrics"] = f"WITH {_BUNDLES} " + " UNION ALL ".join(_MATCHED.format(*m) for m in (
    *_FIRST, ("citation_groundedness_gold_matched", _SUM("gold_grounded"), _SUM("gold_pairs"), "true"), ("citation_groundedness_judge_only", _SUM("judge_grounded"), _SUM("judge_pairs"), "true"),
    *((f"faithfulness_{x}", _OF(f"faithful = '{x}'"), "count(*)", "bool_and(faithful IS NOT NULL)") for x in M.LABELS), ("gold_claim_recall", _OF("present"), "count(*)", "true"),
    ("essential_gold_claim_recall", _OF("essential AND present"), _OF("essential"), "true"), ("must_not_claim_violation", _OF("asserted"), "count(*)", "true"), _acts("out_of_corpus_abstention", "kind = 'out_of_corpus'", "decline"),
    _acts("adversarial_premise_correction", "kind = 'adversarial_premise'", "premise_correction"), _acts("false_abstention", _ASKED, "decline"), ("answer_success", _OF("released"), "count(*)", "true")))
SQL["precalibration_metrics"] = f"WITH {_BUNDLES} " + " UNION ALL ".join(_MATCHED.format(*m) for m in (
    *_FIRST, ("cited_source_gold_location_match", _SUM("gold_grounded"), _SUM("cited"), "true"), ("gold_location_retrieval_coverage", _OF("located"), "count(*)", "true"), ("citation_groundedness", _SUM("cited"), _SUM("cited"), "false"),
    *((n, of, of, "false") for n, of in (*((f"faithfulness_{x}", "count(*)") for x in M.LABELS), ("gold_claim_recall", "count(*)"), ("essential_gold_claim_recall", _OF("essential")), ("must_not_claim_violation", "count(*)"),
                                         ("out_of_corpus_abstention", _OF("kind = 'out_of_corpus'")), ("adversarial_premise_correction", _OF("kind = 'adversarial_premise'")), ("false_abstention", _OF(_ASKED))))))
