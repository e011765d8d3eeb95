"""Retrieval and answer-quality metrics. A rate with denominator 0 is null, never 0; means skip nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LABELS = ("supported", "partially_supported", "unsupported", "contradicted")
CITATION = r"\[Source\s+\d+(?:\s*,\s*Source\s+\d+)*\]"
POSITIVE_STRATA = ("focused_biographical", "focused_analytical", "conceptual", "broad_thematic")
EXHAUSTIVE_STRATA = ("out_of_corpus", "adversarial_premise")


def rate(numerator: Column, denominator: Column) -> Column:
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 9)


def recall_at(hits: DataFrame, gold: DataFrame, items: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """arm, query_id, k, relevant, found, recall, hit, essential_coverage for each k, from one ranked list.

    hits: arm, query_id, id, rank. gold: query_id, id, essential. items: arm, query_id - every item, with gold or without.
    """
    per = gold.groupBy("query_id").agg(F.count("*").alias("relevant"), F.count_if(F.col("essential")).alias("essentials"))
    depth = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    got = hits.join(gold, ["query_id", "id"]).select("arm", "query_id", "rank", "essential", depth).filter("rank <= k").groupBy("arm", "query_id", "k").agg(F.count("*").alias("found"), F.count_if(F.col("essential")).alias("found_essential"))
    rows = items.select("arm", "query_id", depth).join(per, "query_id", "left").join(got, ["arm", "query_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    relevant, found = zero(F.col("relevant")), zero(F.col("found"))
    return rows.select("arm", "query_id", "k", relevant.alias("relevant"), found.alias("found"), rate(found, relevant).alias("recall"), F.when(relevant > 0, (found > 0).cast("int")).alias("hit"), rate(zero(F.col("found_essential")), zero(F.col("essentials"))).alias("essential_coverage"))


def macro(scores: DataFrame, strata: DataFrame) -> DataFrame:
    """Macro averages of items by arm and k, overall (stratum null) and by stratum, with the items that count."""
    s = scores.join(strata, "query_id")
    sets = [[F.col("arm"), F.col("k")], [F.col("arm"), F.col("k"), F.col("stratum")]]
    return s.groupingSets(sets, "arm", "k", "stratum").agg(F.round(F.avg("recall"), 9).alias("recall"), F.count("recall").alias("items"), F.round(F.avg("hit"), 9).alias("hit_rate"), F.round(F.avg("essential_coverage"), 9).alias("essential_coverage"))


def micro_macro(scores: DataFrame) -> DataFrame:
    return scores.groupBy("arm", "k").agg(rate(F.sum("found"), F.sum("relevant")).alias("micro"), F.round(F.avg("recall"), 9).alias("macro"), F.sum("found").alias("found"), F.sum("relevant").alias("relevant"))


def first_per_stratum(items: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """A fixed subset: the first ids of each stratum, as many as its quota."""
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    n = F.row_number().over(W.partitionBy("stratum").orderBy("query_id"))
    return items.withColumn("n", n).filter(F.col("n") <= F.coalesce(quota[F.col("stratum")], F.lit(0))).drop("n")


def calibration(items: DataFrame) -> DataFrame:
    """The first item by id of each positive stratum, all of the exhaustive ones."""
    n = F.row_number().over(W.partitionBy("stratum").orderBy("id"))
    return items.withColumn("n", n).filter(F.col("stratum").isin(*EXHAUSTIVE_STRATA) | (F.col("stratum").isin(*POSITIVE_STRATA) & (F.col("n") == 1))).select("id", "stratum")


def noise_floor(repeats: DataFrame, expected: int) -> DataFrame:
    """Spread of a metric over repeats; complete tells whether every repeat has the same items."""
    members = repeats.groupBy("repeat").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("query_id").cast("string"))), ","), 256).alias("m"))
    same = members.agg((F.countDistinct("m") == 1) & (F.count("*") == expected)).first()[0]
    means = repeats.groupBy("metric", "repeat").agg(F.round(F.avg("value"), 9).alias("v"))
    return means.groupBy("metric").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.stddev_pop("v"), 9).alias("stdev"), F.lit(bool(same)).alias("complete"))


def audit_citations(answers: DataFrame) -> DataFrame:
    """Counts of bracket tokens of answer against source_count: well-formed groups, references, malformed, resolvable, out of range.

    A token runs from [ to the next ], or to the end; a ] alone is one too. Malformed ones are never repaired.
    """
    found = F.regexp_extract_all("answer", F.lit(r"(?s)\[[^\]]*\]|\[.*$|\]"), 0)
    good = F.filter(found, lambda t: t.rlike(f"^{CITATION}$"))
    refs = F.transform(good, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"Source\s+(\d+)"), 1), lambda n: n.cast("long")))
    rows = answers.withColumns({"__found": found, "__refs": refs})
    inside = lambda n: (n >= 1) & (n <= F.col("source_count"))
    every = F.flatten("__refs")
    return rows.select(
        *answers.columns, F.size("__refs").alias("groups"), F.size(every).alias("references"), (F.size("__found") - F.size("__refs")).alias("malformed"),
        F.size(F.filter("__refs", lambda g: F.forall(g, inside))).alias("resolvable_groups"), F.size(F.filter(every, inside)).alias("resolvable"), F.size(F.filter(every, lambda n: ~inside(n))).alias("out_of_range"))


def confusion(pairs: DataFrame) -> DataFrame:
    """The full matrix of LABELS by LABELS (human, judge, n), zeros kept."""
    names = pairs.sparkSession.createDataFrame([(a, b) for a in LABELS for b in LABELS], "human string, judge string")
    counts = pairs.groupBy("human", "judge").agg(F.count("*").alias("n"))
    return names.join(counts, ["human", "judge"], "left").select("human", "judge", F.coalesce("n", F.lit(0)).alias("n"))


def abstention(observations: DataFrame) -> DataFrame:
    """Three rates with a denominator each. observations: stratum, expected, outcome."""
    def part(name: str, of: Column, hit: Column) -> list[Column]:
        n, d = F.count_if(of & hit), F.count_if(of)
        return [n.alias(f"{name}_n"), d.alias(f"{name}_of"), rate(n, d).alias(f"{name}_rate")]

    decline = F.col("outcome") == "decline"
    return observations.agg(
        *part("out_of_corpus_decline", F.col("stratum") == "out_of_corpus", decline), *part("false_abstention", F.col("expected") == "answer", decline),
        *part("premise_correction", F.col("stratum") == "adversarial_premise", F.col("outcome") == "premise_correction"))


def metric_rows(facts: DataFrame, by: list[str], metrics: dict[str, tuple[Column, Column, Column | None]]) -> DataFrame:
    """One row (metric_id, availability, numerator, denominator, value) for each metric, overall and by `by`.

    A metric is (numerator, denominator, available); pending ones keep their denominator and have no value.
    """
    aggs = []
    for name, (num, den, ready) in metrics.items():
        ready = F.lit(True) if ready is None else ready
        value = F.when(ready, rate(num, den))
        aggs.append(F.struct(F.lit(name).alias("metric_id"), F.when(ready, "available").otherwise("pending").alias("availability"), F.when(ready, num).alias("numerator"), den.alias("denominator"), value.alias("value")))
    sets = [[], [F.col(c) for c in by]]
    rows = facts.groupingSets(sets, *by).agg(F.array(*aggs).alias("m"))
    return rows.select(*by, F.inline("m"))
