"""Data-quality queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.operators import corpus as C
from quarry.operators import quality as Q
from quarry.plans.corpus import CHUNKS_SQL, chunk_index, chunk_table, content_sql, tokens_sql
from quarry.sources.stage import written
from quarry.sources.tables import read, texts


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("a"), X.tokens(F.col("text")).alias("t"))


def contamination_ngrams(spark: SparkSession, d: str) -> DataFrame:
    right = texts(spark, d).select(F.col("doc_id").alias("b"), X.tokens(F.col("text")).alias("t"))
    return Q.shared_runs(_items(spark, d), right, 10)


def verbatim_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which one with a smaller number holds 45 words in a row."""
    t = texts(spark, d).select(F.col("doc_id").alias("b"), X.tokens(F.col("text")).alias("t"))
    p = Q.positions(t, "b", 45).select("b", "h", "g")
    first = p.groupBy("h", "g").agg(F.min("b").alias("first"), F.max("b").alias("last")).filter("first < last").select("h", "g", "first")
    return p.join(first, ["h", "g"]).filter("first < b").groupBy("b").agg(F.min("first").alias("source"))


def exact_question_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose normal form is a conversation turn too."""
    norm = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    q = read(spark, d, "benchmark").select("item_id", norm.alias("h"))
    turns = read(spark, d, "conversations").select("conv_id", "turn", norm.alias("h")).unionByName(read(spark, d, "benchmark").filter("item_id % 9 = 0").select(F.col("item_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.sha2(F.lower(F.trim(F.regexp_replace(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   "))), r"\s+", " "))), 256).alias("h")))
    return q.join(turns, "h").select("item_id", "conv_id", "turn")


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """Items with the first word dropped, doubled or with letters exchanged."""
    b = read(spark, d, "benchmark")
    text = F.when(F.col("item_id") % 3 == 0, F.regexp_replace("text", r"^\S+\s+", "")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("xx yy zz "), "text")).otherwise(F.regexp_replace("text", "th", "ht"))
    return b.select(F.col("item_id").alias("b"), text.alias("text"))


def near_questions(spark: SparkSession, d: str) -> DataFrame:
    return Q.near_questions(read(spark, d, "benchmark").select(F.col("item_id").alias("a"), "text"), _edited(spark, d), ratio=False)


def near_questions_ratio(spark: SparkSession, d: str) -> DataFrame:
    return Q.near_questions(read(spark, d, "benchmark").select(F.col("item_id").alias("a"), "text"), _edited(spark, d))


def near_match_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Flagged pairs without a review, reviews without a flag, and pairs reviewed twice."""
    flags = near_questions(spark, d).select("a", "b")
    reviews = flags.filter("a % 5 <> 0").unionByName(flags.filter("a % 7 = 0")).unionByName(flags.filter("a % 11 = 0").select("a", (F.col("b") + 1000).alias("b")))
    n = reviews.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = flags.withColumn("flag", F.lit(1)).join(n, ["a", "b"], "full")
    fault = F.when(F.col("n").isNull(), "missing_review").when(F.col("flag").isNull(), "unknown_pair").when(F.col("n") > 1, "reviewed_twice")
    return both.withColumn("fault", fault).filter("fault is not null").select("a", "b", "fault")


def _gold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows made from the items, with faults planted by number: places are chunks of the document of the item's number."""
    k = F.col("item_id")
    at = lambda n: F.format_string("%d_%03d", k, F.lit(n))
    none = F.array().cast("array<string>")
    places = F.when(k % 6 == 4, F.when(k % 5 == 4, F.array(at(1))).otherwise(none)).when(k % 8 == 3, none).when(k % 9 == 2, F.array(at(1), at(1))).when(k % 10 == 1, F.array(at(1), F.lit("no_such"))).when(k % 14 == 6, F.array(F.lit(" "))).otherwise(F.array(at(1)))
    needed = F.when(k % 11 == 5, F.array(at(1), at(2))).when(k % 6 == 4, none).otherwise(F.slice(places, 1, 1))
    claims = F.when(k % 6 == 4, F.when(k % 7 == 1, F.array(F.lit("x"))).otherwise(none)).when(k % 5 == 0, none).when(k % 7 == 2, F.array(F.lit("x"), F.lit("X "))).when(k % 13 == 3, F.array(F.lit(""))).otherwise(F.array(F.lit("x")))
    return read(spark, d, "benchmark").select(
        F.when(k % 19 == 18, k - 1).otherwise(k).alias("item_id"), k.alias("row"), F.when(k % 13 == 5, F.lit(" ")).when(k % 17 == 7, F.lit("Who was it?")).otherwise(F.col("text")).alias("question"),
        F.when(k % 23 == 9, "other").when(k % 6 == 4, "out_of_corpus").when(k % 12 == 8, "out_of_corpus").otherwise("conceptual").alias("stratum"),
        F.when(k % 7 == 3, "maybe").when(k % 6 == 4, "abstain").otherwise("answer").alias("expected"), places.alias("relevant"), needed.alias("supporting"), claims.alias("claims"), (k % 4 != 1).alias("essential"))


def gold_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that a gold row breaks; skipped chunks are those of documents whose number leaves 7 by 20."""
    manifest = chunk_table(spark, d).select("chunk_id", (F.col("doc_id") % 20 == 7).alias("skipped"))
    return Q.gold_faults(_gold_rows(spark, d), manifest, STRATA)


def stratum_counts(spark: SparkSession, d: str) -> DataFrame:
    """Languages as strata whose counts leave their allowed ranges."""
    ranges = spark.createDataFrame([("en", 1, 400), ("fr", 1, 10_000), ("de", 1000, 2000), ("es", 0, 50), ("it", 1, 5)], "lang string, least int, most int")
    n = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return ranges.join(n, "lang", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < least or n > most").select("lang", "n", "least", "most")


def carryover(spark: SparkSession, d: str) -> DataFrame:
    """Gold locations against a corpus in which chunks are gone, skipped or edited."""
    c = chunk_table(spark, d)
    old = C.manifest(c).withColumn("skipped", F.lit(False))
    new = C.manifest(c.filter("chunk_no % 5 <> 4").withColumn("text", F.when(F.col("chunk_no") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).withColumn("skipped", F.col("doc_id") % 8 == 0)
    places = c.filter("doc_id % 6 = 0 and chunk_no <= 5").select(F.floor(F.col("doc_id") / 12).alias("item_id"), F.when(F.col("doc_id") % 30 == 0, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")).alias("chunk_id"))
    return Q.carry_over(places, old, new)


def store_verification(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors against expected ones: missing, unexpected, other label or other vector."""
    v = read(spark, d, "embeddings").select("vec_id", "label", F.xxhash64("embedding").alias("h"))
    stored = v.filter("vec_id % 50 <> 7").select(F.when(F.col("vec_id") % 50 == 8, F.col("vec_id") + 1_000_000).otherwise(F.col("vec_id")).alias("vec_id"), F.when(F.col("vec_id") % 50 == 9, -1).otherwise(F.col("label")).alias("l2"), F.when(F.col("vec_id") % 50 == 10, 0).otherwise(F.col("h")).alias("h2"))
    both = v.join(stored, "vec_id", "full")
    fault = F.when(F.col("h2").isNull(), "missing").when(F.col("h").isNull(), "unexpected").when(~F.col("label").eqNullSafe(F.col("l2")), "label").when(~F.col("h").eqNullSafe(F.col("h2")), "vector")
    return both.withColumn("fault", fault).filter("fault is not null").select("vec_id", "fault")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Each document's edition: pages of 120 tokens, from 0."""
    t = texts(spark, d).select("doc_id", X.tokens(F.col("text")).alias("t"))
    n = F.greatest(F.ceil(F.size("t") / 120).cast("int"), F.lit(1))
    return t.select("doc_id", "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("p")).select(F.col("doc_id").alias("document"), F.col("p").cast("long").alias("page"), F.slice("t", F.col("p") * 120 + 1, F.lit(120)).alias("t"))


def page_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Chunks to the pages of their document by six anchors of twelve tokens, two of which have to be found, with a floor
    from chunk to chunk."""
    c = chunk_index(spark, d).select(F.col("chunk_id").alias("key"), F.col("ordinal.doc_id").alias("document"), F.col("ordinal.chunk_no").alias("no"), F.col("tokens").alias("t"))
    found = written(Q.anchors(c, 12, 6), "anchors")
    where = Q.locate(c.select("document", "no", "key"), Q.candidates(found, _pages(spark, d), 12, 4, 2))
    total = found.groupBy("key").agg(F.count("*").alias("anchors"))
    confidence = F.when(F.col("matched").isNull(), "not_found").when(F.col("matched") == F.col("anchors"), "high").when(F.col("matched") >= 4, "medium").otherwise("review_required")
    return where.join(total, "key", "left").select("key", "first_page", "last_page", "matched", "regresses", F.coalesce("anchors", F.lit(0)).alias("anchors"), confidence.alias("confidence"))


def page_of_offset(spark: SparkSession, d: str) -> DataFrame:
    """The page on which each chunk begins: offsets of chunks in the pages' token stream, by an as-of join.

    Pages end with the paragraph that fills 120 tokens, so they differ in length.
    """
    n = F.size(X.tokens(F.col("paragraph")))
    p = texts(spark, d).select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "paragraph")).select("doc_id", "pos", n.cast("long").alias("n"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    page = F.floor(F.col("offset") / 120)
    starts = p.withColumn("page", page).groupBy("doc_id", "page").agg(F.min("offset").alias("offset"))
    asked = chunk_table(spark, d).select("doc_id", "chunk_id", (F.col("paragraph_start") - 1).alias("pos")).join(p.select("doc_id", "pos", "offset"), ["doc_id", "pos"])
    return Q.as_of(asked.select("doc_id", "chunk_id", "offset"), starts, "doc_id", "offset", "page").select("chunk_id", "offset", "page")


def role_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten most telling terms of each source, its documents taken together."""
    docs = texts(spark, d).select(F.col("source").alias("document"), X.content_tokens(F.col("text")).alias("t"))
    return Q.role_terms(docs, 10)


def scan_scope(spark: SparkSession, d: str) -> DataFrame:
    """Whether scans looked at the corpus as a whole: one that did, one of another order, one that lacks a chunk, one with another."""
    ids = chunk_table(spark, d).select("chunk_id")
    scans = {
        "whole": ids, "reversed": ids.orderBy(F.desc("chunk_id")), "lacking": ids.filter("chunk_id <> '0_001'"),
        "other": ids.select(F.when(F.col("chunk_id") == "0_001", "x_001").otherwise(F.col("chunk_id")).alias("chunk_id")),
    }
    want = Q.scope(ids, "chunk_id").withColumnsRenamed({"n": "n0", "h1": "g1", "h2": "g2"})
    every = [Q.scope(x, "chunk_id").withColumn("scan", F.lit(name)) for name, x in scans.items()]
    rows = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).crossJoin(F.broadcast(want))  # a row each
    return rows.select("scan", "n", ((F.col("n") == F.col("n0")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).alias("complete"))


def text_free(spark: SparkSession, d: str) -> DataFrame:
    """Fields of artifacts that would publish texts: three that do, at several depths, and one that does not."""
    docs, turns = read(spark, d, "documents"), read(spark, d, "conversations")
    artifacts = {
        "documents": docs, "turns": turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "Text")).alias("turns")),
        "nested": docs.select("doc_id", F.struct(F.struct(F.col("text").alias("Question")).alias("inner")).alias("outer")), "counts": docs.groupBy("lang").count(),
    }
    found = [(name, path) for name, x in artifacts.items() for path in Q.named_fields(x.schema, frozenset({"text", "question", "answer", "excerpt"}))]
    return spark.createDataFrame(found, "artifact string, path string")


def run_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as diagnostics of runs, with numbers that are none and fields that nobody asked for planted."""
    k = F.col("event_id")
    raw = F.concat(F.lit('{"total_ms": "'), F.when(k % 17 == 3, "NaN").when(k % 19 == 4, "-1").when(k % 23 == 5, "soon").otherwise(F.col("value").cast("string")), F.lit('", "retries": '), (k % 4).cast("string"), F.lit(', "mode": "'), F.col("event_type"), F.lit('"'), F.when(k % 7 == 0, ', "prompt": "x", "user": 1').otherwise(""), F.lit("}"))
    raw = F.when(k % 41 == 6, F.lit(None)).otherwise(raw)
    rows = Q.diagnostics(read(spark, d, "events").select("event_id", raw.alias("raw")), "raw", ("total_ms", "retries"), ("mode",))
    return rows.select("event_id", F.round("total_ms", 6).alias("total_ms"), "retries", "mode", "others", "valid")


def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Runs described by three documents, the first that knows a field deciding; items and elapsed time summed over the run's parts."""
    o = read(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("run"), (F.col("o_orderkey") % 4).alias("part"), F.col("o_orderpriority").alias("model"), F.round(F.col("o_totalprice")).cast("long").alias("ms"))
    named = lambda part: F.min(F.when(F.col("part") == part, F.col("model")))
    return o.groupBy("run").agg(F.coalesce(named(3), named(1), named(2)).alias("model"), F.count("*").alias("items"), F.sum("ms").alias("elapsed_ms"))


STRATA = ("focused_biographical", "focused_analytical", "conceptual", "broad_thematic", "out_of_corpus", "adversarial_premise")
QUERIES = {f.__name__: f for f in (
    contamination_ngrams, verbatim_overlap, exact_question_overlap, near_questions, near_questions_ratio, near_match_reviews, gold_validation, stratum_counts, carryover, store_verification, page_alignment, page_of_offset, role_terms, scan_scope, text_free, run_diagnostics, run_metadata)}

# -- DuckDB ------------------------------------------------------------------------------------------------------------


def _pos(source: str, key: str, size: int) -> str:
    return f"SELECT {key}, i - 1 AS pos, array_to_string(t[i:i + {size - 1}], ' ') AS s FROM (SELECT {key}, t, unnest(range(1, len(t) - {size - 2})) AS i FROM {source} WHERE len(t) >= {size})"


_NORM = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_NEAR = f"""g AS (SELECT item_id AS a, list_distinct(regexp_extract_all({_NORM.format('text')}, '[\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark
), o AS (SELECT item_id AS b, list_distinct(regexp_extract_all({_NORM.format("CASE item_id % 3 WHEN 0 THEN regexp_replace(text, '^\\S+\\s+', '') WHEN 1 THEN 'xx yy zz ' || text ELSE regexp_replace(text, 'th', 'ht', 'g') END")}, '[\\p{{L}}\\p{{N}}]+')) AS u FROM benchmark
), pairs AS (SELECT a, b, len(list_intersect(t, u)) AS shared, len(t) + len(u) AS n FROM g, o
), near AS (SELECT a, b, shared, round(shared / (n - shared)::DOUBLE, 9) AS jaccard FROM pairs WHERE shared >= 5 AND round(shared / (n - shared)::DOUBLE, 9) >= 0.72)"""
_PAGES = "pages0 AS (SELECT doc_id, t, unnest(range(0, greatest(CAST(ceil(len(t) / 120) AS BIGINT), 1))) AS p FROM (SELECT doc_id, " + tokens_sql("text") + " AS t FROM documents)), pg AS (SELECT doc_id || ':' || p AS dp, t[p * 120 + 1:p * 120 + 120] AS t FROM pages0)"

SQL = {
    "contamination_ngrams": f"WITH l AS (SELECT item_id AS a, {tokens_sql('text')} AS t FROM benchmark), r AS (SELECT doc_id AS b, {tokens_sql('text')} AS t FROM documents), m AS (SELECT a, b, x.pos AS i, x.pos - y.pos AS d FROM ({_pos('l', 'a', 10)}) x JOIN ({_pos('r', 'b', 10)}) y ON x.s = y.s), k AS (SELECT a, b, d, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS g FROM m), n AS (SELECT a, b, count(*) + 9 AS n FROM k GROUP BY a, b, d, g) SELECT a, b, max(n) AS longest FROM n GROUP BY a, b",
    "verbatim_overlap": f"WITH t AS (SELECT doc_id AS b, {tokens_sql('text')} AS t FROM documents), p AS (SELECT b, md5(s) AS s FROM ({_pos('t', 'b', 45)})), f AS (SELECT s, min(b) AS first FROM p GROUP BY s) SELECT b, min(first) AS source FROM p JOIN f ON f.s = p.s WHERE first < b GROUP BY b",
    "exact_question_overlap": f"WITH q AS (SELECT item_id, {_NORM.format('text')} AS h FROM benchmark), t AS (SELECT conv_id, turn, {_NORM.format('text')} AS h FROM conversations UNION ALL SELECT item_id, -1, {_NORM.format('text')} FROM benchmark WHERE item_id % 9 = 0) SELECT item_id, conv_id, turn FROM q JOIN t ON q.h = t.h",
    "near_questions": f"WITH {_NEAR} SELECT a, b, shared, jaccard FROM near",
    "near_match_reviews": f"WITH {_NEAR}, r AS (SELECT a, b FROM near WHERE a % 5 <> 0 UNION ALL SELECT a, b FROM near WHERE a % 7 = 0 UNION ALL SELECT a, b + 1000 FROM near WHERE a % 11 = 0), n AS (SELECT a, b, count(*) AS n FROM r GROUP BY a, b), j AS (SELECT coalesce(x.a, n.a) AS a, coalesce(x.b, n.b) AS b, CASE WHEN n.n IS NULL THEN 'missing_review' WHEN x.a IS NULL THEN 'unknown_pair' WHEN n.n > 1 THEN 'reviewed_twice' END AS fault FROM near x FULL JOIN n ON n.a = x.a AND n.b = x.b) SELECT * FROM j WHERE fault IS NOT NULL",
    "gold_validation": f"""WITH RECURSIVE {CHUNKS_SQL}, b AS (SELECT item_id AS k, format('{{:d}}_001', item_id) AS c1, format('{{:d}}_002', item_id) AS c2, text FROM benchmark
), g0 AS (SELECT k AS row, CASE WHEN k % 19 = 18 THEN k - 1 ELSE k END AS item_id, CASE WHEN k % 13 = 5 THEN ' ' WHEN k % 17 = 7 THEN 'Who was it?' ELSE text END AS question,
  CASE WHEN k % 23 = 9 THEN 'other' WHEN k % 6 = 4 OR k % 12 = 8 THEN 'out_of_corpus' ELSE 'conceptual' END AS stratum, CASE WHEN k % 7 = 3 THEN 'maybe' WHEN k % 6 = 4 THEN 'abstain' ELSE 'answer' END AS e,
  CASE WHEN k % 6 = 4 THEN CASE WHEN k % 5 = 4 THEN [c1] ELSE [] END WHEN k % 8 = 3 THEN [] WHEN k % 9 = 2 THEN [c1, c1] WHEN k % 10 = 1 THEN [c1, 'no_such'] WHEN k % 14 = 6 THEN [' '] ELSE [c1] END AS p, c1, c2,
  CASE WHEN k % 6 = 4 THEN CASE WHEN k % 7 = 1 THEN ['x'] ELSE [] END WHEN k % 5 = 0 THEN [] WHEN k % 7 = 2 THEN ['x', 'X '] WHEN k % 13 = 3 THEN [''] ELSE ['x'] END AS cl, k % 4 <> 1 AS essential FROM b
), g AS (SELECT *, CASE WHEN row % 11 = 5 THEN [c1, c2] WHEN row % 6 = 4 THEN [] ELSE p[1:1] END AS s FROM g0
), u AS (SELECT DISTINCT row, unnest(list_concat(p, s)) AS c FROM g
), st AS (SELECT u.row, bool_or(k.chunk_id IS NULL) AS unknown, bool_or(coalesce(k.doc_id % 20 = 7, false)) AS skipped FROM u LEFT JOIN chunks k ON k.chunk_id = u.c WHERE trim(u.c) <> '' GROUP BY u.row
), f AS (SELECT g.*, coalesce(unknown, false) AS unknown, coalesce(skipped, false) AS skipped, count(*) OVER (PARTITION BY item_id) AS same_id, count(*) OVER (PARTITION BY lower(trim(regexp_replace(question, '\\s+', ' ', 'g')))) AS same_q FROM g LEFT JOIN st ON st.row = g.row)
SELECT row, rule FROM (SELECT row, unnest([CASE WHEN trim(question) = '' THEN 'question_blank' END, CASE WHEN trim(question) <> '' AND same_q > 1 THEN 'question_duplicate' END, CASE WHEN same_id > 1 THEN 'id_duplicate' END,
  CASE WHEN stratum NOT IN ('conceptual', 'out_of_corpus') THEN 'stratum_unknown' END, CASE WHEN e = 'maybe' THEN 'expected_unknown' END, CASE WHEN stratum = 'out_of_corpus' AND e = 'answer' THEN 'stratum_mismatch' END,
  CASE WHEN e = 'answer' AND len(p) = 0 THEN 'answer_without_location' END, CASE WHEN e = 'abstain' AND len(p) > 0 THEN 'abstain_with_location' END, CASE WHEN list_contains(p, ' ') OR list_contains(s, ' ') THEN 'location_blank' END,
  CASE WHEN len(list_distinct(p)) < len(p) OR len(list_distinct(s)) < len(s) THEN 'location_duplicate' END, CASE WHEN unknown THEN 'location_unknown' END, CASE WHEN skipped THEN 'location_skipped' END,
  CASE WHEN NOT list_has_all(p, s) THEN 'supporting_not_relevant' END, CASE WHEN e = 'answer' AND len(cl) = 0 THEN 'answer_without_claim' END, CASE WHEN e = 'abstain' AND len(cl) > 0 THEN 'abstain_with_claim' END,
  CASE WHEN list_contains(cl, '') THEN 'claim_blank' END, CASE WHEN len(list_distinct(list_transform(cl, lambda x: lower(trim(x))))) < len(cl) THEN 'claim_duplicate' END, CASE WHEN e = 'answer' AND len(cl) > 0 AND NOT essential THEN 'no_essential_claim' END]) AS rule FROM f) WHERE rule IS NOT NULL""",
    "stratum_counts": "WITH r(lang, least, most) AS (VALUES ('en', 1, 400), ('fr', 1, 10000), ('de', 1000, 2000), ('es', 0, 50), ('it', 1, 5)), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT r.lang, coalesce(n, 0) AS n, least, most FROM r LEFT JOIN n ON n.lang = r.lang WHERE coalesce(n, 0) < least OR coalesce(n, 0) > most",
    "carryover": f"WITH RECURSIVE {CHUNKS_SQL}, p AS (SELECT doc_id // 12 AS item_id, CASE WHEN doc_id % 30 = 0 THEN chunk_id || 'x' ELSE chunk_id END AS chunk_id FROM chunks WHERE doc_id % 6 = 0 AND chunk_no <= 5), s AS (SELECT p.item_id, p.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'invalid_old_location' WHEN c.chunk_no % 5 = 4 THEN 'missing' WHEN c.doc_id % 8 = 0 THEN 'newly_skipped' WHEN c.chunk_no % 3 = 0 THEN 'changed_hash' ELSE 'unchanged' END AS status FROM p LEFT JOIN chunks c ON c.chunk_id = p.chunk_id) SELECT *, bool_or(status <> 'unchanged') OVER (PARTITION BY item_id) AS quarantined FROM s",
    "store_verification": "SELECT vec_id, 'missing' AS fault FROM embeddings WHERE vec_id % 50 IN (7, 8) UNION ALL SELECT vec_id + 1000000, 'unexpected' FROM embeddings WHERE vec_id % 50 = 8 UNION ALL SELECT vec_id, 'label' FROM embeddings WHERE vec_id % 50 = 9 UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id % 50 = 10",
    "page_alignment": f"""WITH RECURSIVE {CHUNKS_SQL}, {_PAGES}, ct AS (SELECT chunk_id AS key, doc_id, chunk_no AS no, {tokens_sql('text')} AS t FROM chunks
), st AS (SELECT key, t, unnest([round_even(i * (len(t) - 12) / 5.0, 0)::BIGINT FOR i IN range(0, 6)]) AS s FROM ct WHERE len(t) >= 12
), an AS (SELECT DISTINCT key, doc_id, array_to_string(t[s + 1:s + 12], ' ') AS anchor FROM st JOIN ct USING (key, t)
), sp AS (SELECT DISTINCT CAST(split_part(dp, ':', 1) AS BIGINT) AS doc_id, CAST(split_part(dp, ':', 2) AS BIGINT) AS page, s AS anchor FROM ({_pos('pg', 'dp', 12)})
), h AS (SELECT key, an.anchor, page FROM an JOIN sp ON sp.anchor = an.anchor AND sp.doc_id = an.doc_id
), w AS (SELECT s.key, s.page AS start, h.anchor, min(h.page) AS page FROM (SELECT DISTINCT key, page FROM h) s JOIN h ON h.key = s.key AND h.page BETWEEN s.page AND s.page + 3 GROUP BY ALL
), e AS (SELECT key, start, count(*) AS matched, min(page) AS first_page, max(page) AS last_page FROM w GROUP BY ALL HAVING count(*) >= 2
), o AS (SELECT key, list({{'start': start, 'matched': matched, 'first_page': first_page, 'last_page': last_page}} ORDER BY matched DESC, last_page - first_page, first_page, last_page, start) AS best FROM e GROUP BY key
), c AS (SELECT ct.key, doc_id, no, best FROM ct LEFT JOIN o ON o.key = ct.key
), walk AS (
  SELECT doc_id, 0 AS no, CAST(0 AS BIGINT) AS floor, CAST(NULL AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS STRUCT(start BIGINT, matched BIGINT, first_page BIGINT, last_page BIGINT)) AS x, false AS regresses FROM (SELECT DISTINCT doc_id FROM ct)
  UNION ALL
  SELECT doc_id, no, coalesce(x.first_page, floor), coalesce(x.last_page, last), key, x, coalesce(x.last_page < last, false) FROM (
    SELECT walk.doc_id, c.no, walk.floor, walk.last, c.key, list_filter(c.best, lambda b: b.start >= walk.floor)[1] AS x FROM walk JOIN c ON c.doc_id = walk.doc_id AND c.no = walk.no + 1)
)
SELECT walk.key, x.first_page AS first_page, x.last_page AS last_page, x.matched AS matched, regresses, coalesce(n, 0) AS anchors, CASE WHEN x.matched IS NULL THEN 'not_found' WHEN x.matched = n THEN 'high' WHEN x.matched >= 4 THEN 'medium' ELSE 'review_required' END AS confidence
FROM walk LEFT JOIN (SELECT key, count(*) AS n FROM an GROUP BY key) a ON a.key = walk.key WHERE walk.key IS NOT NULL""",
    "page_of_offset": f"""WITH RECURSIVE {CHUNKS_SQL}, p AS (SELECT doc_id, pos, len({tokens_sql('paragraph')}) AS n FROM (SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS paragraph FROM para)
), o AS (SELECT doc_id, pos, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM p
), s AS (SELECT doc_id, offset_ // 120 AS page, min(offset_) AS start FROM o GROUP BY ALL
), a AS (SELECT c.doc_id, c.chunk_id, o.offset_ FROM chunks c JOIN o ON o.doc_id = c.doc_id AND o.pos = c.paragraph_start - 1)
SELECT chunk_id, offset_ AS offset, page FROM a ASOF LEFT JOIN s ON a.doc_id = s.doc_id AND a.offset_ >= s.start""",
    "role_terms": "WITH t AS (SELECT source AS document, unnest(" + content_sql("text") + ") AS term FROM documents), tf AS (SELECT document, term, count(*) AS tf FROM t WHERE NOT regexp_full_match(term, '[12][0-9]{3}') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT source) AS n FROM documents), s AS (SELECT document, tf.term, tf, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)::DOUBLE) + 1), 9) AS score FROM tf JOIN df ON df.term = tf.term, n) SELECT *, CAST(row_number() OVER (PARTITION BY document ORDER BY score DESC, tf DESC, term) AS INT) AS rank FROM s QUALIFY rank <= 10",
    "scan_scope": f"WITH RECURSIVE {CHUNKS_SQL} SELECT unnest(['whole', 'reversed', 'lacking', 'other']) AS scan, unnest([n, n, n - 1, n]) AS n, unnest([true, true, false, false]) AS complete FROM (SELECT count(*) AS n FROM chunks)",
    "text_free": "SELECT * FROM (VALUES ('documents', 'text'), ('turns', 'turns.[]Text'), ('nested', 'outer.inner.Question')) v(artifact, path)",
    "run_diagnostics": "WITH e AS (SELECT event_id AS k, event_type, value, event_id % 41 = 6 AS gone, event_id % 17 = 3 OR event_id % 19 = 4 OR event_id % 23 = 5 AS odd FROM events) SELECT k AS event_id, CASE WHEN NOT gone AND NOT odd THEN round(value, 6) END AS total_ms, CASE WHEN NOT gone THEN CAST(k % 4 AS DOUBLE) END AS retries, CASE WHEN NOT gone THEN event_type END AS mode, CASE WHEN NOT gone AND k % 7 = 0 THEN 2 ELSE 0 END AS others, NOT gone AND NOT odd AS valid FROM e",
    "run_metadata": "SELECT o_orderkey % 50 AS run, coalesce(min(o_orderpriority) FILTER (o_orderkey % 4 = 3), min(o_orderpriority) FILTER (o_orderkey % 4 = 1), min(o_orderpriority) FILTER (o_orderkey % 4 = 2)) AS model, count(*) AS items, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS elapsed_ms FROM orders GROUP BY 1",
}
