"""Evidence queries with their DuckDB equivalents.

Targets are two words of each benchmark item; the facet of target i is target i + 1, its broader term the first
word alone with target i + 2 as probe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.operators import corpus as C
from quarry.operators import evidence as E
from quarry.plans.corpus import CHUNKS_SQL, _SENTENCES, chunk_index, chunk_table, content_sql, sentences, tokens_sql
from quarry.sources.stage import kept
from quarry.sources.tables import read


def _targets(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", r"\s+")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("target_id"), F.concat_ws(" ", words[2], words[3]).alias("surface"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_table(spark, d)
    return kept(spark, d, ("documents",), "anchor-index", lambda: c.select("chunk_id", E.anchor_tokens(F.col("text")).alias("tokens"), E.explicit_initialisms(F.col("text")).alias("shorts")))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    """All matches of all targets, kept for the queries that rest on them."""
    return kept(spark, d, ("documents", "benchmark"), "evidence-scan", lambda: E.scan(_targets(spark, d), _index(spark, d)))


def anchor_match(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).filter("kind <> 'partial_token_collision'")


def target_scan(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).groupBy("target_id", "kind", "rule").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_id"))


def _strong(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).filter("kind = 'strong'").select("target_id", "chunk_id")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_table(spark, d).select("doc_id", "chunk_no", "chunk_id")
    return kept(spark, d, ("documents",), "adjacency", lambda: C.adjacency(c))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Strong matches alone, kept: without the index of all chunks' tokens and the matches of some of them, for what needs neither."""
    return kept(spark, d, ("documents", "benchmark"), "strong-matches", lambda: E.sequences(_targets(spark, d), chunk_table(spark, d)))


def relationship(spark: SparkSession, d: str) -> DataFrame:
    return related(spark, d, _strong(spark, d))


def related(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """Strong matches s of a target (as pair_id) that stand near those of the next."""
    return E.related(s.select(F.col("target_id").alias("pair_id"), "chunk_id"), s.select((F.col("target_id") - 1).alias("pair_id"), "chunk_id"), _edges(spark, d))


def broader_related(spark: SparkSession, d: str) -> DataFrame:
    broad = _targets(spark, d).select("target_id", F.split("surface", " ")[0].alias("surface"))
    hits = kept(spark, d, ("documents", "benchmark"), "broad-scan", lambda: E.scan(broad, _index(spark, d)).filter("kind = 'strong'"))
    probes = _strong(spark, d).select((F.col("target_id") - 2).alias("pair_id"), "chunk_id")
    return E.related(hits.select(F.col("target_id").alias("pair_id"), "chunk_id"), probes, _edges(spark, d))


def integrity_codes(spark: SparkSession, d: str) -> DataFrame:
    """A whole corpus; one with a chunk gone, one double and one without id; one of another manifest, which names a blank chunk and
    one twice, and whose first text is missing; one without identity."""
    c = chunk_table(spark, d).select("chunk_id", "text")
    ids, n = c.select("chunk_id"), c.count()
    blank = spark.createDataFrame([(" ", "x")], "chunk_id string, text string")
    broken = c.filter("chunk_id <> '0_001'").unionByName(c.filter("chunk_id = '1_001'")).unionByName(blank)
    foreign = ids.unionByName(blank.select("chunk_id")).unionByName(ids.filter("chunk_id = '1_001'"))
    lost = c.withColumn("text", F.when(F.col("chunk_id") != "0_001", F.col("text")))
    cases = {"whole": (c, ids, n, n, ("A1", " a1")), "broken": (broken, ids, n - 1, n, ("a1", "a1")), "foreign": (lost, foreign, n, n, ("a1", "b2")), "nameless": (c, ids, n, n, ("a1", None))}
    out = [E.integrity(*x).withColumn("corpus", F.lit(name)) for name, x in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _selected(spark: SparkSession, d: str) -> DataFrame:
    """The first eight chunks that match a target in any way, best kind first."""
    order = F.when(F.col("kind") == "strong", 0).when(F.col("kind") == "weak", 1).otherwise(2)
    s = _scan(spark, d).withColumn("source_number", F.row_number().over(W.partitionBy("target_id").orderBy(order, "chunk_id")))
    return s.filter("source_number <= 8").select("target_id", "chunk_id", "source_number")


def evidence_lanes(spark: SparkSession, d: str) -> DataFrame:
    s = _strong(spark, d)
    direct = s.union(s.join(_edges(spark, d), "chunk_id").select("target_id", F.col("neighbour_id").alias("chunk_id")))
    b = broader_related(spark, d).select(F.col("pair_id").alias("target_id"), F.explode(F.array("chunk_id", "other_id")).alias("chunk_id"))
    weak = _scan(spark, d).filter("kind = 'weak'").select("target_id", "chunk_id")
    return E.lanes(_selected(spark, d), direct, b, weak)


def _decided(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda df, key, name: df.select(F.col(key).alias("target_id")).distinct().withColumn(name, F.lit(True))
    t = _targets(spark, d).select("target_id").join(flag(_strong(spark, d), "target_id", "direct_present"), "target_id", "left").join(flag(relationship(spark, d), "pair_id", "related_present"), "target_id", "left").join(flag(evidence_lanes(spark, d).filter("lane = 'broader_related'"), "target_id", "broader_present"), "target_id", "left")
    k = F.col("target_id")
    facts = t.na.fill(False).withColumns({"checkable": k % 5 != 4, "integrity": k != 7, "contradiction": k == 9, "has_facet": k % 2 == 0})
    return E.decide(facts)


def evidence_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("target_id", "certified_absence", "decision")


def allowed_sources(spark: SparkSession, d: str) -> DataFrame:
    return E.allowed(_decided(spark, d), evidence_lanes(spark, d)).select("target_id", "source_number", "lane", "decision", "allowed")


def multi_subject(spark: SparkSession, d: str) -> DataFrame:
    x = _decided(spark, d)
    return E.decide_many(x.select(F.floor(F.col("target_id") / 3).alias("query_id"), F.col("direct_present").alias("present"), "checkable", "integrity")).select("query_id", "subjects", "n_present", "decision")


def requirement_routing(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of questions and how many chunks could serve each."""
    asks = ("Who ", "When and why did ", "What was ", "How did it, and where, ", "")
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.element_at(F.array(*[F.lit(a) for a in asks]), (F.col("item_id") % 5 + 1).cast("int")), F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 4))).alias("text"))
    r = E.requirements(q)
    terms = r.select("query_id", "requirement_id", "aspect", F.explode_outer(X.query_terms(F.col("fragment"))).alias("term"))
    texts, words = chunk_table(spark, d), chunk_index(spark, d)
    signs = kept(spark, d, ("documents",), "chunk-signs", lambda: texts.select("chunk_id", F.col("text").rlike(E.DATE).alias("dated"), F.col("text").rlike(E.CAUSAL).alias("causal")))
    hit = terms.join(words.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term")), "term").select("query_id", "requirement_id", "aspect", "chunk_id").distinct()
    hit = hit.join(signs, "chunk_id").filter((F.col("aspect") != "when") | F.col("dated")).filter((F.col("aspect") != "why") | F.col("causal"))
    n = hit.groupBy("query_id", "requirement_id").agg(F.count("*").alias("chunks"))
    return r.join(n, ["query_id", "requirement_id"], "left").select("query_id", "requirement_id", "aspect", "fragment", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def evidence_cards(spark: SparkSession, d: str) -> DataFrame:
    """The best sentence of each document for the item of its number, by coverage, density and earliest place."""
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), X.query_terms(F.col("text")).alias("terms"))
    s = sentences(spark, d).join(q, "doc_id").withColumn("t", F.array_distinct(X.tokens(F.col("sentence"))))
    m = F.size(F.array_intersect("terms", "t"))
    score = F.round(m / F.greatest(F.size("terms"), F.lit(1)) * 10 + m / F.greatest(F.least(F.size("t"), F.lit(24)), F.lit(1)) * 2 + 1 / (F.col("pos") + 10000), 6)
    s = s.withColumns({"matched": m, "score": score}).filter("matched > 0")
    best = s.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))).filter("r <= 2")
    once = best.withColumn("same", F.row_number().over(W.partitionBy("doc_id", "sentence").orderBy("r"))).filter("same = 1")
    return once.select("doc_id", "pos", "matched", "score", "r")


def dossier_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = _scan(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("target_id").orderBy("kind", "chunk_id"))).filter("rank <= 20")
    return E.dossier(rows.join(chunk_table(spark, d).select("chunk_id", "text"), "chunk_id").select(F.col("target_id").alias("query_id"), "chunk_id", "rank", "text"))


QUERIES = {f.__name__: f for f in (anchor_match, target_scan, relationship, broader_related, integrity_codes, evidence_lanes, evidence_decision, allowed_sources, multi_subject, requirement_routing, evidence_cards, dossier_pack)}

# -- DuckDB ------------------------------------------------------------------------------------------------------------


def _anchor(x: str) -> str:
    low = f"replace(lower(regexp_replace(replace({x}, '’', ''''), '[\\p{{Pd}}−]', ' ', 'g')), 'ß', 'ss')"
    bare = f"list_transform(regexp_extract_all({low}, '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*'), lambda t: regexp_replace(t, '(.)''s$', '\\1'))"
    return f"flatten(list_transform({bare}, lambda t: CASE WHEN contains(t, '''') THEN [t] ELSE regexp_extract_all(t, '\\p{{L}}+|\\p{{N}}+') END))"


_SURFACE = "(regexp_split_to_array(text, '\\s+'))"


def _scan_sql(name: str, surface: str) -> str:
    return f"""{name}_t AS (SELECT target_id, a, CASE WHEN len(a) >= 2 THEN upper(array_to_string(list_transform(a, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN t ELSE t[1] END), '')) END AS short
  FROM (SELECT item_id AS target_id, {_anchor(surface)} AS a FROM benchmark)
), {name}_m AS (
  SELECT target_id, chunk_id, a, t, short, shorts, contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ') AS full_ FROM {name}_t JOIN ct ON list_has_any(t, a) OR coalesce(list_contains(shorts, short), false)
), {name} AS (
  SELECT target_id, chunk_id, CASE WHEN full_ THEN 'full_token_sequence' WHEN list_has_all(t, a) AND len(list_filter(range(1, len(t) + 1), lambda i: len(list_filter(a, lambda x: len(list_filter(t[i:i + 11], lambda y: y = x)) < len(list_filter(a, lambda y: y = x)))) = 0)) > 0 THEN 'twelve_token_window'
    WHEN coalesce(list_contains(shorts, short), false) THEN 'mechanical_initialism' WHEN list_has_any(t, a) THEN 'partial_token_collision' END AS rule
  FROM {name}_m
)"""


_CT = f"ct AS (SELECT chunk_id, {_anchor('text')} AS t, list_distinct(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[\\p{{Lu}}\\p{{Nd}}]{{2,10}}') AND regexp_matches(w, '\\p{{Lu}}'))) AS shorts FROM chunks)"
_EDGES = "edges AS (SELECT a.chunk_id, b.chunk_id AS neighbour_id FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND abs(a.chunk_no - b.chunk_no) = 1)"
_KIND = "CASE rule WHEN 'full_token_sequence' THEN 'strong' WHEN 'partial_token_collision' THEN 'partial_token_collision' ELSE 'weak' END"
_ALL = f"""WITH RECURSIVE {CHUNKS_SQL}, {_CT}, {_EDGES}, {_scan_sql('s0', _SURFACE + "[3] || ' ' || " + _SURFACE + '[4]')}, {_scan_sql('b0', _SURFACE + '[3]')}, scan AS (SELECT *, {_KIND} AS kind FROM s0 WHERE rule IS NOT NULL
), strong AS (SELECT target_id, chunk_id FROM scan WHERE kind = 'strong'), near AS (SELECT chunk_id, neighbour_id FROM edges UNION SELECT chunk_id, chunk_id FROM chunks
), rel AS (SELECT DISTINCT a.target_id AS pair_id, a.chunk_id, b.chunk_id AS other_id FROM strong a JOIN near n ON n.chunk_id = a.chunk_id JOIN strong b ON b.chunk_id = n.neighbour_id AND b.target_id = a.target_id + 1
), broad AS (SELECT DISTINCT a.target_id AS pair_id, a.chunk_id, b.chunk_id AS other_id FROM b0 a JOIN near n ON n.chunk_id = a.chunk_id JOIN strong b ON b.chunk_id = n.neighbour_id AND b.target_id = a.target_id + 2 WHERE a.rule = 'full_token_sequence'
), sel AS (SELECT target_id, chunk_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY CASE kind WHEN 'strong' THEN 0 WHEN 'weak' THEN 1 ELSE 2 END, chunk_id) AS INT) AS source_number FROM scan QUALIFY source_number <= 8
), lane AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM strong s JOIN near n ON n.chunk_id = s.chunk_id WHERE s.target_id = sel.target_id AND n.neighbour_id = sel.chunk_id) THEN 'direct'
    WHEN EXISTS (SELECT 1 FROM broad b WHERE b.pair_id = sel.target_id AND (b.chunk_id = sel.chunk_id OR b.other_id = sel.chunk_id)) THEN 'broader_related'
    WHEN EXISTS (SELECT 1 FROM scan s WHERE s.target_id = sel.target_id AND s.chunk_id = sel.chunk_id AND s.kind = 'weak') THEN 'analogue' ELSE 'generic_semantic' END AS lane FROM sel
), facts AS (SELECT item_id AS k, EXISTS (SELECT 1 FROM strong WHERE target_id = item_id) AS direct, EXISTS (SELECT 1 FROM rel WHERE pair_id = item_id) AS related, EXISTS (SELECT 1 FROM lane WHERE target_id = item_id AND lane = 'broader_related') AS broader, item_id % 5 <> 4 AS checkable, item_id <> 7 AS integ FROM benchmark
), dec AS (SELECT *, checkable AND integ AND NOT direct AS absent, CASE WHEN NOT integ THEN 'indeterminate' WHEN k = 9 THEN 'direct_answer' WHEN direct AND (k % 2 <> 0 OR related) THEN 'direct_answer' WHEN direct THEN 'partial_answer' WHEN checkable AND broader THEN 'qualified_near_match' WHEN checkable THEN 'clean_abstention' ELSE 'indeterminate' END AS decision FROM facts)"""
_ASKS = "(['Who ', 'When and why did ', 'What was ', 'How did it, and where, ', ''])[item_id % 5 + 1]"

SQL = {
    "anchor_match": f"{_ALL} SELECT target_id, chunk_id, rule, kind FROM scan WHERE kind <> 'partial_token_collision'",
    "target_scan": f"{_ALL} SELECT target_id, kind, rule, count(*) AS chunks, min(chunk_id) AS first_id FROM scan GROUP BY ALL",
    "relationship": f"{_ALL} SELECT * FROM rel",
    "broader_related": f"{_ALL} SELECT * FROM broad",
    "integrity_codes": """SELECT * FROM (VALUES ('whole', '', true), ('broken', 'invalid_loaded_chunk,duplicate_loaded_chunk_id,eligible_chunk_ids_mismatch,loaded_chunk_count_mismatch,collection_count_mismatch', false),
  ('foreign', 'manifest_identity_mismatch,invalid_manifest_chunk_id,duplicate_manifest_chunk_id,invalid_loaded_chunk,loaded_chunk_count_mismatch,manifest_collection_count_mismatch', false), ('nameless', 'manifest_identity_missing', false)) v(corpus, codes, passed)""",
    "evidence_lanes": f"{_ALL} SELECT * FROM lane",
    "evidence_decision": f"{_ALL} SELECT k AS target_id, absent AS certified_absence, decision FROM dec",
    "allowed_sources": f"{_ALL} SELECT target_id, source_number, lane, decision, CASE WHEN decision IN ('direct_answer', 'partial_answer') THEN lane IN ('direct', 'broader_related') WHEN decision = 'qualified_near_match' THEN lane = 'broader_related' AND sum(CAST(lane = 'broader_related' AS INT)) OVER (PARTITION BY target_id ORDER BY source_number ROWS UNBOUNDED PRECEDING) <= 2 ELSE false END AS allowed FROM lane JOIN dec ON k = target_id",
    "multi_subject": f"{_ALL}, g AS (SELECT k // 3 AS query_id, count(*) AS subjects, count(*) FILTER (direct) AS n_present, bool_and(checkable) AS c, bool_and(integ) AS i FROM dec GROUP BY 1) SELECT query_id, subjects, n_present, CASE WHEN NOT i THEN 'indeterminate' WHEN n_present = subjects THEN 'direct_answer' WHEN n_present > 0 THEN 'partial_answer' WHEN c THEN 'clean_abstention' ELSE 'indeterminate' END AS decision FROM g",
    "requirement_routing": f"""WITH RECURSIVE {CHUNKS_SQL}, q AS (SELECT item_id AS query_id, trim(regexp_replace({_ASKS} || array_to_string({_SURFACE}[1:4], ' '), '\\s+', ' ', 'g')) AS q FROM benchmark
), cut AS (SELECT query_id, q, list_filter(string_split(regexp_replace(q, '(?i)\\b(who|what|when|where|why|how)\\b', chr(1) || '\\1', 'g'), chr(1)), lambda p, i: i > 1) AS parts FROM q
), r0 AS (SELECT query_id, unnest(CASE WHEN len(parts) = 0 THEN [0] ELSE range(1, len(parts) + 1) END) AS pos, unnest(CASE WHEN len(parts) = 0 THEN [q] ELSE parts END) AS part, len(parts) = 0 AS general FROM cut
), r1 AS (SELECT query_id, pos, CASE WHEN general THEN 'general' ELSE lower(regexp_extract(part, '^[A-Za-z]+')) END AS aspect, regexp_replace(regexp_replace(part, '^[ ,;:\\-]+|[ ,;:\\-]+$', '', 'g'), '(?i)\\s+(?:and|also)$', '') AS fragment FROM r0
), r AS (SELECT *, 'requirement:' || aspect || ':' || row_number() OVER (PARTITION BY query_id, aspect ORDER BY pos) AS requirement_id FROM r1
), terms AS (SELECT DISTINCT query_id, requirement_id, aspect, unnest({content_sql('fragment')}) AS term FROM r
), c AS (SELECT chunk_id, regexp_matches(text, '{E.DATE}') AS dated, regexp_matches(lower(text), '{E.CAUSAL}') AS causal, unnest(list_distinct({tokens_sql('text')})) AS term FROM chunks
), n AS (SELECT query_id, requirement_id, count(DISTINCT chunk_id) AS chunks FROM terms t JOIN c ON c.term = t.term WHERE (aspect <> 'when' OR dated) AND (aspect <> 'why' OR causal) GROUP BY ALL)
SELECT r.query_id, r.requirement_id, aspect, fragment, coalesce(chunks, 0) AS chunks FROM r LEFT JOIN n ON n.query_id = r.query_id AND n.requirement_id = r.requirement_id""",
    "evidence_cards": f"""WITH {_SENTENCES}, q AS (SELECT item_id AS doc_id, list_distinct({content_sql('text')}) AS terms FROM benchmark), s AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS s FROM sent
), t AS (SELECT s.doc_id, pos, s, terms, list_distinct({tokens_sql('s')}) AS t FROM s JOIN q ON q.doc_id = s.doc_id
), m AS (SELECT *, len(list_intersect(terms, t)) AS matched FROM t
), g AS (SELECT *, round(matched / greatest(len(terms), 1)::DOUBLE * 10 + matched / greatest(least(len(t), 24), 1)::DOUBLE * 2 + 1 / (pos + 10000)::DOUBLE, 6) AS score FROM m WHERE matched > 0
), b AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS INT) AS r FROM g QUALIFY r <= 2)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(matched AS INT) AS matched, score, r FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY r) = 1""",
}
