"""Retrieval queries with their DuckDB equivalents.

All benchmark items are the queries (query_id = item_id; each fifth quotes its first two words, and its eighth to tenth);
embedding i is the vector of item i as a query, and of document i as a candidate, where it stands for the document's first
chunk; a document's source is what diversity caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.operators import corpus as C
from quarry.operators import retrieval as R
from quarry.plans.corpus import CHUNKS_SQL, chunk_index, chunk_table, content_sql, ordered_distinct, tokens_sql
from quarry.sources.stage import kept
from quarry.sources.tables import read

FAR = 1.6  # a distance that filters in these tables, where 1.05 falls back


def _queries(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("text", r"\s+")
    quoted = F.concat(F.lit("“"), w[0], F.lit(" "), w[1], F.lit("” "), "text", F.lit(' "'), F.concat_ws(" ", F.slice(w, 8, 3)), F.lit('"'))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 5 == 0, quoted).otherwise(F.col("text")).alias("text"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, ("documents", "benchmark"), "bm25", lambda: R.lexical(_queries(spark, d), chunk_index(spark, d)))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    def ranked() -> DataFrame:
        v = read(spark, d, "embeddings")
        items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).distinct()
        q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).join(items, "query_id")
        return R.dense(q, v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))

    return kept(spark, d, ("embeddings", "benchmark"), "dense", ranked)


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as first chunks; those without a chunk are no candidates."""
    lookup = chunk_table(spark, d).filter("chunk_no = 1").select("chunk_id")
    return dense_topk(spark, d).withColumn("chunk_id", F.format_string("%s_001", F.col("id").cast("string"))).join(lookup, "chunk_id")


def threshold_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Both thresholds: one filters, the other mostly falls back."""
    s = dense_topk(spark, d)
    return R.within(s, FAR, 5).select("query_id", "id", "rank", F.lit("far").alias("arm")).unionByName(R.within(s, R.MAX_DISTANCE, 5).select("query_id", "id", "rank", F.lit("near").alias("arm")))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(R.within(_semantic(spark, d), FAR, 5), bm25_topk(spark, d))


def diversity_select(spark: SparkSession, d: str) -> DataFrame:
    source = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("source").alias("document"))
    fused = rrf_fusion(spark, d).withColumn("doc", F.regexp_extract("chunk_id", "^(.*)_", 1)).join(source, "doc")
    return R.diversify(fused, 8, 1).select("query_id", "chunk_id", "document", "rank", "rrf_score", "deferred", "position")


def answer_context(spark: SparkSession, d: str) -> DataFrame:
    edges = C.id_neighbours(chunk_table(spark, d).select("chunk_id"))
    return R.with_neighbours(diversity_select(spark, d).filter("position <= 5"), edges)


def exact_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold an item's first line, whatever the case."""
    needle = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.split("text", "\n")[0]).alias("needle"))
    return C.holding(chunk_table(spark, d), needle, "query_id").select("query_id", "chunk_id", "doc_id", "chunk_no")


def index_context(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold a term exactly, then their neighbours, then ranked chunks; each once, at most eight."""
    c = chunk_table(spark, d)
    exact = exact_chunks(spark, d).withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id", "chunk_no"))).select("query_id", "chunk_id", "position")
    near = R.with_neighbours(exact, C.id_neighbours(c.select("chunk_id")), 1 << 30)
    ranked = bm25_topk(spark, d).select("query_id", "chunk_id", F.lit(2).alias("tier"), "rank")
    every = near.select("query_id", "chunk_id", F.when(F.col("origin") == "primary", 0).otherwise(1).alias("tier"), F.col("source_number").alias("rank")).unionByName(ranked)
    once = every.withColumn("r", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("tier", "rank"))).filter("r = 1")
    order = W.partitionBy("query_id").orderBy("tier", "rank")
    return once.withColumn("source_number", F.row_number().over(order)).filter("source_number <= 8").select("query_id", "chunk_id", "source_number", "tier")


def displacement(spark: SparkSession, d: str) -> DataFrame:
    """The first five of the vector arm that the answer context lacks, and why."""
    first = _semantic(spark, d).filter("rank <= 5").select("query_id", "chunk_id", "rank", "distance")
    kept = answer_context(spark, d).select("query_id", "chunk_id")
    far = R.within(_semantic(spark, d), FAR, 5).select("query_id", "chunk_id", F.lit(True).alias("within"))
    held = diversity_select(spark, d).select("query_id", "chunk_id", "deferred")
    lost = first.join(kept, ["query_id", "chunk_id"], "left_anti").join(far, ["query_id", "chunk_id"], "left").join(held, ["query_id", "chunk_id"], "left")
    cause = F.when(F.col("within").isNull(), "distance_filtering").when(F.col("deferred"), "document_diversity").otherwise("rank_cutoff")
    return lost.select("query_id", "chunk_id", "rank", cause.alias("cause"))


def candidate_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of each candidate of the vector arm."""
    c = dense_topk(spark, d).withColumn("chunk_id", F.format_string("%s_001", F.col("id").cast("string")))
    known = chunk_table(spark, d).filter("chunk_no = 1").select("chunk_id", F.lit(True).alias("known"))
    near = R.within(_semantic(spark, d), FAR, 5).select("query_id", "chunk_id", F.lit(True).alias("near"))
    kept = answer_context(spark, d).select("query_id", "chunk_id", "origin")
    rows = c.join(known, "chunk_id", "left").join(near, ["query_id", "chunk_id"], "left").join(kept, ["query_id", "chunk_id"], "left")
    status = F.when(F.col("known").isNull(), "missing").when(F.col("near").isNull(), "filtered").when(F.col("origin").isNull(), "eligible").otherwise("kept")
    return rows.select("query_id", "chunk_id", "rank", status.alias("status"))


def rank_utility(spark: SparkSession, d: str) -> DataFrame:
    pools = _semantic(spark, d).select("query_id", F.lit("dense").alias("pool"), F.col("chunk_id").alias("id"), "rank").unionByName(bm25_topk(spark, d).select("query_id", F.lit("lexical").alias("pool"), F.col("chunk_id").alias("id"), "rank"))
    return R.rank_utility(pools)


def retrieval_modes(spark: SparkSession, d: str) -> DataFrame:
    asks = F.element_at(F.array(*[F.lit(x) for x in ("Trace the rise of", "What did", "How, over  time, did", "The law as an engine of", "Who is")]), (F.col("item_id") % 5 + 1).cast("int"))
    return read(spark, d, "benchmark").select("item_id", R.retrieval_mode(F.concat(asks, F.lit(" "), "text")).alias("mode"))


QUERIES = {f.__name__: f for f in (bm25_topk, dense_topk, threshold_fallback, rrf_fusion, diversity_select, answer_context, index_context, displacement, candidate_status, rank_utility, retrieval_modes)}

# -- DuckDB ------------------------------------------------------------------------------------------------------------

def lexical_sql(queries: str) -> str:
    """CTEs up to lex (query_id, chunk_id, score, matched_terms, rank), from chunks and SQL that gives query_id and text."""
    return f"""
qt AS ({queries}
), q0 AS (SELECT query_id, {content_sql('text')} AS c, list_filter(list_transform(regexp_extract_all(text, '["“”]([^"“”]+)["“”]', 1), lambda p: array_to_string({tokens_sql('p')}, ' ')), lambda p: p <> '') AS said FROM qt
), q AS (SELECT query_id, {ordered_distinct('c')} AS terms, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])) AS bigrams, list_distinct(said) AS quoted FROM q0
), ct AS (SELECT chunk_id, doc_id, chunk_no, {tokens_sql('text')} AS t FROM chunks
), st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS mean FROM ct
), post AS (SELECT chunk_id, term, len, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM ct) GROUP BY ALL
), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term
), m AS (
  SELECT query_id, post.chunk_id, count(*) AS matched, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1.0::DOUBLE - 0.75 + 0.75::DOUBLE * len / mean)))) AS bm25
  FROM (SELECT query_id, unnest(terms) AS term FROM q) x JOIN post ON post.term = x.term JOIN dfs ON dfs.term = x.term, st GROUP BY ALL
), lexs AS (
  SELECT q.query_id, ct.chunk_id, ct.doc_id, ct.chunk_no, coalesce(matched, 0) AS matched_terms,
         round(coalesce(bm25 * (1.0::DOUBLE + 0.2::DOUBLE * matched / len(terms)), 0) + 0.5::DOUBLE * len(list_filter(bigrams, lambda p: contains(body, p))) + 2.0::DOUBLE * len(list_filter(quoted, lambda p: contains(body, p))), 9) AS score
  FROM q JOIN (SELECT *, array_to_string(t, ' ') AS body FROM ct) ct ON len(terms) > 0 LEFT JOIN m ON q.query_id = m.query_id AND ct.chunk_id = m.chunk_id
), lex AS (
  SELECT query_id, chunk_id, score, matched_terms, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no, chunk_id) AS INT) AS rank FROM lexs WHERE score > 0 QUALIFY rank <= 20
)"""


_LEX = lexical_sql("SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN '“' || w[1] || ' ' || w[2] || '” ' || text || ' \"' || array_to_string(w[8:10], ' ') || '\"' ELSE text END AS text FROM (SELECT item_id, text, regexp_split_to_array(text, '\\s+') AS w FROM benchmark)")
_DENSE = f"""
gaps AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), 9) AS distance
  FROM embeddings v JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND q.vec_id <> v.vec_id
), den AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM gaps QUALIFY rank <= 20)"""
_FUSED = f"""{CHUNKS_SQL}, {_LEX}, {_DENSE}, sem AS (
  SELECT den.*, id || '_001' AS chunk_id FROM den JOIN chunks ON chunk_id = id || '_001'
), semw AS (
  SELECT * FROM sem QUALIFY distance <= {FAR} OR NOT bool_or(distance <= {FAR}) OVER (PARTITION BY query_id) OR (rank <= 5 AND NOT coalesce(bool_or(distance <= {FAR}) FILTER (rank <= 5) OVER (PARTITION BY query_id), false))
), fused0 AS (
  SELECT coalesce(s.query_id, x.query_id) AS query_id, coalesce(s.chunk_id, x.chunk_id) AS chunk_id, s.rank AS semantic_rank, s.distance, x.rank AS lexical_rank, x.score AS bm25_score,
         round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 12) AS rrf_score
  FROM semw s FULL JOIN lex x ON s.query_id = x.query_id AND s.chunk_id = x.chunk_id
), fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, semantic_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS INT) AS rank FROM fused0)"""
_DIVERSE = f"""{_FUSED}, src AS (
  SELECT f.*, d.source AS document, row_number() OVER (PARTITION BY query_id, d.source ORDER BY rank) > 1 AS full_ FROM fused f JOIN documents d ON CAST(d.doc_id AS VARCHAR) = regexp_extract(f.chunk_id, '^(.*)_', 1)
), fst AS (SELECT *, min(rank) FILTER (full_) OVER (PARTITION BY query_id) AS fr, arg_min(rrf_score, rank) FILTER (full_) OVER (PARTITION BY query_id) AS fs FROM src
), dfd AS (SELECT *, full_ OR coalesce(rank > fr AND rrf_score < fs * 0.75, false) AS deferred FROM fst
), diverse AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY deferred, rank) AS INT) AS position FROM dfd QUALIFY position <= 8)"""
_EDGES = """edges AS (
  SELECT a.chunk_id, b.chunk_id AS neighbour_id FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND abs(a.chunk_no - b.chunk_no) = 1 AND a.chunk_no < 1000 AND (b.chunk_no < 1001)
)"""
_CONTEXT = f"""{_DIVERSE}, {_EDGES}, parts AS (
  SELECT query_id, chunk_id, 0 AS tier, position AS parent, '' AS side FROM diverse WHERE position <= 5
  UNION ALL SELECT query_id, neighbour_id, 1, position, neighbour_id FROM diverse JOIN edges ON edges.chunk_id = diverse.chunk_id WHERE position <= 5
), once AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, parent, side) = 1
), context AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, parent, side) AS INT) AS source_number, CASE tier WHEN 0 THEN 'primary' ELSE 'neighbour' END AS origin FROM once QUALIFY source_number <= 8)"""


def _within(limit: float) -> str:
    return f"SELECT * FROM den QUALIFY distance <= {limit} OR NOT bool_or(distance <= {limit}) OVER (PARTITION BY query_id) OR (rank <= 5 AND NOT coalesce(bool_or(distance <= {limit}) FILTER (rank <= 5) OVER (PARTITION BY query_id), false))"


SQL = {
    "bm25_topk": f"WITH RECURSIVE {CHUNKS_SQL}, {_LEX} SELECT * FROM lex",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM den",
    "threshold_fallback": f"WITH {_DENSE} SELECT query_id, id, rank, 'far' AS arm FROM ({_within(FAR)}) UNION ALL SELECT query_id, id, rank, 'near' FROM ({_within(R.MAX_DISTANCE)})",
    "rrf_fusion": f"WITH RECURSIVE {_FUSED} SELECT * FROM fused",
    "diversity_select": f"WITH RECURSIVE {_DIVERSE} SELECT query_id, chunk_id, document, rank, rrf_score, deferred, position FROM diverse",
    "answer_context": f"WITH RECURSIVE {_CONTEXT} SELECT * FROM context",
    "index_context": f"""WITH RECURSIVE {CHUNKS_SQL}, {_LEX}, {_EDGES}, ex AS (
  SELECT b.item_id AS query_id, c.chunk_id, row_number() OVER (PARTITION BY b.item_id ORDER BY doc_id, chunk_no) AS position FROM chunks c JOIN benchmark b ON contains(lower(c.text), lower(string_split(b.text, chr(10))[1]))
), near0 AS (SELECT query_id, chunk_id, 0 AS tier, position AS parent, '' AS side FROM ex UNION ALL SELECT query_id, neighbour_id, 1, position, neighbour_id FROM ex JOIN edges ON edges.chunk_id = ex.chunk_id
), near1 AS (SELECT * FROM near0 QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, parent, side) = 1
), every AS (SELECT query_id, chunk_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, parent, side) AS rank FROM near1 UNION ALL SELECT query_id, chunk_id, 2, rank FROM lex
), once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, rank) = 1
) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS INT) AS source_number, tier FROM once QUALIFY source_number <= 8""",
    "displacement": f"WITH RECURSIVE {_CONTEXT} SELECT s.query_id, s.chunk_id, s.rank, CASE WHEN w.chunk_id IS NULL THEN 'distance_filtering' WHEN v.deferred THEN 'document_diversity' ELSE 'rank_cutoff' END AS cause FROM sem s LEFT JOIN semw w ON w.query_id = s.query_id AND w.chunk_id = s.chunk_id LEFT JOIN diverse v ON v.query_id = s.query_id AND v.chunk_id = s.chunk_id WHERE s.rank <= 5 AND NOT EXISTS (SELECT 1 FROM context c WHERE c.query_id = s.query_id AND c.chunk_id = s.chunk_id)",
    "candidate_status": f"WITH RECURSIVE {_CONTEXT} SELECT d.query_id, d.id || '_001' AS chunk_id, d.rank, CASE WHEN k.chunk_id IS NULL THEN 'missing' WHEN w.chunk_id IS NULL THEN 'filtered' WHEN c.chunk_id IS NULL THEN 'eligible' ELSE 'kept' END AS status FROM den d LEFT JOIN chunks k ON k.chunk_id = d.id || '_001' LEFT JOIN semw w ON w.query_id = d.query_id AND w.id = d.id LEFT JOIN context c ON c.query_id = d.query_id AND c.chunk_id = d.id || '_001'",
    "rank_utility": f"WITH RECURSIVE {_FUSED}, p AS (SELECT query_id, 'dense' AS pool, chunk_id AS id, rank FROM sem UNION ALL SELECT query_id, 'lexical', chunk_id, rank FROM lex), u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS utility, count(DISTINCT pool) AS pools, min(rank) AS best_rank FROM p GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, pools DESC, best_rank, id) AS INT) AS rank FROM u",
    "retrieval_modes": "SELECT item_id, CASE WHEN regexp_matches((['Trace the rise of', 'What did', 'How, over  time, did', 'The law as an engine of', 'Who is'])[item_id % 5 + 1] || ' ' || text, '" + R.BROAD + "') THEN 'broad_synthesis' ELSE 'standard' END AS mode FROM benchmark",
}
