"""Corpus and text queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.operators import corpus as C
from quarry.sources.stage import kept
from quarry.sources.tables import read, texts


def docs(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d)


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """All chunks, kept for the queries that follow."""
    return kept(spark, d, ("documents",), "chunks", lambda: C.chunks(docs(spark, d).select("doc_id", "text")))


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, ordinal and tokens of all chunks: their texts are cut into words once."""
    c = chunk_table(spark, d)
    return kept(spark, d, ("documents",), "chunk-index", lambda: c.select("chunk_id", F.struct("doc_id", "chunk_no").alias("ordinal"), X.tokens(F.col("text")).alias("tokens")))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "paragraph"))


def chapter_title(spark: SparkSession, d: str) -> DataFrame:
    """A short line counts as a heading here; it holds until the next."""
    rows = paragraphs(spark, d).select(F.col("doc_id").alias("document"), F.col("pos").alias("ordinal"), F.when(F.length("paragraph") < 40, F.col("paragraph")).alias("heading"))
    return C.running_title(rows).withColumn("chapter_title", F.coalesce("chapter_title", F.concat(F.lit("document "), "document"))).select("document", "ordinal", "chapter_title")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "benchmark")
    return q.select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


def query_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.array_join(X.bigrams(X.content_tokens(F.col("text"))), "|").alias("bigrams"))


def quoted_phrases(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit('He asked “'), F.substring("text", 1, 30), F.lit('” and "'), F.substring("text", 31, 20), F.lit('" twice: “'), F.substring("text", 1, 30), F.lit("”"))
    return read(spark, d, "benchmark").select("item_id", F.array_join(X.quoted_phrases(said), "|").alias("phrases"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    plain = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    return read(spark, d, "benchmark").select("item_id", F.sha2(plain, 256).alias("question_sha256"), F.length("text").alias("char_count"))


def question_set_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash of the whole ordered question set."""
    line = F.concat_ws("\t", F.lpad(F.col("item_id").cast("string"), 12, "0"), F.sha2("text", 256))
    return read(spark, d, "benchmark").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("set_sha256"), F.count("*").alias("items"))


def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return chunk_table(spark, d)


def skip_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*[F.lit(s) for s in ("01_Front Matter", "05_One", "x32_BIBLIOGRAPHY", "07_Two", "02_Table of contents")]), (F.col("doc_id") % 5 + 1).cast("int")), F.lit(".md"))
    return docs(spark, d).select("doc_id", name.alias("document")).filter(~X.is_structural(F.col("document")))


def manifest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.manifest(chunk_table(spark, d))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    per = docs(spark, d).select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("p"), F.size(X.chunk_starts(X.paragraphs(F.col("text")))).alias("c"))
    return per.agg(F.count("*").alias("documents"), F.sum("p").alias("paragraphs"), F.sum("c").alias("chunks"), F.count_if(F.expr("c = 0")).alias("empty_documents"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return C.id_neighbours(chunk_table(spark, d).select("chunk_id"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return C.adjacency(chunk_table(spark, d).select("doc_id", "chunk_no", "chunk_id"))


def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk but each third, as if selected, with the chapter changing at chunk 8."""
    c = chunk_table(spark, d).filter("chunk_no % 3 <> 0").select("doc_id", F.floor(F.col("chunk_no") / 8).alias("chapter"), F.col("paragraph_start").alias("start"), F.col("paragraph_end").alias("end"))
    return C.merge_adjacent(c).drop("island")


def reading_view(spark: SparkSession, d: str) -> DataFrame:
    return C.unseen_part(chunk_table(spark, d).drop("text")).select("chunk_id", "paragraph_start", "paragraph_end", "shown_from")


def sources_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten chunks that hold a needle, in corpus order."""
    hit = chunk_table(spark, d).filter(F.contains(F.lower("text"), F.lit("the")))
    return hit.orderBy("doc_id", "chunk_no").offset(10).limit(10).select("chunk_id", "doc_id", "paragraph_start")


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold the first line of a benchmark item, whatever the case."""
    needles = read(spark, d, "benchmark").select("item_id", F.split("text", "\n")[0].alias("needle"))
    return C.holding(chunk_table(spark, d), needles, "item_id").select("item_id", "chunk_id")


def candidate_terms(spark: SparkSession, d: str) -> DataFrame:
    return C.candidate_terms(docs(spark, d), 50)


def doc_distribution(spark: SparkSession, d: str) -> DataFrame:
    return chunk_table(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))


def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("paragraph_start").cast("string"), F.col("paragraph_end").cast("string")
    label = F.concat(F.lit("Document "), "doc_id", F.lit(", ¶"), F.when(a == b, a).otherwise(F.concat(a, F.lit("–"), b)))
    return chunk_table(spark, d).select("chunk_id", label.alias("label"), F.ceil(F.length("text") / 4).alias("token_estimate"), F.substring(F.sha2(F.concat_ws("|", "chunk_id", F.lit("scope")), 256), 1, 24).alias("unit_id"))


def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """Front matter of 24 pages in Roman numerals, the body in Arabic from 1."""
    p = read(spark, d, "pages").select("page_id")
    return p.select("page_id", F.when(F.col("page_id") < 24, X.roman(F.col("page_id") + 1)).otherwise((F.col("page_id") - 23).cast("string")).alias("label"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.slug(F.split("text", "\n")[0]).alias("slug"), X.cut_at_word(F.col("text"), 120).alias("short"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's longest sentence around the first word that the benchmark's first item has too."""
    terms = read(spark, d, "benchmark").filter("item_id = 3").select(X.query_terms(F.col("text")).alias("terms"))
    s = sentences(spark, d)
    best = s.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.length("sentence")), "pos"))).filter("r = 1")
    # a single row of terms
    return best.join(F.broadcast(terms)).select("doc_id", X.excerpt(F.col("sentence"), F.col("terms")).alias("excerpt"))


def index_section(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs from an index heading on; each seventh document gets one after three quarters of its paragraphs."""
    p = paragraphs(spark, d)
    n = F.count("*").over(W.partitionBy("doc_id"))
    p = p.withColumn("paragraph", F.when((F.col("doc_id") % 7 == 0) & (F.col("pos") == F.floor(n * 0.75)), F.lit("General Index")).otherwise(F.col("paragraph")))
    return C.split_index(p).groupBy("doc_id").agg(F.count_if(F.col("in_index")).alias("index_paragraphs"), F.count_if(~F.col("in_index")).alias("body_paragraphs"))


def full_context(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a document as one numbered context, in order."""
    part = F.struct("chunk_no", F.concat(F.lit("["), F.col("chunk_no").cast("string"), F.lit("] "), F.col("text")).alias("t"))
    c = chunk_table(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return c.select("doc_id", F.sha2(F.array_join("parts.t", "\n\n"), 256).alias("context_sha256"))


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """The manifest against one in which chunks are gone, new or edited."""
    c = chunk_table(spark, d)
    new = c.filter("chunk_no % 5 <> 4").withColumn("text", F.when(F.col("chunk_no") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return C.diff_manifests(C.manifest(c), C.manifest(new)).groupBy("status").agg(F.count("*").alias("n"))


def document_catalog(spark: SparkSession, d: str) -> DataFrame:
    first = chunk_table(spark, d).withColumn("ordinal", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_no")))
    return first.filter("ordinal = 1").select("doc_id", "chunk_id", "paragraph_end")


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Importer: HTML pages to plain text and title."""
    h = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(h, r"<[^>]+>", " "), r"\s+", " "))
    return read(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"), F.length(plain).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    paragraphs, chapter_title, tokens, query_terms, query_bigrams, quoted_phrases, sentences, fingerprints, question_set_hash, chunk_paragraphs, skip_filter, manifest_chunks,
    manifest_counts, neighbours, adjacency, merge_adjacent, reading_view, sources_page, exact_match, candidate_terms, doc_distribution, citation_labels, page_labels,
    slugs, excerpts, index_section, full_context, manifest_diff, document_catalog, page_text)}

# -- DuckDB ------------------------------------------------------------------------------------------------------------


#: Letters with marks of the given tables and their plain forms: DuckDB has no compatibility decomposition.
MARKED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_sql(x: str) -> str:
    return f"translate(replace(lower(replace({x}, '’', '''')), 'ß', 'ss'), '{MARKED}', '{PLAIN}')"


def tokens_sql(x: str) -> str:
    found = f"regexp_extract_all({fold_sql(f'coalesce({x}, chr(32))')}, '{X.WORD.replace(chr(39), chr(39) * 2)}')"
    return f"list_filter(list_transform({found}, lambda t: regexp_replace(t, '(.)''s$', '\\1')), lambda t: NOT regexp_full_match(t, '[0-9]{{1,2}}'))"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def content_sql(x: str) -> str:
    return f"list_filter({tokens_sql(x)}, lambda t: NOT list_contains({STOP_SQL}, t) AND length(t) > 1)"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


PARAGRAPHS_SQL = """
para AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]'), lambda p: trim(p)), lambda p: p <> '' AND p <> '[IMAGE]' AND NOT starts_with(p, '#')) AS ps FROM documents
)"""
_WEAK = " OR ".join([f"length(p) < {X.WEAK_LENGTH}", *(f"starts_with(lower(p), '{w}')" for w in X.WEAK_STARTS)])
_QUOTE = " OR ".join("starts_with(p, '" + q.replace("'", "''") + "')" for q in X.QUOTES)
CHUNKS_SQL = PARAGRAPHS_SQL + f""", flags AS (
  SELECT doc_id, ps, len(ps) AS n, list_transform(ps, lambda p: {_WEAK}) AS weak, list_transform(ps, lambda p: {_QUOTE}) AS quote, list_transform(ps, lambda p: ends_with(p, ':')) AS setup FROM para
), starts AS (
  SELECT doc_id, 0 AS start, 1 AS no FROM flags WHERE n > 0
  UNION ALL
  SELECT s.doc_id, CASE WHEN quote[s.start + 4] AND setup[s.start + 3] THEN s.start + 2 WHEN weak[s.start + 4] AND s.start + 4 < n THEN s.start + 4 ELSE s.start + 3 END, s.no + 1
  FROM starts s JOIN flags f ON f.doc_id = s.doc_id WHERE s.start + 4 < f.n
), chunks AS (
  SELECT s.doc_id, CAST(no AS INT) AS chunk_no, s.doc_id || '_' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS chunk_id,
         s.start + 1 AS paragraph_start, least(s.start + 4, n) AS paragraph_end, array_to_string(ps[s.start + 1:s.start + 4], chr(10) || chr(10)) AS text
  FROM starts s JOIN flags f ON f.doc_id = s.doc_id
)"""
_C = f"WITH RECURSIVE {CHUNKS_SQL}"
_MANIFEST = "SELECT chunk_id, doc_id, paragraph_start, paragraph_end, sha256(text) AS text_sha256, length(text) AS char_count FROM chunks"
_P = f"WITH {PARAGRAPHS_SQL}, rows AS (SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS paragraph FROM para)"
_SENTENCES = r"sent AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents)"
_SAID = "'He asked “' || substr(text, 1, 30) || '” and \"' || substr(text, 31, 20) || '\" twice: “' || substr(text, 1, 30) || '”'"

SQL = {
    "paragraphs": f"{_P} SELECT doc_id, CAST(pos AS INT) AS pos, paragraph FROM rows",
    "chapter_title": f"{_P} SELECT doc_id AS document, CAST(pos AS INT) AS ordinal, coalesce(last_value(CASE WHEN length(paragraph) < 40 THEN paragraph END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'document ' || doc_id) AS chapter_title FROM rows",
    "tokens": f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM t",
    "query_terms": f"WITH t AS (SELECT item_id, {content_sql('text')} AS t FROM benchmark) SELECT item_id, array_to_string({ordered_distinct('t')}, ' ') AS terms FROM t",
    "query_bigrams": f"WITH t AS (SELECT item_id, {content_sql('text')} AS t FROM benchmark), b AS (SELECT item_id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS b FROM t) SELECT item_id, array_to_string({ordered_distinct('b')}, '|') AS bigrams FROM b",
    "quoted_phrases": f"WITH t AS (SELECT item_id, list_filter(list_transform(regexp_extract_all({_SAID}, '[\"“”]([^\"“”]+)[\"“”]', 1), lambda p: array_to_string({tokens_sql('p')}, ' ')), lambda p: p <> '') AS p FROM benchmark) SELECT item_id, array_to_string({ordered_distinct('p')}, '|') AS phrases FROM t",
    "sentences": f"WITH {_SENTENCES} SELECT doc_id, CAST(unnest(range(0, len(ss))) AS INT) AS pos, unnest(ss) AS sentence FROM sent",
    "fingerprints": r"SELECT item_id, sha256(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS question_sha256, length(text) AS char_count FROM benchmark",
    "question_set_hash": "SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS set_sha256, count(*) AS items FROM (SELECT lpad(CAST(item_id AS VARCHAR), 12, '0') || chr(9) || sha256(text) AS l FROM benchmark)",
    "chunk_paragraphs": f"{_C} SELECT * FROM chunks",
    "skip_filter": "SELECT * FROM (SELECT doc_id, (['01_Front Matter', '05_One', 'x32_BIBLIOGRAPHY', '07_Two', '02_Table of contents'])[doc_id % 5 + 1] || '.md' AS document FROM documents) WHERE NOT (" + " OR ".join(f"contains(lower(document), '{s}')" for s in X.STRUCTURAL) + ")",
    "manifest_chunks": f"{_C} {_MANIFEST}",
    "manifest_counts": f"{_C} SELECT (SELECT count(*) FROM para) AS documents, (SELECT CAST(sum(len(ps)) AS BIGINT) FROM para) AS paragraphs, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM para WHERE len(ps) = 0) AS empty_documents",
    "neighbours": f"{_C}, n AS (SELECT chunk_id, regexp_extract(chunk_id, '^(.*)_(\\d{{3}})$', 1) AS stem, CAST(regexp_extract(chunk_id, '^(.*)_(\\d{{3}})$', 2) AS INT) AS k FROM chunks WHERE regexp_full_match(chunk_id, '.*_\\d{{3}}')), w AS (SELECT chunk_id, stem || '_' || lpad(CAST(k + o AS VARCHAR), CAST(greatest(3, length(CAST(k + o AS VARCHAR))) AS INT), '0') AS neighbour_id FROM n, (VALUES (-1), (1)) v(o)) SELECT w.chunk_id, neighbour_id FROM w JOIN chunks c ON c.chunk_id = neighbour_id",
    "adjacency": f"{_C}, p AS (SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS b FROM chunks) SELECT chunk_id, b AS neighbour_id FROM p WHERE b IS NOT NULL UNION ALL SELECT b, chunk_id FROM p WHERE b IS NOT NULL",
    "merge_adjacent": f"{_C}, r AS (SELECT doc_id, chunk_no // 8 AS chapter, paragraph_start AS s, paragraph_end AS e FROM chunks WHERE chunk_no % 3 <> 0), m AS (SELECT *, max(e) OVER (PARTITION BY doc_id, chapter ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chapter ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc_id, chapter, min(s) AS start, max(e) AS end, count(*) AS merged FROM i GROUP BY doc_id, chapter, island",
    "reading_view": f"{_C} SELECT chunk_id, paragraph_start, paragraph_end, greatest(paragraph_start, coalesce(lag(paragraph_end) OVER (PARTITION BY doc_id ORDER BY chunk_no) + 1, paragraph_start)) AS shown_from FROM chunks",
    "sources_page": f"{_C} SELECT chunk_id, doc_id, paragraph_start FROM chunks WHERE contains(lower(text), 'the') ORDER BY doc_id, chunk_no LIMIT 10 OFFSET 10",
    "exact_match": f"{_C} SELECT item_id, chunk_id FROM chunks JOIN benchmark b ON contains(lower(chunks.text), lower(string_split(b.text, chr(10))[1]))",
    "candidate_terms": r"WITH f AS (SELECT doc_id, regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,3})', 1) AS t FROM documents), u AS (SELECT doc_id, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM f) SELECT term, count(*) AS n FROM u WHERE length(term) > 3 GROUP BY term ORDER BY n DESC, min((doc_id, pos)) LIMIT 50",
    "doc_distribution": f"{_C} SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id",
    "citation_labels": f"{_C} SELECT chunk_id, 'Document ' || doc_id || ', ¶' || CASE WHEN paragraph_start = paragraph_end THEN CAST(paragraph_start AS VARCHAR) ELSE paragraph_start || '–' || paragraph_end END AS label, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate, substr(sha256(chunk_id || '|scope'), 1, 24) AS unit_id FROM chunks",
    "page_labels": "SELECT page_id, CASE WHEN page_id < 24 THEN (['', 'x', 'xx'])[(page_id + 1) // 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[(page_id + 1) % 10 + 1] ELSE CAST(page_id - 23 AS VARCHAR) END AS label FROM pages",
    "slugs": f"SELECT doc_id, regexp_replace(regexp_replace({fold_sql('string_split(text, chr(10))[1]')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 119), ' \\S*$', '') || '…' END AS short FROM documents",
    "excerpts": f"WITH {_SENTENCES}, t AS (SELECT {content_sql('text')} AS t FROM benchmark WHERE item_id = 3), s AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS s FROM sent), b AS (SELECT doc_id, regexp_split_to_array(s, '\\s+') AS w FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, pos) = 1), h AS (SELECT doc_id, w, len(w) AS n, coalesce(list_position(list_transform(w, lambda x: len(list_intersect({tokens_sql('x')}, t.t)) > 0), true), 0) AS hit FROM b, t), g AS (SELECT *, greatest(1, least(greatest(hit, 1) - 10, n - 31)) AS st FROM h) SELECT doc_id, CASE WHEN n <= 32 THEN array_to_string(w, ' ') ELSE CASE WHEN st > 1 THEN '… ' ELSE '' END || array_to_string(w[st:st + 31], ' ') || CASE WHEN st + 31 < n THEN ' …' ELSE '' END END AS excerpt FROM g",
    "index_section": f"{_P}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM rows), g AS (SELECT doc_id, pos, n, CASE WHEN doc_id % 7 = 0 AND pos = floor(n * 0.75) THEN 'General Index' ELSE paragraph END AS p FROM c), s AS (SELECT *, min(CASE WHEN trim(regexp_replace(lower(p), '[^a-z ]+', ' ', 'g')) IN ('index', 'general index', 'index of names') AND pos >= floor(n * 0.55) THEN pos END) OVER (PARTITION BY doc_id) AS start FROM g) SELECT doc_id, count(*) FILTER (coalesce(pos >= start, false)) AS index_paragraphs, count(*) FILTER (NOT coalesce(pos >= start, false)) AS body_paragraphs FROM s GROUP BY doc_id",
    "full_context": f"{_C} SELECT doc_id, sha256(string_agg('[' || chunk_no || '] ' || text, chr(10) || chr(10) ORDER BY chunk_no)) AS context_sha256 FROM chunks GROUP BY doc_id",
    "manifest_diff": f"{_C}, n AS (SELECT chunk_id, CASE WHEN chunk_no % 7 = 0 THEN text || '!' ELSE text END AS text FROM chunks WHERE chunk_no % 5 <> 4) SELECT CASE WHEN n.text IS NULL THEN 'missing' WHEN c.text <> n.text THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS n FROM chunks c LEFT JOIN n ON n.chunk_id = c.chunk_id GROUP BY 1",
    "document_catalog": f"{_C} SELECT doc_id, chunk_id, paragraph_end FROM chunks WHERE chunk_no = 1",
    "page_text": r"SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars FROM pages",
}
