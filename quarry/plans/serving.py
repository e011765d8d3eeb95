"""Routing, faceted and serving queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.operators import serving as S
from quarry.plans.corpus import CHUNKS_SQL, chunk_table
from quarry.plans.metrics import _DENSE_LABEL_SQL, label_pools
from quarry.sources.tables import LEDGER_SQL, ledger, read

#: Openings that are put before the items' texts.
ASKS = (
    "Trace the development of ", "Does the book mention Mary Smith or ", "What is the relationship between Mary Smith and John Doe in ", "Why did they leave, and when did ", "Who was ", "How did Article 9 and the 3rd Army cause ",
    "How does the manuscript describe the causes of ", "Given that several causes matter, compare ", "From the U-2 to “the last”, what did NATO change in ",
)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Whole items as questions: an opening, the text, and for each fourth a second question."""
    first = F.element_at(F.array(*[F.lit(a) for a in ASKS]), (F.col("item_id") % len(ASKS) + 1).cast("int"))
    last = F.when(F.col("item_id") % 4 == 0, "? And who said so?").otherwise("?")
    return read(spark, d, "benchmark").select("item_id", F.concat(first, F.coalesce("text", F.lit("")), last).alias("question"))


def route_traits(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark, d).withColumn("target", F.size(S.trusted_targets("question")) > 0)
    return q.select("item_id", F.array_join(S.route_traits(F.col("question"), F.col("target")), ",").alias("traits"))


def trusted_targets(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("item_id", F.inline(S.trusted_targets("question")))


def help_questions(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations and help questions with typing errors, by turn."""
    said = ("what can yuo do", "howdo i use archivist", "what is our purpose", "waht can you do?", "How does this wrok", "what did you do there", "how do i sue this")
    typed = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("conv_id") % len(said) + 1).cast("int"))
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", typed).otherwise(F.col("text")).alias("said"))
    return c.select("conv_id", "turn", S.help_matcher()("said", F.col("turn") == 0).alias("help"))


def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    return S.bounded_history(read(spark, d, "conversations").select("conv_id", "turn", (F.length("text") * 10).alias("chars")))


def followup_subject(spark: SparkSession, d: str) -> DataFrame:
    subject = F.when((F.col("role") == "user") & (F.length("text") < 400), F.regexp_extract("text", r"^\S+\s+(\S+)", 1))
    return S.followup_subject(read(spark, d, "conversations").select("conv_id", "turn", F.nullif(subject, F.lit("")).alias("subject"))).select("conv_id", "turn", "latest")


def stage_bands(spark: SparkSession, d: str) -> DataFrame:
    """Sources in order of name as a narrative of six stages."""
    s = read(spark, d, "documents").select("source").distinct().withColumn("ordinal", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("source")) - 1)
    return S.bands(s, 6)


def scope_apportionment(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_table(spark, d).select(F.col("doc_id").alias("query_id"), F.col("chunk_no").alias("source"), (F.col("paragraph_end") - F.col("paragraph_start") + 1).alias("length"))
    return S.apportion(c, 10)


def requirement_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a requirement through its facets, in first-seen order."""
    pools = label_pools(spark, d).select("query_id", (F.col("rank") % 3).alias("facet"), "id", "rank")
    seen = pools.groupBy("query_id", (F.col("facet") % 2).alias("requirement"), "id").agg(F.min("rank").alias("first"))
    return seen.groupBy("query_id", "requirement").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "id"))), lambda x: x.id.cast("string")), ",").alias("sources"))


def schedule(spark: SparkSession, d: str) -> DataFrame:
    """Counterbalanced arms AB/BA and batches of eight."""
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("item_id"))
    return read(spark, d, "benchmark").select("item_id", F.when(n % 2 == 1, "AB").otherwise("BA").alias("order_of_arms"), (F.floor((n - 1) / 8) + 1).alias("batch"))


def rate_gate(spark: SparkSession, d: str) -> DataFrame:
    """Users as clients of five instances; a request is active for as many seconds as its value says."""
    e = read(spark, d, "events").select((F.col("user_id") % 5).alias("instance"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("category"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("seconds"))
    return S.rate_gate(e, (1, 2, 8), (3, 2, 6))


def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    e = ledger(spark, d).select("id", F.col("project_id").alias("key"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("at"), F.col("cost_nano").cast("double").alias("cost"))
    return S.admit_within(e, 5_000_000_000)


QUERIES = {f.__name__: f for f in (
    route_traits, trusted_targets, help_questions, bounded_history, followup_subject, stage_bands, scope_apportionment, requirement_sources,
    schedule, rate_gate, budget_admission)}


SQL = {
    "bounded_history": "WITH t AS (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text) * 10) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, CAST(total AS BIGINT) AS chars_from_here FROM t WHERE n <= 6 AND total <= 16000",
    "followup_subject": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND length(text) < 400 THEN nullif(regexp_extract(text, '^\\S+\\s+(\\S+)', 1), '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM conversations",
    "stage_bands": "WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS ordinal FROM (SELECT DISTINCT source FROM documents)) SELECT source, CAST(ordinal AS INT) AS ordinal, CAST(least(5, floor(ordinal * 6 / count(*) OVER ())) AS BIGINT) AS band FROM s",
    "scope_apportionment": f"WITH RECURSIVE {CHUNKS_SQL}, s AS (SELECT doc_id AS query_id, chunk_no AS source, paragraph_end - paragraph_start + 1 AS length FROM chunks), m AS (SELECT *, unnest(range(1, length)) AS j FROM s WHERE length > 1), r AS (SELECT m.query_id, source, row_number() OVER (PARTITION BY m.query_id ORDER BY length / j::DOUBLE DESC, source) AS r, spare FROM m JOIN (SELECT query_id, 10 - count(*) AS spare FROM s GROUP BY 1) x ON x.query_id = m.query_id), w AS (SELECT query_id, source, count(*) AS e FROM r WHERE r <= spare GROUP BY ALL) SELECT s.*, coalesce(e, 0) + 1 AS scopes FROM s LEFT JOIN w ON w.query_id = s.query_id AND w.source = s.source",
    "requirement_sources": f"WITH {_DENSE_LABEL_SQL}, f AS (SELECT query_id, rank % 3 % 2 AS requirement, id, min(rank) AS first FROM pools GROUP BY ALL) SELECT query_id, requirement, string_agg(CAST(id AS VARCHAR), ',' ORDER BY first, id) AS sources FROM f GROUP BY ALL",
    "schedule": "WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark) SELECT item_id, CASE WHEN n % 2 = 1 THEN 'AB' ELSE 'BA' END AS order_of_arms, (n - 1) // 8 + 1 AS batch FROM n",
}
