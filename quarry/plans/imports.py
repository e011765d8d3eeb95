"""Import, store and closure queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.plans.corpus import _SENTENCES, CHUNKS_SQL, PARAGRAPHS_SQL, chunk_table
from quarry.sources.tables import LEDGER_SQL, ledger, read


def project_import(spark: SparkSession, d: str) -> DataFrame:
    """Documents split at an index heading, both parts chunked; each seventh gets a heading at three quarters."""
    def parts(ps: Column) -> Column:
        n = F.size(ps)
        full = F.transform(ps, lambda p, i: F.when((F.col("doc_id") % 7 == 0) & (i == F.floor(n * 0.75)), F.lit("General Index")).otherwise(p))
        at = F.array_position(F.transform(full, lambda p, i: F.lower(p).isin("index", "general index", "index of names") & (i >= F.floor(n * 0.55))), F.lit(True)).cast("int")
        body = F.when(at > 0, F.slice(full, 1, F.greatest(at - 1, F.lit(0)))).otherwise(full)
        rest = F.when(at > 0, F.slice(full, at, n)).otherwise(F.slice(full, 1, 0))
        return F.struct(F.size(X.chunk_starts(body)).alias("body_chunks"), F.size(rest).alias("index_paragraphs"))

    return read(spark, d, "documents").select("doc_id", X.once(X.paragraphs(F.col("text")), parts).alias("x")).select("doc_id", "x.*")


def filtered_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors kept without embedding them again, and how many each excluded collection loses."""
    v = read(spark, d, "embeddings").withColumn("excluded", F.col("label").isin(3, 5))
    return v.groupBy("label").agg(F.count_if(~F.col("excluded")).alias("kept"), F.count_if("excluded").alias("excluded"))


def promotion_check(spark: SparkSession, d: str) -> DataFrame:
    """Collections before and after one is replaced: the others have to stay as they are."""
    before = read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("before"))
    after = read(spark, d, "embeddings").filter("label <> 4 or vec_id % 2 = 0").filter("not (label = 6 and vec_id % 50 = 3)").groupBy("label").agg(F.count("*").alias("after"))
    status = F.when(F.col("label") == 4, "replaced").when(F.col("before").eqNullSafe(F.col("after")), "untouched").otherwise("changed")
    return before.join(after, "label", "full").withColumn("status", status)


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose embedding is not cached under the hash of their text."""
    q = read(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    cache = q.filter("item_id % 3 <> 0").select(F.when(F.col("item_id") % 10 == 1, F.lit("stale")).otherwise(F.col("h")).alias("h"))
    return q.join(cache, "h", "left_anti").select("item_id")


def run_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose name carries a version from 18 to 25, with their cost."""
    run = F.concat(F.element_at(F.array(F.lit("eval-v"), F.lit("smoke-"), F.lit("run-v")), (F.col("o_orderkey") % 3 + 1).cast("int")), (F.col("o_custkey") % 40).cast("string"), F.lit("-x"))
    o = read(spark, d, "orders").select(run.alias("run_id"), "o_totalprice").withColumn("version", F.regexp_extract("run_id", r"^(?:eval|run)-v(\d+)-", 1))
    o = o.filter("version <> ''").withColumn("version", F.col("version").cast("int")).filter("version between 18 and 25")
    return o.groupBy("version").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def followup_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Pronouns of a question replaced by the latest subject of the user's turns before; without one it stays."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.nullif(F.when(F.col("role") == "user", F.regexp_extract("text", r"^\S+\s+(\w\S+\w)", 1)), F.lit("")).alias("subject"))
    latest = F.last("subject", ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    asked = F.element_at(F.array(F.lit("Where did they meet?"), F.lit("Tell me more."), F.lit("What was its aim?"), F.lit("Who was there?")), (F.col("turn") % 4 + 1).cast("int"))
    rows = c.withColumns({"latest": latest, "q": asked})
    own = F.concat("latest", F.when(F.col("latest").endswith("s"), "'").otherwise("'s"))
    # subjects hold no group marks, so they can stand in a replacement
    named = F.when(F.col("q") == "Tell me more.", F.concat(F.lit("Tell me more about "), "latest", F.lit("."))).otherwise(F.regexp_replace(F.regexp_replace("q", F.lit(r"\b(?:they|it)\b"), F.col("latest")), F.lit(r"\bits\b"), own))
    return rows.select("conv_id", "turn", F.when(F.col("latest").isNull(), F.col("q")).otherwise(named).alias("resolved"))


def claim_anchoring(spark: SparkSession, d: str) -> DataFrame:
    """Claims found as substrings, each at or after the end of the one before; offsets or a failure code."""
    claims = F.transform(F.slice(X.sentences(F.col("text")), 1, 5), lambda s, i: F.when(i == 2, F.lit("no such claim")).otherwise(s))
    first = F.struct(F.lit(1).alias("pos"), F.array().cast("array<struct<start:int,end:int,failure:string>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        at = F.call_function("locate", c, F.col("text"), s.pos)
        hit = F.struct((at - 1).alias("start"), (at - 1 + F.length(c)).cast("int").alias("end"), F.lit(None).cast("string").alias("failure"))
        lost = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("not_found").alias("failure"))
        return F.struct(F.when(at > 0, (at + F.length(c)).cast("int")).otherwise(s.pos).alias("pos"), F.concat(s.out, F.array(F.when(at > 0, hit).otherwise(lost))).alias("out"))

    found = F.aggregate(claims, first, step, lambda s: s.out)
    return read(spark, d, "documents").select("doc_id", F.posexplode(found).alias("n", "x")).select("doc_id", "n", "x.*")


def usage_closure(spark: SparkSession, d: str) -> DataFrame:
    """Events of a turn against their checkpoints, in order and field by field."""
    e = ledger(spark, d).select("conversation_id", "id", "response_id", "total_tokens", "cost_nano", "unpriced")
    n = F.row_number().over(W.partitionBy("conversation_id").orderBy("id"))
    left = e.withColumn("n", n)
    right = e.filter("id % 97 <> 5").withColumn("total_tokens", F.when(F.col("id") % 89 == 7, F.col("total_tokens") + 1).otherwise(F.col("total_tokens"))).withColumn("n", n)
    right = right.select("conversation_id", "n", F.col("response_id").alias("r"), F.col("total_tokens").alias("t"), F.col("cost_nano").alias("c"))
    both = left.join(right, ["conversation_id", "n"], "full")
    fault = F.when(F.col("r").isNull(), "missing_checkpoint").when(F.col("response_id").isNull(), "missing_event").when(F.col("r") != F.col("response_id"), "order").when(~F.col("t").eqNullSafe(F.col("total_tokens")) | ~F.col("c").eqNullSafe(F.col("cost_nano")), "fields").when(F.col("unpriced") == 1, "unpriced").otherwise("closed")
    return both.groupBy(fault.alias("state")).agg(F.count("*").alias("n"))


def requested_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Requested chunks in the order asked for, with those that there are not."""
    asked = spark.createDataFrame([(["3_001", "0_001", "x_001", "5_001", "0_001"],)], "ids array<string>").select(F.posexplode("ids").alias("pos", "chunk_id"))
    c = chunk_table(spark, d).select("chunk_id", F.sha2("text", 256).alias("text_sha256"))
    return asked.join(c, "chunk_id", "left").select("pos", "chunk_id", "text_sha256")


def exact_id_check(spark: SparkSession, d: str) -> DataFrame:
    """A list of ids against the expected: duplicate, unknown, missing, out of order - the first that holds - or exact."""
    c = chunk_table(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_no")).alias("want"))
    k = F.col("doc_id") % 5
    got = F.when(k == 1, F.concat("want", F.array(F.lit(1)))).when(k == 2, F.concat("want", F.array(F.lit(9999)))).when(k == 3, F.slice("want", 2, F.size("want"))).when(k == 4, F.reverse("want")).otherwise(F.col("want"))
    c = c.withColumn("got", got)
    fault = F.when(F.size(F.array_distinct("got")) < F.size("got"), "duplicate").when(F.size(F.array_except("got", "want")) > 0, "unknown").when(F.size(F.array_except("want", "got")) > 0, "missing").when(F.col("got") != F.col("want"), "out_of_order").otherwise("exact")
    return c.select("doc_id", fault.alias("result"))


QUERIES = {f.__name__: f for f in (project_import, filtered_rebuild, promotion_check, cache_misses, run_discovery, followup_resolution, claim_anchoring, usage_closure, requested_lookup, exact_id_check)}

_BODY = CHUNKS_SQL.replace(PARAGRAPHS_SQL, PARAGRAPHS_SQL.replace("para AS", "para0 AS", 1) + ", para AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND len(ps) > 0 THEN ps[1:CAST(floor(len(ps) * 0.75) AS INT)] ELSE ps END AS ps FROM para0)")

SQL = {
    "project_import": f"WITH RECURSIVE {_BODY} SELECT p.doc_id, CAST(count(c.chunk_no) AS INT) AS body_chunks, CAST(CASE WHEN p.doc_id % 7 = 0 AND len(any_value(p.ps)) > 0 THEN len(any_value(p.ps)) - floor(len(any_value(p.ps)) * 0.75) ELSE 0 END AS INT) AS index_paragraphs FROM para0 p LEFT JOIN chunks c ON c.doc_id = p.doc_id GROUP BY p.doc_id",
    "filtered_rebuild": "SELECT label, count(*) FILTER (label NOT IN (3, 5)) AS kept, count(*) FILTER (label IN (3, 5)) AS excluded FROM embeddings GROUP BY label",
    "promotion_check": "WITH n AS (SELECT label, count(*) AS before, count(*) FILTER ((label <> 4 OR vec_id % 2 = 0) AND NOT (label = 6 AND vec_id % 50 = 3)) AS after FROM embeddings GROUP BY label) SELECT *, CASE WHEN label = 4 THEN 'replaced' WHEN before = after THEN 'untouched' ELSE 'changed' END AS status FROM n",
    "cache_misses": "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM benchmark c WHERE c.text = b.text AND c.item_id % 3 <> 0 AND c.item_id % 10 <> 1)",
    "run_discovery": r"WITH r AS (SELECT (['eval-v', 'smoke-', 'run-v'])[o_orderkey % 3 + 1] || (o_custkey % 40) || '-x' AS run_id, o_totalprice FROM orders), v AS (SELECT CAST(nullif(regexp_extract(run_id, '^(?:eval|run)-v(\d+)-', 1), '') AS INT) AS version, o_totalprice FROM r) SELECT version, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM v WHERE version BETWEEN 18 AND 25 GROUP BY version",
    "followup_resolution": r"WITH c AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '^\S+\s+([0-9A-Za-z_]\S+[0-9A-Za-z_])', 1), '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, (['Where did they meet?', 'Tell me more.', 'What was its aim?', 'Who was there?'])[turn % 4 + 1] AS q FROM conversations) SELECT conv_id, turn, CASE WHEN l IS NULL THEN q WHEN q = 'Tell me more.' THEN 'Tell me more about ' || l || '.' ELSE replace(replace(q, ' they ', ' ' || l || ' '), ' its ', ' ' || l || CASE WHEN ends_with(l, 's') THEN '''' ELSE '''s' END || ' ') END AS resolved FROM c",
    "claim_anchoring": f"WITH RECURSIVE {_SENTENCES}, cl AS (SELECT d.doc_id, text, list_transform(ss[1:5], lambda s, i: CASE WHEN i = 3 THEN 'no such claim' ELSE s END) AS cs FROM sent JOIN documents d ON d.doc_id = sent.doc_id), st AS (SELECT doc_id, text, cs, 0 AS n, 1 AS pos, 0 AS hit FROM cl UNION ALL SELECT doc_id, text, cs, n + 1, CASE WHEN instr(substr(text, pos), cs[n + 1]) > 0 THEN pos + instr(substr(text, pos), cs[n + 1]) - 1 + length(cs[n + 1]) ELSE pos END, CASE WHEN instr(substr(text, pos), cs[n + 1]) > 0 THEN pos + instr(substr(text, pos), cs[n + 1]) - 1 ELSE 0 END FROM st WHERE n < len(cs)) SELECT doc_id, CAST(n - 1 AS INT) AS n, CAST(CASE WHEN hit > 0 THEN hit - 1 END AS INT) AS start, CAST(CASE WHEN hit > 0 THEN hit - 1 + length(cs[n]) END AS INT) AS end, CASE WHEN hit = 0 THEN 'not_found' END AS failure FROM st WHERE n > 0",
    "usage_closure": f"WITH {LEDGER_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS n FROM ledger), b AS (SELECT conversation_id, response_id AS r, CASE WHEN id % 89 = 7 THEN total_tokens + 1 ELSE total_tokens END AS t, cost_nano AS c, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS n FROM ledger WHERE id % 97 <> 5) SELECT CASE WHEN r IS NULL THEN 'missing_checkpoint' WHEN response_id IS NULL THEN 'missing_event' WHEN r <> response_id THEN 'order' WHEN t IS DISTINCT FROM total_tokens OR c IS DISTINCT FROM cost_nano THEN 'fields' WHEN unpriced = 1 THEN 'unpriced' ELSE 'closed' END AS state, count(*) AS n FROM a FULL JOIN b ON a.conversation_id = b.conversation_id AND a.n = b.n GROUP BY 1",
    "requested_lookup": f"WITH RECURSIVE {CHUNKS_SQL}, a(pos, chunk_id) AS (VALUES (0, '3_001'), (1, '0_001'), (2, 'x_001'), (3, '5_001'), (4, '0_001')) SELECT pos, a.chunk_id, sha256(text) AS text_sha256 FROM a LEFT JOIN chunks c ON c.chunk_id = a.chunk_id",
    "exact_id_check": f"WITH RECURSIVE {CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'duplicate' WHEN 2 THEN 'unknown' WHEN 3 THEN 'missing' WHEN 4 THEN CASE WHEN n > 1 THEN 'out_of_order' ELSE 'exact' END ELSE 'exact' END AS result FROM n",
}
