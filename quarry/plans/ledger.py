"""Ledger queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.operators import ledger as L
from quarry.sources.tables import LEDGER_SQL, ledger, read

MONTH = "2024-01"
BUDGET = 400_000_000_000
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in (*L.TOKENS, "cost_nano", "unpriced")) + ", count(*) AS events"


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.totals(ledger(spark, d))


def usage_by_operation(spark: SparkSession, d: str) -> DataFrame:
    return L.totals(ledger(spark, d), ["operation"]).orderBy(F.desc("cost_nano"), "operation")


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("id", "response_id", "recorded_at", "operation", "cost_nano").orderBy(F.desc("recorded_at"), F.desc("id")).limit(20)


def tracking_started(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).agg(F.min("recorded_at").alias("tracking_started"))


def month_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.totals(L.scoped(ledger(spark, d), month=MONTH, project_id="p3"))


def request_operation_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.operation_counts(ledger(spark, d))


def budget_state(spark: SparkSession, d: str) -> DataFrame:
    return L.budget_state(ledger(spark, d), MONTH, BUDGET, 80)


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """Line items as requests: models by part, tiers by line, some above the long-context threshold."""
    li = read(spark, d, "lineitem")
    names = [p[0] for p in L.PRICES] + ["gpt-5.6-luna-2026-01-01", "unknown"]
    model = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_partkey") % len(names) + 1).cast("int"))
    tier = F.element_at(F.array(F.lit(None).cast("string"), F.lit("default"), F.lit("priority"), F.lit("flex")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    tokens = (F.floor("l_extendedprice") * 5).cast("long")
    return li.select("l_orderkey", "l_linenumber", model.alias("model"), tier.alias("service_tier"), tokens.alias("input_tokens"), F.floor(tokens / 3).alias("cached_tokens"), F.floor(tokens / 7).alias("cache_write_tokens"), F.floor("l_quantity").cast("long").alias("output_tokens"))


def pricing_cost_nano(spark: SparkSession, d: str) -> DataFrame:
    return L.priced(_usage(spark, d)).select("l_orderkey", "l_linenumber", "model", "service_tier", "cost_nano_usd")


def projected_cost(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.lit("gpt-5.6-terra").alias("model"), F.lit("default").alias("service_tier"), F.lit(4096).cast("long").alias("max_output_tokens"))
    return L.projected_cost(docs).select("doc_id", "input_tokens", "projected_nano_usd")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderstatus").alias("strategy"), F.col("o_orderpriority").alias("version"), (F.col("o_custkey") % 50).alias("run"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost_nano"))


def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return L.rollup(_runs(spark, d))


def phase_costs(spark: SparkSession, d: str) -> DataFrame:
    phase = F.substring_index("turn_id", ":", 1).alias("phase")
    return ledger(spark, d).groupBy(phase).agg(F.coalesce(F.sum("cost_nano"), F.lit(0)).cast("long").alias("cost_nano"), F.count("*").alias("events"), F.sum("unpriced").cast("long").alias("unpriced"))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Each fifth event arrives twice, the second time with another amount."""
    e = ledger(spark, d).select("response_id", "id", "operation", "cost_nano")
    return e.withColumn("arrival", F.lit(1)).unionByName(e.filter("id % 5 = 0").withColumns({"arrival": F.lit(2), "cost_nano": F.col("cost_nano") + 1}))


def dedupe_response(spark: SparkSession, d: str) -> DataFrame:
    return L.keep_first(_arrivals(spark, d), "response_id", [F.col("arrival")])


def latest_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    e = ledger(spark, d).select("project_id", "conversation_id", "operation", "recorded_at", "id", "total_tokens")
    return L.keep_latest(e, ["project_id", "conversation_id", "operation"], [F.desc("recorded_at"), F.desc("id")])


def duplicate_response_ids(spark: SparkSession, d: str) -> DataFrame:
    return L.repeated_keys(_arrivals(spark, d), "response_id")


def running_spend(spark: SparkSession, d: str) -> DataFrame:
    """Admission without feedback: spend of a conversation so far against a ceiling, in event order."""
    order = W.partitionBy("conversation_id").orderBy("recorded_at", "id")
    spent = F.coalesce(F.sum("cost_nano").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).cast("long")
    return ledger(spark, d).select("id", "conversation_id", spent.alias("spent_nano"), ((spent <= 2_000_000_000) & (F.col("unpriced") == 0)).alias("admitted"))


def window_offered_load(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a client in the 60 seconds up to each, itself included; one exactly 60 seconds old is gone."""
    us = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    order = W.partitionBy("conversation_id").orderBy("us").rangeBetween(-59_999_999, 0)
    return ledger(spark, d).withColumn("us", us).select("id", "conversation_id", F.count("*").over(order).alias("offered"))


def spend_by_day(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).groupBy(F.date_format("recorded_at", "yyyy-MM-dd").alias("day")).agg(F.coalesce(F.sum("cost_nano"), F.lit(0)).cast("long").alias("cost_nano"), F.count("*").alias("events"))


def cost_null_if_unpriced(spark: SparkSession, d: str) -> DataFrame:
    return L.all_or_nothing_cost(ledger(spark, d), "conversation_id")


def distinct_scopes(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in ("project_id", "conversation_id", "request_id", "turn_id")])


def status_counters(spark: SparkSession, d: str) -> DataFrame:
    e = ledger(spark, d)
    return e.groupBy("operation", F.when(F.col("unpriced") == 1, "unpriced").otherwise("priced").alias("status")).agg(F.count("*").alias("n"))


def row_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the observation table's checks, one row for each rule broken."""
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 640).alias("http_status"), (F.col("value") - 10).alias("duration_ms"), F.when(F.col("event_id") % 29 == 0, " ").otherwise(F.col("event_type")).alias("route"))
    rules = F.array_compact(F.array(
        F.when(~F.col("http_status").between(100, 599), "http_status"), F.when((F.col("duration_ms") < 0) | F.isnan("duration_ms"), "duration_ms"), F.when(F.trim("route") == "", "route")))
    return e.select("event_id", F.explode(rules).alias("rule"))


def usage_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Events written under both provider spellings, without total, or without anything, brought to one form."""
    k = F.get_json_object("props", "$.k")
    usage = F.when(F.col("event_id") % 4 == 0, F.format_string('{"input_tokens": %s, "output_tokens": 3, "input_tokens_details": {"cached_tokens": 2}}', k)).when(F.col("event_id") % 4 == 1, F.format_string('{"prompt_tokens": %s, "completion_tokens": 5, "total_tokens": 1000}', k)).when(F.col("event_id") % 4 == 2, F.lit("{}")).otherwise(F.col("props"))
    return L.normalised_usage(read(spark, d, "events").select("event_id", usage.alias("usage")))


def server_timing(spark: SparkSession, d: str) -> DataFrame:
    v = F.round("value", 2).cast("string")
    header = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("db;dur=1.5, app;dur="), v)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("app;dur="), v, F.lit(", app;dur=2"))).otherwise(F.lit("total;dur=9"))
    return L.server_timing(read(spark, d, "events").select("event_id", F.round("value", 2).alias("value"), header.alias("header"))).select("event_id", (F.col("app_ms") == F.col("value")).alias("equal"))


QUERIES = {f.__name__: f for f in (
    usage_totals, usage_by_operation, recent_events, tracking_started, month_summary, request_operation_counts, budget_state, pricing_cost_nano, projected_cost,
    cost_rollup, phase_costs, dedupe_response, latest_diagnostics, duplicate_response_ids, running_spend, window_offered_load, spend_by_day, cost_null_if_unpriced,
    distinct_scopes, status_counters, row_constraints, usage_normalised, server_timing)}

_ARRIVALS = f"WITH {LEDGER_SQL}, arrivals AS (SELECT response_id, id, operation, cost_nano, 1 AS arrival FROM ledger UNION ALL SELECT response_id, id, operation, cost_nano + 1, 2 FROM ledger WHERE id % 5 = 0)"
_PRICES = "prices(price_model, p_in, p_cached, p_out, x_write, threshold) AS (VALUES " + ", ".join(
    f"('{m}', {a}::DECIMAL(12,4), {b}::DECIMAL(12,4), {c}::DECIMAL(12,4), {x}::DECIMAL(12,4), {t or 'NULL'}::BIGINT)" for m, a, b, c, x, t in L.PRICES) + ")"
_NAMES = ", ".join(f"'{p[0]}'" for p in L.PRICES) + ", 'gpt-5.6-luna-2026-01-01', 'unknown'"


def _cost(source: str) -> str:
    """Common table expressions that end in `cost`, of rows with model, service_tier and token counts."""
    base = "CASE " + " ".join(f"WHEN model LIKE '{n}-%' THEN '{n}'" for n in L.DATED) + " ELSE model END"
    return f"""{_PRICES}, u AS ({source}), p AS (
  SELECT u.*, prices.*, coalesce(input_tokens > threshold, false) AS far FROM u LEFT JOIN prices ON price_model = {base}
), n AS (
  SELECT *, CAST(round((greatest(0, input_tokens - cached_tokens - cache_write_tokens) * p_in * CASE WHEN far THEN 2 ELSE 1 END + cached_tokens * p_cached
    + cache_write_tokens * p_in * x_write * CASE WHEN far THEN 2 ELSE 1 END + output_tokens * p_out * CASE WHEN far THEN 1.5 ELSE 1.0 END)::DECIMAL(38,8) * 1000, 0) AS BIGINT) AS nano FROM p
), cost AS (
  SELECT *, CASE WHEN coalesce(service_tier, 'default') = 'default' THEN nano WHEN service_tier = 'priority' AND (model = 'gpt-5.6-sol' OR model LIKE 'gpt-5.6-sol-%') THEN nano * 2 END AS cost_nano_usd FROM n
)"""


SQL = {
    "usage_totals": f"WITH {LEDGER_SQL} SELECT {_SUMS} FROM ledger",
    "usage_by_operation": f"WITH {LEDGER_SQL} SELECT operation, {_SUMS} FROM ledger GROUP BY operation",
    "recent_events": f"WITH {LEDGER_SQL} SELECT id, response_id, recorded_at, operation, cost_nano FROM ledger ORDER BY recorded_at DESC, id DESC LIMIT 20",
    "tracking_started": f"WITH {LEDGER_SQL} SELECT min(recorded_at) AS tracking_started FROM ledger",
    "month_summary": f"WITH {LEDGER_SQL} SELECT {_SUMS} FROM ledger WHERE project_id = 'p3' AND strftime(recorded_at, '%Y-%m') = '{MONTH}'",
    "request_operation_counts": f"WITH {LEDGER_SQL}, c AS (SELECT request_id, operation, count(*) AS n FROM ledger GROUP BY ALL) SELECT request_id, string_agg(operation || '=' || n, ',' ORDER BY operation || '=' || n) AS operations, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY request_id",
    "budget_state": f"WITH {LEDGER_SQL}, s AS (SELECT CAST(coalesce(sum(cost_nano), 0) AS BIGINT) AS spent_nano FROM ledger WHERE strftime(recorded_at, '%Y-%m') = '{MONTH}'), p AS (SELECT *, round(spent_nano * 100 / {BUDGET}.0, 4) AS percent_used FROM s) SELECT spent_nano, CAST(percent_used AS DOUBLE) AS percent_used, percent_used >= 80 AS warning, percent_used >= 100 AS exceeded, greatest(0, {BUDGET} - spent_nano) AS remaining_nano FROM p",
    "pricing_cost_nano": f"""WITH {_cost(f"SELECT l_orderkey, l_linenumber, ([{_NAMES}])[CAST(l_partkey % {len(L.PRICES) + 2} + 1 AS INT)] AS model, ([NULL, 'default', 'priority', 'flex'])[l_linenumber % 4 + 1] AS service_tier, t AS input_tokens, t // 3 AS cached_tokens, t // 7 AS cache_write_tokens, CAST(floor(l_quantity) AS BIGINT) AS output_tokens FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) * 5 AS t FROM lineitem)")} SELECT l_orderkey, l_linenumber, model, service_tier, cost_nano_usd FROM cost""",
    "projected_cost": f"""WITH {_cost("SELECT doc_id, 'gpt-5.6-terra' AS model, 'default' AS service_tier, strlen(text) + 32768 AS input_tokens, 0 AS cached_tokens, strlen(text) + 32768 AS cache_write_tokens, 4096 AS output_tokens FROM documents")} SELECT doc_id, input_tokens, cost_nano_usd AS projected_nano_usd FROM cost""",
    "cost_rollup": "WITH r AS (SELECT o_orderstatus AS strategy, o_orderpriority AS version, o_custkey % 50 AS run, CAST(round(o_totalprice * 100) AS BIGINT) AS cost_nano FROM orders) SELECT strategy, version, run, CASE grouping(strategy, version, run) WHEN 0 THEN 'run' WHEN 1 THEN 'version' ELSE 'total' END AS level, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, count(*) AS operations, min(version) AS min_version, max(version) AS max_version FROM r GROUP BY GROUPING SETS ((strategy, version, run), (strategy, version), ())",
    "phase_costs": f"WITH {LEDGER_SQL} SELECT split_part(turn_id, ':', 1) AS phase, CAST(coalesce(sum(cost_nano), 0) AS BIGINT) AS cost_nano, count(*) AS events, CAST(sum(unpriced) AS BIGINT) AS unpriced FROM ledger GROUP BY 1",
    "dedupe_response": f"{_ARRIVALS} SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY arrival) = 1",
    "latest_diagnostics": f"WITH {LEDGER_SQL} SELECT project_id, conversation_id, operation, recorded_at, id, total_tokens FROM ledger QUALIFY row_number() OVER (PARTITION BY project_id, conversation_id, operation ORDER BY recorded_at DESC, id DESC) = 1",
    "duplicate_response_ids": f"{_ARRIVALS} SELECT response_id, count(*) AS copies FROM arrivals GROUP BY 1 HAVING count(*) > 1",
    "running_spend": f"WITH {LEDGER_SQL}, s AS (SELECT *, CAST(coalesce(sum(cost_nano) OVER (PARTITION BY conversation_id ORDER BY recorded_at, id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS spent_nano FROM ledger) SELECT id, conversation_id, spent_nano, spent_nano <= 2000000000 AND unpriced = 0 AS admitted FROM s",
    "window_offered_load": f"WITH {LEDGER_SQL} SELECT id, conversation_id, count(*) OVER (PARTITION BY conversation_id ORDER BY epoch_us(recorded_at) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS offered FROM ledger",
    "spend_by_day": f"WITH {LEDGER_SQL} SELECT strftime(recorded_at, '%Y-%m-%d') AS day, CAST(coalesce(sum(cost_nano), 0) AS BIGINT) AS cost_nano, count(*) AS events FROM ledger GROUP BY 1",
    "cost_null_if_unpriced": f"WITH {LEDGER_SQL} SELECT conversation_id, CAST(CASE WHEN sum(unpriced) = 0 THEN sum(cost_nano) END AS BIGINT) AS cost_nano, count(*) AS events FROM ledger GROUP BY 1",
    "distinct_scopes": f"WITH {LEDGER_SQL} SELECT count(DISTINCT project_id) AS n_project_id, count(DISTINCT conversation_id) AS n_conversation_id, count(DISTINCT request_id) AS n_request_id, count(DISTINCT turn_id) AS n_turn_id FROM ledger",
    "status_counters": f"WITH {LEDGER_SQL} SELECT operation, CASE WHEN unpriced = 1 THEN 'unpriced' ELSE 'priced' END AS status, count(*) AS n FROM ledger GROUP BY 1, 2",
    "row_constraints": "WITH e AS (SELECT event_id, event_id % 640 AS s, value - 10 AS ms, CASE WHEN event_id % 29 = 0 THEN ' ' ELSE event_type END AS route FROM events) SELECT event_id, 'http_status' AS rule FROM e WHERE s NOT BETWEEN 100 AND 599 UNION ALL SELECT event_id, 'duration_ms' FROM e WHERE ms < 0 OR isnan(ms) UNION ALL SELECT event_id, 'route' FROM e WHERE trim(route) = ''",
    "usage_normalised": "WITH k AS (SELECT event_id, event_id % 4 AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN m < 2 THEN k END AS input_tokens, CASE m WHEN 0 THEN 3 WHEN 1 THEN 5 END::BIGINT AS output_tokens, CASE m WHEN 0 THEN 2 WHEN 1 THEN 0 END::BIGINT AS cached_tokens, CASE m WHEN 0 THEN k + 3 WHEN 1 THEN 1000 END AS total_tokens FROM k",
    "server_timing": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true END AS equal FROM events",
}
