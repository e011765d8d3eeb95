"""Cost and usage ledger: filtered totals, rollups, budgets, idempotent ingest. Integers of nano-USD throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TOKENS = ("input_tokens", "cached_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "total_tokens")

#: Prices in USD a million tokens: input, cached input, output, cache-write multiplier, long-context threshold (fixed values).
PRICES = (
    ("gpt-5", "1.25", "0.125", "10", "1", None),
    ("gpt-5-2025-08-07", "1.25", "0.125", "10", "1", None),
    ("gpt-5.6", "5", "0.50", "30", "1.25", 272000),
    ("gpt-5.6-sol", "5", "0.50", "30", "1.25", 272000),
    ("gpt-5.6-terra", "2.50", "0.25", "15", "1.25", 272000),
    ("gpt-5.6-luna", "1", "0.10", "6", "1.25", 272000),
    ("text-embedding-3-small", "0.02", "0.02", "0", "1", None),
    ("text-embedding-3-large", "0.13", "0.13", "0", "1", None),
)
#: Dated names of these variants have the variant's price (fixed values).
DATED = ("gpt-5.6-sol", "gpt-5.6-terra", "gpt-5.6-luna")
#: One byte is at most one token; this much more covers fields and schema (fixed value).
REQUEST_OVERHEAD_TOKENS = 32768


def scoped(ledger: DataFrame, *, month: str | None = None, **equal: str | None) -> DataFrame:
    """Rows of a month (yyyy-MM) and of every scope column that is given."""
    for name, value in equal.items():
        if value is not None:
            ledger = ledger.filter(F.col(name) == value)
    return ledger if month is None else ledger.filter(F.date_format("recorded_at", "yyyy-MM") == month)


def totals(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Token sums, cost, events and unpriced events; sums of nothing are 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*TOKENS, "cost_nano", "unpriced")]
    return ledger.groupBy(*(by or [])).agg(*sums, F.count("*").alias("events"))


def operation_counts(ledger: DataFrame) -> DataFrame:
    """request_id and a map of operation to events, as sorted `operation=n` text."""
    each = ledger.groupBy("request_id", "operation").agg(F.count("*").alias("n"))
    pair = F.concat_ws("=", "operation", F.col("n").cast("string"))
    return each.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("operations"), F.sum("n").cast("long").alias("events"))


def budget_state(ledger: DataFrame, month: str, budget_nano: int | None, warn_percent: int) -> DataFrame:
    """Spend of the month against a budget; percent to four places, half up; nothing is known without a budget."""
    spent = scoped(ledger, month=month).agg(F.coalesce(F.sum("cost_nano"), F.lit(0)).cast("long").alias("spent_nano"))
    if budget_nano is None:
        none = F.lit(None)
        return spent.select("spent_nano", none.cast("double").alias("percent_used"), F.lit(False).alias("warning"), F.lit(False).alias("exceeded"), none.cast("long").alias("remaining_nano"))
    percent = F.round(F.col("spent_nano").cast("decimal(28,0)") * 100 / F.lit(budget_nano).cast("decimal(20,0)"), 4).cast("double")
    left = F.greatest(F.lit(0).cast("long"), F.lit(budget_nano).cast("long") - F.col("spent_nano"))
    return spent.withColumn("percent_used", percent).select("spent_nano", "percent_used", (F.col("percent_used") >= warn_percent).alias("warning"), (F.col("percent_used") >= 100).alias("exceeded"), left.alias("remaining_nano"))


def price_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([list(p) for p in PRICES], "price_model string, p_in string, p_cached string, p_out string, x_write string, threshold long")
    return rows.select("price_model", *[F.col(c).cast("decimal(12,4)").alias(c) for c in ("p_in", "p_cached", "p_out", "x_write")], "threshold")


def priced(usage: DataFrame) -> DataFrame:
    """usage: model, service_tier, token counts. Adds cost_nano_usd, null where the model or tier has no price.

    The price table is a handful of literal rows, so it is broadcast.
    """
    base = F.col("model")
    for name in DATED:
        base = F.when(F.col("model").startswith(f"{name}-"), F.lit(name)).otherwise(base)
    p = usage.withColumn("price_model", base).join(F.broadcast(price_table(usage.sparkSession)), "price_model", "left")
    long_context = F.coalesce(F.col("input_tokens") > F.col("threshold"), F.lit(False))
    times = lambda factor: F.when(long_context, F.lit(factor)).otherwise(F.lit("1")).cast("decimal(4,1)")
    count = lambda c: F.col(c).cast("decimal(14,0)")
    plain = F.greatest(F.lit(0).cast("long"), F.col("input_tokens") - F.col("cached_tokens") - F.col("cache_write_tokens")).cast("decimal(14,0)")
    micro = plain * (F.col("p_in") * times("2")) + count("cached_tokens") * F.col("p_cached") + count("cache_write_tokens") * (F.col("p_in") * F.col("x_write") * times("2")) + count("output_tokens") * (F.col("p_out") * times("1.5"))
    nano = F.round(micro * 1000, 0).cast("long")
    tier = F.coalesce("service_tier", F.lit("default"))
    fast = (tier == "priority") & ((F.col("model") == "gpt-5.6-sol") | F.col("model").startswith("gpt-5.6-sol-"))
    cost = F.when(tier == "default", nano).when(fast, nano * 2)
    return p.withColumn("cost_nano_usd", cost).drop("price_model", "p_in", "p_cached", "p_out", "x_write", "threshold")


def projected_cost(requests: DataFrame) -> DataFrame:
    """Upper bound of a request's cost before it is sent: a token for each byte and an overhead, all written to the cache."""
    tokens = (F.octet_length("prompt") + REQUEST_OVERHEAD_TOKENS).cast("long")
    usage = requests.withColumns({"input_tokens": tokens, "cached_tokens": F.lit(0).cast("long"), "cache_write_tokens": tokens, "output_tokens": F.col("max_output_tokens").cast("long")})
    return priced(usage).withColumnRenamed("cost_nano_usd", "projected_nano_usd").drop("cached_tokens", "cache_write_tokens")


def rollup(costs: DataFrame) -> DataFrame:
    """costs: strategy, version, run, cost_nano. Runs, versions and the grand total in one pass, by grouping sets."""
    level = F.when(F.grouping_id("strategy", "version", "run") == 0, "run").when(F.grouping_id("strategy", "version", "run") == 1, "version").otherwise("total")
    sets = [[F.col("strategy"), F.col("version"), F.col("run")], [F.col("strategy"), F.col("version")], []]
    return costs.groupingSets(sets, "strategy", "version", "run").agg(level.alias("level"), F.sum("cost_nano").cast("long").alias("cost_nano"), F.count("*").alias("operations"), F.min("version").alias("min_version"), F.max("version").alias("max_version"))


def keep_first(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Idempotent append: the first arrival of a key stays, later ones are ignored."""
    return events.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def keep_latest(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: the latest row of a key wins."""
    return events.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def repeated_keys(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def all_or_nothing_cost(events: DataFrame, by: str) -> DataFrame:
    """Cost of a group, null as soon as one event is unpriced."""
    return events.groupBy(by).agg(F.when(F.sum("unpriced") == 0, F.sum("cost_nano")).cast("long").alias("cost_nano"), F.count("*").alias("events"))


def normalised_usage(raw: DataFrame) -> DataFrame:
    """usage (JSON under either provider spelling) as token counts: total is the sum where it is absent; nothing known is null."""
    pick = lambda *names: F.coalesce(*[F.get_json_object("usage", f"$.{n}").cast("long") for n in names])
    out = raw.withColumns({
        "input_tokens": pick("input_tokens", "prompt_tokens"),
        "output_tokens": pick("output_tokens", "completion_tokens"),
        "cached_tokens": pick("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"),
        "given_total": pick("total_tokens"),
    })
    known = F.coalesce("input_tokens", "output_tokens", "given_total").isNotNull()
    both = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    zero = lambda c: F.when(known, F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return out.select(*[c for c in raw.columns if c != "usage"], zero("input_tokens"), zero("output_tokens"), zero("cached_tokens"), F.when(known, F.coalesce("given_total", both)).cast("long").alias("total_tokens"))


def server_timing(rows: DataFrame) -> DataFrame:
    """app_ms of a Server-Timing header: the value if exactly one finite `app;dur=` is there."""
    found = F.regexp_extract_all("header", F.lit(r"(?:^|,)\s*app;dur=([0-9]+(?:\.[0-9]+)?)\s*(?=,|$)"), 1)
    return rows.withColumn("app_ms", F.when(F.size(found) == 1, found[0].cast("double")))
