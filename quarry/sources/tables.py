"""Readers of the engine's tables, and of files in other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, where its files have fewer splits than there are cores: such a table is small, and one task
    would do the work of all. Tables of many splits are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows take work: whole texts."""
    return spread(read(spark, sf_dir, name))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage ledger: one row for each priced or unpriced event. Money is in nano-USD, integers throughout."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    unpriced = F.col("event_id") % 17 == 0
    e = e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("resp-"), F.col("event_id")).alias("response_id"),
        F.col("ts").alias("recorded_at"),
        F.col("event_type").alias("operation"),
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("project_id"),
        F.concat(F.lit("c"), F.col("user_id")).alias("conversation_id"),
        F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("turn_id"),
        F.concat(F.lit("q"), F.floor(F.col("event_id") / 3)).alias("request_id"),
        (k - F.floor(k / 3)).alias("input_tokens"),
        F.floor(k / 3).alias("output_tokens"),
        k.alias("total_tokens"),
        F.when(~unpriced, F.round(F.col("value") * 1000000).cast("long")).alias("cost_nano"),
        unpriced.cast("int").alias("unpriced"),
    )
    return e.withColumns({
        "cached_tokens": F.floor(F.col("input_tokens") / 4),
        "cache_write_tokens": F.floor(F.col("input_tokens") / 10),
        "reasoning_tokens": F.floor(F.col("output_tokens") / 2),
    })


#: The same view for DuckDB.
LEDGER_SQL = """
ledger0 AS (
  SELECT event_id AS id, 'resp-' || event_id AS response_id, ts AS recorded_at, event_type AS operation, 'p' || (user_id % 5) AS project_id,
         'c' || user_id AS conversation_id, event_type || ':' || event_id AS turn_id, 'q' || (event_id // 3) AS request_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens,
         CASE WHEN event_id % 17 <> 0 THEN CAST(round(value * 1000000) AS BIGINT) END AS cost_nano, CAST(event_id % 17 = 0 AS INT) AS unpriced
  FROM events
), ledger1 AS (SELECT *, total_tokens - total_tokens // 3 AS input_tokens, total_tokens // 3 AS output_tokens FROM ledger0
), ledger AS (SELECT *, input_tokens // 4 AS cached_tokens, input_tokens // 10 AS cache_write_tokens, output_tokens // 2 AS reasoning_tokens FROM ledger1)
"""


def text_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """document (file name) and whole text, one row for each file; ordinal by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return decoded(files.select(name.alias("document"), "content"))


def decoded(files: DataFrame) -> DataFrame:
    """content (binary) as text: UTF-8 with or without mark, UTF-16 with mark, else Windows-1252.

    All in built-in functions: a byte order mark decides, then validity as UTF-8.
    """
    mark = F.hex(F.substring("content", 1, 3))
    utf16 = mark.startswith("FFFE") | mark.startswith("FEFF")
    body = F.when(mark == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    strict = F.try_validate_utf8(body.cast("string"))
    # Windows-1252 is Latin-1 but for 27 characters between U+0080 and U+009F
    high = [(bytes([b]).decode("latin-1"), c) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))]
    western = F.translate(F.decode("content", "ISO-8859-1"), "".join(a for a, _ in high), "".join(c for _, c in high))
    text = F.when(utf16, F.decode("content", "UTF-16")).otherwise(F.coalesce(strict, western))
    return files.withColumn("text", text).drop("content")


def save(df: DataFrame, path: str) -> None:
    """Parquet that never replaces what is there."""
    df.write.mode("errorifexists").parquet(path)


def upsert_latest(existing: DataFrame, arriving: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both by key, the latest version winning; on equal versions the arriving row."""
    from pyspark.sql.window import Window as W

    both = existing.withColumn("__new", F.lit(0)).unionByName(arriving.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__new")
