"""Helpers that the operators of this subpackage share: tables, shared storage, Arrow batch size."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.stage import shared_dir
from quarry.sources.tables import read, texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return texts(spark, sf_dir, name) if name == "documents" else read(spark, sf_dir, name)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: short lineage that outlives executors.

    The files go when the driver's process ends, since a lazily read result may still need them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    # the shuffle files of this write aren't needed after it, since its table is in shared storage
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, since one row holds a whole text; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator's results or working columns (leading __) would clash with, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone and not c.startswith("__")])


def partitions_for(total_bytes: int, each: int = 32 << 20, least: int = 1) -> int:
    return max(least, -(-int(total_bytes) // each))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of words keep their lower-case form, all others become blanks (fixed values of the word rule).
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def byte_words(text: str | None) -> list[bytes]:
    """Words of digits, lower-cased ASCII letters and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []
