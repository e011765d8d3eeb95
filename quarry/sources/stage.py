"""Tables that a plan reads more than once, written to shared storage: a short lineage that outlives executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, the warehouse, which executors share too;
    a temporary folder only in local mode, where driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.startswith("local"):
            where = "file://" + tempfile.mkdtemp(prefix="quarry-")
        else:
            where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quarry-work"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        place, files = _path(spark, path)
        files.delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; the files go when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `label`, derived from `tables` of sf_dir, written at its first use in an application (a cached scan).

    It is made anew where one of the tables was modified since, or where its files are gone.
    """
    stamps = []
    for name in tables:
        place, files = _path(spark, f"{sf_dir}/{name}.parquet")
        stamps.append(files.getFileStatus(place).getModificationTime())
    key = (spark.sparkContext.applicationId, sf_dir, label, *stamps)
    if (df := _kept.get(key)) is not None:
        place, files = _path(spark, df.inputFiles()[0] if df.inputFiles() else "file:///none")
        if df.inputFiles() and not files.exists(place):
            df = None
    if df is None:
        df = _kept[key] = written(make(), label)
    return df
