"""Structured Streaming forms of the ledger's online behaviours. They extend the batch operators; results agree with them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.tables import upsert_latest


def first_arrivals(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Idempotent append: an event id that comes again within the delay is ignored."""
    return events.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["response_id"])


def spend_by_window(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Cost and events of each operation and window; a window is final once the watermark has passed it."""
    w = events.withWatermark("recorded_at", delay).groupBy(F.window("recorded_at", width), "operation")
    return w.agg(F.coalesce(F.sum("cost_nano"), F.lit(0)).cast("long").alias("cost_nano"), F.count("*").alias("events")).select(F.col("window.start").alias("start"), "operation", "cost_nano", "events")


def upsert_into(path: str, keys: list[str], version: str):
    """A function for foreachBatch: the latest row of each key, kept under path, a folder for each batch.

    A batch that is run again after a failure writes its folder anew from the same predecessor.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.withColumn("__batch", F.lit(number))
        if number:
            newest = upsert_latest(spark.read.parquet(f"{path}/{number - 1}"), newest, keys, version)
        else:
            newest = upsert_latest(newest.limit(0), newest, keys, version)
        newest.write.mode("overwrite").parquet(f"{path}/{number}")

    return write


def rate_gate(requests: DataFrame, limit: int, delay: str = "2 minutes") -> DataFrame:
    """id, client, admitted: at most `limit` admitted requests of a client in any 60 seconds; refused ones don't count.

    requests: id, client, at (seconds), ts (timestamp). State is the times admitted within the last minute, at most `limit`; requests
    of a micro-batch are taken in time order.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for i, at in zip(rows["id"].tolist(), rows["at"].tolist(), strict=True):
            held = [t for t in held if t > at - 60]
            ok = len(held) < limit
            if ok:
                held.append(at)
            out.append((i, key[0], ok))
        state.update((held,))
        state.setTimeoutDuration(120_000)
        yield pd.DataFrame(out, columns=["id", "client", "admitted"])

    return requests.groupBy("client").applyInPandasWithState(step, "id long, client string, admitted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
