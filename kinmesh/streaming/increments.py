"""Structured Streaming around the batch operators: new records are cleaned and counted as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmesh.functions import text


def cleaned(stream: DataFrame, name: str) -> DataFrame:
    """A stream with the cleaned name and its legal forms; the same expressions as in batch."""
    full = text.clean_full_name(F.col(name))
    return stream.withColumn("_c", full).withColumn("clean_name", text.without_legal_ids(F.col("_c"))).withColumn("firm_legal_id", text.legal_ids(F.col("_c"))).drop("_c")


def arrivals(stream: DataFrame, at: str, *by: str, window: str = "30 days", late: str = "60 days") -> DataFrame:
    """Rows per window and key; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n"))


def once_each(stream: DataFrame, key: str, at: str, late: str = "60 days") -> DataFrame:
    """Rows delivered again within the bound are dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def into_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, all_at_once: bool = True) -> StreamingQuery:
    """Hands every micro-batch to a batch operator, with a checkpoint so that each batch is handled once."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if all_at_once else w).start()
