"""Streams: hits that come in over time. Addresses that were seen are dropped, and responses in the cache live for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def new_addresses(hits: DataFrame, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """hits(qid, url, ts) without addresses that the same question had within the time; late rows are dropped by the watermark."""
    keyed = hits.withColumn("key", urls.normalize(F.col("url"))).withWatermark(ts, within)
    return keyed.dropDuplicatesWithinWatermark(["qid", "key"])


def engine_activity(hits: DataFrame, ts: str = "ts", window: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Hits and addresses of each engine in windows of event time."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return hits.withWatermark(ts, late).groupBy(span, "engine_id").agg(F.count(F.lit(1)).alias("hits"), F.approx_count_distinct("url").alias("addresses")).select("window.start", "window.end", "engine_id", "hits", "addresses")
