"""Landed batches to one table of new, acceptable posts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as fn
from ..operators import dedup, quality


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Batches of one run; columns are matched by name and a missing one is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def label_batch(batch: DataFrame, query: str, order: int) -> DataFrame:
    return batch.withColumns({"query": F.lit(query), "query_ord": F.lit(order)})


def accept_posts(landed: DataFrame, as_of: Column, hours: int = 24 * 7) -> DataFrame:
    """Recent posts that pass the quality rules; the first query to find a post keeps it."""
    posts = landed.withColumn("ts", fn.parse_instant(F.col("timestamp_utc")))
    return dedup.first_query_wins(quality.quality_filter(quality.recent_posts(posts, as_of, hours)))


def merge_batches(batches: list[DataFrame], as_of: Column, hours: int = 24) -> DataFrame:
    """First arrival per id and address, then recency; the helper column is dropped again."""
    merged = dedup.first_per_id_then_url(union_batches(batches))
    dated = merged.withColumn("_ts", fn.coerce_instant(F.col("timestamp_utc")))
    return dated.where(quality.is_recent(F.col("_ts"), as_of, hours)).drop("_ts")
