"""Hourly signals of a stream.

The Poisson bootstrap is a sum per (hour, block of replicates), so it is kept as streaming state like
any other sum. When the watermark closes an hour, its block sums come out once and are turned into
intervals. State is hours x blocks rows, whatever the number of posts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as v
from ..functions import combined_signal
from ..operators import bootstrap, tfidf
from ..operators.hourly import draw_key, with_keyword_signal


def _start(window_column: str):
    return F.col(f"{window_column}.start").cast("timestamp_ntz")


def stream_hourly_means(posts: DataFrame) -> DataFrame:
    """Posts and mean lexicon signal of each closed hour (append mode)."""
    hourly = (
        with_keyword_signal(posts)
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.avg("keyword_signal").alias("keyword_signal"), F.count("*").alias("tweet_count"))
    )
    return hourly.select(_start("w").alias("time"), "keyword_signal", "tweet_count")


def stream_block_sums(posts: DataFrame, model: tfidf.TermModel, replicates=v.BOOTSTRAP_REPLICATES) -> DataFrame:
    """Bootstrap block sums of each closed hour (append mode), scored with a stored model."""
    scored = tfidf.score(with_keyword_signal(posts), model)
    scored = scored.select(
        "ts",
        draw_key(scored).alias("tweet_id"),
        "keyword_signal",
        "tfidf_signal",
        combined_signal(F.col("keyword_signal"), F.col("tfidf_signal"), F.col("weight")).alias(
            "combined_signal"
        ),
    )
    lanes = bootstrap.expand_lanes(scored, replicates)
    sums = lanes.groupBy(F.window("ts", "1 hour").alias("w"), "block").agg(*bootstrap.lane_sums())
    names = [c for c in sums.columns if c not in ("w", "block")]
    return sums.select(_start("w").alias("time"), "block", *names)


def closed_hours(blocks: DataFrame, replicates=v.BOOTSTRAP_REPLICATES) -> DataFrame:
    """Signals of hours whose block sums are complete; all blocks of an hour close together."""
    return bootstrap.intervals(blocks, "time", replicates)


def start_signals(
    posts: DataFrame,
    model: tfidf.TermModel,
    path: str,
    checkpoint: str,
    replicates=v.BOOTSTRAP_REPLICATES,
    trigger: dict | None = None,
    finish: Callable[[DataFrame], DataFrame] = lambda signals: signals,
) -> StreamingQuery:
    """Write the signals of closed hours below `path`.

    A batch overwrites its own folder, so a batch repeated after a restart does not duplicate hours.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(closed_hours(batch, replicates)).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return (
        stream_block_sums(posts, model, replicates)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def start_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, by=()) -> StreamingQuery:
    """Append a stream to parquet files with exactly-once file commits."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if by:
        writer = writer.partitionBy(*by)
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
