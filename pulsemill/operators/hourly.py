"""Hourly series."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as v
from ..functions import (
    combined_signal,
    engagement_weight,
    hour_start,
    keyword_signal,
    lexicon_polarity,
)
from ..schema import METRICS
from ..session import cut_lineage
from . import bootstrap, tfidf

def with_keyword_signal(posts: DataFrame) -> DataFrame:
    """Add `sentiment`, `weight` and `keyword_signal`."""
    return posts.withColumns(
        {
            "sentiment": lexicon_polarity(F.col("content")),
            "weight": engagement_weight(F.col("like_count"), F.col("retweet_count"), F.col("reply_count")),
        }
    ).withColumn("keyword_signal", keyword_signal(F.col("sentiment"), F.col("weight")))


def draw_key(posts: DataFrame) -> Column:
    """What a post's bootstrap counts are drawn from: id, else address, else a hash of text and time."""
    blank = F.lit("")
    named = [F.nullif(F.col(c).cast("string"), blank) for c in ("tweet_id", "url") if c in posts.columns]
    return F.coalesce(*named, F.xxhash64("content", "ts").cast("string"))


def score_posts(posts: DataFrame, model: tfidf.TermModel) -> DataFrame:
    """`(time, tweet_id, ts, three signals)`: everything an hourly series needs, without the text.

    A blank id is replaced, see `draw_key`.
    """
    scored = tfidf.score(with_keyword_signal(posts.where(F.col("ts").isNotNull())), model)
    return scored.select(
        hour_start(F.col("ts")).alias("time"),
        draw_key(scored).alias("tweet_id"),
        "ts",
        "keyword_signal",
        "tfidf_signal",
        combined_signal(F.col("keyword_signal"), F.col("tfidf_signal"), F.col("weight")).alias(
            "combined_signal"
        ),
    )


def hourly_keyword(posts: DataFrame) -> DataFrame:
    """Posts and mean lexicon signal per hour."""
    scored = with_keyword_signal(posts.where(F.col("ts").isNotNull()))
    return scored.groupBy(hour_start(F.col("ts")).alias("time")).agg(
        F.avg("keyword_signal").alias("keyword_signal"), F.count("*").alias("tweet_count")
    )


def hourly_signals(scored: DataFrame, replicates=v.BOOTSTRAP_REPLICATES, **options) -> DataFrame:
    """Mean and interval of each signal per hour that has posts."""
    return bootstrap.poisson_intervals(scored, by="time", replicates=replicates, **options)


def dense_hours(hourly: DataFrame, count="tweet_count") -> DataFrame:
    """Every hour from the first to the last; one without posts has count 0 and NULL signals.

    The series is worked out once and stored; hours are a range that Spark splits, however far apart the ends are.
    """
    spark = hourly.sparkSession
    stored = cut_lineage(hourly, "hourly")
    first, n = stored.agg(F.min("time").cast("string"), F.timestamp_diff("HOUR", F.min("time"), F.max("time")) + 1).first()
    start = F.lit(first).cast("timestamp_ntz")
    hours = spark.range(n or 0).select(F.timestamp_add("HOUR", F.col("id").cast("int"), start).alias("time"))
    filled = hours.join(stored, "time", "left")
    return filled.withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("bigint")))


def long_form(hourly: DataFrame) -> DataFrame:
    """One row per hour and metric: `(time, metric, value, ci_low, ci_high)`."""
    parts = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}_signal").alias("value"),
            F.col(f"{m}_ci_low").alias("ci_low"),
            F.col(f"{m}_ci_high").alias("ci_high"),
        )
        for m in METRICS
    ]
    return hourly.select("time", F.explode(F.array(*parts)).alias("p")).select("time", "p.*")
