"""Counts and reports over post tables."""

from pyspark.sql import DataFrame, Observation, functions as F


def posts_per_date(posts: DataFrame) -> DataFrame:
    return posts.groupBy("date").agg(F.count("*").alias("posts"))


def tag_coverage(posts: DataFrame) -> DataFrame:
    """Posts, posts with hashtags, posts with mentions and mean likes, in one row."""
    return posts.agg(
        F.count("*").alias("posts"),
        F.count_if(F.size("hashtags") > 0).alias("with_hashtags"),
        F.count_if(F.size("mentions") > 0).alias("with_mentions"),
        F.avg("like_count").alias("mean_likes"),
    )


def top_hashtags(posts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent hashtags, case kept, repeats in one post counted; ties by tag."""
    tags = posts.select(F.explode("hashtags").alias("hashtag"))
    counts = tags.groupBy("hashtag").agg(F.count("*").alias("uses"))
    return counts.orderBy(F.desc("uses"), F.asc("hashtag")).limit(k)


def approx_top_hashtags(posts: DataFrame, k: int = 10) -> DataFrame:
    """Same from a sketch of fixed size, for tag sets too large to count exactly."""
    tags = posts.select(F.explode("hashtags").alias("hashtag"))
    top = tags.agg(F.expr(f"approx_top_k(hashtag, {int(k)})").alias("top"))
    row = top.select(F.explode("top").alias("t"))
    return row.select(F.col("t.item").alias("hashtag"), F.col("t.count").alias("uses"))


def query_rate(posts: DataFrame, seen_at="ingested_at") -> DataFrame:
    """Posts and posts per minute for each query and, under '(all)', for the whole run.

    Whole seconds are counted; a query lasts at least one second and a run at least one minute.
    """
    per_query = posts.groupBy("query").agg(
        F.count("*").alias("n"), F.min(seen_at).alias("first"), F.max(seen_at).alias("last")
    )
    spans = per_query.rollup("query").agg(
        F.grouping("query").alias("whole_run"),
        F.sum("n").alias("posts"),
        ((F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))) / F.lit(1e6))
        .cast("bigint")
        .alias("seconds"),
    )
    whole = F.col("whole_run") == 1
    minutes = F.greatest("seconds", F.when(whole, 60).otherwise(1)) / F.lit(60.0)
    return spans.select(
        F.when(whole, "(all)").otherwise(F.col("query")).alias("query"),
        "posts",
        "seconds",
        (F.col("posts") / minutes).alias("posts_per_minute"),
    )


def newest_posts(posts: DataFrame, n: int) -> DataFrame:
    """Exactly the n newest posts, newest first."""
    return posts.orderBy(F.desc("ts"), F.asc("tweet_id")).limit(n)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, counted while some later action runs: no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
