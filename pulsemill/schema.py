"""Table schemas and the tolerant projection onto them."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

TAGS = ArrayType(StringType())


def _struct(*fields):
    return StructType([StructField(name, kind, True) for name, kind in fields])


# As landed by a collector: text only, cast later, so that one bad cell never changes a column's type.
RAW_POST = _struct(
    ("tweet_id", StringType()),
    ("username", StringType()),
    ("handle", StringType()),
    ("timestamp_utc", StringType()),
    ("content", StringType()),
    ("like_count", StringType()),
    ("retweet_count", StringType()),
    ("reply_count", StringType()),
    ("hashtags", StringType()),
    ("mentions", StringType()),
    ("url", StringType()),
    ("query", StringType()),
)

CLEAN_POST = _struct(
    ("tweet_id", StringType()),
    ("username", StringType()),
    ("handle", StringType()),
    ("timestamp_utc", StringType()),
    ("ts", TimestampType()),
    ("content", StringType()),
    ("like_count", LongType()),
    ("retweet_count", LongType()),
    ("reply_count", LongType()),
    ("hashtags", TAGS),
    ("mentions", TAGS),
    ("hashtags_json", StringType()),
    ("mentions_json", StringType()),
    ("url", StringType()),
    ("query", StringType()),
    ("date", DateType()),
)

PAGE = _struct(("page_id", LongType()), ("url", StringType()), ("html", StringType()))

METRICS = ("keyword", "tfidf", "combined")

HOURLY_SIGNAL = _struct(
    ("time", TimestampNTZType()),
    *[
        (f"{metric}_{part}", DoubleType())
        for metric in METRICS
        for part in ("signal", "ci_low", "ci_high")
    ],
    ("tweet_count", LongType()),
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the schema's columns in order; a missing one becomes a typed NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
