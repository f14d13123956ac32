"""Keep-first deduplication.

Every variant is `row_number() = 1` over a key. Spark turns that into a per-task group limit
before the shuffle, so of a key that holds a third of all rows each map task sends one row.

Of rows that lie in parquet files, `fetch_late` decides on narrow rows and fetches the texts of those that won.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


# File and row number there: together they identify a stored row.
POSITION = ("_file", "_row")


def with_position(stored: DataFrame) -> DataFrame:
    """Rows as read from parquet (filtered or projected at most), with their POSITION."""
    return stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


# Rows of a file that share one bitmap, as `bitmap_construct_agg` has it.
_MARKS = 15


def _marks(won: DataFrame) -> DataFrame:
    """Positions as bitmaps: a bit for each row of a file, up to the last that won."""
    place = F.col("_row").bitwiseAND(F.lit((1 << _MARKS) - 1))
    marks = won.groupBy("_file", F.shiftright("_row", _MARKS).alias("_part")).agg(
        F.bitmap_construct_agg(place).alias("_bits"), F.max(place).alias("_last")
    )
    return marks.select("_file", "_part", F.expr("substring(_bits, 1, cast(_last div 8 + 1 AS int))").alias("_bits"))


def fetch_late(placed: DataFrame, choose: Callable[[DataFrame], DataFrame], marked: bool = False) -> DataFrame:
    """The rows that `choose` keeps of rows with a POSITION, without it.

    `choose` runs on what it compares alone, since only the positions of its rows are asked for. Whole rows then move
    once, to meet the positions that won, or not at all where Spark finds these small enough to send round. With
    `marked` the positions are always sent round, as bitmaps of one bit a stored row, and whole rows never move. The
    files are read twice. NULL keys, ties and repeated rows are as `choose` treats them; an empty table stays empty.
    """
    won = choose(placed).select(*POSITION)
    if marked:
        met = placed.withColumn("_part", F.shiftright("_row", _MARKS)).join(F.broadcast(_marks(won)), ["_file", "_part"])
        # Past the end of a bitmap there is no bit.
        byte = F.expr(f"conv(hex(substring(_bits, cast((_row & {(1 << _MARKS) - 1}) div 8 + 1 AS int), 1)), 16, 10)")
        held = F.expr("shiftright(_byte, cast(_row & 7 AS int)) & 1") == 1
        return met.withColumn("_byte", byte.cast("int")).where(held).select(*[c for c in placed.columns if c not in POSITION])
    return placed.join(won, list(POSITION), "left_semi").drop(*POSITION)


def keep_first(df: DataFrame, key, order, null_keys: str = "merge") -> DataFrame:
    """One row per key: the first in `order`.

    NULL keys are equal to each other under "merge" (one survives); under "keep" all survive.
    """
    if null_keys not in ("merge", "keep"):
        raise ValueError(f"unknown null_keys: {null_keys}")
    key = F.col(key) if isinstance(key, str) else key
    ranked = df.where(key.isNotNull()) if null_keys == "keep" else df
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = ranked.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    return first.unionByName(df.where(key.isNull())) if null_keys == "keep" else first


def row_tie(df: DataFrame) -> Column:
    """A last tie-breaker that depends on the row's values alone."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in POSITION])


def _per_id_then_url(df: DataFrame, order: list, null_keys: str) -> DataFrame:
    """The first row per `tweet_id`, then of those the first per `url`; equal rows that have a POSITION by this."""
    order = [*order, *[F.col(c).asc() for c in POSITION if c in df.columns]]
    return keep_first(keep_first(df, "tweet_id", order, null_keys), "url", order, null_keys)


def _tied(df: DataFrame) -> DataFrame:
    """With the tie-breaker as a column, so that later steps need not carry what it is made of."""
    return df.withColumn("_tie", row_tie(df))


def latest_per_id_then_url(df: DataFrame, tie=None, null_keys: str = "merge") -> DataFrame:
    """The newest row per `tweet_id`, then of those the newest per `url`."""
    newest = F.col("ts").desc()
    if tie:
        return _per_id_then_url(df, [newest, *tie], null_keys)
    return _per_id_then_url(_tied(df), [newest, F.col("tweet_id").asc(), F.col("_tie").asc()], null_keys).drop("_tie")


def first_per_id_then_url(df: DataFrame, arrival="seq", null_keys: str = "merge") -> DataFrame:
    """The first to arrive per `tweet_id`, then per `url`."""
    return _per_id_then_url(_tied(df), [F.col(arrival).asc(), F.col("_tie").asc()], null_keys).drop("_tie")


def identity_key() -> Column:
    """Id, else address, else text and time: the first that is not blank."""
    blank = F.lit("")
    return F.coalesce(
        F.nullif(F.col("tweet_id"), blank),
        F.nullif(F.col("url"), blank),
        F.concat(F.coalesce("content", blank), F.coalesce("timestamp_utc", blank)),
    )


def first_per_identity(df: DataFrame, arrival="seq") -> DataFrame:
    return keep_first(df, identity_key(), [F.col(arrival).asc(), row_tie(df).asc()])


def first_query_wins(df: DataFrame, query_order="query_ord", arrival="seq") -> DataFrame:
    """One row per `tweet_id` over all queries: the earliest query, then the earliest arrival."""
    order = [F.col(query_order).asc(), F.col(arrival).asc(), row_tie(df).asc()]
    return keep_first(df, "tweet_id", order)


def unseen_posts(incoming: DataFrame, stored: DataFrame, key="tweet_id") -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(key), key, "left_anti")
