"""Posts derived from the `events` and `documents` test tables.

An event becomes a post: the whole text of a document, a market phrase that depends on the event
type, a hashtag and a mention. Some ids and addresses repeat. The SQL twin is in checks/oracle.py.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import use_utc

PHRASES = {
    "purchase": " buy nifty options breakout",
    "error": " sensex crash panic today",
    "click": " bullish #nifty50",
    "signup": " join channel t.me/x",
}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shifted(every: int, at: int) -> Column:
    event = F.col("event_id")
    return event - F.when(event % every == at, 1).otherwise(0)


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed posts with `ts`, `date` and the arrival number `seq`."""
    use_utc(spark)
    documents = _table(spark, sf_dir, "documents")
    size = documents.agg(F.count("*").alias("n")).scalar()
    # A shuffled join deals both sides by doc_id anyway. Done here, a broadcast join too runs on all cores where the
    # tables are one file each. Ids leave remainders evenly, so no part is hot.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = _table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % size).repartition(parts, "doc_id")
    kind = F.col("event_type")
    phrase = F.coalesce(*[F.when(kind == k, p) for k, p in PHRASES.items()], F.lit(""))
    user = F.concat(F.lit("@u"), F.col("user_id").cast("string"))
    post_id = _shifted(20, 1)
    ts = F.col("ts").cast("timestamp")
    joined = events.join(documents.select("doc_id", "text").repartition(parts, "doc_id"), "doc_id")
    return joined.select(
        post_id.cast("string").alias("tweet_id"),
        F.concat(user, F.when(F.col("user_id") % 37 == 0, "bot").otherwise("")).alias("username"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp_utc"),
        ts.alias("ts"),
        F.concat("text", phrase, F.lit(" #"), kind, F.lit(" "), user).alias("content"),
        F.floor("value").alias("like_count"),
        F.get_json_object("props", "$.k").cast("bigint").alias("retweet_count"),
        (F.col("user_id") % 7).alias("reply_count"),
        F.concat(F.lit("https://example.com/status/"), _shifted(50, 3).cast("string")).alias("url"),
        F.concat(F.lit("Q"), (F.col("user_id") % 4 + 1).cast("string")).alias("query"),
        F.to_date(ts).alias("date"),
        F.col("event_id").alias("seq"),
    )


def raw_event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts as landed text: counts as text, tag columns partly empty, untidy white
    space, and some unusable timestamps."""
    posts = event_posts(spark, sf_dir)
    seq = F.col("seq")
    return posts.select(
        "tweet_id",
        "username",
        F.when(seq % 97 == 5, "2024")
        .when(seq % 97 == 6, "soon")
        .otherwise(F.col("timestamp_utc"))
        .alias("timestamp_utc"),
        F.concat(F.lit("  "), F.replace("content", F.lit(" the "), F.lit(" the\u200b \n"))).alias("content"),
        F.when(seq % 11 == 0, F.concat(F.col("like_count").cast("string"), F.lit(".9")))
        .when(seq % 11 == 1, "n/a")
        .otherwise(F.col("like_count").cast("string"))
        .alias("like_count"),
        F.col("retweet_count").cast("string").alias("retweet_count"),
        F.when(seq % 13 == 0, None).otherwise(F.col("reply_count").cast("string")).alias("reply_count"),
        F.when(seq % 3 == 0, "").when(seq % 3 == 1, " #market , ,#Nifty").alias("hashtags"),
        F.when(seq % 2 == 0, "@desk").alias("mentions"),
        "url",
        "query",
        "seq",
    )


def render_pages(posts: DataFrame, cards_per_page: int = 20) -> DataFrame:
    """Posts as stored result pages of a fixed number of cards."""

    def escaped(c: Column) -> Column:
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(mark), F.lit(entity))
        return c

    card = F.format_string(
        '<article><div data-testid="User-Name"><span>Name</span><span>%s</span></div>'
        '<a href="%s?s=20"><time datetime="%s">now</time></a><div data-testid="tweetText">%s</div>'
        '<div data-testid="reply"><span>%s</span></div><div data-testid="repost"><span>%s</span></div>'
        '<div data-testid="like"><span>%s</span></div></article>',
        escaped(F.col("username")),
        escaped(F.col("url")),
        F.col("timestamp_utc"),
        escaped(F.col("content")),
        F.col("reply_count").cast("string"),
        F.col("retweet_count").cast("string"),
        F.col("like_count").cast("string"),
    )
    page = F.floor(F.col("seq") / cards_per_page).alias("page_id")
    cards = posts.select(page, F.struct("seq", card.alias("card")).alias("c"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["card"]), "\n")
    return cards.groupBy("page_id").agg(
        F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html")
    )
