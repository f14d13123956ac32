"""One registered query per operator. Each reads the given tables whole and returns a DataFrame.

Doubles are rounded to 6 places and lists joined to text, so that two engines can be compared by value.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsemill import fixed_values as v
from pulsemill import functions as fn
from pulsemill.operators import bootstrap, dedup, hourly, quality, stats, tfidf, topics
from pulsemill.plans.clean import clean_posts, shape_posts
from pulsemill.plans.collect import accept_posts, label_batch, merge_batches, union_batches
from pulsemill.plans.signals import signal_table
from pulsemill.schema import HOURLY_SIGNAL, RAW_POST, conform
from pulsemill.session import new_path, use_utc
from pulsemill.sources.event_posts import event_posts, raw_event_posts, render_pages
from pulsemill.sources.pages import cards_to_posts, posts_from_pages, read_cards
from pulsemill.sources.posts_csv import (
    read_posts_csv,
    read_signals_csv,
    write_csv_by_query,
    write_posts_csv,
    write_signals_csv,
)
from pulsemill.sources.key_store import build_keys, unseen_by_keys
from pulsemill.sources.posts_parquet import CODEC, read_posts, upsert_by_date, write_by_date
from pulsemill.streaming import hourly as stream_hourly
from pulsemill.streaming import ingest, progress
from pulsemill.streaming.upsert import start_upsert

WEEK = 24 * 7
MONTH = 24 * 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def newest(spark, sf_dir):
    """Time of the newest event: the fixed 'now' of every check."""
    return table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("now")).scalar()


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def shaped(*shapes):
    """The n-th shape for events whose id leaves n when divided by the number of shapes."""
    turn = F.col("event_id") % len(shapes)
    return F.coalesce(*[F.when(turn == n, s) for n, s in enumerate(shapes)])


def events_with_k(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.withColumn("k", F.get_json_object("props", "$.k"))


def ntz(c):
    return c.cast("timestamp_ntz")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def round_doubles(df):
    return rounded(df, *[f.name for f in df.schema if f.dataType.typeName() == "double"])


# --- column functions ---------------------------------------------------------------------------


def parse_counts(spark, sf_dir):
    user, k = text("user_id"), F.col("k")
    shown = shaped(
        F.concat(user, F.lit("."), k, F.lit("K")),
        F.concat(user, F.lit("."), k, F.lit("M")),
        F.concat(user, F.lit(","), F.lpad(k, 3, "0")),
        F.concat(user, F.lit("B")),
        F.concat(user, F.lit("k")),
        F.lit(""),
        F.concat(F.lit(" "), user, F.lit(".5 K ")),
        F.concat(F.lit("-"), k),
        F.concat(k, F.lit("."), user),
    )
    rows = events_with_k(spark, sf_dir).withColumn("shown", shown)
    return rows.select("event_id", "shown", fn.parse_count(F.col("shown")).alias("n"))


def safe_ints(spark, sf_dir):
    shown = shaped(
        F.col("k"),
        F.concat(F.col("k"), F.lit(".9")),
        F.lit("n/a"),
        F.lit("NaN"),
        F.lit("Infinity"),
        text(F.lit(9007199254740993) + F.col("event_id")),
        F.concat(F.lit("-"), F.col("k"), F.lit(".5")),
    )
    rows = events_with_k(spark, sf_dir).withColumn("shown", F.when(F.col("user_id") != 7, shown))
    return rows.select("event_id", "shown", fn.safe_int(F.col("shown")).alias("n"))


def parse_timestamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    shown = shaped(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.concat(whole, F.lit("+05:30")),
        whole,
        F.date_format(ts, "yyyy-MM-dd"),
        F.date_format(ts, "yyyy"),
        F.date_format(ts, "HH:mm"),
        F.lit("2024-13-45T00:00:00Z"),
    )
    rows = events.withColumn("shown", shown)
    return rows.select(
        "event_id",
        "shown",
        ntz(fn.parse_instant(F.col("shown"))).alias("strict"),
        ntz(fn.coerce_instant(F.col("shown"))).alias("coerced"),
    )


def normalize_text(spark, sf_dir):
    untidy = F.concat(
        F.lit("\u3000"),
        F.replace("text", F.lit(" "), F.lit("\u200b\u2003\u00a0 \ufeff")),
        F.lit("\u0085\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", fn.normalize_text(untidy).alias("content"))


ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def nfkc_text(spark, sf_dir):
    wide = "".join(chr(ord(c) + 0xFEE0) for c in ASCII_LETTERS)
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.nfkc(F.translate("text", ASCII_LETTERS, wide)).alias("content")
    )


def token_sets(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(
        "doc_id", F.sort_array(fn.token_set(F.col("text"))).alias("t")
    )
    return tokens.select(
        "doc_id", F.size("t").cast("bigint").alias("token_count"), F.array_join("t", " ").alias("tokens")
    )


def hashtags(spark, sf_dir):
    tags = fn.comma_text(fn.hashtags(F.col("content")))
    return event_posts(spark, sf_dir).select("seq", tags.alias("hashtags"))


def mentions(spark, sf_dir):
    tags = fn.comma_text(fn.mentions(F.col("content")))
    return event_posts(spark, sf_dir).select("seq", tags.alias("mentions"))


def tag_fallback(spark, sf_dir):
    content = F.col("content")
    tags = raw_event_posts(spark, sf_dir).select(
        "seq",
        fn.tags_or_extract(fn.split_tags(F.col("hashtags")), fn.hashtags(content)).alias("h"),
        fn.tags_or_extract(fn.split_tags(F.col("mentions")), fn.mentions(content)).alias("m"),
    )
    return tags.select(
        "seq", fn.json_text(F.col("h")).alias("hashtags_json"), fn.comma_text(F.col("m")).alias("mentions")
    )


def canonical_urls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    base = F.concat(F.lit("https://example.com/u/status/"), text("event_id"))
    shown = shaped(
        base,
        F.concat(base, F.lit("?s=20")),
        F.concat(base, F.lit("/photo/1?x=/status/9")),
        F.concat(F.lit("https://example.com/home?to=/status/"), text("event_id")),
        F.lit(""),
    )
    url = fn.canonical_url(shown)
    return events.select("event_id", url.alias("url"), fn.status_id(url).alias("tweet_id"))


def author_handles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    block = shaped(
        F.concat(F.lit("Some Name\n@u"), text("user_id"), F.lit("\n2h")),
        F.concat(F.lit(" User "), text("user_id"), F.lit(" \nsecond line")),
        F.lit(""),
    )
    return events.select("event_id", fn.author_handle(block).alias("handle"))


def first_metrics(spark, sf_dir):
    events = events_with_k(spark, sf_dir)
    first = shaped(F.col("k"), F.lit(""), F.lit("  "), F.lit(None))
    second = F.concat(text("user_id"), F.lit(".5K"))
    return events.select("event_id", fn.first_metric(first, second).alias("n"))


def keyword_sentiment(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return posts.select("seq", fn.lexicon_polarity(F.col("content")).alias("sentiment"))


def keyword_signal(spark, sf_dir):
    scored = hourly.with_keyword_signal(event_posts(spark, sf_dir))
    return rounded(scored.select("seq", "weight", "keyword_signal"), "weight", "keyword_signal")


# --- filters and reports ------------------------------------------------------------------------


def recent_posts(spark, sf_dir):
    posts = quality.recent_posts(event_posts(spark, sf_dir), newest(spark, sf_dir), WEEK)
    return posts.select("seq", "tweet_id", ntz(F.col("ts")).alias("ts"))


def quality_filter(spark, sf_dir):
    return quality.quality_filter(event_posts(spark, sf_dir)).select("seq", "tweet_id")


def content_or_url(spark, sf_dir):
    posts = event_posts(spark, sf_dir).select(
        "seq",
        F.when(F.col("reply_count") > 1, F.col("content")).otherwise("").alias("content"),
        F.when(F.col("like_count") > 20, F.col("url")).alias("url"),
    )
    kept = posts.where(quality.has_content_or_url(F.col("content"), F.col("url")))
    return kept.select("seq", F.char_length("content").cast("bigint").alias("content_chars"), "url")


def untidy_posts(spark, sf_dir):
    """Posts of which some have no address or hardly any text."""
    return event_posts(spark, sf_dir).withColumns(
        {
            "url": F.when(F.col("reply_count") == 3, F.lit(None)).otherwise(F.col("url")),
            "content": F.when(F.col("like_count") == 11, "too short").otherwise(F.col("content")),
        }
    )


def reject_report(spark, sf_dir):
    return quality.reject_report(untidy_posts(spark, sf_dir), newest(spark, sf_dir), WEEK)


def topic_match(spark, sf_dir):
    return topics.match_topics(event_posts(spark, sf_dir)).select("seq", "topic")


def topic_match_table(spark, sf_dir):
    rules = spark.createDataFrame(
        topics.parse_rules(), "ord INT, label STRING, clauses ARRAY<ARRAY<STRING>>"
    )
    return topics.match_topic_table(event_posts(spark, sf_dir), rules).select("seq", "topic")


# --- deduplication ------------------------------------------------------------------------------


def dedup_id_url(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    kept = dedup.latest_per_id_then_url(posts, tie=[F.col("tweet_id").asc(), F.col("seq").asc()])
    return kept.select("seq", "tweet_id", "url")


def dedup_first_seen(spark, sf_dir):
    return dedup.first_per_id_then_url(event_posts(spark, sf_dir)).select("seq", "tweet_id", "url")


def stored_posts(spark, sf_dir):
    posts, path = event_posts(spark, sf_dir), new_path(spark, "posts-dedup")
    write_by_date(posts, path)
    return read_posts(spark, path, posts.schema, position=True)


def dedup_stored(spark, sf_dir):
    """As `dedup_id_url`, of posts in files: their texts are fetched by position."""
    tie = [F.col("tweet_id").asc(), F.col("seq").asc()]
    kept = dedup.fetch_late(stored_posts(spark, sf_dir), lambda rows: dedup.latest_per_id_then_url(rows, tie), marked=True)
    return kept.select("seq", "tweet_id", "url", "content")


def dedup_stored_first(spark, sf_dir):
    """As `dedup_first_seen`, of posts in files."""
    return dedup.fetch_late(stored_posts(spark, sf_dir), dedup.first_per_id_then_url, marked=True).select(
        "seq", "tweet_id", "url", "content"
    )


def dedup_identity(spark, sf_dir):
    posts = event_posts(spark, sf_dir).withColumns(
        {
            "tweet_id": F.when(F.col("reply_count") < 3, "").otherwise(F.col("tweet_id")),
            "url": F.when(F.col("reply_count") < 2, F.lit(None)).otherwise(F.col("url")),
            "timestamp_utc": F.col("date").cast("string"),
        }
    )
    return dedup.first_per_identity(posts).select("seq")


def first_query_wins(spark, sf_dir):
    order = F.substring("query", 2, 1).cast("int")
    posts = event_posts(spark, sf_dir).withColumn("query_ord", order)
    return dedup.first_query_wins(posts).select("seq", "tweet_id", "query")


def unseen_posts(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    early = F.date_trunc("day", newest(spark, sf_dir)) - F.expr("INTERVAL 7 DAYS")
    incoming = posts.withColumn("tweet_id", F.col("url").substr(28, 20))
    return dedup.unseen_posts(incoming, posts.where(F.col("ts") < early)).select("seq", "tweet_id")


def unseen_by_stored_keys(spark, sf_dir):
    """As `unseen_posts`, against the key table of the stored posts."""
    posts = event_posts(spark, sf_dir)
    root = new_path(spark, "posts-keys")
    early = F.date_trunc("day", newest(spark, sf_dir)) - F.expr("INTERVAL 7 DAYS")
    build_keys(posts.where(F.col("ts") < early), root)
    incoming = posts.withColumn("tweet_id", F.col("url").substr(28, 20))
    return unseen_by_keys(incoming, root).select("seq", "tweet_id")


# --- counts -------------------------------------------------------------------------------------


def posts_per_date(spark, sf_dir):
    return stats.posts_per_date(event_posts(spark, sf_dir))


def tagged(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return posts.withColumns(
        {
            "hashtags": fn.hashtags(F.col("content")),
            "mentions": fn.mentions(F.col("content")),
        }
    )


def tag_coverage(spark, sf_dir):
    return rounded(stats.tag_coverage(tagged(spark, sf_dir)), "mean_likes")


def top_hashtags(spark, sf_dir):
    return stats.top_hashtags(tagged(spark, sf_dir))


def approx_top_hashtags(spark, sf_dir):
    return stats.approx_top_hashtags(tagged(spark, sf_dir))


def query_rate(spark, sf_dir):
    rate = stats.query_rate(event_posts(spark, sf_dir), seen_at="ts")
    return rounded(rate, "posts_per_minute")


def newest_posts(spark, sf_dir):
    return stats.newest_posts(event_posts(spark, sf_dir), 100).select("seq", "tweet_id")


# --- jobs ---------------------------------------------------------------------------------------


def clean(spark, sf_dir):
    kept = clean_posts(raw_event_posts(spark, sf_dir), newest(spark, sf_dir), MONTH)
    return kept.select(
        "tweet_id", "username", "handle", ntz(F.col("ts")).alias("ts"), "content", "like_count",
        "retweet_count", "reply_count", "hashtags_json", "mentions_json", "url", "query", "date",
    )


def clean_counts(spark, sf_dir):
    """Rows before, after the time filter, and after deduplication, observed in one pass."""
    raw, landed = stats.counted(raw_event_posts(spark, sf_dir), "landed")
    shaped_rows, valid = stats.counted(shape_posts(raw, newest(spark, sf_dir), MONTH), "valid")
    kept = dedup.latest_per_id_then_url(shaped_rows).select("tweet_id")
    unique = kept.agg(F.count("*").alias("n")).collect()[0].n
    rows = [("landed", landed.get["rows"]), ("valid", valid.get["rows"]), ("unique", unique)]
    return spark.createDataFrame(rows, "step STRING, posts BIGINT")


def collected(spark, sf_dir):
    """One batch per query label, in query order."""
    posts = event_posts(spark, sf_dir).drop("ts", "date")
    return [
        label_batch(posts.where(F.col("query") == q), q, n)
        for n, q in enumerate(("Q1", "Q2", "Q3", "Q4"), start=1)
    ]


def accepted(spark, sf_dir):
    landed = union_batches(collected(spark, sf_dir))
    return accept_posts(landed, newest(spark, sf_dir), WEEK).select("seq", "tweet_id", "query")


def merged_batches(spark, sf_dir):
    first, *others = collected(spark, sf_dir)
    batches = [first.drop("username"), *others]
    merged = merge_batches(batches, newest(spark, sf_dir), MONTH)
    return merged.select("seq", "tweet_id", "username", "url")


def tfidf_vocab(spark, sf_dir):
    return rounded(tfidf.vocabulary(event_posts(spark, sf_dir)), "idf")


def tfidf_weights(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    kept = tfidf.vocabulary(posts).collect()
    weights = tfidf.term_weights(posts, [r.term for r in kept], [r.idf for r in kept], key="seq")
    return rounded(weights, "weight")


def tfidf_score(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    scored = tfidf.score(posts, tfidf.fit(posts))
    return rounded(scored.select("seq", "tfidf_signal"), "tfidf_signal")


def stored_model_score(spark, sf_dir):
    """Fit, store, load, score."""
    posts = event_posts(spark, sf_dir)
    path = new_path(spark, "term-model")
    tfidf.save_model(tfidf.fit(posts), spark, path)
    scored = tfidf.score(posts, tfidf.load_model(spark, path))
    return rounded(scored.select("seq", "tfidf_signal"), "tfidf_signal")


def hourly_keyword(spark, sf_dir):
    return rounded(hourly.hourly_keyword(event_posts(spark, sf_dir)), "keyword_signal")


def combined_signal(spark, sf_dir):
    """The three signals of every post."""
    posts = event_posts(spark, sf_dir)
    scored = hourly.score_posts(posts.withColumn("tweet_id", F.col("seq")), tfidf.fit(posts))
    signals = ("keyword_signal", "tfidf_signal", "combined_signal")
    return rounded(scored.select(F.col("tweet_id").alias("seq"), "time", *signals), *signals)


def hourly_bootstrap(spark, sf_dir):
    """Intervals of the lexicon signal alone."""
    scored = hourly.with_keyword_signal(event_posts(spark, sf_dir))
    scored = scored.withColumn("time", fn.hour_start(F.col("ts")))
    return round_doubles(bootstrap.poisson_intervals(scored, metrics=("keyword_signal",)))


def hourly_dense(spark, sf_dir):
    found = hourly.hourly_keyword(event_posts(spark, sf_dir))
    return rounded(hourly.dense_hours(found), "keyword_signal")


def hourly_signals(spark, sf_dir):
    """The flagship: raw text to hourly signals with intervals, over all posts."""
    return round_doubles(signal_table(event_posts(spark, sf_dir)))


def signals_long(spark, sf_dir):
    return round_doubles(hourly.long_form(signal_table(event_posts(spark, sf_dir))))


# --- sources and sinks --------------------------------------------------------------------------


def pages_extract(spark, sf_dir):
    posts = posts_from_pages(render_pages(event_posts(spark, sf_dir)))
    return posts.select(
        "tweet_id", "username", "timestamp_utc", "content", "like_count", "retweet_count", "reply_count",
        "hashtags", "mentions", "url",
    )


def page_cards(spark, sf_dir):
    cards = cards_to_posts(read_cards(table(spark, sf_dir, "pages")))
    return cards.groupBy("page_id", "card_problem").agg(F.count("*").alias("cards"))


def csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "posts-csv")
    write_posts_csv(conform(raw_event_posts(spark, sf_dir), RAW_POST), path)
    return read_posts_csv(spark, path)


def csv_by_query(spark, sf_dir):
    path = new_path(spark, "posts-by-query")
    write_csv_by_query(conform(raw_event_posts(spark, sf_dir), RAW_POST), path)
    return read_posts_csv(spark, path).groupBy("query").agg(
        F.count("*").alias("posts"), F.sum(F.char_length("content")).alias("content_chars")
    )


def parquet_by_date(spark, sf_dir):
    path = new_path(spark, "posts-by-date")
    write_by_date(shape_posts(raw_event_posts(spark, sf_dir), newest(spark, sf_dir), MONTH), path)
    return read_posts(spark, path).select("tweet_id", "content", "like_count", "query", "date")


def two_loads(spark, sf_dir):
    """All posts but those of the last day and a half, then those of the last two days."""
    posts = shape_posts(raw_event_posts(spark, sf_dir), newest(spark, sf_dir), MONTH)
    now = newest(spark, sf_dir)
    return [posts.where(F.col("ts") < now - F.expr("INTERVAL 36 HOURS")), posts.where(F.col("ts") >= now - F.expr("INTERVAL 48 HOURS"))]


def upserted(spark, sf_dir, **how):
    """Two overlapping loads."""
    path = new_path(spark, "posts-upsert")
    for load in two_loads(spark, sf_dir):
        upsert_by_date(load, path, **how)
    return read_posts(spark, path).select("tweet_id", "url", "content", "query", "date")


def upserted_by_keys(spark, sf_dir):
    """The same loads; the dates that they touch come from the table of stored keys."""
    return upserted(spark, sf_dir, keys=True)


def signals_csv(spark, sf_dir):
    path = new_path(spark, "signals-csv")
    write_signals_csv(signal_table(event_posts(spark, sf_dir)), path)
    return round_doubles(read_signals_csv(spark, path, HOURLY_SIGNAL))


# --- streams ------------------------------------------------------------------------------------


def landed_stream(spark, sf_dir):
    """Posts landed as files, read back as a stream in arrival order."""
    path = new_path(spark, "landed")
    posts = event_posts(spark, sf_dir)
    posts.write.parquet(path)
    stream = ingest.stream_posts(spark, path, schema=posts.schema)
    return ingest.with_event_time(stream)


def run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stream_hourly_means(spark, sf_dir):
    """Hours closed by the watermark; the last hours stay open."""
    out = new_path(spark, "hourly-means")
    means = stream_hourly.stream_hourly_means(landed_stream(spark, sf_dir))
    run(ingest_start(means, out))
    return rounded(spark.read.parquet(out), "keyword_signal")


def ingest_start(stream, out):
    return stream_hourly.start_table(stream, out, new_path(stream.sparkSession, "checkpoint"))


def stream_signals(spark, sf_dir):
    out = new_path(spark, "stream-signals")
    model = tfidf.fit(event_posts(spark, sf_dir))
    run(
        stream_hourly.start_signals(
            landed_stream(spark, sf_dir), model, out, new_path(spark, "checkpoint")
        )
    )
    return round_doubles(spark.read.schema(HOURLY_SIGNAL).option("recursiveFileLookup", True).parquet(out))


def stream_new_posts(spark, sf_dir):
    out = new_path(spark, "new-posts")
    stream = ingest.count_old(landed_stream(spark, sf_dir), newest_value(spark, sf_dir), WEEK)
    run(ingest_start(ingest.new_posts(stream), out))
    return spark.read.parquet(out).select("tweet_id")


def stream_upsert(spark, sf_dir):
    """The loads of `upsert_by_date` as they land, by a stream that is started anew for each."""
    landed, root, checkpoint = (new_path(spark, n) for n in ("landed", "posts-stream", "checkpoint"))
    for load in two_loads(spark, sf_dir):
        load.write.mode("append").option("compression", CODEC).parquet(landed)
        run(start_upsert(ingest.stream_posts(spark, landed, schema=load.schema), root, checkpoint))
    return read_posts(spark, root).select("tweet_id", "url", "content", "query", "date")


LOADS = 4


def stream_post_counts(spark, sf_dir):
    """Old, late and accepted posts of each of four loads by arrival, over as many starts of the stream."""
    landed, out, checkpoint, kept = (new_path(spark, n) for n in ("landed", "accepted", "checkpoint", "counts"))
    events = table(spark, sf_dir, "events").count()
    # A multiple of 20, so that two posts of one id land together.
    size = -(-events // (LOADS * 20)) * 20
    posts = event_posts(spark, sf_dir).drop("content")
    now = newest_value(spark, sf_dir)
    for n in range(LOADS):
        posts.where((F.col("seq") >= n * size) & (F.col("seq") < (n + 1) * size)).write.mode("append").parquet(landed)
        stream = ingest.with_event_time(ingest.stream_posts(spark, landed, schema=posts.schema))
        accepted = progress.count_accepted(ingest.new_posts(ingest.count_old(stream, now, WEEK * 3)))
        counts = progress.BatchCounts()
        spark.streams.addListener(counts)
        query = stream_hourly.start_table(accepted, out, checkpoint)
        run(query)
        spark.streams.removeListener(counts)
        counts.finish(query).store(spark, query, kept)
    load = F.row_number().over(Window.orderBy("batch_id"))  # LOADS rows
    return progress.read_counts(spark, kept).select(load.alias("load"), "posts", "old_posts", "late_posts", "accepted_posts")


def newest_value(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now")).collect()[0].now
    return F.lit(now).cast("timestamp")


QUERIES = {
    "parse_counts": parse_counts,
    "safe_ints": safe_ints,
    "parse_timestamps": parse_timestamps,
    "normalize_text": normalize_text,
    "nfkc_text": nfkc_text,
    "token_sets": token_sets,
    "hashtags": hashtags,
    "mentions": mentions,
    "tag_fallback": tag_fallback,
    "canonical_url": canonical_urls,
    "author_handles": author_handles,
    "first_metrics": first_metrics,
    "keyword_sentiment": keyword_sentiment,
    "keyword_signal": keyword_signal,
    "recent_posts": recent_posts,
    "quality_filter": quality_filter,
    "content_or_url": content_or_url,
    "reject_report": reject_report,
    "topic_match": topic_match,
    "topic_match_table": topic_match_table,
    "dedup_id_url": dedup_id_url,
    "dedup_first_seen": dedup_first_seen,
    "dedup_stored": dedup_stored,
    "dedup_stored_first": dedup_stored_first,
    "dedup_coalesced_key": dedup_identity,
    "first_query_wins": first_query_wins,
    "unseen_posts": unseen_posts,
    "unseen_by_keys": unseen_by_stored_keys,
    "posts_per_date": posts_per_date,
    "tag_coverage": tag_coverage,
    "top_hashtags": top_hashtags,
    "approx_top_hashtags": approx_top_hashtags,
    "query_rate": query_rate,
    "newest_posts": newest_posts,
    "clean_posts": clean,
    "clean_counts": clean_counts,
    "accepted_posts": accepted,
    "merged_batches": merged_batches,
    "tfidf_vocab": tfidf_vocab,
    "tfidf_weights": tfidf_weights,
    "tfidf_score": tfidf_score,
    "stored_model_score": stored_model_score,
    "hourly_keyword": hourly_keyword,
    "combined_signal": combined_signal,
    "hourly_bootstrap": hourly_bootstrap,
    "hourly_dense": hourly_dense,
    "hourly_signals": hourly_signals,
    "signals_long": signals_long,
    "pages_extract": pages_extract,
    "page_cards": page_cards,
    "csv_roundtrip": csv_roundtrip,
    "csv_by_query": csv_by_query,
    "parquet_by_date": parquet_by_date,
    "upsert_by_date": upserted,
    "upsert_by_keys": upserted_by_keys,
    "signals_csv": signals_csv,
    "stream_hourly": stream_hourly_means,
    "stream_signals": stream_signals,
    "stream_new_posts": stream_new_posts,
    "stream_upsert": stream_upsert,
    "stream_post_counts": stream_post_counts,
}
