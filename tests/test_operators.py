from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import dedup, quality, stats, topics
from pulsemill.plans import collect
from pulsemill.session import new_path

def now():
    return F.lit("2026-01-14T12:00:00Z").cast("timestamp")


POST = "seq BIGINT, tweet_id STRING, url STRING, ts TIMESTAMP, content STRING, username STRING"


def posts(spark, rows):
    filled = [(n, *r) for n, r in enumerate(rows)]
    raw = spark.createDataFrame(filled, POST.replace("TIMESTAMP", "STRING"))
    return raw.withColumn("ts", F.expr("try_cast(ts as timestamp)"))


def kept(df, column="seq"):
    return sorted(r[column] for r in df.select(column).collect())


GOOD = "a text of more than twenty characters"
URL = "https://example.com/status/1"


def test_reject_rules(spark):
    old, at_cut, fresh = "2026-01-13T11:59:59Z", "2026-01-13T12:00:00Z", "2026-01-14T11:00:00Z"
    rows = [
        ("1", URL, at_cut, GOOD, "@me"),
        ("2", URL, old, GOOD, "@me"),
        ("3", None, fresh, GOOD, "@me"),
        ("4", URL, fresh, "x" * 19, "@me"),
        ("5", URL, fresh, "x" * 20, "@me"),
        *[(f"s{n}", URL, fresh, GOOD + " " + t.upper(), "@me") for n, t in enumerate(quality.v.SPAM_TERMS)],
        *[(f"b{n}", URL, fresh, GOOD, "@My" + t.upper()) for n, t in enumerate(quality.v.BOT_TERMS)],
        ("6", URL, fresh, GOOD, None),
        ("7", URL, None, GOOD, "@me"),
        ("8", URL, fresh, None, "@me"),
    ]
    df = posts(spark, rows)
    report = {r.reject_reason: r.posts for r in quality.reject_report(df, now(), 24).collect()}
    assert report == {"kept": 3, "old": 2, "no_url": 1, "short": 2, "spam": 6, "bot": 4}
    passed = quality.quality_filter(quality.recent_posts(df, now(), 24))
    assert kept(passed, "tweet_id") == ["1", "5", "6"]


def test_latest_per_id_then_url(spark):
    rows = [
        ("a", "u1", "2026-01-14T01:00:00Z", "first", None),
        ("a", "u2", "2026-01-14T02:00:00Z", "newer", None),
        ("b", "u2", "2026-01-14T03:00:00Z", "same url as newer a", None),
        ("c", "u3", "2026-01-14T04:00:00Z", "tie", None),
        ("c", "u3", "2026-01-14T04:00:00Z", "tie", None),
        (None, "u5", "2026-01-14T05:00:00Z", "null id", None),
        (None, "u6", "2026-01-14T06:00:00Z", "null id", None),
    ]
    df = posts(spark, rows)
    once = dedup.latest_per_id_then_url(df)
    ids = [(r.tweet_id, r.url) for r in once.orderBy("ts").collect()]
    assert ids == [("b", "u2"), ("c", "u3"), (None, "u6")]
    assert dedup.latest_per_id_then_url(once).count() == 3
    assert dedup.latest_per_id_then_url(df, null_keys="keep").count() == 4
    assert kept(dedup.latest_per_id_then_url(df.orderBy(F.rand(3)))) == kept(once)


def test_dedup_limits_hot_keys_before_the_shuffle(spark):
    """A third of all rows under one key: each map task sends one row of it."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("tweet_id"),
        F.col("id").alias("seq"),
    )
    first = dedup.keep_first(df, "tweet_id", [F.col("seq")])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert first.count() == 20_001


def stored(spark, rows):
    path = new_path(spark, "positions")
    rows.repartition(3).write.parquet(path)
    return dedup.with_position(spark.read.schema(rows.schema).parquet(path))


@pytest.mark.parametrize("null_keys", ["merge", "keep"])
def test_rows_fetched_by_position(spark, null_keys):
    """Ties, repeated rows and NULL keys of stored rows end as those of any others."""
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 41).cast("string")).alias("tweet_id"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 53).cast("string")).alias("url"),
        (F.timestamp_seconds(F.col("id") % 5)).alias("ts"),
        (F.col("id") % 11).alias("seq"),
        F.repeat(F.lit("x"), (F.col("id") % 4).cast("int")).alias("content"),
    )
    placed = stored(spark, rows)
    for choose in (dedup.latest_per_id_then_url, dedup.first_per_id_then_url):
        late = dedup.fetch_late(placed, lambda p: choose(p, null_keys=null_keys))
        assert late.columns == rows.columns
        assert sorted(map(repr, late.collect())) == sorted(map(repr, choose(rows, null_keys=null_keys).collect()))
        assert dedup.fetch_late(placed.where("false"), choose).count() == 0


@pytest.mark.parametrize("choose", [dedup.latest_per_id_then_url, dedup.first_per_id_then_url])
def test_texts_of_stored_rows_move_once(spark, choose):
    rows = spark.range(100).selectExpr("string(id % 9) tweet_id", "string(id % 7) url", "timestamp_seconds(id) ts", "id seq", "'text' content")
    placed, limit = stored(spark, rows), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.fetch_late(placed, choose)._jdf.queryExecution().executedPlan()
        tree, moved = [plan.initialPlan()], []
        while tree:
            node = tree.pop()
            tree += [node.children().apply(k) for k in range(node.children().size())]
            if "Exchange" in node.nodeName():
                moved.append("content" in node.output().mkString(","))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved.count(True) == 1 and len(moved) >= 3


@pytest.mark.parametrize("null_keys", ["merge", "keep"])
def test_rows_fetched_by_bitmaps(spark, null_keys):
    """With `marked`, the same rows (also of files of more than one bitmap), and no text is shuffled."""
    rows = spark.range(80_000).selectExpr(
        "if(id % 3 > 0, string(id % 40009), null) tweet_id", "if(id % 7 > 0, string(id % 53017), null) url",
        "timestamp_seconds(id % 5) ts", "id % 11 seq", "string(id) content",
    )
    path = new_path(spark, "bitmaps")
    rows.coalesce(1).write.parquet(path)
    rows.limit(0).union(rows.where("seq = 3 and tweet_id is not null")).repartition(2).write.mode("append").parquet(path)
    placed = dedup.with_position(spark.read.schema(rows.schema).parquet(path))
    for choose in (dedup.latest_per_id_then_url, dedup.first_per_id_then_url):
        late = dedup.fetch_late(placed, lambda p: choose(p, null_keys=null_keys), marked=True)
        assert late.columns == rows.columns
        assert sorted(late.collect(), key=repr) == sorted(choose(placed, null_keys=null_keys).drop(*dedup.POSITION).collect(), key=repr)
        assert dedup.fetch_late(placed.where("false"), choose, marked=True).count() == 0
    plan = dedup.fetch_late(placed, choose, marked=True)._jdf.queryExecution().executedPlan()
    tree, moved = [plan.initialPlan()], []
    while tree:
        node = tree.pop()
        tree += [node.children().apply(k) for k in range(node.children().size())]
        if "Exchange" in node.nodeName():
            moved.append("content" in node.output().mkString(","))
    assert not any(moved) and len(moved) >= 3


def test_first_seen_variants(spark):
    rows = [
        ("a", "u1", None, "x", None), ("a", "u9", None, "y", None), ("", "u1", None, "x", None),
        ("", "u1", None, "z", None), ("", "", None, "x", None), (None, None, None, "x", None), ("b", "u1", None, "q", None),
    ]
    df = posts(spark, rows).withColumn("timestamp_utc", F.lit("t"))
    assert kept(dedup.first_per_identity(df)) == [0, 2, 4, 6]
    assert kept(dedup.first_per_id_then_url(df)) == [0, 5]
    labelled = collect.union_batches(
        [collect.label_batch(df.where("seq > 0"), "Q1", 1), collect.label_batch(df, "Q2", 2).drop("username")]
    )
    winners = {r.tweet_id: (r.query, r.seq) for r in dedup.first_query_wins(labelled).collect()}
    assert winners == {"a": ("Q1", 1), "": ("Q1", 2), None: ("Q1", 5), "b": ("Q1", 6)}
    assert kept(dedup.unseen_posts(df, df.where("seq = 0"))) == [2, 3, 4, 5, 6]


def test_topics(spark):
    texts = [
        "#Nifty50 and #sensex", "#BSE today", "nifty Intraday call", "intraday only", "sensex fell today",
        "the indian market for stock", "banknifty futures", "#nifty options", "nifty50", None,
    ]
    want = ["Q1", "Q2", "Q4", None, "Q6", "Q7", "Q8", "Q5", None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "tweet_id INT, content STRING")
    got = {r.tweet_id: r.topic for r in topics.match_topics(df).collect()}
    assert [got[n] for n in range(len(texts))] == want
    rules = spark.createDataFrame(topics.parse_rules(), "ord INT, label STRING, clauses ARRAY<ARRAY<STRING>>")
    table = {r.tweet_id: r.topic for r in topics.match_topic_table(df, rules).collect()}
    assert [table.get(n) for n in range(len(texts))] == want


def test_topics_by_searches_are_those_of_tokens(spark):
    """Searches in the text find what a list of its tokens holds, at all ends of words."""
    rules = (("A", "#nifty50"), ("B", "nifty today OR #x_1 y"), ("C", "बाज़ार"), ("D", "a-b"), ("E", "##bse"), ("F", "bse"))
    words = ["#nifty50", "nifty50", "Nifty", "xnifty", "nifty9", "##nifty", "a#x_1", "#x_1y", "y", "today", "_today", "बाज़ार", "बाज़ारx", "a-b", "##bse", "#bse", "BSE."]
    texts = [f"{a}{gap}{b}" for a in words for b in words for gap in (" ", "", "\n#")]
    df = spark.createDataFrame([(t,) for t in texts], "content STRING")
    want = topics.topic_label(topics.topic_tokens(F.col("content")), rules)
    found = topics.match_topics(df.withColumn("want", want), rules)
    assert found.where(~F.col("topic").eqNullSafe(F.col("want"))).collect() == []
    assert "regexp_extract_all" not in topics.match_topics(df, rules)._jdf.queryExecution().executedPlan().toString()


def test_rules_are_sent_to_the_words(spark):
    """Words of texts are not shuffled to meet the rules, whose size Spark does not know."""
    rules = spark.createDataFrame(topics.parse_rules(), "ord INT, label STRING, clauses ARRAY<ARRAY<STRING>>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = topics.match_topic_table(spark.createDataFrame([("nifty options",)], "content STRING"), rules)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [word" in plan.toString()


def test_stats(spark):
    df = spark.createDataFrame(
        [
            (["#a", "#b", "#a"], ["@x"], 2, "Q1", datetime(2026, 1, 1, 0, 0, 0)),
            (["#b"], [], 4, "Q1", datetime(2026, 1, 1, 0, 0, 30)),
            ([], [], 0, "Q2", datetime(2026, 1, 1, 0, 2, 0)),
        ],
        "hashtags ARRAY<STRING>, mentions ARRAY<STRING>, like_count BIGINT, query STRING, ingested_at TIMESTAMP_NTZ",
    ).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    row = stats.tag_coverage(df).collect()[0]
    assert (row.posts, row.with_hashtags, row.with_mentions, row.mean_likes) == (3, 2, 1, 2.0)
    assert [tuple(r) for r in stats.top_hashtags(df).collect()] == [("#a", 2), ("#b", 2)]
    assert sorted(tuple(r) for r in stats.approx_top_hashtags(df).collect()) == [("#a", 2), ("#b", 2)]
    rate = {r.query: (r.posts, r.posts_per_minute) for r in stats.query_rate(df).collect()}
    assert rate == {"Q1": (2, 4.0), "Q2": (1, 60.0), "(all)": (3, 1.5)}
    same, seen = stats.counted(df, "three")
    same.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 3


def test_dense_hours_across_a_stray_timestamp(spark):
    from pulsemill.operators.hourly import dense_hours

    hours = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'1900-01-01 05:00:00', 1.5D, 2L), (TIMESTAMP_NTZ'2024-01-01 00:00:00', NULL, 1L) AS t(time, s, tweet_count)")
    dense = dense_hours(hours)
    hours_apart = int((datetime(2024, 1, 1) - datetime(1900, 1, 1, 5)).total_seconds()) // 3600
    assert dense.count() == hours_apart + 1 and dense.where("tweet_count > 0").count() == 2
    assert dense_hours(hours.limit(0)).count() == 0
    two = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 22:00:00', 1L), (TIMESTAMP_NTZ'2024-01-02 01:00:00', 4L) AS t(time, n)")
    assert [(str(r.time)[11:13], r.n) for r in dense_hours(two, "n").orderBy("time").collect()] == [("22", 1), ("23", 0), ("00", 0), ("01", 4)]
