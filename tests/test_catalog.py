import pytest

import __spark_entry__ as contract
from checks.catalog import QUERIES
from checks.compare import database, differences, type_differences
from checks.oracle import ORACLE
from pulsemill.operators.quality import recent_posts
from pulsemill.operators.hourly import hourly_keyword
from pulsemill.session import new_path
from pulsemill.sources.event_posts import event_posts
from pulsemill.sources.posts_parquet import read_posts, write_by_date
from pulsemill.schema import CLEAN_POST, conform

# The rest is compared by `python -m checks.compare`.
QUICK = (
    "parse_counts", "parse_timestamps", "nfkc_text", "keyword_signal", "reject_report", "topic_match",
    "dedup_id_url", "query_rate", "clean_posts", "hourly_dense", "page_cards",
)


def test_every_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, sf_dir, name):
    db = database(sf_dir)
    sql = contract.oracle_sql()[name]
    df = contract.queries()[name](spark, sf_dir)
    assert differences(df.toPandas(), db.execute(sql).df()) == ""
    assert type_differences(df, db, sql) == ""


def test_stored_posts_are_pruned_by_date_and_column(spark, sf_dir):
    from pyspark.sql import functions as F

    path = new_path(spark, "posts")
    write_by_date(conform(event_posts(spark, sf_dir).withColumns(
        {"hashtags": F.array().cast("array<string>"), "mentions": F.array().cast("array<string>")}), CLEAN_POST), path)
    as_of = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    df = hourly_keyword(recent_posts(read_posts(spark, path), as_of, 24))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-09" in plan
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "ReadSchema: struct<ts:timestamp,content:string,like_count:bigint,retweet_count:bigint,reply_count:bigint>" in plan
