"""Processed posts to the hourly signal table."""

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as v
from ..operators import hourly, tfidf


def signal_table(
    posts: DataFrame, replicates=v.BOOTSTRAP_REPLICATES, model: tfidf.TermModel | None = None, **options
) -> DataFrame:
    """Fit the latent score on the posts (unless a model is given), score, and aggregate by hour."""
    dated = posts.where(F.col("ts").isNotNull())
    model = model or tfidf.fit(dated)
    return hourly.hourly_signals(hourly.score_posts(dated, model), replicates, **options)
