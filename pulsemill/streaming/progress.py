"""What became of the posts of each batch: old, late behind the watermark, accepted.

Old posts are counted by an observed metric before anything is dropped. Late ones are dropped inside the deduplication,
and only its operator knows how many, so they are read from the query's progress. Accepted ones are counted behind it.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "batch_id BIGINT, posts BIGINT, old_posts BIGINT, late_posts BIGINT, accepted_posts BIGINT"


def count_accepted(posts: DataFrame, name="post_kept") -> DataFrame:
    return posts.observe(name, F.count(F.lit(1)).alias("accepted_posts"))


def counts_of(progress, age="post_age", kept="post_kept") -> tuple | None:
    """A row of COUNTS from one batch's progress; None for a batch without posts.

    Late posts are those the deduplication dropped. Operators behind it see its output only, so nothing is counted twice.
    """
    seen = progress.observedMetrics
    if not progress.numInputRows or age not in seen:
        return None
    late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators if s.operatorName.startswith("dedupe"))
    accepted = seen[kept]["accepted_posts"] if kept in seen else None
    return progress.batchId, seen[age]["posts"], seen[age]["old_posts"], late, accepted


class BatchCounts(StreamingQueryListener):
    """Counts of all batches since it was added, also of streams that run longer than Spark keeps their progress.

    A batch that is repeated after a restart replaces its earlier counts.
    """

    def __init__(self):
        self.rows: dict[tuple[str, int], tuple] = {}

    def add(self, progress) -> None:
        row = counts_of(progress)
        if row:
            self.rows[str(progress.id), row[0]] = row

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def finish(self, query) -> "BatchCounts":
        """Take in what the listener may not have been told yet when the query ended."""
        for progress in query.recentProgress:
            self.add(progress)
        return self

    def table(self, spark: SparkSession, query) -> DataFrame:
        mine = sorted(r for (of, _), r in self.rows.items() if of == str(query.id))
        return spark.createDataFrame(mine, COUNTS)

    def store(self, spark: SparkSession, query, path: str) -> None:
        """Keep the counts of each batch below `path`, in a folder of its own; a repeated batch replaces its folder."""
        rows = self.table(spark, query)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in COUNTS.split(",")]
    return spark.read.schema(COUNTS).parquet(path).select(*names)
