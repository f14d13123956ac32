"""Bootstrap confidence intervals of hourly means.

Each post takes part in replicate b with a Poisson(1) count drawn from a hash of (post id, b). Replicate
sums are ordinary sums, so they combine on the map side, work on a stream, and a hot hour costs no more
memory than a quiet one. What is shuffled is at most tasks x hours x replicates partial sums, whatever
the number of posts. Rows with equal ids draw alike.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as v

METRIC_COLUMNS = ("keyword_signal", "tfidf_signal", "combined_signal")

# Replicates summed side by side in one row: fewer rows and hash lookups per post, while the
# generated code stays small enough to be compiled.
LANES = 4

_WORD = 0xFFFFFFFF
# Odd multipliers below 2^31, so that a product with a 32-bit word fits a BIGINT.
_MIX_A, _MIX_B, _STEP = 0x7FEB352D, 0x21F0AAAD, 0x1E3779B1

# Poisson(1) distribution function at 0..8.
POISSON_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058,
    0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
    0.9999167588507119, 0.9999897508033253, 0.9999988747974020,
)
POISSON_STEPS = tuple(int(p * 2**32) for p in POISSON_CDF)


def seed_words(key: Column) -> tuple[Column, Column]:
    """Low and high word of a post's seed: the id where it is a number, else a hash of it."""
    seed = F.coalesce(key.try_cast("bigint"), F.xxhash64(key))
    return seed.bitwiseAND(F.lit(_WORD)), F.shiftright(seed, 32).bitwiseAND(F.lit(_WORD))


def _low_word(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_WORD))


def _fold(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, bits))


def _count_of(drawn: Column) -> Column:
    """Poisson(1) count of a uniform 32-bit draw."""
    count = F.lit(len(POISSON_STEPS))
    for n in range(len(POISSON_STEPS) - 1, -1, -1):
        count = F.when(drawn < F.lit(POISSON_STEPS[n]), F.lit(n)).otherwise(count)
    return count


# A hash round multiplies a 32-bit word, keeps the low word and folds high bits in. Two rounds, the
# high word of the seed between them. Each step is a column of its own: a step uses its input
# twice, and one nested expression would double with every step.
_HASH_STEPS = (
    lambda x, high: _low_word(_fold(x, 16) * F.lit(_MIX_A)),
    lambda x, high: _low_word(_fold(x, 15) * F.lit(_MIX_B)),
    lambda x, high: _fold(x, 16).bitwiseXOR(high),
    lambda x, high: _low_word(_fold(x, 16) * F.lit(_MIX_A)),
    lambda x, high: _low_word(_fold(x, 15) * F.lit(_MIX_B)),
    lambda x, high: _fold(x, 16),
    lambda x, high: _count_of(x),
)


def expand_lanes(scored: DataFrame, replicates: int, key="tweet_id") -> DataFrame:
    """Each post once per block of replicates, with the block's Poisson counts in w0..w3.

    A count depends on the post id and the replicate alone, so all metrics of a post share it.
    """
    blocks = -(-replicates // LANES)
    low, high = seed_words(F.col(key))
    seeded = scored.withColumns({"_low": low, "_high": high})
    spread = seeded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    start = F.col("block").cast("bigint") * LANES
    drawn = spread.withColumns(
        {f"w{k}": _low_word(F.col("_low") + (start + k) * F.lit(_STEP)) for k in range(LANES)}
    )
    for step in _HASH_STEPS:
        drawn = drawn.withColumns({f"w{k}": step(F.col(f"w{k}"), F.col("_high")) for k in range(LANES)})
    return drawn.drop("_low", "_high")


def lane_sums(metrics=METRIC_COLUMNS) -> list[Column]:
    """Aggregates of one block: weight and weighted sums per lane, and the plain count and sums."""
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(m).alias(f"sum_{m}") for m in metrics]
    for k in range(LANES):
        sums.append(F.sum(f"w{k}").alias(f"sum_w{k}"))
        sums += [F.sum(F.col(f"w{k}") * F.col(m)).alias(f"sum_w{k}_{m}") for m in metrics]
    return sums


def block_sums(scored: DataFrame, by: str, replicates: int, metrics=METRIC_COLUMNS, key="tweet_id"):
    """Sums per group and block.

    The narrow rows are gathered by group first, so that a task combines many posts of few groups;
    the rebalance step splits a group that is too large for one task. It gathers by a hash of the
    group: partitioned by the group itself, the rows would already satisfy the aggregation, which
    would then run without a partial step, and nothing could be split.
    """
    narrow = scored.select(by, key, *metrics, F.xxhash64(by).alias("_gather"))
    narrow = narrow.hint("rebalance", F.col("_gather")).drop("_gather")
    return expand_lanes(narrow, replicates, key).groupBy(by, "block").agg(*lane_sums(metrics))


def _quantile(ordered: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    below = F.floor(at).cast("int")
    low, high = F.get(ordered, below), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - below)


def intervals(blocks: DataFrame, by: str, replicates: int, alpha=v.BOOTSTRAP_ALPHA, metrics=METRIC_COLUMNS):
    """Mean, percentile interval and count per group from block sums.

    A replicate that drew no post has no mean and is left out. What meets in one group is at most
    `replicates` means per metric, whatever the number of posts.
    """

    def lane_means(m):
        means = [
            F.when(
                (F.col(f"sum_w{k}") > 0) & (F.col("block") * LANES + k < replicates),
                F.col(f"sum_w{k}_{m}") / F.col(f"sum_w{k}"),
            )
            for k in range(LANES)
        ]
        return F.array_compact(F.array(*means)).alias(m)

    plain = [(F.col(f"sum_{m}") / F.col("n")).alias(f"mean_{m}") for m in metrics]
    means = blocks.select(by, "block", "n", *plain, *[lane_means(m) for m in metrics])
    first = F.col("block") == 0
    grouped = means.groupBy(by).agg(
        F.max("n").alias("tweet_count"),
        *[F.max(F.when(first, F.col(f"mean_{m}"))).alias(f"mean_{m}") for m in metrics],
        *[F.sort_array(F.flatten(F.collect_list(m))).alias(f"all_{m}") for m in metrics],
    )
    out = []
    for m in metrics:
        out += [
            F.col(f"mean_{m}").alias(m),
            _quantile(F.col(f"all_{m}"), alpha / 2).alias(_bound(m, "low")),
            _quantile(F.col(f"all_{m}"), 1 - alpha / 2).alias(_bound(m, "high")),
        ]
    return grouped.select(by, *out, "tweet_count")


def _bound(metric: str, side: str) -> str:
    return metric.replace("_signal", f"_ci_{side}")


def poisson_intervals(
    scored: DataFrame, by="time", replicates=v.BOOTSTRAP_REPLICATES, alpha=v.BOOTSTRAP_ALPHA,
    metrics=METRIC_COLUMNS, key="tweet_id",
) -> DataFrame:
    return intervals(block_sums(scored, by, replicates, metrics, key), by, replicates, alpha, metrics)
