"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source are laid on lines, one for each of its shards (documents in an order drawn by seed), and
the lines are cut into blocks of equally many words. Each source is given whole blocks, by the highest
quotients target / (2 k + 1), and so are its shards by their sizes. A shard's blocks are taken from the start of
its line, which the seed has shuffled, and a second time once all have been taken.
"""

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pulsemill.llm.names import free_name
from pulsemill.session import cut_lineage

SEED = 20_240
BLOCK_WORDS = 64
# Words of a shard, and the most shards of a source (beyond that shards grow: their rows are narrow).
SHARD_WORDS = 1 << 16
MAX_SHARDS = 4096
REPEATS = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)


def apportion(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by Sainte-Lague: each goes to the highest quotient votes / (2 seats + 1), ties to the earlier party.

    No party gets more than `most`. Starts from the rounded shares and moves single seats.
    """
    import heapq

    seats = min(seats, sum(most))
    exact = [Fraction(v) for v in votes]
    total = sum(exact)
    given = [min(m, int(v * seats / total)) if total else 0 for v, m in zip(exact, most)]
    gains = [(-v / (2 * g + 1), k) for k, (v, g, m) in enumerate(zip(exact, given, most)) if g < m]
    heapq.heapify(gains)
    for _ in range(seats - sum(given)):
        _, k = heapq.heappop(gains)
        given[k] += 1
        if given[k] < most[k]:
            heapq.heappush(gains, (-exact[k] / (2 * given[k] + 1), k))
    # Shares rounded down never exceed a party's due by more than the divisor rule allows, but capped
    # parties pass seats on, so seats are moved until no quotient still to be served beats one served.
    while True:
        served = min(((exact[k] / (2 * g - 1), -k) for k, g in enumerate(given) if g), default=None)
        waiting = max(((exact[k] / (2 * g + 1), -k) for k, g in enumerate(given) if g < most[k]), default=None)
        if served is None or waiting is None or waiting[0] <= served[0]:
            return given
        given[-served[1]] -= 1
        given[-waiting[1]] += 1


def water_level(sizes: list[int], weights: list[float], share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Targets that share out `share` of all sizes by weight, none above `repeats` times its size."""
    caps = [Fraction(repeats * s) for s in sizes]
    left, open_ = Fraction(share) * sum(sizes), set(range(len(sizes)))
    targets = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(Fraction(weights[k]) for k in open_)
        full = {k for k in open_ if left * Fraction(weights[k]) / total >= caps[k]}
        if not full:
            for k in open_:
                targets[k] = left * Fraction(weights[k]) / total
            break
        for k in full:
            targets[k] = caps[k]
            left -= caps[k]
        open_ -= full
        left = max(left, Fraction(0))
    return [float(t) for t in targets]


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How many words the mix takes of every document row.

    docs: doc_id, source, text; other columns are ignored. Sources are ordered by code point, NULL last, and weigh
    3, 1, 2, repeating; see `water_level` for targets. Returns doc_id, source, text_key (xxhash64 of the text),
    size (words between white space; NULL text: 0), source_size, target, taken (0 to 2 * size). Depends on
    the rows only, not on their order or partitions; of rows that agree in all of these columns it is open which
    gets which share. The driver sees one row per source.
    """
    spark = docs.sparkSession
    text_key = F.xxhash64("text")
    sized = cut_lineage(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            "source",
            text_key.alias("text_key"),
            F.xxhash64(F.lit(seed), "doc_id", text_key).alias("draw"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        ),
        "sized",
    )
    totals = sorted(
        ((r.source, int(r.total)) for r in sized.groupBy("source").agg(F.sum("size").alias("total")).collect()),
        key=lambda r: (r[0] is None, (r[0] or "").encode()),
    )
    sizes = [t for _, t in totals]
    targets = water_level(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))])
    seats = [REPEATS * -(-s // block_words) for s in sizes]
    # A source whose target is the most it can give, gives all; the others share the other blocks.
    open_ = [k for k, (s, t) in enumerate(zip(sizes, targets)) if t < REPEATS * s]
    quotas = list(seats)
    shared = round(sum(targets[k] for k in open_) / block_words)
    for k, quota in zip(open_, apportion([targets[k] for k in open_], shared, [seats[k] for k in open_])):
        quotas[k] = quota
    plan = spark.createDataFrame(
        [
            (source, total, target, min(MAX_SHARDS, -(-total // SHARD_WORDS) or 1), quota)
            for (source, total), target, quota in zip(totals, targets, quotas)
        ],
        "source string, source_size bigint, target double, shards int, quota bigint",
    )
    # One row per source, of which the driver has just built the list.
    placed = sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.source)).select(
        sized.doc_id, sized.source, "text_key", "draw", "size", "source_size", "target", "quota",
        F.pmod("draw", "shards").cast("int").alias("shard"),
    )

    def share_out(keys, group: pd.DataFrame) -> pd.DataFrame:
        """Blocks of each shard of a source; at most MAX_SHARDS rows."""
        group = group.sort_values("shard")
        most = (REPEATS * -(-group.words // block_words)).tolist()
        given = apportion(group.words.tolist(), int(group.quota.iloc[0]), most)
        return pd.DataFrame({"q_source": group.source, "q_shard": group.shard, "words": group.words, "blocks": np.array(given, np.int64)})

    shards = placed.groupBy("source", "shard", "quota").agg(F.sum("size").alias("words"))
    shards = shards.groupBy("source").applyInPandas(share_out, "q_source string, q_shard int, words bigint, blocks bigint")
    line = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(line))
    laid = laid.join(shards, laid.source.eqNullSafe(shards.q_source) & (laid.shard == shards.q_shard))

    per_pass = F.ceil(F.col("words") / block_words)
    taken = F.lit(0).cast("bigint")
    for k in range(REPEATS):
        # The k-th time round, blocks up to this word of the line.
        reach = F.greatest(F.lit(0), F.least(per_pass, F.col("blocks") - k * per_pass)) * block_words
        start = F.col("end") - F.col("size")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("end"), reach) - start)
    return laid.select(
        "doc_id", "source", "text_key", "size", "source_size", "target", taken.cast("bigint").alias("taken")
    )


def mixed(docs: DataFrame, **how: int) -> DataFrame:
    """The documents the mix takes words of, all columns as they are, with size, source_size, target and taken.

    Where `docs` has a column of one of these names, its own is kept.
    """
    key, at = free_name(docs, "text_key"), free_name(docs, "number")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    plan = mix(docs, **how).where("taken > 0")

    # Rows that agree in id, source and text are told apart by their number.
    def numbered(df, key, at):
        return df.withColumn(at, F.row_number().over(Window.partitionBy("doc_id", "source", key).orderBy(F.lit(0))))

    a, b = numbered(keyed, key, at), numbered(plan, "text_key", "number")
    on = a.doc_id.eqNullSafe(b.doc_id) & a.source.eqNullSafe(b.source) & (a[key] == b.text_key) & (a[at] == b.number)
    extra = [c for c in ("size", "source_size", "target", "taken") if c not in docs.columns]
    return a.join(b, on).select(*[a[c] for c in docs.columns], *[b[c] for c in extra])
