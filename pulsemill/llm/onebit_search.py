"""Approximate nearest neighbours by inner product, on randomly rotated one-bit codes.

A vector less the centre is rotated into a space of more dimensions and each coordinate reduced to its sign. Packed
signs and two scalars (distance to the centre, and how well the code fits: its inner product with the rotated
vector) give an unbiased estimate of the inner product with any query, and a bound of its error that holds with high
probability. Queries are reduced to integers of `QUERY_BITS` bits, so that an estimate is a few ANDs and bit counts.
The best by estimate are computed exactly first; all vectors whose upper bound reaches the last of them are
reranked on the original numbers.

Vectors and queries are dealt into blocks by hash of their id and every block of queries meets every block of
vectors, so equal vectors do not gather anywhere.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemill.session import cut_lineage

NEAREST = 20
# The centre is the mean of this many vectors at most, those with the smallest hashes of their ids.
FIT_ROWS = 10_000
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
# Code bits for each dimension of a vector.
WIDTH = 4
QUERY_BITS = 4
# Half-width of the error interval in standard deviations.
CONFIDENCE = 3.0
SEED = 7

# Numbers beyond 2^LARGE are scaled by powers of two before they are squared.
LARGE = 400

_INDEX = "row bigint, vec_id bigint, vector binary, code binary, radius double, fit double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Orthonormal columns: `dim` coordinates into a multiple of 64, WIDTH times as many at least."""
    bits = 64 * math.ceil(dim * WIDTH / 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """Not NULL, with finite components only, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _length(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares would leave the range of doubles."""
    most = np.abs(rows).max(axis=1, initial=0)
    most = np.where(most > 0, most, 1)
    return most * np.linalg.norm(rows / most[:, None], axis=1)


def _exponent(most: float) -> int:
    """The power of two to divide by: none for numbers of usual size."""
    power = math.frexp(most)[1]
    return power if power > LARGE else 0


def index(vectors: DataFrame, dim: int, centre: np.ndarray, seed: int = SEED, power: int = 0) -> DataFrame:
    """Code and scalars of every row of (row, vec_id, embedding), divided by 2^power like the centre."""
    turn = rotation(dim, seed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                yield _coded(batch.slice(at, 2048), dim, centre, turn, power)

    return vectors.select("row", "vec_id", "embedding").mapInArrow(scan, _INDEX)


def _coded(batch: pa.RecordBatch, dim: int, centre: np.ndarray, turn: np.ndarray, power: int) -> pa.RecordBatch:
    v = np.ldexp(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), -power)
    off = (v - centre) @ turn.T
    radius = _length(off)
    fit = np.abs(off).sum(axis=1) / (np.where(radius > 0, radius, 1) * math.sqrt(off.shape[1]))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"),
            batch.column("vec_id"),
            pa.array([x.tobytes() for x in v], pa.binary()),
            pa.array([x.tobytes() for x in np.packbits(off > 0, axis=1)], pa.binary()),
            pa.array(radius),
            pa.array(fit),
        ],
        names=["row", "vec_id", "vector", "code", "radius", "fit"],
    )


def search(embeddings: DataFrame, queries: Column, nearest: int = NEAREST, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """The `nearest` vectors with the largest inner products with each query, its own excepted.

    embeddings: vec_id, embedding; other columns are ignored. queries: condition on `vec_id`. Returns query_id, rank (from
    1), vec_id, score (exact inner product in double precision), ties to the smaller id; fewer rows where
    there are fewer vectors. Rows with a NULL id or an unusable vector (see `usable`) take no part. Every other row is
    a candidate, and a query where the condition holds, also where rows share an id (a query meets no row of its own
    id). Vectors are searched among those of their length. A score beyond the range of doubles is infinite, and ranked by
    its true size. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = (
        embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("dim", F.size("embedding"))
    )
    vectors = cut_lineage(vectors, "vectors")
    most = F.max(F.array_max(F.transform("embedding", F.abs)))
    lengths = vectors.groupBy("dim").agg(most.alias("most"), F.count("*").alias("n"), F.count_if(queries).alias("asked"))
    found = None
    for r in lengths.where("asked > 0").orderBy("dim").collect():  # lengths, not rows
        one = _of_length(vectors.where(F.col("dim") == r["dim"]), queries, r, nearest, confidence, seed)
        found = one if found is None else found.union(one)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if found is None else found


def _of_length(vectors: DataFrame, queries: Column, size, nearest: int, confidence: float, seed: int) -> DataFrame:
    dim, n, n_asked, power = size["dim"], size["n"], size["asked"], _exponent(size["most"])
    fitted = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(FIT_ROWS).toArrow().column("embedding")
    centre = np.ldexp(np.array(fitted.to_pylist(), np.float64), -power).mean(axis=0)

    coded = cut_lineage(index(vectors, dim, centre, seed, power), "codes")
    blocks, groups = math.ceil(n / BLOCK_ROWS), max(1, math.ceil(n_asked / BLOCK_QUERIES))
    place = F.xxhash64("row")
    rows = coded.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int"))
    rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # A stated set of queries meets all vectors, block by block.
    asked = coded.where(queries).select(
        F.col("row").alias("asked"),
        F.col("vec_id").alias("query_id"),
        F.col("vector").alias("query"),
        F.pmod(place, F.lit(groups)).cast("int").alias("group"),
    )
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    turn = rotation(dim, seed)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, centre, turn, nearest, confidence, power)

    met = rows.groupBy("block", "group").cogroup(asked.groupBy("block", "group"))
    met = met.applyInPandas(meet, "asked bigint, query_id bigint, vec_id bigint, score double, scaled double")
    best = Window.partitionBy("asked").orderBy(F.desc("scaled"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
    )


def _nearest(rows: pd.DataFrame, asked: pd.DataFrame, centre, turn, nearest: int, confidence: float, power: int) -> pd.DataFrame:
    """The best of one block of vectors for one block of queries."""
    found = []
    if len(rows) and len(asked):
        dim, bits = len(centre), len(turn)
        ids = rows.vec_id.to_numpy()
        v = np.frombuffer(b"".join(rows.vector), np.float64).reshape(-1, dim)
        code = np.frombuffer(b"".join(rows.code), np.uint64).reshape(len(rows), -1)
        radius, fit = rows.radius.to_numpy(), rows.fit.to_numpy()
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        fit = np.where(fit > 0, fit, 1)
        spread = np.sqrt(np.maximum(1 / fit**2 - 1, 0) / (bits - 1))
        q_ids = asked.query_id.to_numpy()
        q = np.frombuffer(b"".join(asked["query"]), np.float64).reshape(-1, dim)
        # Where vectors were scaled, queries are brought to the size of 1, each by its own power of two.
        own = np.frexp(np.abs(q).max(axis=1))[1] if power else np.zeros(len(q), np.int64)
        q = np.ldexp(q, -own[:, None])
        turned = q @ turn.T
        low = turned.min(axis=1)
        step = (turned.max(axis=1) - low) / (2**QUERY_BITS - 1)
        step = np.where(step > 0, step, 1)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        rest = _length(turned - low[:, None] - step[:, None] * level)
        planes = [np.packbits((level >> k) & 1, axis=1).view(np.uint64) for k in range(QUERY_BITS)]
        length = _length(q)
        for k in range(len(asked)):
            dot = np.zeros(len(rows), np.int64)
            for b, plane in enumerate(planes):
                for word in range(code.shape[1]):
                    dot += np.bitwise_count(code[:, word] & plane[k, word]).astype(np.int64) << b
            # Signs are 2 * bit - 1: the sum of the query over the signs, then by the code's own length and fit.
            signed = 2 * (step[k] * dot + low[k] * ones) - (step[k] * level[k].sum(dtype=np.int64) + low[k] * bits)
            guess = q[k] @ centre + radius * signed / (math.sqrt(bits) * fit)
            error = confidence * radius * (length[k] * spread + rest[k] / (math.sqrt(bits) * fit))
            guess[ids == q_ids[k]] = -np.inf
            some = min(2 * nearest, len(rows))
            first = np.argpartition(-guess, some - 1)[:some]
            exact = (v[first] * q[k]).sum(axis=1)
            exact[np.isneginf(guess[first])] = -np.inf
            bar = np.partition(exact, -nearest)[-nearest] if some >= nearest else -np.inf
            chosen = np.flatnonzero((guess + error >= bar) & ~np.isneginf(guess))
            exact = (v[chosen] * q[k]).sum(axis=1)
            order = np.lexsort((ids[chosen], -exact))[:nearest]
            scaled = exact[order]
            with np.errstate(over="ignore"):
                score = np.ldexp(scaled, 2 * power + int(own[k])) if power else scaled
            found.append((np.full(len(order), asked.asked.iloc[k]), np.full(len(order), q_ids[k]), ids[chosen][order], score, scaled))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
    return pd.DataFrame(dict(zip(("asked", "query_id", "vec_id", "score", "scaled"), columns)))
