"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, each of some feature pairs a table over a grid of bins; a score
is the logistic of the sum. The tables are learned by cyclic boosting: in turn, every feature gets a shallow
tree (three leaves) fitted to the gradients with a small step; afterwards the pairs with most to gain get trees
that cut both features once (four leaves). Scoring is binning and adding table entries, a batch at a time.

The model is fitted on a bounded sample of the labelled rows (`FIT_ROWS`, those with the smallest hashes of
their ids), in the driver; the sample's features take a few MB. Everything is deterministic.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsemill.llm.arrow_text import pieces

# Most labelled rows that a fit uses.
FIT_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 120
STEP = 0.15
# Ridge of the leaf values, in units of summed curvature.
RIDGE = 1.0
THRESHOLD = 0.7

_MARKS = re.compile(r"[^\w\s]{2,}")
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "mark", "odd_mark", "beyond_ascii", "line_words",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_lines", "double_marks", "bare_marks",
    "sentence_ends",
)

_CLASS = np.zeros(256, np.int8)  # 1 upper, 2 lower, 3 digit, 4 ordinary mark, 5 odd mark, 6 beyond ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 4 if chr(_c) in ".,;:'\"()-?!" else 5


def features(text: str | None) -> list[float]:
    """The values of FEATURES for a text; NULL is empty."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    n = len(data)
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7) if n else np.zeros(7)
    words = text.split()
    w = len(words)
    lines = [line for line in text.split("\n") if line]
    share = lambda x, of: float(x) / of if of else 0.0
    letters = counts[1] + counts[2]
    tally = Counter(words)
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        share(sum(map(len, words)), w),
        share(counts[1], letters),
        share(counts[3], n),
        share(counts[4], n),
        share(counts[5], n),
        share(counts[6], n),
        share(w, len(lines)),
        share(len(tally), w),
        share(max(tally.values(), default=0), w),
        share(sum(a == b for a, b in zip(words, words[1:])), w),
        share(len(set(zip(words, words[1:]))), max(w - 1, 0)),
        share(len(set(lines)), len(lines)),
        share(len(_MARKS.findall(text)), w),
        share(sum(len(x) == 1 and not x.isalnum() for x in words), w),
        share(text.count(". ") + text.count(".\n") + text.endswith("."), w),
    ]


@dataclass
class Model:
    """Bin edges and tables by feature, and tables by pair of features (on coarser bins)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of feature values."""
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _leaf(g, h):
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the best tree with up to three leaves: the best cut, then the best second cut."""
    cuts: list[int] = []
    for _ in range(2):
        best, at = 1e-9, None
        for low, high in zip([0, *cuts], [*cuts, len(g)]):
            if high - low < 2:
                continue
            left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
            all_g, all_h = g[low:high].sum(), h[low:high].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            if gains.max() > best:
                best, at = gains.max(), low + 1 + int(gains.argmax())
        if at is not None:
            cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for low, high in zip([0, *cuts], [*cuts, len(g)]):
        out[low:high] = _leaf(g[low:high].sum(), h[low:high].sum())
    return out


def _crossed(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both axes of a grid once."""
    sums = [np.zeros((g.shape[0] + 1, g.shape[1] + 1)) for _ in range(2)]
    for total, part in zip(sums, (g, h)):
        total[1:, 1:] = part.cumsum(0).cumsum(1)
    gg, hh = sums
    quarters = lambda s: (s[:, :], s[:, -1:] - s, s[-1:, :] - s, s[-1, -1] - s[:, -1:] - s[-1:, :] + s)
    gains = sum(_gain(a, b) for a, b in zip(quarters(gg), quarters(hh)))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g)
    for rows in (slice(0, i), slice(i, None)):
        for columns in (slice(0, j), slice(j, None)):
            out[rows, columns] = _leaf(g[rows, columns].sum(), h[rows, columns].sum())
    return float(gains[i, j] - _gain(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn the tables from feature rows and labels 0/1; without rows of both labels, the smoothed share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    columns = range(x.shape[1])
    model.edges = [_edges(x[:, k], BINS) for k in columns]
    model.coarse = [_edges(x[:, k], PAIR_BINS) for k in columns]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes(at, size):
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for k in columns:
            change = STEP * _tree(*slopes(bins[k], len(model.tables[k])))
            model.tables[k] += change
            total += change[bins[k]]
    cells = {}
    gains = []
    for i in columns:
        for j in range(i):
            shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
            cell = rough[i] * shape[1] + rough[j]
            g, h = slopes(cell, shape[0] * shape[1])
            gains.append((_crossed(g.reshape(shape), h.reshape(shape))[0], i, j))
            cells[i, j] = cell, shape
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs[i, j] = np.zeros(cells[i, j][1])
    for _ in range(ROUNDS // 2):
        for (i, j), table in model.pairs.items():
            cell, shape = cells[i, j]
            g, h = slopes(cell, shape[0] * shape[1])
            change = STEP * _crossed(g.reshape(shape), h.reshape(shape))[1]
            table += change
            total += change.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text leaves 2 when divided by 4 (a NULL id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> Model:
    """Fit on at most `max_rows` labelled documents outside the held-out part.

    labels: doc_id, quality (0/1; NULL is no label; of repeated labels the greater counts). Of several rows of one doc_id
    the text of the least hash counts, so that the driver gets `max_rows` rows of features at most, whatever is repeated.
    Without a labelled document, empty tables too, the model scores 0.5 throughout.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # The broadcast holds `max_rows` narrow rows at most.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "text", F.xxhash64("text").alias("text_key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [features(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("label").cast(pa.int32()), batch.column("text_key"), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "text_key", "x"])

    found = rows.mapInArrow(scan, "doc_id bigint, label int, text_key bigint, x array<double>")
    once = found.groupBy("doc_id").agg(F.min(F.struct("text_key", "x", "label")).alias("of"))
    got = once.select("doc_id", "of.label", "of.x").toArrow().combine_chunks()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    return fit(x[order], got.column("label").to_numpy()[order].astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and score of every document row.

    Only the text is scored: NULL and empty texts have features of zero, repeated rows equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(shared.value.score(x))], names=["doc_id", "text_key", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(scan, "doc_id bigint, text_key bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score `threshold` or more, all columns as they are, without a shuffle.

    NULL and empty texts are scored with features of zero, very long ones whole; repeated rows go or stay together, and an
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(scan, docs.schema)
