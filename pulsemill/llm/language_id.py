"""Language identification by words first, with backoff to character n-grams.

Every word of a text votes with its log frequency in each language. A word no language knows is cut into
character n-grams (with marks at its ends), the longest first; where none of a length is known, the next
shorter length votes. The language with the greatest sum wins.

Frequencies come from a bounded sample of labelled documents (`FIT_DOCS` of each language, those with the smallest
hashes of their ids) and are counted by Spark. The model keeps every word and n-gram of the sample, each with the
languages that know it only; the sample bounds what is broadcast.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemill.llm.arrow_text import pieces

FIT_DOCS = 3_000
LENGTHS = (4, 3, 2, 1)
# Weight of an n-gram vote for each step down from a word.
BACKOFF = 0.4
UNKNOWN = "und"
_MEMO = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def grams_of(word: str, length: int) -> list[str]:
    marked = word if length == 1 else f"<{word}>"
    return [marked[k : k + length] for k in range(len(marked) - length + 1)]


@dataclass
class Model:
    """Log frequencies of words and n-grams: of term k, entries first[k] to first[k + 1] of `lang` and `more`.

    `floors` holds, for words and each length, the log frequency of a term that a language does not know; `more` is how
    far a language that knows the term is above it.
    """

    languages: list[str]
    rows: list[dict[str, int]]  # words, then n-grams by LENGTHS
    floors: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    more: np.ndarray

    def total(self, kind: int, terms: list[int]) -> np.ndarray:
        """Sum of the log frequencies of some terms, by language."""
        at = np.array(terms, np.int64)
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        entries = np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.floors[kind] * len(terms) + np.bincount(self.lang[entries], self.more[entries], len(self.languages))

    def vote(self, word: str) -> np.ndarray:
        """Votes of an unknown word; the shortest n-grams may be unknown too, then it has none."""
        for kind, (length, known) in enumerate(zip(LENGTHS, self.rows[1:]), 1):
            found = [known[g] for g in grams_of(word, length) if g in known]
            if found:
                return self.total(kind, found) / len(found) * BACKOFF**kind
        return np.zeros(len(self.languages))

    def predict(self, text: str | None, memo: dict[str, np.ndarray]) -> tuple[str, float]:
        """Language and its share of the probability; `und` and 0 without a letter or a learned language."""
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        known = self.rows[0]
        at = [known.get(w, -1) for w in words]
        total = self.total(0, [k for k in at if k >= 0])
        for k, word in zip(at, words):
            if k < 0:
                vote = memo.get(word)
                if vote is None:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    vote = memo[word] = self.vote(word)
                total = total + vote
        odds = np.exp(total - total.max())
        best = int(total.argmax())  # ties: the first language by name
        return self.languages[best], float(odds[best] / odds.sum())


def held_out(doc_id: Column) -> Column:
    """Rows nothing is learned from: crc32 of the id as text leaves 1 when divided by 3 (a NULL id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Count words and n-grams of documents outside the held-out part that have a `lang`.

    Rows without a lang or a doc_id teach nothing, texts without a letter nothing either; very long texts count whole.
    An empty table gives a model without languages.
    """
    chosen = _chosen(docs, fit_docs)
    # `fit_docs` narrow rows of each language.
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tally: dict[tuple[int, str], int] = {}
                for word in words_of(text):
                    tally[0, word] = tally.get((0, word), 0) + 1
                    for kind, length in enumerate(LENGTHS, 1):
                        for gram in grams_of(word, length):
                            tally[kind, gram] = tally.get((kind, gram), 0) + 1
                kinds, terms = zip(*tally) if tally else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(tally), pa.string()),
                        pa.array(kinds, pa.int32()),
                        pa.array(terms, pa.string()),
                        pa.array(tally.values(), pa.int64()),
                    ],
                    names=["lang", "kind", "term", "n"],
                )

    counted = rows.mapInArrow(scan, "lang string, kind int, term string, n bigint")
    counted = counted.groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    return _model(counted.toArrow())  # terms of the sample


def _chosen(docs: DataFrame, fit_docs: int) -> DataFrame:
    """doc_id and lang of the sample; repeated rows count towards `fit_docs`.

    Hashes are counted by their first 12 bits, so that only rows of the slots the sample reaches into
    are ordered by language, however many a language has.
    """
    draw = F.xxhash64("doc_id")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", "lang", draw.alias("draw"), F.shiftright(draw, 52).alias("slot")
    )
    before = Window.partitionBy("lang").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        labelled.groupBy("lang", "slot")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where(F.col("before") < fit_docs)
        .groupBy(F.col("lang").alias("of"))
        .agg(F.max("slot").alias("last"))
    )
    # One row of each language.
    near = labelled.join(F.broadcast(reached), (F.col("lang") == F.col("of")) & (F.col("slot") <= F.col("last")))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return (
        near.select("doc_id", "lang", "draw")
        .distinct()
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= fit_docs)
        .select("doc_id", "lang")
    )


def _model(counted: pa.Table) -> Model:
    languages = sorted(set(counted.column("lang").to_pylist()))
    number = {lang: k for k, lang in enumerate(languages)}
    listed = sorted(zip(*[counted.column(c).to_pylist() for c in ("kind", "term", "lang", "n")]))
    sizes = np.zeros((len(LENGTHS) + 1, len(languages)))
    for kind, _, lang, n in listed:
        sizes[kind, number[lang]] += n
    # Half an occurrence for languages that do not know the term.
    floors = np.log(0.5 / (sizes + 1))
    rows: list[dict[str, int]] = [{} for _ in range(len(LENGTHS) + 1)]
    first = []
    for k, (kind, term, *_) in enumerate(listed):
        if term not in rows[kind]:
            rows[kind][term] = len(first)
            first.append(k)
    kinds = np.array([x[0] for x in listed], np.int64)
    lang = np.array([number[x[2]] for x in listed], np.int64)
    times = np.array([x[3] for x in listed], np.float64)
    more = np.log(times / (sizes[kinds, lang] + 1)) - floors[kinds, lang]
    return Model(languages, rows, floors, np.array([*first, len(listed)], np.int64), lang, more)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every document row.

    docs: doc_id, text; other columns are ignored. Returns doc_id, text_key (xxhash64 of the text), lang_pred, score
    (probability of lang_pred). NULL and empty texts and texts without a letter are `und` with score 0, also
    where no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            found = [shared.value.predict(t, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "text_key", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(scan, "doc_id bigint, text_key bigint, lang_pred string, score double")
