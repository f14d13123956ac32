"""How far the word use of each source lies from its language's and from other sources'.

Counting is by sorting pointers: in each piece of an Arrow text buffer a pointer marks the start of every word, and the
pointers are sorted by the 8 bytes of text they point at, then, where those are equal, by the next 8 (multikey
quicksort whose characters are slices of 8 bytes). A run of equal words of one source yields the word's occurrences and
the number of documents, for a document's pointers stand together in it. Words are copied once per run, not once per
occurrence. Runs of all pieces are summed by source, so that a very common word or source is one row a task.

A group is a (lang, source). Divergences need a value for every kept term and every pair of sources, also where a term
does not occur. These are not written out: with f0 the value of a term that neither source has, the sum over all V
terms is V f0, plus what each source's own terms add against a source without them (few different counts, so a
histogram of counts suffices), plus a correction for the terms that both have. All of it is integer arithmetic.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemill.llm.arrow_text import LOWER, bytes_of, pieces
from pulsemill.session import cut_lineage

# A term is kept in a language if this many of its documents hold it.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
# Bytes of text whose pointers are sorted together; a longer single text is sorted by itself.
SLICE_BYTES = 4 << 20

# Letters a-z and all bytes of characters beyond ASCII, after lower-casing.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word of lower-cased `data`, and the number of its text."""
    inside = _LETTER[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) + 1 - start
    return start, length, np.searchsorted(offsets, start, side="right") - 1


def equal_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in an order where equal words of one group stand together, texts ascending, and where each run begins."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    label = group.astype(np.int64)
    free = int(label.max(initial=-1)) + 1
    active, depth = np.arange(len(start)), 0
    while len(active):
        rest = length[active] - depth
        at = start[active] + depth
        key = padded[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
        spare = (8 * np.maximum(8 - rest, 0)).astype(np.uint64)  # bits past the word's end
        key = (key >> spare) << spare
        longer = rest > 8
        order = np.lexsort((longer, key, label[active]))
        active, key, longer = active[order], key[order], longer[order]
        old = label[active]
        new = np.ones(len(active), bool)
        new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1]) | (longer[1:] != longer[:-1])
        run = np.cumsum(new) - 1
        label[active] = free + run
        free += int(run[-1]) + 1
        # Longer words go on, unless they are alone already.
        active = active[longer & (np.bincount(run)[run] > 1)]
        depth += 8
    order = np.argsort(label, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = label[order[1:]] != label[order[:-1]]
    return order, np.flatnonzero(first)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = bytes_of(batch.column("text"))
    data = LOWER[raw]
    start, length, doc = pointers(data, offsets)
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    order, runs = equal_runs(data, start, length, group[doc])
    of = doc[order]
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = of[1:] != of[:-1]
    fresh[runs] = 1
    head = order[runs]
    n = np.diff(np.append(runs, len(order)))
    docs = np.add.reduceat(fresh, runs) if len(runs) else n
    ends = np.cumsum(length[head])
    begins = ends - length[head]
    text = data[np.repeat(start[head] - begins, length[head]) + np.arange(int(ends[-1]) if len(ends) else 0)]
    places = np.append(0, ends).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(places.tobytes()), pa.py_buffer(text.tobytes())).cast(pa.string())
    mine = pa.array(doc[head])
    columns = [batch.column("lang").take(mine), batch.column("source").take(mine), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences (n) and documents (docs) of every term in every (lang, source); see `audit` for what is read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=SLICE_BYTES):
            yield _counted(batch)

    runs = _texts(docs).mapInArrow(scan, _COUNTS)
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _share(count, total, kinds) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 kinds)); NULL without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    low = wide(total + 2 * kinds)
    high = F.lit(UNIT).cast("decimal(10,0)") * wide(count + 2)
    return F.when(kinds > 0, 1 + F.call_function("div", high, low)).cast("bigint")


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Divergence of every (lang, source) from the other sources of its language, and the terms it uses most beyond it.

    docs: text, lang, source; other columns are ignored, whatever their names. NULL in any of the three is the empty
    string. Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased, of any length; every row is a document,
    repeated rows too. A language keeps the terms of at least `least` of its documents.

    Returns lang, source, part, item, value, rank. Part `pair`: item is another source of the language, value the sum over
    all kept terms (0 if there is none). Part `term`: item is one of the `top` kept terms by value that
    occur in the group at a greater share than in the language. Ties go by item in UTF-8 order. A group without
    terms has its pairs; an empty table gives no rows.
    """
    counts = cut_lineage(term_counts(docs), "term-counts")
    same = Window.partitionBy("lang", "term")  # one row a source at most
    kept = counts.withColumns(
        {
            "in_docs": F.sum("docs").over(same),
            "lang_n": F.sum("n").over(same),
            "lead": (F.col("source") == F.min("source").over(same)).cast("bigint"),
        }
    ).where(F.col("in_docs") >= least)
    kept = cut_lineage(kept.select("lang", "term", "source", "n", "lang_n", "lead"), "kept-terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("lead").alias("kinds"))
    groups = _texts(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "kinds"])
    groups = groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("kinds")))
    groups = cut_lineage(groups, "groups")

    placed = kept.join(groups, ["lang", "source"])
    placed = placed.withColumn("p", _share(F.col("n"), F.col("total"), F.col("kinds")))
    usual = placed.withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))).where("p > q")
    terms = usual.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))

    found = _ranked(terms).where(F.col("rank") <= top).unionByName(_ranked(_pairs(groups, placed)))
    return found


def _pairs(groups: DataFrame, placed: DataFrame) -> DataFrame:
    """Value of every ordered pair of sources of a language."""
    pick = lambda df, name, *more: df.select("lang", *[F.col(c).alias(f"{c}_{name}") for c in ("source", "p0", *more)])
    f0 = _apart(F.col("p0_a"), F.col("p0_b"))
    one, two = pick(groups, "a", "kinds"), pick(groups, "b")
    ends = ("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"))
    none = one.join(two, "lang").where("source_a < source_b").select(*ends, F.coalesce(F.col("kinds_a") * f0, F.lit(0)).alias("v"))

    # A source's own terms against another source without them, for each different count.
    histogram = placed.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("times"))
    alone = pick(histogram, "a", "p", "times").join(two, "lang").where("source_a <> source_b")
    lone = F.col("times_a") * (_apart(F.col("p_a"), F.col("p0_b")) - f0)
    alone = alone.select("lang", F.least("source_a", "source_b").alias("a"), F.greatest("source_a", "source_b").alias("b"), lone.alias("v"))

    # Terms that both have: their own value in place of the two above.
    both = pick(placed, "a", "p", "term").withColumnRenamed("term_a", "term")
    both = both.join(pick(placed, "b", "p", "term").withColumnRenamed("term_b", "term"), ["lang", "term"]).where("source_a < source_b")
    met = _apart(F.col("p_a"), F.col("p_b")) - _apart(F.col("p_a"), F.col("p0_b")) - _apart(F.col("p0_a"), F.col("p_b")) + f0
    both = both.select(*ends, met.alias("v"))

    summed = none.union(alone).union(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", way.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
