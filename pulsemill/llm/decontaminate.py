"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `window` consecutive words (a shorter item is one window). A window counts as
the set of its word shingles. For it to stand in a text, all of its shingles must, so its rarest shingle is a
sufficient prefix: only that one is joined. Rarity is counted over all documents. A match must leave room
for the window before and after it (positional and length bounds) and is then compared word by word.

Python hashes the shingles of the documents batch by batch and keeps those that hit a bitmap of fixed size;
only they are shuffled. False hits of the bitmap or of the hash are removed by the comparison.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsemill.llm.arrow_text import Words, pieces
from pulsemill.llm.bitmap import bitmap, in_bitmap
from pulsemill.llm.names import free_name
from pulsemill.session import cut_lineage

WINDOW = 10
SHINGLE = 5

_WINDOWS = "item_id string, words string, n_words int, size int, tokens array<bigint>"
_COUNTS = "token bigint, n bigint"
_SCANNED = "doc_id bigint, text_key bigint, n_words bigint, matches array<struct<token: bigint, at: int, before: int, context: string>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Benchmark words in every document.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. One row per document row: doc_id,
    text_key (xxhash64 of the text), n_words, n_hit (words inside occurrences of a window), n_items (items
    with such windows), items_sha256, contaminated. NULL and empty texts have no words; an item without words
    never occurs; items of one id count once; repeated document rows give repeated rows. An empty benchmark
    contaminates nothing.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    items = cut_lineage(_item_windows(benchmark, window, shingle), "items")
    windows = items.select("words", "n_words", "size", "tokens").distinct()
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # at most `shingle` of them
    prefixes = cut_lineage(_prefixes(windows, _occurrences(docs, windows, sizes)), "prefixes")

    bits = bitmap(prefixes, "token")
    reach = window - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _matches(batch, sizes, bits.value, reach)

    scanned = cut_lineage(docs.mapInArrow(scan, _SCANNED), "scanned")
    base = scanned.select("doc_id", "text_key", "n_words")
    matches = scanned.where(F.size("matches") > 0).select("doc_id", "text_key", F.col("n_words").alias("in_doc"), F.inline("matches"))

    start = F.col("at") - F.col("offset")
    room = (F.col("offset") <= F.col("before")) & (start + F.col("length") <= F.col("in_doc"))
    here = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("length")), " ")
    found = (
        matches.join(prefixes.withColumnRenamed("n_words", "length"), "token")
        .where(room)
        .where(here == F.col("words"))
        .select("doc_id", "text_key", "words", start.alias("start"), "length")
    )
    found = cut_lineage(found.distinct(), "found")
    hits = found.groupBy("doc_id", "text_key").agg(_covered(F.collect_set(F.struct("start", "length"))).alias("n_hit"))
    named = (
        found.select("doc_id", "text_key", "words").distinct()
        .join(items.select("words", "item_id").distinct(), "words")
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    hits = hits.join(named, _same(hits, named)).select(hits.doc_id, hits.text_key, "n_hit", "item_ids")
    n_hit = F.coalesce("n_hit", F.lit(0))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return base.join(hits, _same(base, hits), "left").select(
        base.doc_id,
        base.text_key,
        "n_words",
        n_hit.cast("bigint").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **bounds: int) -> DataFrame:
    """The documents that hold no window of the benchmark, all columns as they are."""
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    bad = decontaminate(docs, benchmark, **bounds).where("contaminated").select("doc_id", "text_key").distinct()
    same = keyed.doc_id.eqNullSafe(bad.doc_id) & (keyed[key] == bad.text_key)
    return keyed.join(bad, same, "left_anti").select(*[keyed[c] for c in docs.columns])


def _same(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.text_key == b.text_key)


def _item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    def cut(batches):
        for batch in pieces(batches):
            words, ids, out = Words(batch.column("text")), batch.column("item_id").to_pylist(), []
            hashes = {}
            for size in range(1, shingle + 1):
                at, h = words.shingles(size)
                hashes[size] = np.zeros(len(words.start), np.uint64)
                hashes[size][at] = h
            for i, item in enumerate(ids):
                a, b = int(words.first[i]), int(words.first[i + 1])
                length = min(window, b - a)
                size = min(shingle, length)
                for at in range(a, b - length + 1) if length else ():
                    tokens = hashes[size][at : at + length - size + 1].view(np.int64).tolist()
                    out.append((item, words.join(at, at + length), length, size, tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[k] for r in out], kind)
                    for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))
                ],
                names=["item_id", "words", "n_words", "size", "tokens"],
            )

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return rows.mapInArrow(cut, _WINDOWS)


def _occurrences(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """How often each shingle of the benchmark occurs in all documents."""
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    bits = bitmap(tokens, "token")

    def count(batches):
        for batch in pieces(batches):
            words, found = Words(batch.column("text")), [np.zeros(0, np.uint64)]
            for size in sizes:
                _, h = words.shingles(size)
                found.append(h[in_bitmap(bits.value, h)])
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    counted = docs.select("text").mapInArrow(count, _COUNTS)
    return counted.groupBy("token").agg(F.sum("n").alias("n")).join(tokens, "token", "left_semi")


def _prefixes(windows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The rarest shingle of every window that can occur at all, with its place in the window."""
    each = windows.select("words", "n_words", F.size("tokens").alias("all"), F.posexplode("tokens").alias("offset", "token"))
    return (
        each.join(occurrences, "token")
        .groupBy("words", "n_words", "all")
        .agg(F.min(F.struct("n", "offset", "token")).alias("rarest"), F.count("*").alias("known"))
        .where(F.col("known") == F.col("all"))
        .select("words", "n_words", "rarest.offset", "rarest.token")
    )


def _matches(batch: pa.RecordBatch, sizes: list[int], bits: np.ndarray, reach: int) -> pa.RecordBatch:
    words = Words(batch.column("text"))
    rows = []
    for size in sizes:
        at, h = words.shingles(size)
        hit = in_bitmap(bits, h)
        rows += zip(words.doc[at[hit]].tolist(), at[hit].tolist(), h[hit].view(np.int64).tolist())
    rows.sort()
    out = []
    lists = np.zeros(batch.num_rows + 1, np.int32)
    for doc, at, token in rows:
        first, last = int(words.first[doc]), int(words.first[doc + 1])
        low = max(first, at - reach)
        out.append({"token": token, "at": at - first, "before": at - low, "context": words.join(low, min(last, at + reach + 1))})
        lists[doc + 1] += 1
    kind = pa.struct([("token", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.string())])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("text_key"),
            pa.array(np.diff(words.first).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.cumsum(lists, dtype=np.int32)), pa.array(out, kind)),
        ],
        names=["doc_id", "text_key", "n_words", "matches"],
    )


def _covered(spans):
    """Number of words in the union of (start, length) spans."""
    ordered = F.sort_array(spans)
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(so_far, span):
        end = span["start"] + span["length"]
        fresh = end - F.greatest(span["start"], so_far["end"])
        return F.struct(F.greatest(so_far["end"], end).alias("end"), (so_far["n"] + F.greatest(fresh, F.lit(0))).alias("n"))

    return F.aggregate(ordered, zero, add, lambda x: x["n"])
