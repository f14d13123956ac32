"""SimHash fingerprints, and near-duplicates by a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, in which neighbours share most bits, and cut into ranges of equal
size. A range is an upper node: the bits that all of its fingerprints share (mask and pattern). A fingerprint
goes only to the ranges whose pattern differs from it in at most `radius` of the masked bits. Within a range
the same is done on blocks of sorted fingerprints, ever smaller, each time dropping whole blocks whose
difference exceeds the radius, and single fingerprints are compared last. No pair within the radius is lost:
each pair meets in the range of the member with the greater rank.

A range returns a spanning forest of its links, not all pairs; `components.smallest_reachable` joins them.

`keep_dissimilar` is for a pipeline: texts of a Jaccard similarity of 0.8 and more. At 0.8, SimHashes differ in about 10 of 64
bits, a radius at which the index prunes nothing. It takes a wide fingerprint instead (thousands of
independent bits), whose bits are cut into bands: texts that agree in one whole band meet, and the exact
similarity decides. Where many texts meet in a band, each is first compared with the most popular one it meets (the
text that meets most others, hence the least altered of a group of copies), once. Then texts of different components are
compared: all that meet in a band of few texts; those of a larger band are put in Gray order of 64 further bits, in
ORDERS independent ones, and compared with their neighbours in each. So far the number of comparisons
follows the number of bands a text has, not the size of its group. Pairs that no band brings together, or that the wide
fingerprints keep apart, are found by shingles: sets of this similarity share one at least of their rarest shingles (`_rarest`),
whatever the order of rareness, so texts of different components that share one are compared. What is left of large bands and of
shingles of many texts is compared whole (`_rest`): blocks of texts meet blocks of texts, in tasks of bounded memory. So the
components are those of all similar pairs.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pulsemill.llm.arrow_text import _mixed, pieces
from pulsemill.llm.bitmap import bitmap, in_bitmap
from pulsemill.llm.components import forest, smallest_reachable
from pulsemill.llm.names import free_name
from pulsemill.session import cut_lineage

RADIUS = 2
SHINGLE = 3
SEED = 42
# Fingerprints in a range (512 KB), and the most ranges (their patterns, 24 bytes each, go to every task). Every range
# costs copies of fingerprints near its border, so there are no more than keep all cores busy.
RANGE_SIZE = 1 << 16
SMALLEST_RANGE = 4096
MAX_RANGES = 1 << 14
# Sizes of the blocks inside a range.
BLOCKS = (4096, 256, 16)

# Stage: words in a shingle, the least similarity, the share of pairs at just that similarity which some band brings
# together, and the bits of a band beyond log2 of the number of rows, which keep chance candidates few.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
SPARE_BITS = 3
# Candidates of bands that differ in more bits of their first 64 CHECK_WORDS are left to the comparison by shingles: at 0.8,
# 78 differ on average, with a deviation of 8.1 (96 and 8.8 for texts of five shingles); 256 of unrelated texts.
CHECK_WORDS = 8
CHECK_RADIUS = 140
# Texts of a band that are all compared with each other.
FEW = 8
# Texts that share a rare shingle and are all compared with each other, where enough of their rare shingles agree.
SOME = 128
# Gray orders of a larger band, each of another word of the wide fingerprint; neighbours in any of them are compared.
ORDERS = 4
EDGE = ["a", "b", "edge", "word", "band", "root"]
# Texts whose shingles are counted, about; in how many of them a shingle is common; and the most that are told (512 KB). They
# decide which shingles are taken for rare, hence how many texts meet, never what is found.
SAMPLED = 8192
OFTEN = 2
COMMON = 1 << 16
# Shingles in a block of texts that is compared with another block.
BLOCK_SHINGLES = 1 << 19

_GAP = re.compile(rb"[\x20\x09-\x0d]+")
_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of all word shingles; a text of fewer words is one shingle, one without words has none."""
    words = [w for w in _GAP.split((text or "").encode("utf-8", "replace").translate(_TO_LOWER)) if w]
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    size = min(shingle, len(words))
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit the majority (over half) of the hashes of all word shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle, seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and fp (the fingerprint as a signed long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))], names=["doc_id", "text_key", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(scan, "doc_id bigint, text_key bigint, fp bigint")


def gray_rank(fp):
    """Position of a fingerprint in Gray order, as a signed long that sorts like the unsigned one."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def near_links(fps: DataFrame, radius: int = RADIUS, range_size: int = RANGE_SIZE) -> DataFrame:
    """Links (a, b) whose components equal those of all pairs of distinct `fp` within `radius` bits."""
    spark = fps.sparkSession
    ranked = cut_lineage(fps.select("fp").distinct().withColumn("rank", gray_rank(F.col("fp"))), "ranked")
    n = ranked.count()
    busy = min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / SMALLEST_RANGE))
    parts = min(MAX_RANGES, max(math.ceil(n / range_size), busy))
    if parts > 1:
        steps = [k / parts for k in range(1, parts)]
        cuts = ranked.agg(F.percentile_approx("rank", steps, max(10_000, 10 * parts))).first()[0]
    else:
        cuts = []
    cuts = np.array(sorted(set(cuts)), np.int64)
    bounds = spark.sparkContext.broadcast(cuts)

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds.value, rank, side="right").astype(np.int32)), batch.column("fp"), batch.column("rank")],
                names=["part", "fp", "rank"],
            )

    placed = ranked.mapInArrow(place, "part int, fp bigint, rank bigint")
    nodes = placed.groupBy("part").agg(F.bit_and("fp"), F.bit_or("fp")).orderBy("part").collect()  # MAX_RANGES rows at most
    if not nodes:
        return spark.createDataFrame([], "a bigint, b bigint")
    every = np.array([r[1] for r in nodes], np.int64).view(np.uint64)
    some = np.array([r[2] for r in nodes], np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast((np.array([r[0] for r in nodes], np.int32), every, ~(every ^ some)))

    def send(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 2048):
                yield _sent(fp[at : at + 2048], batch.column("part").to_numpy()[at : at + 2048], tree.value, radius)

    def within(keys, group: pd.DataFrame) -> pd.DataFrame:
        mine = group.own.to_numpy()
        fp = group.fp.to_numpy().view(np.uint64)
        return forest(*_search(_by_gray(fp[mine]), fp, radius))

    return placed.mapInArrow(send, "part int, fp bigint, own boolean").groupBy("part").applyInPandas(within, "a bigint, b bigint")


def _sent(fp: np.ndarray, part: np.ndarray, tree, radius: int) -> pa.RecordBatch:
    """Each fingerprint to its own range, and to every later range with a close enough pattern."""
    parts, pattern, mask = tree
    apart = np.bitwise_count((fp.view(np.uint64)[:, None] ^ pattern) & mask)
    who, where = np.nonzero((apart <= radius) & (parts >= part[:, None]))
    to = parts[where]
    return pa.RecordBatch.from_arrays([pa.array(to), pa.array(fp[who]), pa.array(to == part[who])], names=["part", "fp", "own"])


def _by_gray(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return fp[np.argsort(rank, kind="stable")]


def _search(members: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (probe, member) pairs within the radius, probes taken a few at a time; a forest keeps what is held small."""
    levels = []
    for size in BLOCKS:
        starts = np.arange(0, len(members), size)
        every, some = np.bitwise_and.reduceat(members, starts), np.bitwise_or.reduceat(members, starts)
        levels.append((size, every, ~(every ^ some)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    held = 0
    for at in range(0, len(probes), 1024):
        some = probes[at : at + 1024]
        size, every, mask = levels[0]
        who, node = np.nonzero(np.bitwise_count((some[:, None] ^ every) & mask) <= radius)
        for finer, every, mask in levels[1:]:
            who, node = _children(who, node, size // finer, len(every))
            near = np.bitwise_count((some[who] ^ every[node]) & mask[node]) <= radius
            who, node, size = who[near], node[near], finer
        who, node = _children(who, node, size, len(members))
        near = (np.bitwise_count(some[who] ^ members[node]) <= radius) & (some[who] != members[node])
        a.append(some[who[near]])
        b.append(members[node[near]])
        held += int(near.sum())
        if held > 1 << 20:
            kept = forest(np.concatenate(a), np.concatenate(b))
            a, b = [kept.a.to_numpy().view(np.uint64)], [kept.b.to_numpy().view(np.uint64)]
            held = len(kept)
    return np.concatenate(a), np.concatenate(b)


def _children(who: np.ndarray, node: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    below = (node[:, None] * fan + np.arange(fan)).ravel()
    who = np.repeat(who, fan)
    there = below < n
    return who[there], below[there]


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Fingerprint and component of every document row.

    docs: doc_id, text; other columns are ignored. Returns doc_id, text_key, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over fingerprints at most `radius` bits apart. NULL, empty and
    blank texts have fingerprint zero and link like any other; a NULL doc_id is never the smallest unless a
    component has no other. Repeated rows give repeated rows.
    """
    fps = cut_lineage(fingerprints(docs, shingle, seed), "fingerprints")
    roots = smallest_reachable(near_links(fps, radius))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut_lineage(rooted.join(smallest, "root").select("fp", "component_id"), "labels")
    return fps.join(labels, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """One document of each component: that of the smallest doc_id (then text hash); all columns as they are.

    Of rows that agree in doc_id and text one stays.
    """
    found = near_components(docs, **how)
    return _first_of(docs, found, "component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone"))


def _first_of(docs: DataFrame, found: DataFrame, *component) -> DataFrame:
    key = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    kept = found.groupBy(*component).agg(F.min(key).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key"))
    name = free_name(docs, "text_key")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    same = keyed.doc_id.eqNullSafe(kept.kept_id) & (keyed[name] == kept.kept_key)
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).select(*docs.columns)


def keep_dissimilar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> DataFrame:
    """One document of each group that pairs of at least `similarity` connect: that of the smallest doc_id (then text hash).

    Similarity is the Jaccard index of the sets of word shingles. Every pair that is linked was compared exactly, and no pair is
    missed: of those at just `similarity`, RECALL meet in a band, the others by a rare shingle. NULL, empty and blank texts are
    alike. Texts of any length are compared whole. All columns as they are, whatever their names; of rows that agree in doc_id and text
    one stays. An empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    n = docs.count()
    bits, bands = band_settings(n, similarity)
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, n, shingle, seed))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in batch.column("text").to_pylist()]
            found = [_sketch(h, bits, bands) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([w for w, _ in found], pa.list_(pa.int64())),
                    pa.array([k for _, k in found], pa.list_(pa.int64())),
                    pa.array([_rarest(h, similarity, *common.value).view(np.int64) for h in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "size", "wide", "bands", "rarest"],
            )

    kind = "doc_id bigint, text_key bigint, size bigint, wide array<bigint>, bands array<bigint>, rarest array<bigint>"
    sketches = cut_lineage(rows.mapInArrow(scan, kind), "sketches")
    once = lambda *names: sketches.groupBy("text_key").agg(*[F.first(c).alias(c) for c in names])
    info = cut_lineage(once("size", "wide"), "sizes")
    members = cut_lineage(_shared(once("bands").select(F.explode("bands").alias("band"), "text_key")), "members")
    counts = members.groupBy("band").agg(F.count("*").alias("n"))
    big = cut_lineage(members.join(counts.where(F.col("n") > FEW), "band"), "large-bands")
    # Most texts of a large group of copies are one component after this, and need not meet each other.
    close = _close(info, _stars(big), similarity)
    roots = _joined(None, _similar(close, _sets(rows, _ends(close), shingle, seed), similarity))
    few = _rooted(members.join(counts.where(F.col("n").between(2, FEW)), "band").select("band", "text_key"), roots)
    pairs = _met(few).union(_neighbours(big, roots, info, *range(ORDERS)))
    close = _close(info, cut_lineage(pairs.distinct(), "pairs"), similarity)
    roots = _joined(roots, _similar(close, _sets(rows, _ends(close), shingle, seed), similarity))
    # What the bands did not bring together, or their check kept apart: every similar pair shares a rare shingle.
    shared = _shared(sketches.select(F.explode("rarest").alias("band"), "text_key")).distinct()
    mixed = _mixed_bands(_rooted(shared, roots), info)
    enough = _enough(mixed.where(F.col("n") <= SOME), similarity)
    links = _similar(enough, _sets(rows, _ends(enough), shingle, seed), similarity)
    many = mixed.where(F.col("n") > SOME).select("band", "text_key")
    rest = cut_lineage(_rest(big.select("band", "text_key").union(many), roots, info), "rest")
    if not rest.isEmpty():
        sets = _sets(rows, rest.select("text_key"), shingle, seed)
        links = links.union(cut_lineage(_block_links(rest, sets, similarity), "block-links"))
    roots = _joined(roots, links)
    found = cut_lineage(_rooted(sketches.select("doc_id", "text_key"), roots), "found")
    return _first_of(docs, found, "root")


def _common(rows: DataFrame, n: int, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in about SAMPLED texts, sorted, and the place of each from rarest to most common."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle, seed)).view(np.int64))], names=["shingle"])

    some = rows.where(F.pmod("text_key", F.lit(max(1, n // SAMPLED))) == 0).select("text", "text_key")
    counts = some.mapInArrow(scan, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = [r.shingle for r in counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()]
    found = np.array(found[::-1], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order


def _rarest(hashes: np.ndarray, similarity: float, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """So many of the rarest shingles of a set of hashes that any set of this similarity has one of them among its own rarest.

    All sets take shingles in one order: those that are not common by their hash, then the common ones by their place. Empty sets,
    which are alike, share a zero.
    """
    if not len(hashes):
        return np.zeros(1, np.uint64)
    take = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    spot = np.searchsorted(common, hashes)
    late = np.append(common, np.uint64(0))[spot] == hashes
    late &= spot < len(common)
    last = hashes[late][np.argsort(places[spot[late]])]
    return np.sort(np.concatenate([hashes[~late], last])[:take])


def _met(few: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different components in a band, of rows (band, text_key, root)."""
    one, two = (few.select("band", F.col("text_key").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return one.join(two, "band").where("a < b AND root_a <> root_b").select("a", "b")


def _mixed_bands(rooted: DataFrame, info: DataFrame) -> DataFrame:
    """Rows (band, text_key, root) of bands that hold several components, with the text's size and the number n of texts in the band."""
    rooted = cut_lineage(rooted, "shingle-roots")
    ends = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    mixed = rooted.join(ends.where("low < high").select("band", "n"), "band").join(info.select("text_key", "size"), "text_key")
    return cut_lineage(mixed, "mixed-shingles")


def _enough(mixed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, size_a, size_b) of texts of different components whose sizes and shared rarest shingles allow the similarity.

    Up to the last of the rarest shingles of one of them every shingle that both texts have is among the rarest of both; of the others of
    that text, one fewer than it must share with any, all may be shared.
    """
    names = {"text_key": "", "size": "size_", "root": "root_"}
    one, two = (mixed.select("band", *[F.col(c).alias(n + side) for c, n in names.items()]) for side in "ab")
    sized = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    pairs = one.join(two, "band").where("a < b AND root_a <> root_b").where(sized)
    pairs = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("shared"))
    others = F.ceil(similarity * F.greatest("size_a", "size_b") - 1e-9) - 1
    agree = (F.col("shared") + others) * (1 + similarity) >= similarity * (F.col("size_a") + F.col("size_b")) - 1e-9
    return cut_lineage(pairs.where(agree).select("a", "b", "size_a", "size_b"), "enough-shared")


def _ends(pairs: DataFrame) -> DataFrame:
    """Every text key of the pairs once; each side is made distinct before both are put together."""
    one, two = (pairs.select(F.col(side).alias("text_key")).distinct() for side in ("a", "b"))
    return one.union(two).distinct()


def _shared(spread: DataFrame) -> DataFrame:
    """Rows (band, text_key) whose band others have too; and the first and last row of each sorted partition.

    A band with very many texts is split over partitions, for rows are dealt by band and text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, True
        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held else batch
            if not rows.num_rows:
                continue
            band = rows.column("band").to_numpy()
            same = band[1:] == band[:-1]
            keep = np.append(before, same) | np.append(same, True)
            yield rows.slice(0, len(band) - 1).filter(pa.array(keep[:-1]))
            held, before = rows.slice(len(band) - 1), bool(same[-1]) if len(same) else before
        if held:
            yield held

    ordered = spread.repartitionByRange("band", "text_key").sortWithinPartitions("band", "text_key")
    return ordered.mapInArrow(scan, "band bigint, text_key bigint")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots with more links; earlier components are given by the links to their roots."""
    if roots is not None:
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
    return cut_lineage(smallest_reachable(links), "roots")


def _stars(big: DataFrame) -> DataFrame:
    """Pairs (a, b) of every text and the most popular text it meets in a large band."""
    popular = big.select("band", "text_key", F.sum("n").over(Window.partitionBy("text_key")).alias("met"))
    centres = popular.groupBy("band").agg(F.max(F.struct("met", "text_key")).alias("centre"))
    nearest = big.select("band", "text_key").join(centres, "band").groupBy("text_key").agg(F.max("centre")["text_key"].alias("centre"))
    ends = F.least("text_key", "centre").alias("a"), F.greatest("text_key", "centre").alias("b")
    return cut_lineage(nearest.where("text_key <> centre").select(*ends).distinct(), "stars")


def _neighbours(big: DataFrame, roots: DataFrame, info: DataFrame, *words: int) -> DataFrame:
    """Pairs (a, b) of texts of different components that stand side by side in a band, in Gray order of one of these words.

    The words of the wide fingerprint are independent, and each gives an order of its own.
    """
    ranks = F.array(*[F.struct(F.lit(w).alias("word"), gray_rank(F.col("wide")[w]).alias("rank")) for w in words])
    rooted = cut_lineage(_rooted(big.select("band", "text_key"), roots), "rooted")
    ends = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = rooted.join(ends.select("band"), "band", "left_semi")
    placed = mixed.join(info.select("text_key", ranks.alias("ranks")), "text_key").select("band", "text_key", "root", F.inline("ranks"))
    # Written before it is dealt by range, which reads its input twice.
    placed = cut_lineage(placed.select("word", "band", "rank", "text_key", "root"), "placed")
    ordered = placed.repartitionByRange("word", "band", "rank", "text_key").sortWithinPartitions("word", "band", "rank", "text_key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held else batch
            if not held:
                yield _edge(batch.slice(0, 1), 2 * part)
            word, band, key, root = (rows.column(c).to_numpy() for c in ("word", "band", "text_key", "root"))
            at = np.flatnonzero((word[1:] == word[:-1]) & (band[1:] == band[:-1]) & (root[1:] != root[:-1]))
            low, high = np.minimum(key[at], key[at + 1]), np.maximum(key[at], key[at + 1])
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), none, none, none, none], names=EDGE)
            held = rows.slice(rows.num_rows - 1)
        if held:
            yield _edge(held, 2 * part + 1)

    kind = ", ".join(f"{c} bigint" for c in EDGE)
    found = cut_lineage(ordered.select("word", "band", "text_key", "root").mapInArrow(scan, kind), "side-by-side")
    # The rows at the borders of partitions, two for each: neighbours that a border parts.
    edges = found.where(F.col("edge").isNotNull()).orderBy("edge").collect()
    parted = [(min(x.a, y.a), max(x.a, y.a)) for x, y in zip(edges[1::2], edges[2::2]) if (x.word, x.band) == (y.word, y.band) and x.root != y.root]
    pairs = found.where(F.col("edge").isNull()).select("a", "b")
    return pairs.union(big.sparkSession.createDataFrame(parted, "a bigint, b bigint")).distinct()


def _rest(big: DataFrame, roots: DataFrame, info: DataFrame) -> DataFrame:
    """Texts of large bands that hold several components: (text_key, root, size, pool, main).

    Components that share such a band, directly or by others, are one pool; `main` marks the texts of a pool's largest component.
    Texts that meet in a large band are of one component or of one pool.
    """
    rooted = cut_lineage(_rooted(big.select("band", "text_key"), roots), "band-roots")
    ends = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = cut_lineage(rooted.join(ends.select("band", "low"), "band"), "mixed-bands")
    links = mixed.select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()
    pools = smallest_reachable(links).select(F.col("node").alias("root"), F.col("root").alias("pool"))
    texts = mixed.select("text_key", "root").distinct().join(info.select("text_key", "size"), "text_key")
    texts = texts.join(pools, "root", "left").withColumn("pool", F.coalesce("pool", "root"))
    texts = cut_lineage(texts, "pooled")
    parts = texts.groupBy("pool", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("pool").agg(F.max(F.struct("n", "root"))["root"].alias("first"))
    return texts.join(main, "pool").select("text_key", "root", "size", "pool", (F.col("root") == F.col("first")).alias("main"))


def _block_links(rest: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that join all texts of one pool, but of different components, that are similar enough.

    Of two such texts one at least is not of the main component: those texts probe all. Probes and members are dealt into blocks
    by their number of shingles, and every block of probes meets every block of members in a group of its own.
    """
    per = lambda of: F.ceil(F.sum(of) / F.lit(block)).cast("int")
    blocks = rest.groupBy("pool").agg(
        per(F.col("size")).alias("members"), F.coalesce(per(F.when(~F.col("main"), F.col("size"))), F.lit(0)).alias("probes")
    )
    blocks = blocks.select("pool", *[F.greatest(c, F.lit(1)).alias(c) for c in ("members", "probes")])
    keyed = rest.join(blocks, "pool").join(sets, "text_key")
    own = lambda of: F.pmod(F.xxhash64("text_key"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["pool", "text_key", "root", "shingles"]
    members = keyed.select(*columns, F.lit(False).alias("probe"), own("members").alias("member_block"), every("probes").alias("probe_block"))
    probes = keyed.where(~F.col("main")).select(
        *columns, F.lit(True).alias("probe"), every("members").alias("member_block"), own("probes").alias("probe_block")
    )

    def meet(group: pa.Table) -> pa.Table:
        probe = group.column("probe").to_numpy()
        a, b = _similar_pairs(group.filter(pa.array(probe)), group.filter(pa.array(~probe)), similarity)
        found = forest(a, b)
        return pa.table({"a": pa.array(found.a.to_numpy(), pa.int64()), "b": pa.array(found.b.to_numpy(), pa.int64())})

    dealt = probes.unionByName(members).groupBy("pool", "member_block", "probe_block")
    return dealt.applyInArrow(meet, "a bigint, b bigint")


def _similar_pairs(probes: pa.Table, members: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the pairs (probe, member) of different components that are similar enough, counted by the members' shingles."""
    sets, roots, held = members.column("shingles").combine_chunks(), members.column("root").to_numpy(), [np.zeros((2, 0), np.int64)]
    values, sizes = sets.flatten().to_numpy(), sets.value_lengths().to_numpy()
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    for root, shingles in zip(probes.column("root").to_pylist(), probes.column("shingles")):
        mine = shingles.values.to_numpy()
        low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        shared = np.bincount(owner[at], minlength=len(sizes))
        near = (shared * (1 + similarity) >= similarity * (len(mine) + sizes) - 1e-9) & (roots != root)
        other = np.unique(roots[near])
        held.append(np.array([np.full(len(other), root), other]))
    a, b = np.concatenate(held, axis=1)
    return a, b


def _edge(row: pa.RecordBatch, edge: int) -> pa.RecordBatch:
    key = row.column("text_key")
    columns = [key, key, pa.array([edge]), row.column("word").cast(pa.int64()), row.column("band"), row.column("root")]
    return pa.RecordBatch.from_arrays(columns, names=EDGE)


def band_settings(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band for `n` texts, and how many bands bring `recall` of the pairs of this similarity together."""
    bits = min(60, max(16, n.bit_length() + SPARE_BITS))
    agree = 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits))) if agree < 1 else 1


def _sketch(hashes: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the wide fingerprint of a set of hashes, and a number for each of its bands."""
    words = max(CHECK_WORDS, -(-bits * bands // 64))
    ones = np.zeros(64 * words, np.int64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 2048):
        ones += _tally(_mixed(hashes[at : at + 2048, None] + salts))
    major = 2 * ones > len(hashes)
    wide = np.packbits(major).view(">u8")[:CHECK_WORDS].astype(np.uint64).view(np.int64)
    values = major[: bits * bands].reshape(bands, bits) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    return wide, _mixed(_mixed(values) + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def _tally(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit, by full adders on whole columns of words: three rows become a sum and a carry."""
    total, weight = np.zeros(64 * rows.shape[1], np.int64), 1
    while len(rows):
        carries = []
        while len(rows) > 16:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * third :]])
        bits = np.unpackbits(rows.astype(">u8").view(np.uint8), axis=1)
        total += weight * bits.sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries) if carries else rows[:0], 2 * weight
    return total


def _close(info: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of text keys whose sizes and wide fingerprints allow the similarity, with both sizes."""
    for side in ("a", "b"):
        pairs = pairs.join(info.select(*[F.col(c).alias(f"{c}_{side}") for c in ("text_key", "size", "wide")]), F.col(side) == F.col(f"text_key_{side}"))
    apart = sum((F.bit_count(F.col("wide_a")[k].bitwiseXOR(F.col("wide_b")[k])) for k in range(CHECK_WORDS)), F.lit(0))
    sized = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    return cut_lineage(pairs.where(sized & (apart <= CHECK_RADIUS)).select("a", "b", "size_a", "size_b"), "candidates")


def _sets(rows: DataFrame, keys: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Shingle sets (text_key, shingles) of these texts, and of a few others."""
    bits = bitmap(keys, "text_key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = batch.filter(pa.array(in_bitmap(bits.value, batch.column("text_key").to_numpy().view(np.uint64))))
            sets = [np.unique(shingle_hashes(t, shingle, seed)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(sets, pa.list_(pa.int64()))], names=["text_key", "shingles"])

    sets = rows.select("text", "text_key").mapInArrow(scan, "text_key bigint, shingles array<bigint>")
    return cut_lineage(sets.groupBy("text_key").agg(F.first("shingles").alias("shingles")), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, size_a, size_b) whose texts are similar enough."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("text_key").alias(f"key_{side}"), F.col("shingles").alias(f"set_{side}")), F.col(side) == F.col(f"key_{side}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return cut_lineage(pairs.where(shared * (1 + similarity) >= similarity * (F.col("size_a") + F.col("size_b")) - 1e-9).select("a", "b"), "similar")


def _rooted(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with a text_key and the root of its component, itself where nothing is like it."""
    return keyed.join(roots, keyed.text_key == roots.node, "left").select(*keyed.columns, F.coalesce("root", "text_key").alias("root"))
