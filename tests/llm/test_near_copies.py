"""The pipeline's near-duplicate stage against all pairs."""

import random

import numpy as np
import pytest

from pulsemill.llm import simhash_dedup

KIND = "doc_id BIGINT, text STRING, band STRING, text_key STRING, root STRING"


def table(spark, texts, parts=5):
    return spark.createDataFrame([(k, t, "clash", "clash", "clash") for k, t in enumerate(texts)], KIND).repartition(parts)


def components(texts, similarity=0.8):
    """Smallest row reachable from each row over pairs that are similar enough."""
    sets = [frozenset(simhash_dedup.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def altered(draw, words, rate):
    return " ".join(w if draw.random() > rate else f"x{draw.randrange(10**6)}" for w in words)


@pytest.fixture(scope="module")
def group():
    """Copies of one text with every degree of change, its original left out, beside unrelated texts."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(500)}" for _ in range(150)]
    texts = [altered(draw, base, draw.random() * 0.06) for _ in range(300)]
    texts += [altered(draw, base, 0.04) for _ in range(60)]
    texts += [" ".join(f"v{draw.randrange(3000)}" for _ in range(draw.randrange(5, 200))) for _ in range(60)]
    draw.shuffle(texts)
    return texts


def test_a_large_group_of_near_copies(spark, group):
    want = components(group)
    kept = {r.doc_id for r in simhash_dedup.keep_dissimilar(table(spark, group)).collect()}
    linked = {k for k, r in enumerate(want) if want.count(r) > 1}
    # Texts without a partner stay, groups lose all but one, but for the pairs that no band brings together.
    assert kept >= {k for k, r in enumerate(want) if r == k}
    assert len(linked - kept) >= 0.97 * len(linked - {k for k, r in enumerate(want) if r == k})


def test_comparisons_are_bounded_by_memberships(spark, group, monkeypatch):
    made = []
    close = simhash_dedup._close
    monkeypatch.setattr(simhash_dedup, "_close", lambda info, pairs, s: (made.append(pairs.count()), close(info, pairs, s))[1])
    docs = table(spark, group)
    simhash_dedup.keep_dissimilar(docs).count()
    bands = simhash_dedup.band_settings(len(group))[1]
    assert made[0] <= len(group) and max(made) <= len(group) * bands / 2


def test_rows_at_partition_borders_meet(spark):
    rows = [(b, k) for b in range(40) for k in range(b % 12)] + [(99, k) for k in range(500)]
    spread = spark.createDataFrame(rows, "band BIGINT, text_key BIGINT").repartition(7)
    found = simhash_dedup._shared(spread).collect()
    alone = {(b, 0) for b in range(40) if b % 12 == 1}
    assert len(found) == len(set(found)) and set(map(tuple, found)) >= set(rows) - alone and set(map(tuple, found)) <= set(rows)
    keys = [k for _, k in rows if _ == 99]
    big = spark.createDataFrame([(99, k, 500) for k in keys], "band BIGINT, text_key BIGINT, n BIGINT")
    info = spark.createDataFrame([(k, 1, [k * 7919 % 1000]) for k in keys], "text_key BIGINT, size BIGINT, wide ARRAY<BIGINT>")
    roots = spark.createDataFrame([(k, 0) for k in keys if k % 3 == 0 and k], "node BIGINT, root BIGINT")
    got = {tuple(r) for r in simhash_dedup._neighbours(big, roots, info, 0).collect()}
    rank = lambda k: int(np.bitwise_xor.reduce([(k * 7919 % 1000) >> s for s in range(10)]))
    line = sorted(keys, key=lambda k: (rank(k), k))
    of = lambda k: 0 if k % 3 == 0 else k
    assert got == {(min(a, b), max(a, b)) for a, b in zip(line, line[1:]) if of(a) != of(b)}


def test_odd_texts(spark):
    texts = [None, "", " \n", "one", "ONE", "one two three four", "a " * 400_000, "A " * 400_000, "é", None]
    kept = {r.doc_id for r in simhash_dedup.keep_dissimilar(table(spark, texts)).collect()}
    assert kept == {0, 3, 5, 6, 8}
    assert simhash_dedup.keep_dissimilar(table(spark, texts).limit(0)).columns == ["doc_id", "text", "band", "text_key", "root"]


def meeting(texts, similarity=0.8):
    """Components over all pairs of texts that share a band and are similar enough: what no cap may lessen."""
    bits, bands = simhash_dedup.band_settings(len(texts))
    sets = [np.unique(simhash_dedup.shingle_hashes(t, 5)) for t in texts]
    keys = [set(simhash_dedup._sketch(h, bits, bands)[1].tolist()) for h in sets]
    sets, root = [set(h.tolist()) for h in sets], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def test_no_link_of_a_large_band_is_lost(spark):
    # Copies of one text too far from each other to be linked; half of them have a close copy of their own.
    draw = random.Random(11)
    base = [f"w{draw.randrange(500)}" for _ in range(200)]
    texts = [altered(draw, base, 0.04) for _ in range(600)]
    texts += [altered(draw, t.split(), 0.022) for t in texts[:300]]
    got = {r.doc_id for r in simhash_dedup.keep_dissimilar(table(spark, texts)).collect()}
    assert got == set(meeting(texts))


def test_blocks_meet_all_blocks(spark):
    draw = random.Random(5)
    sets = [sorted(draw.sample(range(40), draw.randrange(30, 41))) for _ in range(60)] + [[], []]
    rows = [(k, k // 2 * 2, len(s), k % 3, k < 20) for k, s in enumerate(sets)]
    rest = spark.createDataFrame(rows, "text_key BIGINT, root BIGINT, size BIGINT, pool BIGINT, main BOOLEAN")
    held = spark.createDataFrame(list(enumerate(sets)), "text_key BIGINT, shingles ARRAY<BIGINT>")
    found = {tuple(r) for r in simhash_dedup._block_links(rest, held, 0.8, block=100).collect()}
    links = set()
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            alike = len({*a} & {*b}) >= 0.8 * len({*a} | {*b}) - 1e-9
            if i % 3 == j % 3 and i // 2 != j // 2 and not (i < 20 and j < 20) and alike:
                links.add((i // 2 * 2, j // 2 * 2))
    reach = lambda pairs: simhash_dedup.forest(*np.array(sorted(pairs), np.int64).T).values.tolist()
    assert links and reach(found) == reach(links)


def test_pairs_that_no_band_brings_together_are_found(spark, monkeypatch):
    """Without bands that meet, and with every candidate of theirs dropped, the groups are those of all pairs."""
    draw = random.Random(6)
    line = [f"c{n}" for n in range(12)]
    bases = [[f"w{draw.randrange(5000)}" for _ in range(draw.randrange(5, 90))] for _ in range(60)]
    texts = [" ".join(b) for b in bases]
    texts += [altered(draw, b, 0.02) for b in bases for _ in range(2)]
    texts += [" ".join(line + b[:8]) for b in bases] + [altered(draw, bases[0] + bases[1], 0.03) for _ in range(40)] + [None, "", " "]
    want = {k for k, r in enumerate(components(texts)) if r == k}
    monkeypatch.setattr(simhash_dedup, "CHECK_RADIUS", -1)
    got = {r.doc_id for r in simhash_dedup.keep_dissimilar(table(spark, texts)).collect()}
    assert got == want
    monkeypatch.setattr(simhash_dedup, "COMMON", 3)
    monkeypatch.setattr(simhash_dedup, "SOME", 20)
    monkeypatch.setattr(simhash_dedup, "band_settings", lambda n, *how: (60, 1))
    assert {r.doc_id for r in simhash_dedup.keep_dissimilar(table(spark, texts)).collect()} == want


def test_similar_sets_share_a_rare_shingle():
    draw = random.Random(8)
    common = np.array(sorted(draw.sample(range(60), 20)), np.uint64)
    places = np.array(draw.sample(range(20), 20))
    for _ in range(3000):
        a = set(draw.sample(range(60), draw.randrange(1, 40)))
        b = set(draw.sample(sorted(a), draw.randrange(max(1, len(a) * 7 // 10), len(a) + 1))) | set(draw.sample(range(60), draw.randrange(4)))
        if len(a & b) * 1.8 >= 0.8 * (len(a) + len(b)) - 1e-9:
            one, two = (simhash_dedup._rarest(np.array(sorted(s), np.uint64), 0.8, common, places) for s in (a, b))
            assert set(one) & set(two)
