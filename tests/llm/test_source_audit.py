"""The source audit against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as contract
from checks.compare import database, differences
from pulsemill.llm import source_audit

KIND = "doc_id BIGINT, text STRING, lang STRING, source STRING, term STRING, n STRING, docs STRING"
LOWER = {i: i + 32 for i in range(65, 91)}


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, "clash", "x", "y") for k, (t, lang, s) in enumerate(rows)], KIND).repartition(3)


def expected(rows, least, top):
    find = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    n, held, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = find((text or "").translate(LOWER))
        groups[lang].add(source)
        n.update((lang, source, w) for w in words)
        held.update((lang, w) for w in set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(w for (g, w), c in held.items() if g == lang and c >= least)
        total = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        share = lambda c, t: 1 + 10**9 * (c + 2) // (t + 2 * len(kept))  # noqa: E731, B023
        p = {(s, w): share(n[lang, s, w], total[s]) for s in sources for w in kept}
        q = {w: share(sum(n[lang, s, w] for s in sources), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s, w], p[t, w]) for w in kept), t.encode()) for t in sources if t != s]
            terms = [(-f(p[s, w], q[w]), w.encode()) for w in kept if n[lang, s, w] and p[s, w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:most], 1)}
    return out


def test_audit_equals_brute_force(spark):
    draw = random.Random(3)
    words = ["a", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijklmnopq", "Été", "été", "straße", "中文字", "x" * 30, "x" * 31, "Zed", "zed"]
    text = lambda k: " 1-".join(draw.choices(words, k=k))
    rows = [(text(draw.randrange(12)), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "S2", "é", None])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("42 !!", "fr", "only"), ("lonely", "it", "one"), ("lonely", "it", "two"), ("", None, None)]
    rows += [rows[0]] * 4 + [("hot " * 50, "en", "s1")] * 60 + [(" ".join(words) * 3, "en", "s2")]
    for least, top in ((2, 3), (10, 10), (1, 2)):
        got = source_audit.audit(table(spark, rows), least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == expected(rows, least, top)


def test_audit_of_texts_longer_than_a_slice(spark):
    long = "word " * 1_100_000 + "q" * 5_000_000
    rows = [(long, "en", "s1"), (long, "en", "s2"), ("word word", "en", "s2")]
    assert {tuple(r) for r in source_audit.audit(table(spark, rows), 2).collect()} == expected(rows, 2, 10)


def test_audit_of_nothing(spark):
    assert source_audit.audit(table(spark, []).limit(0)).collect() == []


def test_runs_are_sorted_as_whole_words():
    words = [b"abcdefgh", b"abcdefgh", b"abcdefghabcdefgh", b"abcdefghabcdefgh", b"abcdefghabcdefghi", b"b", b"abcdefgh"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    start, length, text = source_audit.pointers(data, np.array([0, 20, len(data)]))
    order, runs = source_audit.equal_runs(data, start, length, np.zeros(len(start), np.int64))
    found = sorted(tuple(sorted(r)) for r in np.split(order, runs[1:]))
    spans = defaultdict(list)
    for k, (s, n) in enumerate(zip(start, length)):
        spans[data[s : s + n].tobytes()].append(k)
    assert found == sorted(tuple(v) for v in spans.values()) and text[0] == 0 and text[-1] == 1


def test_audit_equals_sql(spark, sf_dir):
    mine = contract.queries()["op11_source_audit"](spark, sf_dir).toPandas()
    assert differences(mine, database(sf_dir).execute(contract.oracle_sql()["op11_source_audit"]).df()) == ""
