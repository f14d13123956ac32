"""WARC archives: exact round trips, equal files however the pages are partitioned, commits that may be repeated."""

import gzip
import hashlib
import os

import pytest

import __spark_entry__ as contract
from checks.compare import database, differences
from pulsemill.llm import warc

KIND = "page_id BIGINT, url STRING, html STRING, copy INT, shard STRING, payload_digest STRING"
PAGES = [
    (3, "http://a/3", "<p>" + "x" * 200),
    (1, "http://a/1", "<p>" + "x" * 200),
    (2, "http://a/ü b\n", "<p>" + "x" * 200),
    (None, None, "<p>" + "x" * 200),
    (4, None, None),
    (5, "http://a/5", ""),
    (6, "http://a/6", "é" * 49),
    (7, "http://a/7", "é" * 49),
    (8, "http://a/8", "é" * 50),
    (9, "http://a/9", "é" * 50),
    (10, "http://a/10", "WARC/1.1\r\n\r\n" + "\r\n\r\n" * 30),
    (11, "http://a/11", "long " * 400_000),
    (12, "http://a/z", "tie" * 50),
    (12, "http://a/y", "tie" * 50),
    (-(2**63), "http://a/low", "low" * 50),
    (2**63 - 1, "http://a/high", "high" * 50),
    (0, "http://a/0", "zero" * 50),
] + [(13, "http://a/13", "same " * 30)] * 9 + [(None, None, "no id " * 30)] * 3 + [(None, None, "short")] * 2


def table(spark, pages, parts=3):
    return spark.createDataFrame([(*p, 1, "clash", "clash") for p in pages], KIND).repartition(parts)


def expected(pages):
    first, out = {}, []
    rank = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")
    for p in sorted(pages, key=rank):
        raw = (p[2] or "").encode()
        keeps = len(raw) < 100 or raw not in first
        first.setdefault(raw, p[0])
        out.append((p[0], len(raw), hashlib.sha256(raw).hexdigest(), "response" if keeps else "revisit", None if keeps else first[raw]))
    return sorted(out, key=repr)


def read(spark, root):
    return [tuple(r) for r in warc.read_archives(spark, root, payloads=False).drop("url", "payload").collect()]


@pytest.mark.parametrize("sizes", [{}, {"file_bytes": 300, "shard_bytes": 1200}, {"shard_bytes": 1, "max_shards": 5}])
def test_round_trip(spark, tmp_path, sizes):
    roots = [f"{tmp_path}/{n}" for n in (3, 1)]
    files = []
    for root, parts in zip(roots, (3, 1)):
        manifest = warc.write_archives(table(spark, PAGES, parts), root, **sizes).collect()
        files.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in manifest))
        assert sum(r.records for r in manifest) == len(PAGES)
        assert all(hashlib.sha256(open(f"{root}/{r.name}", "rb").read()).hexdigest() == r.sha256 for r in manifest)
        assert sorted(read(spark, root), key=repr) == expected(PAGES)
    # The same bytes, however the pages came, and shards in the order of the pages.
    assert files[0] == files[1] and len(files[0]) > (1 if sizes else 0)
    texts = {r.payload for r in warc.read_archives(spark, roots[0]).where("record_type = 'response'").collect()}
    assert texts == {p[2] or "" for p in PAGES}
    names, ids = sorted(f[0] for f in files[0]), []
    for name in names:
        ids += [line[11:].strip() for line in gzip.open(f"{roots[0]}/{name}") if line.startswith(b"X-Page-Id: ")]
    ids = [2**70 if x == b"-" else int(x) for x in ids]
    assert ids == sorted(ids)


def test_only_committed_files_count(spark, tmp_path):
    root = str(tmp_path)
    manifest = warc.write_archives(table(spark, PAGES), root).collect()
    os.makedirs(f"{root}/_temporary-lost")
    open(f"{root}/_temporary-lost/part", "wb").write(b"half a file")
    open(f"{root}/pages-99999-00000.warc.gz", "wb").write(b"half a file")
    assert sorted(read(spark, root), key=repr) == expected(PAGES)
    reported = spark.createDataFrame([(r.shard, r.roll, f"{root}/gone", r.name, r.records, r.bytes, r.sha256) for r in manifest], warc._FILES)
    again = warc.commit(reported, root)
    assert sorted(r.name for r in again.collect()) == sorted(r.name for r in manifest)
    path = f"{root}/{manifest[0].name}"
    size = os.path.getsize(path)
    open(path, "r+b").truncate(size - 10)
    with pytest.raises(Exception, match="ends within a record|Error"):
        read(spark, root)
    with pytest.raises(Exception, match="is not the file"):
        warc.commit(reported, root)


def test_no_pages(spark, tmp_path):
    assert warc.write_archives(table(spark, PAGES).limit(0), str(tmp_path)).count() == 0
    assert read(spark, str(tmp_path)) == []


def test_records_are_valid():
    row = {"absent": False, "page_id": 1, "url": "http://a/ ", "payload_digest": hashlib.sha256(b"hi").hexdigest(), "copy": 0, "payload_bytes": 2}
    headers, block = warc.parse(warc._record(row, b"hi", warc.DATE))
    assert headers["warc-target-uri"] == "http://a/%20" and block.endswith(b"\r\n\r\nhi")
    with pytest.raises(ValueError, match="block"):
        warc.parse(warc._record(row, b"hi", warc.DATE).replace(b"\r\n\r\nhi", b"\r\n\r\nho"))


def test_warc_equals_sql(spark, sf_dir):
    mine = contract.queries()["op12_warc"](spark, sf_dir).toPandas()
    assert differences(mine, database(sf_dir).execute(contract.oracle_sql()["op12_warc"]).df()) == ""
