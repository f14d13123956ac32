"""Pages to WARC archives and back.

What is written where is settled on narrow rows first: payload digests, which page keeps its payload and which ones
revisit it, and the order of all records. The order is cut into shards of about equal size by the exact running sum of
record sizes, so that shards depend on the pages only, not on how they were partitioned. Then every payload moves
once: records and payloads are dealt by shard and sorted, a payload just before its record, and one task writes a shard
as a stream. Files are rolled by their compressed size.

A task writes under a temporary name of its own attempt and reports its files. Spark commits the reports of the attempts
that count as a table, and only files named there get their final names and a place in the manifest. A lost executor or
a second attempt leaves files that nothing refers to; repeating the commit changes nothing. Equal pages give equal files.
"""

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemill.session import cut_lineage

# Payloads below this many bytes are always written in full.
REVISIT_BYTES = 100
# Compressed bytes at which a file ends, uncompressed ones of a shard, and the most shards (their first keys, 25 bytes
# each, go to every task); with more pages the shards grow, and each rolls more files.
FILE_BYTES = 256 << 20
SHARD_BYTES = 8 << 20
MAX_SHARDS = 20_000
# What the headers of a record take, about; and how many copies of one page are numbered in one go.
HEADER_BYTES = 512
COPIES = 4096
# Archives do not tell when a page was fetched; the caller may.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ORDER = ["absent", "page_id", "spread", "copy"]
_FILES = "shard int, roll int, temporary string, name string, records bigint, bytes bigint, sha256 string"
_READ = "page_id bigint, url string, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """One narrow row for each record: key, digest, type, and the payload itself where it is below `least` bytes.

    Equal rows are counted before anything is shuffled and told apart by `copy`. Of equal payloads the one with the
    smallest page_id (then url; NULL last) is the response.
    """
    small = F.when(F.col("payload_bytes") < least, F.col("html")).alias("small")
    key = ["page_id", "url", "payload_digest", "payload_bytes"]
    once = cut_lineage(_keyed(pages).groupBy(*key, small).agg(F.count("*").alias("n")), "pages")
    whole = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    firsts = once.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(whole).alias("first"), F.sum("n").alias("total"))
    told = once.join(firsts.where("total > 1"), "payload_digest", "left")
    # Numbered in two steps, so that no array is longer than COPIES.
    told = told.withColumn("step", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    told = told.withColumn("copy", F.explode(F.expr(f"sequence(step * {COPIES}, least(n, (step + 1) * {COPIES}) - 1)")))
    itself = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 0)
    revisit = F.col("total").isNotNull() & ~itself
    return told.select(
        F.col("page_id").isNull().alias("absent"),
        F.coalesce("page_id", F.lit(0)).alias("page_id"),
        _spread().alias("spread"),
        "copy",
        "url",
        "payload_digest",
        "payload_bytes",
        "small",
        revisit.alias("revisit"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
    )


def _keyed(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("bigint")})


def _spread():
    return F.xxhash64("url", "payload_digest")


def _shard_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The order of records (absent, page_id, spread, copy) as byte strings that sort alike."""
    out = np.zeros((batch.num_rows, 25), np.uint8)
    out[:, 0] = batch.column("absent").to_numpy(zero_copy_only=False)
    for k, name in enumerate(_ORDER[1:]):
        raw = batch.column(name).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 1 + 8 * k : 9 + 8 * k] = raw.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S25").ravel()


def _shards(rows: DataFrame, shard_bytes: int, max_shards: int) -> np.ndarray:
    """First key of every shard, from the exact running size of all records in order."""
    spark = rows.sparkSession
    size = F.lit(HEADER_BYTES) + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    sized = rows.select(*_ORDER, size.alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = so_far + np.cumsum(batch.column("size").to_numpy())
            so_far = int(ends[-1]) if len(ends) else so_far
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(ends)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_ORDER, "size", "part", "upto"])

    kinds = "absent boolean, page_id bigint, spread bigint, copy bigint, size bigint, part int, upto bigint"
    ordered = sized.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(run, kinds)
    ordered = cut_lineage(ordered, "ordered")
    sums = ordered.groupBy("part").agg(F.max("upto").alias("bytes")).orderBy("part").collect()  # one row a shuffle partition
    total = sum(r["bytes"] for r in sums)
    if not total:
        return np.zeros(0, "S25")
    width = max(shard_bytes, math.ceil(total / max_shards))
    starts, at = [], 0
    for r in sums:
        starts.append((r["part"], at))
        at += r["bytes"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, offset bigint"))
    shard = F.expr(f"(offset + upto - size) div {width}").cast("int").alias("shard")
    firsts = ordered.join(offsets, "part").select(*_ORDER, shard).groupBy("shard").agg(F.min(F.struct(*_ORDER)).alias("k"))
    firsts = firsts.select("shard", "k.*").orderBy("shard").toArrow()  # MAX_SHARDS rows at most
    return _shard_keys(firsts.combine_chunks().to_batches()[0])


def write_archives(
    pages: DataFrame,
    root: str,
    prefix: str = "pages",
    date: str = DATE,
    file_bytes: int = FILE_BYTES,
    shard_bytes: int = SHARD_BYTES,
    max_shards: int = MAX_SHARDS,
) -> DataFrame:
    """Write a record for every row of `pages` below `root`; returns the manifest (shard, roll, name, records, bytes, sha256).

    pages: page_id, url, html; other columns are ignored. NULL html is an empty payload, a NULL page_id sorts last, a
    NULL url is written as the page's URN. Equal rows have a record each. Payloads of any size are written, one at a time. An
    empty table gives no file and an empty manifest. `root` is a folder that all executors reach (a path or a URI
    that pyarrow opens); its manifest is a table in `root`/manifest.
    """
    rows = cut_lineage(records(pages), "records")
    bounds = rows.sparkSession.sparkContext.broadcast(_shards(rows, shard_bytes, max_shards))
    n_shards = max(1, len(bounds.value))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.searchsorted(bounds.value, _shard_keys(batch), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *batch.columns], names=["shard", *batch.schema.names])

    def place_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in place(batches):
            yield batch.take(pa.array(_may_be_first(batch)))

    kind = ", ".join(f"{n} {t}" for n, t in [("shard", "int"), *rows.withColumn("html", F.lit("")).dtypes])
    told = rows.withColumn("html", F.lit(None).cast("string")).mapInArrow(place, kind)
    payloads = _keyed(pages).where(F.col("payload_bytes") >= REVISIT_BYTES).select(
        F.col("page_id").isNull().alias("absent"),
        F.coalesce("page_id", F.lit(0)).alias("page_id"),
        _spread().alias("spread"),
        F.lit(0).cast("bigint").alias("copy"),
        "url",
        "payload_digest",
        "payload_bytes",
        *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in ("small", "revisit", "refers_to", "refers_url")],
        "html",
    )
    together = told.union(payloads.mapInArrow(place_payloads, kind)).repartition(n_shards, "shard")
    together = together.sortWithinPartitions("shard", "absent", "page_id", "spread", "payload_digest", "url", F.col("html").isNull(), "copy")
    attempt = f"{root.rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _Writer(attempt, prefix, date, file_bytes).write(batches)

    written = cut_lineage(together.mapInArrow(write, _FILES), "warc-files")
    return commit(written, root)


def _may_be_first(batch: pa.RecordBatch) -> list[int]:
    """Rows of a batch whose page may be the response of its payload: of the smallest page_id, each url once."""
    absent, ids = batch.column("absent").to_pylist(), batch.column("page_id").to_pylist()
    digests, urls = batch.column("payload_digest").to_pylist(), batch.column("url").to_pylist()
    best: dict = {}
    for key, digest in zip(zip(absent, ids), digests):
        best[digest] = min(best.get(digest, key), key)
    chosen = {(d, u): k for k, (a, i, d, u) in enumerate(zip(absent, ids, digests, urls)) if best[d] == (a, i)}
    return sorted(chosen.values())


def commit(written: DataFrame, root: str) -> DataFrame:
    """Give the reported files their final names and write the manifest; may be repeated."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, old = _store(r["temporary"])
                _, new = _store(f"{root.rstrip('/')}/{r['name']}")
                if store.get_file_info(old).type == pa.fs.FileType.File:
                    store.move(old, new)
                found = store.get_file_info(new)
                if found.type != pa.fs.FileType.File or found.size != r["bytes"]:
                    raise OSError(f"{new} is not the file that was written")
            yield batch

    spark = written.sparkSession
    manifest = f"{root.rstrip('/')}/manifest"
    spread = written.repartition(max(1, min(MAX_SHARDS, written.count() // 16)))
    spread.mapInArrow(rename, _FILES).drop("temporary").write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class _Writer:
    """The files of one task."""

    def __init__(self, folder: str, prefix: str, date: str, file_bytes: int):
        self.store, self.folder = _store(folder)
        self.uri, self.prefix, self.date, self.limit = folder, prefix, date, file_bytes
        self.out = self.shard = None

    def write(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                row = {n: c[k].as_py() for n, c in columns.items()}
                key = (row["absent"], row["page_id"], row["url"], row["payload_digest"])
                if row["html"] is not None:
                    held = (key, row["html"])
                    continue
                if self.out and (self.shard != row["shard"] or self.bytes >= self.limit):
                    yield self.close()
                if not self.out:
                    self.open(row["shard"])
                payload = row["small"]
                if payload is None and not row["revisit"]:
                    if held[0] != key:
                        raise LookupError(f"page {row['page_id']} has no payload")
                    payload = held[1]
                self.put(_record(row, None if row["revisit"] else payload.encode("utf-8", "replace"), self.date))
        if self.out:
            yield self.close()

    def open(self, shard: int) -> None:
        self.roll = self.roll + 1 if shard == self.shard else 0
        self.shard, self.bytes, self.records, self.digest = shard, 0, 0, hashlib.sha256()
        self.store.create_dir(self.folder, recursive=True)
        self.file = f"{shard:05d}-{self.roll:05d}-{uuid.uuid4().hex}"
        self.name = f"{self.prefix}-{shard:05d}-{self.roll:05d}.warc.gz"
        self.out = self.store.open_output_stream(f"{self.folder}/{self.file}", compression=None)
        self.put(_about(self.name, self.date))
        self.records = 0

    def put(self, record: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.out = None
        row = [self.shard, self.roll, f"{self.uri}/{self.file}", self.name, self.records, self.bytes, self.digest.hexdigest()]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [f.split(" ")[0] for f in _FILES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)


def _identity(absent: bool, page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    raw = hashlib.sha256(repr((absent, page_id, url, digest, copy)).encode("utf-8", "replace")).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=5)}>"


def _target(page_id: int | None, url: str | None) -> str:
    """A url in printable ASCII: blanks, control characters and others are percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{'-' if page_id is None else page_id}"


def _block(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode("ascii") + b"\r\n" + block + b"\r\n\r\n"


def _about(name: str, date: str) -> bytes:
    fields = b"software: pulsemill\r\nformat: WARC File Format 1.1\r\n"
    identity = _identity(False, None, name, "", 0)
    return _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", identity), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], fields)


def _record(row: dict, payload: bytes | None, date: str) -> bytes:
    """A record with headers made anew; of a revisit (no payload) the block is the HTTP header alone."""
    page = None if row["absent"] else row["page_id"]
    size, digest = row["payload_bytes"], row["payload_digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode("ascii")
    headers = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _identity(row["absent"], row["page_id"], row["url"], digest, row["copy"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", _target(page, row["url"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "-" if page is None else page),
        ("X-Payload-Length", size),
    ]
    if payload is None:
        first = row["refers_to"]
        headers += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _identity(first is None, first or 0, row["refers_url"], digest, 0)),
            ("WARC-Refers-To-Target-URI", _target(first, row["refers_url"])),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page-Id", "-" if first is None else first),
        ]
    return _block(headers, http + (payload or b""))


def members(stream, size: int = 1 << 15) -> Iterator[bytes]:
    """The records of a file: what each of its gzip members holds."""
    rest, packer, out = b"", None, []
    while True:
        data = rest or stream.read(size)
        if not data:
            break
        packer = packer or zlib.decompressobj(31)
        out.append(packer.decompress(data))
        rest = packer.unused_data
        if packer.eof:
            yield b"".join(out)
            packer, out = None, []
    if packer:
        raise EOFError("a file ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; its length and block digest are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("ascii").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    block = rest[:length]
    if not version.startswith("WARC/1.") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{headers['warc-record-id']}: the block is not the one that was written")
    return headers, block


def _number(text: str | None) -> int | None:
    return None if text in (None, "-") else int(text)


def _row(record: bytes) -> dict | None:
    headers, block = parse(record)
    kind = headers["warc-type"]
    if kind == "warcinfo":
        return None
    size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha256:")
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, written, digest = len(payload), digest, hashlib.sha256(payload).hexdigest()
        if written != digest:
            raise ValueError(f"{headers['warc-record-id']}: the payload has another digest")
    return {
        "page_id": _number(headers["x-page-id"]),
        "url": headers["warc-target-uri"],
        "payload": None if payload is None else payload.decode("utf-8", "replace"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _number(headers.get("x-refers-to-page-id")),
    }


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files in the manifest below `root`; digests are computed anew and checked.

    Returns page_id, url (as written), payload (NULL for revisits, or if not asked for), payload_bytes, payload_digest,
    record_type and refers_to.
    """
    manifest = spark.read.parquet(f"{root.rstrip('/')}/manifest").select("name")
    base = root.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                store, path = _store(f"{base}/{name}")
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in members(stream):
                        row = _row(record)
                        if row:
                            row["payload"] = row["payload"] if payloads else None
                            rows.append(row)
                            held += len(record)
                        if held > 16 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ROW)

    files = manifest.count()
    return manifest.repartition(max(1, min(MAX_SHARDS, files))).mapInArrow(read, _READ)


_ROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
