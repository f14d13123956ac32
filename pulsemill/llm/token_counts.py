"""Token counts with a digest cache.

Counts are stored once per distinct content and tokenizer version: a table of (tokenizer digest, content
digest, count), partitioned by tokenizer. Documents are reduced to digests, digests joined to the stored counts;
only one document of each missing digest is encoded, and its count appended.
"""

import hashlib
import json
import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemill.llm.arrow_text import pieces
from pulsemill.session import cut_lineage
from pulsemill.sources.guards import load_or_empty

LIMIT = 512
_CACHE = "tokenizer string, content string, n_tokens bigint"
_BATCH_BYTES = 1 << 18

# Byte-level tokenizers cut a text before a single blank between two other characters, whatever stands around: no word runs on
# over a blank, and a blank before anything but white space begins the next word. So a text's count is the sum of those of its
# parts, and a task encodes equal parts once. Parts of up to PART characters are remembered, about PARTS of them; both limits
# concern memory only.
_BREAK = re.compile(r"(?<=\S)(?= \S)")
PART = 64
PARTS = 1 << 19


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file, the library and its version, and how it is called."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{content} {library.__name__} {library.__version__} plain".encode()).hexdigest()


def cuts_at_blanks(model) -> bool:
    """Whether this tokenizer (of the library for .json) is byte-level with the usual pattern and nothing that looks past a blank."""
    made = json.loads(model.to_str())
    before, merges = made["pre_tokenizer"] or {}, made["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not made["normalizer"]
    strips = any(t[how] for t in made["added_tokens"] for how in ("lstrip", "rstrip", "single_word"))
    return bool(
        plain and merges["type"] == "BPE" and not merges.get("dropout") and not strips and not any(_BREAK.search(t["content"]) for t in made["added_tokens"])
    )


class Encoder:
    """Counts tokens with the library that belongs to the file: no added tokens, no truncation, no padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.pieces = path.endswith(".model")
        self.known, self.parts = {}, False
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import tokenizers

            self.model = tokenizers.Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.parts = cuts_at_blanks(self.model)

    def count(self, texts: list[str]) -> list[int]:
        if not self.parts:
            return self._whole(texts)
        parts, known = [_BREAK.split(t) for t in texts], self.known
        fresh = list(set().union(*parts).difference(known))
        known.update(zip(fresh, self._whole(fresh)))
        counts = [sum(map(known.__getitem__, some)) for some in parts]
        for part in fresh:
            if len(part) > PART:
                del known[part]
        if len(known) > PARTS:
            known.clear()
        return counts

    def _whole(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)  # the same ids, without offsets
        return [len(x.ids) for x in encode(texts, add_special_tokens=False)]


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    stored = load_or_empty(spark, lambda: spark.read.schema(_CACHE).parquet(cache), _CACHE, "empty")
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have met


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document row.

    docs: doc_id, text; other columns are ignored. cache: folder in a store all executors share; it is read,
    and counts of new contents are appended. tokenizer: name of a file of `public_tokenizers`. Returns doc_id,
    n_bytes (UTF-8), n_tokens, over_limit. Contents are normalised only so far as no tokenizer can tell them
    apart: NULL is empty text.
    """
    spark = docs.sparkSession
    path = public_tokenizers.path(tokenizer)
    version = tokenizer_version(path)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("content"))
    keyed = cut_lineage(rows.select("doc_id", "content", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")

    missing = keyed.groupBy("content").agg(F.min("doc_id").alias("first")).join(_cached(spark, cache, version), "content", "left_anti")
    # Only the narrow side is hashed; the texts stream past it.
    to_encode = rows.join(
        missing.hint("shuffle_hash"), (rows.content == missing.content) & rows.doc_id.eqNullSafe(missing["first"]), "left_semi"
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in pieces(batches, size=_BATCH_BYTES):
            encoder = encoder or Encoder(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(encoder.count(batch.column("text").to_pylist()), pa.int64())], names=["content", "n_tokens"]
            )

    fresh = to_encode.select("content", "text").mapInArrow(encode, "content string, n_tokens bigint")
    fresh = fresh.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # repeated rows
    fresh.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)

    # Counts read from files are not bound to the join's partitions: Spark can split a content with very many copies.
    counts = cut_lineage(_cached(spark, cache, version), "counts")
    return keyed.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
