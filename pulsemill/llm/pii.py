"""Personal data: patterns, and terms that give the patterns' values away.

Addresses, numbers and phones found by pattern are protected entities. From all documents it is estimated how
much a word near an entity tells of it: the pointwise mutual information of word and entity, log(P(c|t) / P(c)), as a
share of the entity's information content -log P(c). A share of 1 means that the word occurs
only with that entity. Words above `REMOVE` are removed, those above `GENERALISE` replaced by their kind; the entities
themselves are replaced by theirs. Such words go from the whole text: every occurrence in a document that holds the entity,
or, with `everywhere`, in every document.

All counts are of different texts, so that copies are one witness: N texts, n_c with the entity, n_t with the word, n_ct
with the word near the entity. P(c) is n_c / N, and P(c|t) is (n_ct + PRIOR P(c)) / (n_t + PRIOR), as if PRIOR more texts
named the word and held the entity as often as any. That decides for entities seen once too, with more caution the fewer
witnesses there are. Information grows with the number of texts, however common a word is beside its entity; so the word's own
texts must also hold the entity at a share that is certain enough (`CERTAIN`). Only words near an entity are counted,
through a bitmap of fixed size.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pulsemill.llm.arrow_text import Words, pieces
from pulsemill.llm.bitmap import bitmap, in_bitmap
from pulsemill.llm.names import free_name
from pulsemill.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
# Words before and after an entity that are its surroundings.
REACH = 8
PRIOR = 2
GENERALISE = 0.75
# A word discloses an entity only if the share of its texts that hold the entity is this much at least, by the lower end of
# Wilson's interval at DEVIATIONS: 1 of 1, 2 of 2 or 3, not 1 of 2. Other than the information, it does not grow with the corpus.
CERTAIN = 0.25
DEVIATIONS = 1.645
REMOVE = 0.9

# The patterns, and how long their matches may be.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_SPAN = "struct<start: bigint, kind: int, end: bigint>"
_WORD = "struct<term: bigint, start: bigint, end: bigint>"
_SCANNED = f"doc_id bigint, text_key bigint, spans array<{_SPAN}>, mentions array<struct<entity: bigint, words: array<{_WORD}>>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time: from each @ both ways."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = max(done, at)
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all entities, sorted."""
    text = text or ""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m[0])) if m.end() - m.start() <= 37 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


class _Places:
    """Where the words of one text are, in characters."""

    def __init__(self, text: str, words: Words, doc: int):
        self.first, last = int(words.first[doc]), int(words.first[doc + 1])
        self.words, self.base = words, int(words.offsets[doc])
        # Code points up to each byte of the text, to turn byte into character positions.
        raw = words.data[self.base : int(words.offsets[doc + 1])]
        self.points = np.cumsum((raw & 0xC0) != 0x80) if len(raw) != len(text) else None
        starts = words.start[self.first : last] - self.base
        self.begins = starts if self.points is None else self.points[starts] - 1

    def word(self, k: int, spans) -> dict | None:
        """Word k of the text, unless it stands in a span."""
        byte = int(self.words.end[self.first + k]) - self.base
        low, high = int(self.begins[k]), byte if self.points is None else int(self.points[byte - 1])
        if any(s < high and low < e for s, _, e in spans):
            return None
        return {"term": int(self.words.hash[self.first + k].view(np.int64)), "start": low, "end": high}


def _mentions(text: str, spans, words: Words, doc: int, reach: int):
    """For each entity its hash and the words around it."""
    places = _Places(text, words, doc)
    begins = places.begins
    out = []
    for start, kind, end in spans:
        value = text[start:end].lower() if kind == 0 else "".join(_DIGITS.findall(text[start:end])) if kind else text[start:end]
        a, b = int(np.searchsorted(begins, start)), int(np.searchsorted(begins, end))
        near = [places.word(k, spans) for k in [*range(max(0, a - reach), a), *range(b, min(len(begins), b + reach))]]
        near = [w for w in near if w]
        entity = xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}".encode("utf-8", "replace"))
        out.append({"entity": _signed(entity), "words": near})
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def find(
    docs: DataFrame, reach: int = REACH, prior: float = PRIOR, threshold: float = GENERALISE, everywhere: bool = False, certain: float = CERTAIN
) -> DataFrame:
    """Entities and disclosing terms of every document row; terms `everywhere`, or where the document holds their entity.

    docs: doc_id, text; other columns are ignored. Returns doc_id, text_key (xxhash64 of the text), base and terms: arrays
    of (start, kind, end) by start, kind a number in KINDS, code points, end exclusive, terms with `share`. NULL and
    empty texts have none; repeated rows give repeated rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            spans = [base_spans(t) for t in texts]
            words = Words(batch.column("text")) if any(spans) else None
            mentions = [_mentions(t, s, words, k, reach) if s else [] for k, (t, s) in enumerate(zip(texts, spans))]
            listed = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(listed, _ARROW_SPANS), pa.array(mentions, _ARROW_MENTIONS)],
                names=["doc_id", "text_key", "spans", "mentions"],
            )

    scanned = cut_lineage(rows.mapInArrow(scan, _SCANNED), "entities")
    mentions = scanned.where(F.size("mentions") > 0).select("doc_id", "text_key", F.inline("mentions"))
    near = mentions.select("doc_id", "text_key", "entity", F.inline("words"))
    flagged = cut_lineage(_disclosing(rows, scanned.select("text_key"), mentions, near, prior, threshold, certain), "flagged")
    if everywhere:
        named = _occurrences(rows, flagged).join(flagged.groupBy("term").agg(F.max("share").alias("share")), "term")
    else:
        held = mentions.select("text_key", "entity").distinct().join(flagged, "entity")
        named = _occurrences(rows, flagged).join(held.groupBy("text_key", "term").agg(F.max("share").alias("share")), ["text_key", "term"])
    place = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "share")
    terms = named.groupBy("doc_id", "text_key", "start", "end").agg(F.max("share").alias("share"))
    terms = terms.groupBy(F.col("doc_id").alias("in_doc"), F.col("text_key").alias("in_text"))
    terms = terms.agg(F.sort_array(F.collect_list(place)).alias("terms"))
    same = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_key") == F.col("in_text"))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, share: double>>")
    return scanned.join(terms, same, "left").select(
        "doc_id", "text_key", F.col("spans").alias("base"), F.coalesce("terms", none).alias("terms")
    )


def _occurrences(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, text_key, term, start and end of the flagged terms in all texts, outside of entities; and of a few other words."""
    bits = bitmap(flagged.select("term").distinct(), "term")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column("text"))
            hit = np.flatnonzero(in_bitmap(bits.value, words.hash))
            docs, cuts = np.unique(words.doc[hit], return_index=True)
            lists = [[] for _ in range(batch.num_rows)]
            for doc, at in zip(docs.tolist(), np.split(hit, cuts[1:])):
                text = batch.column("text")[doc].as_py()
                places, spans = _Places(text, words, doc), base_spans(text)
                lists[doc] = [w for k in at.tolist() if (w := places.word(k - places.first, spans))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(lists, _ARROW_WORDS)], names=["doc_id", "text_key", "words"]
            )

    found = rows.mapInArrow(scan, f"doc_id bigint, text_key bigint, words array<{_WORD}>")
    return found.select("doc_id", "text_key", F.inline("words"))


def _disclosing(rows: DataFrame, keys: DataFrame, mentions: DataFrame, near: DataFrame, prior: float, threshold: float, certain: float) -> DataFrame:
    """(entity, term, share) of the pairs above the threshold; `keys` are the text_key of all rows."""
    together = near.select("entity", "term", "text_key").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    together = cut_lineage(together, "pairs")
    alone = mentions.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    bits = bitmap(together.select("term").distinct(), "term")
    copies = cut_lineage(keys.groupBy("text_key").agg(F.count("*").alias("n")), "copies")
    total = F.lit(float(copies.count()))
    repeated = bitmap(copies.where("n > 1"), "text_key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of texts that may be repeated with their text, all others summed."""
        for batch in pieces(batches):
            words, keys = Words(batch.column("text")), batch.column("text_key").to_numpy()
            hit = np.flatnonzero(in_bitmap(bits.value, words.hash))
            doc, once = np.unique(np.stack([words.doc[hit].astype(np.uint64), words.hash[hit]]), axis=1) if len(hit) else (words.hash[:0],) * 2
            several = in_bitmap(repeated.value, keys.view(np.uint64))[doc.astype(np.int64)]
            term, times = np.unique(once[~several], return_counts=True)
            n = np.concatenate([times, np.ones(several.sum(), np.int64)]).astype(np.int64)
            of = pa.array([None] * len(term) + keys[doc[several].astype(np.int64)].tolist(), pa.int64())
            terms = pa.array(np.concatenate([term, once[several]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([of, terms, pa.array(n)], names=["text_key", "term", "n"])

    counted = rows.select("text", "text_key").mapInArrow(count, "text_key bigint, term bigint, n bigint")
    counted = counted.groupBy("text_key", "term").agg(F.sum(F.when(F.col("text_key").isNull(), F.col("n"))).alias("n"))
    in_texts = counted.groupBy("term").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n_t"))
    base = F.col("n_c") / total
    told = (F.col("n_ct") + prior * base) / (F.col("n_t") + prior)
    p, n, z = F.col("n_ct") / F.col("n_t"), F.col("n_t"), F.lit(DEVIATIONS)
    least = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (
        together.join(alone, "entity")
        .join(in_texts, "term")
        .where(least >= certain)
        .select("entity", "term", F.when(base < 1, F.least(F.lit(1.0), F.log(told / base) / -F.log(base))).alias("share"))
        .where(F.col("share") >= threshold)
    )


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sanitise(docs: DataFrame, remove: float = REMOVE, **how) -> DataFrame:
    """The documents with entities generalised to their kinds and disclosing terms generalised or removed.

    All columns as they are but text and, where there is one, n_chars (length of the new text). Where spans
    overlap, their union is replaced by the kind of the first. NULL and empty texts stay, very long ones are worked on
    whole, repeated rows stay and change alike, an empty table stays empty.
    """
    key, spans_name = free_name(docs, "text_key"), free_name(docs, "pii_spans")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(0.0).alias("share")))
    found = find(docs, **how).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "text_key"])
    found = found.select(
        F.col("doc_id").alias("in_doc"), F.col("text_key").alias("in_text"), F.sort_array(F.concat(plain, "terms")).alias(spans_name)
    )
    same = keyed.doc_id.cast("bigint").eqNullSafe(found.in_doc) & (keyed[key] == found.in_text)
    joined = keyed.join(found, same, "left").select(*[keyed[c] for c in docs.columns], found[spans_name])
    names = docs.columns
    place = names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            spans = batch.column(spans_name).to_pylist()
            columns = list(batch.columns[:-1])
            if any(spans):
                texts = [_rewritten(t, s, remove) if s else t for t, s in zip(columns[place].to_pylist(), spans)]
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(rewrite, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out


def _rewritten(text: str, spans: list[dict], remove: float) -> str:
    out, done = [], 0
    for s in spans:
        if s["start"] < done:
            done = max(done, s["end"])
            continue
        out.append(text[done : s["start"]])
        if s["kind"] < KINDS.index("term"):
            out.append(f"[{KINDS[s['kind']].upper()}]")
        elif s["share"] < remove:
            out.append("[NUMBER]" if text[s["start"] : s["end"]].isdigit() else "[WORD]")
        done = s["end"]
    return "".join([*out, text[done:]])


_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_ARROW_WORDS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_ARROW_MENTIONS = pa.list_(
    pa.struct(
        [
            ("entity", pa.int64()),
            ("words", _ARROW_WORDS),
        ]
    )
)
