"""Text normalisation and tokens."""

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..fixed_values import SPACE_CLASS, SPACES, TOKEN_EDGE_PUNCTUATION, ZERO_WIDTH


def _nfkc_udf():
    # Built in a closure, so the executors need no copy of this package. Arrow's own kernel is
    # not used: its NFKC leaves letters decomposed.
    normalize = unicodedata.normalize

    def nfkc_batch(batch: pa.Array) -> pa.Array:
        # Few texts at a time: a batch is never held as Python strings.
        parts = [pa.array([], pa.string())]
        for n in range(0, len(batch), 64):
            texts = batch.slice(n, 64).to_pylist()
            parts.append(pa.array([t if t is None else normalize("NFKC", t) for t in texts], pa.string()))
        return pa.concat_arrays(parts)

    return F.arrow_udf(nfkc_batch, "string")


def nfkc(c: Column) -> Column:
    """Unicode NFKC, which Spark has no expression for.

    ASCII text is already in that form, so it is sent to the Arrow worker as NULL.
    """
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfkc_udf()(foreign), c)


def strip_zero_width(c: Column) -> Column:
    """Without zero-width characters. Plain byte searches are cheaper here than translate."""
    return reduce(lambda text, mark: F.replace(text, F.lit(mark)), ZERO_WIDTH, c)


def strip_space(c: Column) -> Column:
    """Unicode white space cut from both ends."""
    return F.btrim(c, F.lit(SPACES))


def squeeze_space(c: Column, space: str = SPACE_CLASS) -> Column:
    """Every run of Unicode white space becomes one blank; the ends are cut."""
    return F.trim(F.regexp_replace(c, f"{space}+", " "))


def _tidy_udf():
    # What Python calls white space is SPACE_CLASS.
    normalize, marks = unicodedata.normalize, ZERO_WIDTH

    def tidy(text):
        if not text.isascii():
            text = normalize("NFKC", text)
            for mark in marks:
                text = text.replace(mark, "")
        return " ".join(text.split())

    def tidy_batch(batch: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for n in range(0, len(batch), 64):
            texts = batch.slice(n, 64).to_pylist()
            parts.append(pa.array(["" if t is None else tidy(t) for t in texts], pa.string()))
        return pa.concat_arrays(parts)

    return F.arrow_udf(tidy_batch, "string")


def normalize_text(c: Column) -> Column:
    """NFKC, then zero-width characters out, then white space squeezed; NULL becomes ''.

    One pass of the Arrow worker over all texts: a regular expression that meets every blank costs several times as much.
    """
    return _tidy_udf()(c)


def token_set(c: Column) -> Column:
    """Distinct lower-case tokens of two or more characters, edge punctuation cut afterwards."""
    words = F.split(squeeze_space(F.coalesce(c, F.lit(""))), " ")
    long_words = F.filter(words, lambda w: F.char_length(w) > 1)
    edge = F.lit(TOKEN_EDGE_PUNCTUATION)
    return F.array_distinct(F.transform(long_words, lambda w: F.lower(F.btrim(w, edge))))
