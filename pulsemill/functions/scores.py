"""Per-post scores."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .. import fixed_values as v


def lexicon_polarity(
    c: Column,
    bullish=v.BULLISH_TERMS,
    bearish=v.BEARISH_TERMS,
    match: str = "substring",
) -> Column:
    """Sign of (bullish terms present - bearish terms present), each term counted once.

    `match="substring"` finds "gain" in "against"; `match="token"` asks for a free-standing term.
    The terms are searched for in an Arrow worker, several times as fast there as one expression a term; there is no join.
    """
    if match not in ("substring", "token"):
        raise ValueError(f"unknown match: {match}")
    text = F.lower(F.coalesce(c, F.lit("")))
    if match == "token":
        # Pad each run of word characters (marks included) so that a term is a plain substring.
        text = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_]+", " "), F.lit(" "))

    pad = " " if match == "token" else ""
    terms = [(pad + t.lower() + pad, sign) for sign, found in ((1, bullish), (-1, bearish)) for t in found]
    return F.signum(_balance_udf(terms)(text)).cast("int")


def _balance_udf(terms):
    """Sum of the signs of the terms that a text holds. Built in a closure: executors need no copy of this package.

    Places whose first three bytes begin a term are found for all terms at once, and the rest is compared there: terms are put into
    eight groups, a bit each, and a byte's bits say in which groups it may be first, second or third.
    """
    terms = [(np.frombuffer(t.encode(), np.uint8), sign) for t, sign in terms]
    long = [(t, sign, t[0] << 16 | t[1] << 8 | t[2]) for t, sign in ((t.astype(np.int32), sign) for t, sign in terms if len(t) > 2)]
    short = [(t.tobytes(), sign) for t, sign in terms if len(t) < 3]
    starts = np.unique(np.array([code for _, _, code in long], np.int32))
    groups = np.zeros((3, 256), np.uint8)
    for bit, some_starts in enumerate(np.array_split(starts, 8)):
        for n in range(3):
            groups[n, some_starts >> (16 - 8 * n) & 255] |= 1 << bit
    groups = [g.tobytes() for g in groups]
    most = max([len(t) for t, _ in terms], default=0)

    def some(texts):
        joined = b"".join([*texts, bytes(most + 2)])
        data, size = np.frombuffer(joined, np.uint8), len(joined) - most - 2
        first, second, third = (np.frombuffer(joined.translate(g), np.uint8)[n : n + size] for n, g in enumerate(groups))
        ends = np.cumsum([len(t) for t in texts])
        at = np.flatnonzero((first & second & third) != 0)
        code = data[at].astype(np.int32) << 16 | data[at + 1].astype(np.int32) << 8 | data[at + 2]
        known = starts[np.minimum(np.searchsorted(starts, code), len(starts) - 1)] == code if len(starts) else np.zeros(0, bool)
        at, code = at[known], code[known]
        sums = np.array([sum([sign for t, sign in short if t in text]) for text in texts], np.int32)
        for term, sign, start in long:
            place = at[code == start]
            for n in range(3, len(term)):
                place = place[data[place + n] == term[n]]
            text = np.searchsorted(ends, place, side="right")
            # A term never begins in one text and ends in the next.
            sums[np.unique(text[place + len(term) <= ends[text]])] += sign
        return sums

    def balance(batch: pa.Array) -> pa.Array:
        sums = [some(batch.slice(n, 256).cast(pa.large_binary()).to_pylist()) for n in range(0, len(batch), 256)]
        return pa.array(np.concatenate([np.zeros(0, np.int32), *sums]))

    return F.arrow_udf(balance, "int")


def engagement_weight(likes: Column, retweets: Column, replies: Column) -> Column:
    raw = likes * v.LIKE_WEIGHT + retweets * v.RETWEET_WEIGHT + replies * v.REPLY_WEIGHT
    return F.log1p(F.greatest(raw, F.lit(0.0)))


def keyword_signal(polarity: Column, weight: Column) -> Column:
    return polarity * weight


def combined_signal(keyword: Column, tfidf: Column, weight: Column) -> Column:
    return v.KEYWORD_SHARE * keyword + v.TFIDF_SHARE * tfidf * weight
