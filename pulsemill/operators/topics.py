"""Label posts by the first topic rule they match."""

import re
import unicodedata
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import TOPIC_RULES, WORD_CLASS


def parse_rules(rules=TOPIC_RULES):
    """(order, label, clauses) per rule: OR between clauses, AND between the words of one."""
    return [
        (n, label, [clause.lower().split() for clause in text.split(" OR ")])
        for n, (label, text) in enumerate(rules, start=1)
    ]


def topic_tokens(content: Column, wanted=None) -> Column:
    """Distinct lower-case words, hashtags (with '#') and the words of hashtags; only `wanted` ones if given."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(content, F.lit(""))), F.lit(f"(#?{WORD_CLASS}+)"), F.lit(1)
    )
    if wanted:
        marked = sorted({"#" + w.lstrip("#") for w in wanted} | set(wanted))
        found = F.filter(found, lambda t: t.isin(*marked))
    return F.array_distinct(F.concat(found, F.transform(found, lambda t: F.ltrim(t, F.lit("#")))))


def topic_label(tokens: Column, rules=TOPIC_RULES) -> Column:
    """Label of the first matching rule, NULL without one."""
    branches = [
        F.when(
            reduce(or_, [reduce(and_, [F.array_contains(tokens, w) for w in c]) for c in clauses]),
            label,
        )
        for _, label, clauses in parse_rules(rules)
    ]
    return F.coalesce(*branches)


def match_topics(posts: DataFrame, rules=TOPIC_RULES) -> DataFrame:
    """Posts with a `topic` label, found without a join; unmatched posts get NULL."""
    return posts.withColumn("topic", _label_of(F.col("content"), rules))


def _holds(text: Column, word: str) -> Column:
    """Whether `topic_tokens` of the lower-cased text hold the word. A plain search comes first: most texts lack most words."""
    run = word.lstrip("#")
    if len(word) - len(run) > 1 or not run or any(unicodedata.category(c)[0] not in "LN" and c != "_" for c in run):
        return F.lit(False)  # not a token
    mark = "#" if word != run else ""
    free = f"{mark}{re.escape(run)}(?<!{WORD_CLASS}{re.escape(run)})(?!{WORD_CLASS})"
    return text.contains(word) & text.rlike(free)


def _label_of(content: Column, rules) -> Column:
    """As `topic_label` of the text's tokens, without a list of tokens."""
    text = F.lower(F.coalesce(content, F.lit("")))
    branches = [
        F.when(reduce(or_, [reduce(and_, [_holds(text, w) for w in c]) for c in clauses]), label) for _, label, clauses in parse_rules(rules)
    ]
    return F.coalesce(*branches)


def rule_words(rules: DataFrame) -> DataFrame:
    """Rule table `(ord, label, clauses ARRAY<ARRAY<STRING>>)` to one row per clause word."""
    clause = rules.select("ord", "label", F.posexplode("clauses").alias("clause", "words"))
    lower = F.transform("words", lambda w: F.lower(w))
    words = clause.select("ord", "label", "clause", F.array_distinct(lower).alias("words"))
    return words.select(
        "ord", "label", "clause", F.size("words").alias("needed"), F.explode("words").alias("word")
    )


def match_topic_table(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """As `match_topics`, for a rule table of any size.

    A label depends on the text alone, so texts are labelled once each, by digest, and labels joined back. The words
    of the texts are equi-joined with the rules' words; a text meets at most the rules that share one with it. The rules are
    sent round, whatever Spark takes their size for: dealt by word, every word of every text would be shuffled.
    """
    keyed = posts.withColumn("_text", F.unhex(F.sha2(F.coalesce("content", F.lit("")), 256)))
    words = keyed.select("_text", F.explode(topic_tokens(F.col("content"))).alias("word"))
    hits = words.join(F.broadcast(rule_words(rules)), "word").distinct().groupBy("_text", "ord", "clause", "label", "needed")
    full = hits.count().where(F.col("count") == F.col("needed"))
    labels = full.groupBy("_text").agg(F.min_by("label", "ord").alias("topic"))
    return keyed.join(labels, "_text", "left").drop("_text")
