"""Bounds, hot rows and plain counts of the operators that learn from the corpus."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pulsemill.llm import language_id, onebit_search, pii, quality_gam

DOCS = "doc_id BIGINT, text STRING, lang STRING, text_key STRING, label STRING, term STRING"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, lang, "clash", "clash", "clash") for k, (t, lang) in enumerate(rows)], DOCS).repartition(parts)


def search(spark, rows, **how):
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = onebit_search.search(vectors, F.col("vec_id") % 20 == 0, **how).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


def test_every_row_is_a_candidate_whatever_its_id_and_length(spark):
    rows = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [-5.0, 0.0]), (2, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 1.0, 1.0]), (40, [1.0])]
    assert search(spark, rows) == [(0, 1, 1, 5.0), (0, 2, 2, 1.0), (0, 3, 1, -5.0), (20, 1, 21, 6.0)]


def test_huge_numbers(spark):
    draw = np.random.default_rng(3)
    v = draw.standard_normal((60, 8))
    plain = [r[:3] for r in search(spark, [(k, x.tolist()) for k, x in enumerate(v)], nearest=5)]
    assert [r[:3] for r in search(spark, [(k, (x * 2.0**700).tolist()) for k, x in enumerate(v)], nearest=5)] == plain
    mixed = [(0, [1.0, 1.0]), (1, [1e200, 0.0]), (2, [2.0, 0.0]), (3, [-1e200, 1e200]), (20, [1e200, 1e200])]
    got = search(spark, mixed)
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (0, 4, 3)] and got[2][3] == 2.0
    assert [r[2] for r in got if r[0] == 20][:1] == [1] and got[4][3] == math.inf


def test_the_fit_is_bounded_by_rows_not_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y: seen.append((len(x), x.copy(), y.copy())) or quality_gam.Model(base=0.0))
    texts = [(f"some words of text {n} " * (n + 1), "en") for n in range(40)]
    docs = table(spark, texts)
    hot = docs.union(docs.where("doc_id = 4").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id BIGINT, quality INT")
    for some in (docs, hot, hot.repartition(7)):
        quality_gam.train(some, labels, max_rows=20)
    assert [s[0] for s in seen] == [20] * 3 and all((s[1] == seen[0][1]).all() and (s[2] == seen[0][2]).all() for s in seen)
    quality_gam.train(docs.limit(0), labels)
    assert seen[-1][0] == 0


def test_languages_equal_plain_votes(spark):
    draw = random.Random(2)
    stock = {lang: ["".join(draw.choices(letters, k=draw.randrange(1, 9))) for _ in range(60)] for lang, letters in (("aa", "abcdeß"), ("bb", "cdefgé"), ("cc", "xyzab"))}
    rows = []
    for _ in range(90):
        lang = draw.choice(list(stock))
        own = draw.choices(stock[lang], k=draw.randrange(12)) + ["".join(draw.choices("abcdefgxyz", k=6)) for _ in range(draw.randrange(4))]
        rows.append((" 7_".join(own), draw.choice([lang, lang, None])))
    rows += [(None, "aa"), ("", None), ("42 !", "bb"), ("x" * 3000, "cc"), ("中 文", None)]
    docs = table(spark, rows)
    taught = {r.doc_id for r in docs.where(F.col("lang").isNotNull() & ~language_id.held_out(F.col("doc_id"))).select("doc_id").collect()}
    counts, langs = defaultdict(Counter), sorted({rows[d][1] for d in taught})
    for d in taught:
        for w in language_id.words_of(rows[d][0]):
            counts[rows[d][1], 0][w] += 1
            for n in language_id.LENGTHS:
                counts[rows[d][1], n].update(language_id.grams_of(w, n))
    known = lambda kind, t: any(counts[lang, kind][t] for lang in langs)
    vote = lambda kind, t: np.array([math.log((counts[x, kind][t] or 0.5) / (sum(counts[x, kind].values()) + 1)) for x in langs])
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    for d, (text, _) in enumerate(rows):
        words, total = language_id.words_of(text), np.zeros(len(langs))
        for w in words:
            if known(0, w):
                total += vote(0, w)
                continue
            for step, n in enumerate(language_id.LENGTHS, 1):
                found = [vote(n, g) for g in language_id.grams_of(w, n) if known(n, g)]
                if found:
                    total += np.mean(found, axis=0) * language_id.BACKOFF**step
                    break
        if not words:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        odds = np.exp(total - total.max())
        assert abs(got[d].score - odds.max() / odds.sum()) < 1e-9
        assert abs(total[langs.index(got[d].lang_pred)] - total.max()) < 1e-9


def disclosing(texts):
    """Flagged words by counts in different texts, as the module's docstring has them."""
    once = sorted({t or "" for t in texts})
    find = re.compile("[0-9a-z\x80-\U0010ffff]+")
    words = {t: [(m[0], m.start(), m.end()) for m in find.finditer(t.translate({i: i + 32 for i in range(65, 91)}))] for t in once}
    has, together, holds = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in once:
        spans = pii.base_spans(t)
        free = [w for w in words[t] if not any(a < w[2] and w[1] < b for a, _, b in spans)]
        for w in words[t]:
            has[w[0]].add(t)
        for a, _, b in spans:
            entity = t[a:b].lower()
            holds[entity].add(t)
            before, after = [w for w in words[t] if w[1] < a][-pii.REACH :], [w for w in words[t] if w[1] >= b][: pii.REACH]
            for w in before + after:
                if w in free:
                    together[entity, w[0]].add(t)
    out = set()
    for (entity, w), both in together.items():
        n_ct, n_t, base, z = len(both), len(has[w]), len(holds[entity]) / len(once), pii.DEVIATIONS
        p = n_ct / n_t
        least = (p + z * z / (2 * n_t) - z * math.sqrt(p * (1 - p) / n_t + z * z / (4 * n_t * n_t))) / (1 + z * z / n_t)
        told = (n_ct + pii.PRIOR * base) / (n_t + pii.PRIOR)
        if least >= pii.CERTAIN and math.log(told / base) / -math.log(base) >= pii.GENERALISE:
            out.add(w)
    return out


def private_texts(unrelated):
    draw = random.Random(9)
    stock = [f"common{n}" for n in range(30)]
    texts = []
    for n in range(12):
        mail = f"user{n % 6}@ex.org"
        texts.append(" ".join([*draw.choices(stock, k=9), f"Nick{n % 6}", mail, f"rare{n}", *draw.choices(stock, k=12), f"far{n}"]))
    texts += ["rare3 in another text", "nick1 and rare4 and common3", None, ""]
    return texts + [" ".join([*draw.choices(stock, k=8), f"plain{n}"]) for n in range(unrelated)]


def test_disclosing_terms_equal_plain_counts(spark):
    texts = private_texts(200)
    flagged = disclosing(texts)
    got = {r.doc_id: r for r in pii.find(table(spark, [(t, "en") for t in texts + texts[:2]]), everywhere=True).collect()}
    assert {"rare0", "nick2"} <= flagged and not {"rare3", "common3"} & flagged
    for d, text in enumerate(texts):
        spans = pii.base_spans(text)
        want = [
            (m.start(), m.end())
            for m in re.finditer("[0-9A-Za-z]+", text or "")
            if m[0].lower() in flagged and not any(a < m.end() and m.start() < b for a, _, b in spans)
        ]
        assert [(t.start, t.end) for t in got[d].terms] == want
    # Texts without a pattern lose no word but those that are certain enough.
    assert [d for d in range(16, len(texts)) if got[d].terms] == []


def test_more_unrelated_texts_flag_no_more_words(spark):
    few, many = (
        {text[t.start : t.end].lower() for r in pii.find(table(spark, [(t, "en") for t in texts]), everywhere=True).collect() for text in [texts[r.doc_id]] for t in r.terms}
        for texts in (private_texts(200), private_texts(2000))
    )
    assert few == many != set()
