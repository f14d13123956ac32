import re
import unicodedata
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsemill import fixed_values as v
from pulsemill import functions as fn


def check(apply, function, cases, kind="string"):
    got = apply(function, [x for x, _ in cases], kind)
    assert got == [y for _, y in cases]


def test_parse_count(apply):
    check(
        apply,
        fn.parse_count,
        [
            ("", 0), (None, 0), ("7", 7), ("1,234", 1234), ("1.2K", 1200), ("32.3K", 32299),
            ("8.2M", 8199999), ("5B", 0), ("2k", 0), ("abc", 0), ("1.5 K", 1500), ("-5", -5),
            ("nan", 0), ("inf", 0), ("1d", 0), (" 3 ", 3), ("K", 0), ("1e3", 1000), ("9e99", 0),
        ],
    )


def test_safe_int(apply):
    check(
        apply,
        fn.safe_int,
        [
            (None, 0), ("3", 3), ("3.9", 3), ("-3.9", -3), ("x", 0), ("NaN", 0), ("Infinity", 0),
            ("7300000000000000017", 7300000000000000017), ("99999999999999999999", 0), (" 4 ", 4), ("1d", 0),
        ],
    )


def test_first_metric(spark):
    rows = spark.createDataFrame([("", "1.2K"), (" ", "3"), ("4", "5"), (None, None)], "a STRING, b STRING")
    got = rows.select(fn.first_metric(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [1200, 3, 4, 0]


SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def plain_normalize(text):
    text = unicodedata.normalize("NFKC", text or "")
    for c in v.ZERO_WIDTH:
        text = text.replace(c, "")
    return " ".join(text.split())


def test_normalize_text(apply):
    texts = [
        None, "", "ＡＢc １２", "ﬁne", "a​b‌c‍d﻿e", "a b\u0085c d　e",
        " \t\nx \r\n y ", "café", "가", "क़", "①", *[f"a{s}b" for s in SPACES],
    ]
    got = apply(fn.normalize_text, texts)
    assert got == [plain_normalize(t) for t in texts]
    assert apply(fn.normalize_text, got) == got


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=50, max_size=50))
def test_normalize_any_text(apply, texts):
    assert apply(fn.normalize_text, texts) == [plain_normalize(t) for t in texts]


def test_timestamps(apply):
    shown = [
        "2026-01-14T05:35:17.000Z", "2026-01-14T05:35:17+05:30", "2026-01-14T05:35:17.123456Z",
        "2026-01-14 05:35Z", "2026", "17:05", "2026-01-14T05:35:17", "2026-01-14", "soon", "2026-02-30T00:00:00Z", None,
    ]
    whole = datetime(2026, 1, 14, 5, 35, 17)
    strict = [
        whole, datetime(2026, 1, 14, 0, 5, 17), whole.replace(microsecond=123456), whole.replace(second=0),
        None, None, None, None, None, None, None,
    ]
    loose = strict[:4] + [None, None, whole, datetime(2026, 1, 14), None, None, None]
    assert apply(lambda c: fn.parse_instant(c).cast("timestamp_ntz"), shown) == strict
    assert apply(lambda c: fn.coerce_instant(c).cast("timestamp_ntz"), shown) == loose


def test_hours(apply):
    at = [datetime(2026, 1, 14, 0, 59, 59), datetime(2026, 1, 14, 1, 0, 0)]
    got = apply(fn.hour_start, at, "timestamp_ntz")
    assert got == [datetime(2026, 1, 14, 0), datetime(2026, 1, 14, 1)]


def test_tags(apply):
    texts = ["#a,#b #A #a", "no tag", "#", None, "#तेज़ी x", "#café_1 @me,@You", "mail@host"]
    pattern = re.compile(r"#\w+")
    assert apply(fn.hashtags, texts) == [pattern.findall(t or "") for t in texts]
    pattern = re.compile(r"@\w+")
    assert apply(fn.mentions, texts) == [pattern.findall(t or "") for t in texts]
    check(
        apply,
        fn.split_tags,
        [(None, []), ("", []), (" , ,", []), ("#a, #b , #c", ["#a", "#b", "#c"])],
    )


def test_tag_fallback(spark):
    rows = spark.createDataFrame([("#x", "#y"), ("", "#y #z"), (None, "none")], "h STRING, c STRING")
    tags = fn.tags_or_extract(fn.split_tags(F.col("h")), fn.hashtags(F.col("c")))
    got = rows.select(tags.alias("t"), fn.json_text(tags).alias("j"), fn.comma_text(tags).alias("c")).collect()
    assert [r.t for r in got] == [["#x"], ["#y", "#z"], []]
    assert [r.j for r in got] == ['["#x"]', '["#y","#z"]', "[]"]
    assert [r.c for r in got] == ["#x", "#y,#z", ""]


def test_links(apply):
    url = "https://example.com/u/status/12"
    check(
        apply,
        fn.canonical_url,
        [(url, url), (url + "?s=20", url), (url + "/photo/1", url + "/photo/1"), ("https://example.com/u", None),
         ("https://example.com/?to=/status/1", None), ("", None), (None, None)],
    )
    check(apply, fn.status_id, [(url, "12"), (url + "/photo/1", "12"), ("x", ""), (None, "")])
    check(
        apply,
        fn.author_handle,
        [("Name\n@me_1\n2h", "@me_1"), ("Only name\nx", "Only name"), ("", ""), (None, "")],
    )


def test_token_set(apply):
    got = apply(fn.token_set, ["The (cat), the a .. CAT!", None, "x"])
    assert [sorted(t) for t in got] == [["", "cat", "the"], [], []]


def brute_polarity(text):
    text = (text or "").lower()
    score = sum(t in text for t in v.BULLISH_TERMS) - sum(t in text for t in v.BEARISH_TERMS)
    return (score > 0) - (score < 0)


def test_polarity(apply):
    texts = [None, "", "nothing", "buy", "SELL now", "buy and sell", "bullish but sell", "against", "belong", "मंदी",
             "खरीदो", "bahar nikal jao", "paisa banega", "bearish crash moon"]
    assert apply(fn.lexicon_polarity, texts) == [brute_polarity(t) for t in texts]
    by_token = apply(lambda c: fn.lexicon_polarity(c, match="token"), ["against", "a gain!", "(sell)", "खरीदो"])
    assert by_token == [0, 1, -1, 1]


def test_engagement(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 0, 1), (-9, 0, 0), (3, 2, 4)], "a BIGINT, b BIGINT, c BIGINT")
    got = [r.w for r in rows.select(fn.engagement_weight(F.col("a"), F.col("b"), F.col("c")).alias("w")).collect()]
    import math

    want = [0.0, math.log(2), math.log(2.5), 0.0, math.log(10)]
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, want))


def test_stop_words(spark):
    from pyspark.ml.feature import StopWordsRemover

    listed = StopWordsRemover.loadDefaultStopWords("english")
    assert v.ENGLISH_STOP_WORDS == tuple(w for w in listed if re.fullmatch(r"\w{2,}", w))


def test_nfkc_holds_few_texts_of_a_batch(monkeypatch):
    """A batch is normalised in short slices, never as one list of Python strings."""
    import unicodedata

    import pyarrow as pa

    from pulsemill.functions import text

    class Batch(list):
        def slice(self, start, size):
            return Batch(self[start : start + size])

        def to_pylist(self):
            assert len(self) <= 64
            return list(self)

    texts = [None if n % 7 == 0 else f"Ａé　{n}" for n in range(300)]
    monkeypatch.setattr(text.F, "arrow_udf", lambda function, kind: function)
    run = text._nfkc_udf()
    assert run(Batch(texts)).to_pylist() == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert run(pa.array([], pa.string())).to_pylist() == []


def test_all_white_space_is_cut(apply):
    inside = f"a{fn.text.SPACES}b"
    texts = [f"{fn.text.SPACES}{inside}{fn.text.SPACES[::-1]}", fn.text.SPACES, "\u200b x \r\n", "", None, "e\u200d\u0301", "\u00a0e\u0301 "]
    assert apply(fn.strip_space, texts) == [inside, "", "\u200b x", "", None, "e\u200d\u0301", "e\u0301"]
    assert apply(fn.normalize_text, texts) == ["a b", "", "x", "", "", "e\u0301", "\u00e9"]


def plan_of(spark, work):
    posts = spark.createDataFrame([("a  b",)], "content STRING")
    return posts.select(work(F.col("content")))._jdf.queryExecution().executedPlan().toString().lower()


def test_white_space_needs_no_regular_expression(spark):
    for work in (fn.normalize_text, fn.strip_space):
        assert "regexp" not in plan_of(spark, work) and "rlike" not in plan_of(spark, work)


def test_lexicon_terms_at_every_place(apply):
    # Terms across the border of two texts, of one and two letters, repeated, and equal in their first letters.
    terms = {"bullish": ("a", "ab", "abc", "abcd", "abxy", "तेज़ी", "ते", "ab"), "bearish": ("z", "zz", "abce", "xyz q", "zzz", "तेल")}
    texts = ["abc", "d", "ab", "xy", "xyz", " q", "ABCD abce", "zzzz", "", None, "तेल", "ते", "ज़ी तेज़ी", "xyz qab"] * 40

    def sign(text):
        text = (text or "").lower()
        balance = sum(t in text for t in terms["bullish"]) - sum(t in text for t in terms["bearish"])
        return (balance > 0) - (balance < 0)

    assert apply(lambda c: fn.lexicon_polarity(c, **terms), texts) == [sign(t) for t in texts]


def test_lexicon_is_one_search(spark):
    assert "contains(" not in plan_of(spark, fn.lexicon_polarity)


def test_terms_that_share_first_bytes_are_told_apart(spark):
    """More terms than groups, with common beginnings, at ends of texts, in ASCII and beyond it, against Python's own search."""
    up, down = ("gain", "gainer", "gap", "tej", "तेज़ी", "तेजी", "zz", "é"), ("gait", "ga", "bend", "ben", "beta", "तेल", "मंदी", "loss", "lot", "xyz")
    texts = ["against gait", "ga", "gainer gap", "teje tej", "तेज़ी तेल", "तेजी", "मंदी", "", "bendz", "z", "zebra gai", "n xy", "z lo", "ss", "été lossy", "beta ben"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, x STRING").coalesce(1)
    got = [r.y for r in rows.select("n", fn.lexicon_polarity(F.col("x"), up, down).alias("y")).orderBy("n").collect()]
    sums = [sum(t in x for t in up) - sum(t in x for t in down) for x in texts]
    assert got == [(s > 0) - (s < 0) for s in sums]
