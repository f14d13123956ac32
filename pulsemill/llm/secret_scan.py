"""Secret scans: patterns of known secrets, and a battery of randomness tests for others.

Runs of 20 and more letters, digits, +, /, _ and - that hold a digit are candidates. The alphabet of each is inferred (hex,
base 32, 36, 62, 64) and the run tested against drawing its characters at random from that alphabet: chi-squared
uniformity, runs above and below the middle, lag-1 serial correlation. Of those that pass, the ones that
ordinary text does not explain are reported: coincidences of characters and the share of digits are
compared with the frequencies of all documents, and the candidates' p-values, weighted by their length, go through
Benjamini-Hochberg control of false discoveries over the whole table.

Everything is DataFrame expressions. Positions come from running sums of the lengths of matches and of gaps between
them; only numbers are shuffled.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemill.session import cut_lineage

# The patterns every scan must report, and the least lengths of their matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 and more characters
HEX = r"[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 and more characters
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    16: ("^[0-9a-f]+$", "0123456789abcdef"),
    32: ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    36: ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    62: ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    64: ("", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
}
# A run passes the battery if no test, corrected for their number, falls below this.
PASSES = 0.01
FALSE_DISCOVERIES = 0.01
# p-values are counted in steps of a tenth of a power of ten, down to 10^-300.
_STEPS = 3000


def scan(docs: DataFrame, level: float = FALSE_DISCOVERIES) -> DataFrame:
    """Secrets in every document row.

    docs: doc_id, text; other columns are ignored. Returns doc_id, text_key (xxhash64 of the text), n_assign, n_access,
    n_hex, n_random, base_sha256 (of the pattern spans) and spans (all): kind:start:end by start, then kind,
    comma-joined, in code points, end exclusive. A `random` span never overlaps another. NULL and empty texts
    have none; repeated rows give repeated rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.explode_outer(F.concat(*[_found(text, kind) for kind in KINDS])).alias("f"),
    )
    rows = _tested(rows.select("doc_id", "text_key", "f.*"))
    rows = cut_lineage(rows, "matches")
    limit = _threshold(rows, docs, level)
    if limit is None:
        passes = F.lit(False)
    else:
        passes = (F.col("p_random") >= PASSES) & (_step(*_against_text(limit[1]), limit[2]) >= limit[0])
    ok = F.when(F.col("kind") == KINDS.index("random"), passes).otherwise(F.col("ok"))
    # All steps below deal rows by document; equal rows are counted first, so that positions add up once.
    by = ["doc_id", "text_key"]
    rows = rows.select(*by, "kind", "at", "gap", "length", F.coalesce(ok, F.lit(False)).alias("ok"))
    rows = rows.groupBy(*by, "kind", "at", "gap", "length", "ok").count()
    line = Window.partitionBy(*by, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(line)
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "kind", "end")
    each = rows.withColumn("end", end).groupBy(*by).agg(
        F.max("count").alias("copies"), F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("spans")
    )
    last = KINDS.index("random")
    base = F.filter("spans", lambda s: s["kind"] < last)
    alone = lambda s: (s["kind"] < last) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    each = each.withColumn("base", base).withColumn("spans", F.filter("spans", alone))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    done = each.select(
        *by, "copies", *[number(k) for k in range(len(KINDS))],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies", "copy")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, shown), ",")


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind: number, length of the gap before, length, whether long enough; a candidate's text."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}[kind]
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), 2 if kind == "assign" else 1)
    pairs = F.zip_with(whole, value, lambda m, v: F.struct(m.alias("match"), v.alias("value")))
    # There is one gap more than matches; the last is dropped.
    each = F.zip_with(pairs, F.split(text, pattern, -1), lambda p, gap: F.struct(p["match"].alias("match"), p["value"].alias("value"), gap.alias("gap")))
    each = F.filter(each, lambda x: x["match"].isNotNull())
    rows = F.transform(
        each,
        lambda x, at: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            at.cast("bigint").alias("at"),
            F.length(x["gap"]).cast("bigint").alias("gap"),
            F.length(x["match"]).cast("bigint").alias("length"),
            (F.length(x["value"]) >= (ASSIGN_LEAST if kind == "assign" else 1)).alias("ok"),
            (x["match"] if kind == "random" else F.lit(None).cast("string")).alias("token"),
        ),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(_ROWS))


_ROWS = "array<struct<kind: int, at: bigint, gap: bigint, length: bigint, ok: boolean, token: string>>"


def _tested(rows: DataFrame) -> DataFrame:
    """Adds to candidates p_random: least p-value of the battery times three (NULL for digits only), coincidence: rate of
    equal pairs of characters, digits: their number. Other rows have NULL. Each step builds on columns of the one before.
    """
    token, n = F.col("token"), F.col("length").cast("double")
    which = F.lit(len(ALPHABETS) - 1)
    for k, (shape, _) in reversed(list(enumerate(ALPHABETS.values()))[:-1]):
        which = F.when(token.rlike(shape), k).otherwise(which)
    letters = F.array(*[F.lit(x) for _, x in ALPHABETS.values()])
    sizes = F.array(*[F.lit(float(x)) for x in ALPHABETS])
    decimal = token.rlike("^[0-9+/_-]+$")
    rows = rows.withColumn("which", F.when(token.isNotNull() & ~decimal, which))
    rows = rows.withColumn("size", F.get(sizes, F.col("which"))).withColumn("letters", F.get(letters, F.col("which")))
    rows = rows.withColumns(
        {
            "codes": F.when(F.col("which").isNotNull(), _codes(F.split(token, ""), F.col("letters"))),
            "folded": F.split(F.lower(token), ""),
            "digits": n - F.length(F.regexp_replace(token, "[0-9]", "")),
        }
    )
    rows = rows.withColumns({"squares": _squares(F.col("codes")), "same": _squares(F.col("folded"))})
    size = F.col("size")
    upper = F.transform("codes", lambda x: F.when(x * 2 >= F.col("size"), 1.0).otherwise(0.0))
    rows = rows.withColumns({"upper": upper, "mean": _sum(F.col("codes")) / n})
    rows = rows.withColumns({"high": _sum(F.col("upper")), "turns": _lagged(F.col("upper"), lambda a, b: F.abs(a - b))})
    rows = rows.withColumn("off", F.transform("codes", lambda x: x - F.col("mean")))
    rows = rows.withColumns({"pairs": _lagged(F.col("off"), lambda a, b: a * b), "power": _sum(F.transform("off", lambda x: x * x))})

    free, chi = size - 1, F.col("squares") * size / n - n
    # Wilson and Hilferty: the cube root of chi-squared by its mean is nearly normal.
    uneven = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    expected = 2 * F.col("high") * (n - F.col("high")) / n
    spread = F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9)))
    runs = F.abs((F.col("turns") - expected) / spread)
    serial = F.abs((F.col("pairs") / F.greatest("power", F.lit(1e-9)) + 1 / n) * F.sqrt(n))
    rows = rows.withColumns({"uneven": uneven, "runs": runs, "serial": serial})
    least = F.least(_tail(F.col("uneven")), 2 * _tail(F.col("runs")), 2 * _tail(F.col("serial")))
    return rows.select(
        "doc_id", "text_key", "kind", "at", "gap", "length", "ok", "digits",
        F.when(F.col("which").isNotNull(), F.least(F.lit(1.0), 3 * least)).alias("p_random"),
        ((F.col("same") - n) / (n * (n - 1))).alias("coincidence"),
    )


def _codes(characters: Column, letters: Column) -> Column:
    return F.transform(characters, lambda c: F.instr(letters, c).cast("double") - 1)


def _squares(items: Column) -> Column:
    """Sum of the squared counts of an array's distinct items."""
    times = lambda d: F.pow(F.size(F.filter(items, lambda x: x == d)), F.lit(2.0))
    return F.aggregate(F.transform(F.array_distinct(items), times), F.lit(0.0), lambda a, x: a + x)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def _lagged(items: Column, join) -> Column:
    """Sum over neighbours in an array."""
    ahead = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    return _sum(F.filter(F.zip_with(items, ahead, join), lambda x: x.isNotNull()))


def _tail(z: Column) -> Column:
    """Probability that a standard normal exceeds z (Abramowitz and Stegun 26.2.17)."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = poly * F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _frequencies(docs: DataFrame) -> list[float]:
    """Shares of a-z (either case) and of all digits among both in all documents; a tenth of the last is one digit's."""
    text = F.lower("text")
    count = lambda gone: F.sum((F.length(text) - F.length(gone)).cast("double"))
    letters = [count(F.replace(text, F.lit(c))) for c in "abcdefghijklmnopqrstuvwxyz"]
    row = docs.select(*[x.alias(f"c{k}") for k, x in enumerate([*letters, count(F.regexp_replace(text, "[0-9]+", ""))])]).first()
    counts = [(x or 0.0) + 1.0 for x in row]
    return [x / sum(counts) for x in counts]


def _against_text(frequencies: list[float]) -> tuple[Column, Column]:
    """How far a candidate departs from ordinary text (standard normal for such), and its length."""
    n = F.col("length").cast("double")
    each = [*frequencies[:26], *[frequencies[26] / 10] * 10]
    mean, cube = sum(p**2 for p in each), sum(p**3 for p in each)
    variance = (4 * (n - 2) * (cube - mean**2) + 2 * (mean - mean**2)) / (n * (n - 1))
    even = (mean - F.col("coincidence")) / F.sqrt(variance)
    share = frequencies[26]
    digits = F.least(F.lit(8.0), (F.col("digits") - n * share) / F.sqrt(n * share * (1 - share)))
    return (even + digits) / math.sqrt(2), n


def _step(z: Column, n: Column, mean_length: float) -> Column:
    """p-value by weight of its length, as its number of steps below 1."""
    p = F.least(F.lit(1.0), _tail(z) * mean_length / n)
    return F.least(F.lit(_STEPS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int"))


def _threshold(rows: DataFrame, docs: DataFrame, level: float):
    """Least step that Benjamini and Hochberg let pass, with the frequencies and the mean length; None without any."""
    candidates = rows.where((F.col("kind") == KINDS.index("random")) & F.col("p_random").isNotNull())
    n, mean_length = candidates.agg(F.count("*"), F.avg("length")).first()
    if not n:
        return None
    frequencies = _frequencies(docs)
    steps = candidates.groupBy(_step(*_against_text(frequencies), mean_length).alias("step")).count().collect()  # _STEPS + 1 rows at most
    passed, least = 0, None
    for step, count in sorted(steps, reverse=True):
        passed += count
        if 10 ** (-step / 10) <= level * passed / n:
            least = step
    return None if least is None else (least, frequencies, mean_length)
