"""The registered queries once more, as SQL for DuckDB on the same tables."""

from pulsemill import fixed_values as v

# The posts of pulsemill.sources.event_posts.
POSTS = """
size AS MATERIALIZED (SELECT count(*) AS n FROM documents),
posts AS MATERIALIZED (
  SELECT CAST(e.event_id - CASE WHEN e.event_id % 20 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS tweet_id,
         '@u' || e.user_id || CASE WHEN e.user_id % 37 = 0 THEN 'bot' ELSE '' END AS username,
         strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp_utc,
         e.ts,
         d.text || CASE e.event_type
                     WHEN 'purchase' THEN ' buy nifty options breakout'
                     WHEN 'error' THEN ' sensex crash panic today'
                     WHEN 'click' THEN ' bullish #nifty50'
                     WHEN 'signup' THEN ' join channel t.me/x'
                     ELSE '' END
                || ' #' || e.event_type || ' @u' || e.user_id AS content,
         CAST(floor(e.value) AS BIGINT) AS like_count,
         CAST(regexp_extract(e.props, '"k": *([0-9]+)', 1) AS BIGINT) AS retweet_count,
         e.user_id % 7 AS reply_count,
         'https://example.com/status/'
           || (e.event_id - CASE WHEN e.event_id % 50 = 3 THEN 1 ELSE 0 END) AS url,
         'Q' || (e.user_id % 4 + 1) AS query,
         CAST(e.ts AS DATE) AS date,
         e.event_id AS seq
  FROM (SELECT *, event_id % (SELECT n FROM size) AS doc FROM events) e JOIN documents d ON d.doc_id = e.doc
), clock AS (SELECT max(ts) AS now FROM events)"""

EVENTS_K = """
ev AS (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events)"""

SPACE = v.SPACE_CLASS
WORD = v.WORD_CLASS
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def any_of(text, terms):
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def hits(text, terms):
    return " + ".join(f"CAST(contains({text}, {quoted(t)}) AS INT)" for t in terms)


POLARITY = (
    f"CAST(sign(({hits('lower(content)', v.BULLISH_TERMS)})"
    f" - ({hits('lower(content)', v.BEARISH_TERMS)})) AS INT)"
)
WEIGHT = "ln(1 + greatest(like_count + 2.0::DOUBLE * retweet_count + 0.5::DOUBLE * reply_count, 0))"

SCORED = f"""
scored AS MATERIALIZED (
  SELECT *, {POLARITY} AS sentiment, {WEIGHT} AS weight, date_trunc('hour', ts) AS time FROM posts
)"""


def first_by(source, name, key, order):
    """A CTE that keeps the first row per key."""
    return f"""
{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}
  ) WHERE rn = 1
)"""


def select(*ctes, body):
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n" + body


ORACLE = {}

# --- column functions ---------------------------------------------------------------------------

ORACLE["parse_counts"] = select(
    EVENTS_K,
    """shown AS (
  SELECT event_id, CASE event_id % 9
    WHEN 0 THEN user_id || '.' || k || 'K'
    WHEN 1 THEN user_id || '.' || k || 'M'
    WHEN 2 THEN user_id || ',' || lpad(k, 3, '0')
    WHEN 3 THEN user_id || 'B'
    WHEN 4 THEN user_id || 'k'
    WHEN 5 THEN ''
    WHEN 6 THEN ' ' || user_id || '.5 K '
    WHEN 7 THEN '-' || k
    ELSE k || '.' || user_id END AS shown
  FROM ev
)""",
    """parts AS (
  SELECT event_id, shown, trim(replace(shown, ',', '')) AS t,
         trim(regexp_replace(trim(replace(shown, ',', '')), '[KM]$', '')) AS digits
  FROM shown
)""",
    body=f"""SELECT event_id, shown,
  CASE WHEN regexp_matches(digits, '{NUMBER}')
       THEN CAST(trunc(CAST(digits AS DOUBLE)
              * CASE WHEN t LIKE '%K' THEN 1000 WHEN t LIKE '%M' THEN 1000000 ELSE 1 END) AS BIGINT)
       ELSE 0 END AS n
FROM parts""",
)

ORACLE["safe_ints"] = select(
    EVENTS_K,
    """shown AS (
  SELECT event_id, k, CASE WHEN user_id <> 7 THEN CASE event_id % 7
    WHEN 0 THEN k
    WHEN 1 THEN k || '.9'
    WHEN 2 THEN 'n/a'
    WHEN 3 THEN 'NaN'
    WHEN 4 THEN 'Infinity'
    WHEN 5 THEN CAST(9007199254740993 + event_id AS VARCHAR)
    ELSE '-' || k || '.5' END END AS shown
  FROM ev
)""",
    body="""SELECT event_id, shown, CASE
    WHEN shown IS NULL THEN 0
    WHEN event_id % 7 IN (0, 1) THEN CAST(k AS BIGINT)
    WHEN event_id % 7 = 5 THEN 9007199254740993 + event_id
    WHEN event_id % 7 = 6 THEN -CAST(k AS BIGINT)
    ELSE 0 END AS n
FROM shown""",
)

ORACLE["parse_timestamps"] = """
SELECT event_id,
  CASE event_id % 7
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30'
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    WHEN 3 THEN strftime(ts, '%Y-%m-%d')
    WHEN 4 THEN strftime(ts, '%Y')
    WHEN 5 THEN strftime(ts, '%H:%M')
    ELSE '2024-13-45T00:00:00Z' END AS shown,
  CASE event_id % 7
    WHEN 0 THEN date_trunc('milliseconds', ts)
    WHEN 1 THEN date_trunc('second', ts) - INTERVAL '5 hours 30 minutes' END AS strict,
  CASE event_id % 7
    WHEN 0 THEN date_trunc('milliseconds', ts)
    WHEN 1 THEN date_trunc('second', ts) - INTERVAL '5 hours 30 minutes'
    WHEN 2 THEN date_trunc('second', ts)
    WHEN 3 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS coerced
FROM events"""

ORACLE["normalize_text"] = f"""
SELECT doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS content FROM documents"""

ORACLE["nfkc_text"] = "SELECT doc_id, text AS content FROM documents"

ORACLE["token_sets"] = f"""
WITH t AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(
    list_filter(string_split(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')), ' '),
                lambda w: length(w) > 1),
    lambda w: lower(trim(w, {quoted(v.TOKEN_EDGE_PUNCTUATION)}))))) AS t
  FROM documents
)
SELECT doc_id, CAST(len(t) AS BIGINT) AS token_count, array_to_string(t, ' ') AS tokens FROM t"""

for mark, name in (("#", "hashtags"), ("@", "mentions")):
    ORACLE[name] = select(
        POSTS,
        body=f"""SELECT seq, array_to_string(regexp_extract_all(content, '{mark}{WORD}+'), ',') AS {name}
FROM posts""",
    )

RAW = POSTS + """, raw AS MATERIALIZED (
  SELECT * REPLACE (
    CASE WHEN seq % 97 = 5 THEN '2024' WHEN seq % 97 = 6 THEN 'soon' ELSE timestamp_utc END AS timestamp_utc,
    '  ' || replace(content, ' the ', ' the' || chr(8203) || ' ' || chr(10)) AS content,
    CASE WHEN seq % 11 = 0 THEN like_count || '.9' WHEN seq % 11 = 1 THEN 'n/a'
         ELSE CAST(like_count AS VARCHAR) END AS like_count,
    CAST(retweet_count AS VARCHAR) AS retweet_count,
    CASE WHEN seq % 13 <> 0 THEN CAST(reply_count AS VARCHAR) END AS reply_count),
    CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN ' #market , ,#Nifty' END AS hashtags,
    CASE WHEN seq % 2 = 0 THEN '@desk' END AS mentions
  FROM posts
)"""

LISTED_TAGS = f"""
    CASE WHEN seq % 3 = 1 THEN ['#market', '#Nifty']
         ELSE regexp_extract_all(content, '#{WORD}+') END AS h,
    CASE WHEN seq % 2 = 0 THEN ['@desk']
         ELSE regexp_extract_all(content, '@{WORD}+') END AS m"""


def json_list(tags):
    return f"""'[' || array_to_string(list_transform({tags}, lambda x: '"' || x || '"'), ',') || ']'"""


ORACLE["tag_fallback"] = select(
    RAW,
    f"tags AS (SELECT seq, {LISTED_TAGS} FROM raw)",
    body=f"SELECT seq, {json_list('h')} AS hashtags_json, array_to_string(m, ',') AS mentions FROM tags",
)

ORACLE["canonical_url"] = """
SELECT event_id,
  CASE WHEN event_id % 5 IN (0, 1) THEN 'https://example.com/u/status/' || event_id
       WHEN event_id % 5 = 2 THEN 'https://example.com/u/status/' || event_id || '/photo/1' END AS url,
  CASE WHEN event_id % 5 < 3 THEN CAST(event_id AS VARCHAR) ELSE '' END AS tweet_id
FROM events"""

ORACLE["author_handles"] = """
SELECT event_id, CASE event_id % 3
    WHEN 0 THEN '@u' || user_id
    WHEN 1 THEN 'User ' || user_id
    ELSE '' END AS handle
FROM events"""

ORACLE["first_metrics"] = select(
    EVENTS_K,
    body="""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(k AS BIGINT)
    ELSE CAST(trunc(CAST(user_id || '.5' AS DOUBLE) * 1000) AS BIGINT) END AS n
FROM ev""",
)

ORACLE["keyword_sentiment"] = select(POSTS, SCORED, body="SELECT seq, sentiment FROM scored")

ORACLE["keyword_signal"] = select(
    POSTS,
    SCORED,
    body="SELECT seq, round(weight, 6) AS weight, round(sentiment * weight, 6) AS keyword_signal FROM scored",
)

# --- filters and reports ------------------------------------------------------------------------

ORACLE["recent_posts"] = select(
    POSTS, body="SELECT seq, tweet_id, ts FROM posts, clock WHERE ts >= now - INTERVAL 7 DAYS"
)

KEPT = (
    "length(content) >= 20 AND NOT " + any_of("lower(content)", v.SPAM_TERMS)
    + " AND NOT " + any_of("lower(username)", v.BOT_TERMS)
)
ORACLE["quality_filter"] = select(POSTS, body=f"SELECT seq, tweet_id FROM posts WHERE {KEPT}")

ORACLE["content_or_url"] = select(
    POSTS,
    body="""SELECT seq, CAST(CASE WHEN reply_count > 1 THEN length(content) ELSE 0 END AS BIGINT) AS content_chars,
  CASE WHEN like_count > 20 THEN url END AS url
FROM posts WHERE reply_count > 1 OR like_count > 20""",
)

ORACLE["reject_report"] = select(
    POSTS,
    """untidy AS (
  SELECT * REPLACE (CASE WHEN reply_count <> 3 THEN url END AS url,
                    CASE WHEN like_count = 11 THEN 'too short' ELSE content END AS content) FROM posts
)""",
    body=f"""SELECT CASE
    WHEN ts < now - INTERVAL 7 DAYS THEN 'old'
    WHEN url IS NULL THEN 'no_url'
    WHEN length(content) < 20 THEN 'short'
    WHEN {any_of('lower(content)', v.SPAM_TERMS)} THEN 'spam'
    WHEN {any_of('lower(username)', v.BOT_TERMS)} THEN 'bot'
    ELSE 'kept' END AS reject_reason, count(*) AS posts
FROM untidy, clock GROUP BY 1""",
)


def topic_case():
    def word(w):
        return f"list_contains(t, '{w}')"

    cases = []
    for label, text in v.TOPIC_RULES:
        clauses = [" AND ".join(word(w) for w in c.split()) for c in text.split(" OR ")]
        cases.append("WHEN " + " OR ".join(f"({c})" for c in clauses) + f" THEN '{label}'")
    return "CASE " + " ".join(cases) + " END"


TOPICS = f"""
found AS (SELECT seq, regexp_extract_all(lower(content), '#?{WORD}+') AS f FROM posts),
tokens AS (SELECT seq, list_concat(f, list_transform(f, lambda x: ltrim(x, '#'))) AS t FROM found),
labelled AS (SELECT seq, {topic_case()} AS topic FROM tokens)"""
ORACLE["topic_match"] = select(POSTS, TOPICS, body="SELECT seq, topic FROM labelled")
ORACLE["topic_match_table"] = select(
    POSTS, TOPICS, body="SELECT seq, topic FROM labelled"
)

# --- deduplication ------------------------------------------------------------------------------

ORACLE["dedup_id_url"] = select(
    POSTS,
    first_by("posts", "by_id", "tweet_id", "ts DESC, tweet_id, seq"),
    first_by("by_id", "by_url", "url", "ts DESC, tweet_id, seq"),
    body="SELECT seq, tweet_id, url FROM by_url",
)
ORACLE["dedup_first_seen"] = select(
    POSTS,
    first_by("posts", "by_id", "tweet_id", "seq"),
    first_by("by_id", "by_url", "url", "seq"),
    body="SELECT seq, tweet_id, url FROM by_url",
)
ORACLE["dedup_stored"] = ORACLE["dedup_id_url"].replace("SELECT seq, tweet_id, url FROM", "SELECT seq, tweet_id, url, content FROM")
ORACLE["dedup_stored_first"] = ORACLE["dedup_first_seen"].replace("SELECT seq, tweet_id, url FROM", "SELECT seq, tweet_id, url, content FROM")
ORACLE["dedup_coalesced_key"] = select(
    POSTS,
    """keyed AS (
  SELECT seq, CASE WHEN reply_count >= 3 THEN tweet_id WHEN reply_count >= 2 THEN url
              ELSE content || CAST(date AS VARCHAR) END AS k FROM posts
)""",
    first_by("keyed", "first", "k", "seq"),
    body="SELECT seq FROM first",
)
ORACLE["first_query_wins"] = select(
    POSTS,
    first_by("posts", "first", "tweet_id", "query, seq"),
    body="SELECT seq, tweet_id, query FROM first",
)
ORACLE["unseen_posts"] = select(
    POSTS,
    """known AS MATERIALIZED (
  SELECT DISTINCT tweet_id FROM posts WHERE ts < (SELECT date_trunc('day', now) - INTERVAL 7 DAYS FROM clock)
)""",
    body="""SELECT seq, substr(url, 28) AS tweet_id FROM posts
ANTI JOIN known ON known.tweet_id = substr(posts.url, 28)""",
)

# --- counts -------------------------------------------------------------------------------------

ORACLE["posts_per_date"] = select(POSTS, body="SELECT date, count(*) AS posts FROM posts GROUP BY date")

TAGGED = f"""
tagged AS (
  SELECT like_count,
         regexp_extract_all(content, '#{WORD}+') AS h,
         regexp_extract_all(content, '@{WORD}+') AS m
  FROM posts
)"""
ORACLE["tag_coverage"] = select(
    POSTS,
    TAGGED,
    body="""SELECT count(*) AS posts, count(*) FILTER (len(h) > 0) AS with_hashtags,
  count(*) FILTER (len(m) > 0) AS with_mentions, round(avg(like_count), 6) AS mean_likes
FROM tagged""",
)
ORACLE["top_hashtags"] = select(
    POSTS,
    TAGGED,
    body="""SELECT hashtag, count(*) AS uses FROM (SELECT unnest(h) AS hashtag FROM tagged)
GROUP BY hashtag ORDER BY uses DESC, hashtag LIMIT 10""",
)
# Fewer distinct tags than the sketch has room for: its counts are exact.
ORACLE["approx_top_hashtags"] = ORACLE["top_hashtags"]
ORACLE["query_rate"] = select(
    POSTS,
    """spans AS (
  SELECT coalesce(query, '(all)') AS query, count(*) AS posts,
         (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds,
         CASE WHEN query IS NULL THEN 60 ELSE 1 END AS least
  FROM posts GROUP BY ROLLUP (query)
)""",
    body="""SELECT query, posts, seconds, round(posts / (greatest(seconds, least) / 60), 6) AS posts_per_minute
FROM spans""",
)
ORACLE["newest_posts"] = select(
    POSTS, body="SELECT seq, tweet_id FROM posts ORDER BY ts DESC, tweet_id LIMIT 100"
)

# --- jobs ---------------------------------------------------------------------------------------

VALID = f"""
valid AS MATERIALIZED (
  SELECT r.*, date_trunc('milliseconds', r.ts) AS t,
         trim(regexp_replace(replace(content, chr(8203), ''), '{SPACE}+', ' ', 'g')) AS tidy,
         {LISTED_TAGS}
  FROM raw r, clock
  WHERE seq % 97 NOT IN (5, 6) AND date_trunc('milliseconds', r.ts) >= now - INTERVAL 30 DAYS
)"""
BY_ID = first_by("valid", "by_id", "tweet_id", "t DESC, tweet_id, seq")
BY_URL = first_by("by_id", "by_url", "url", "t DESC, tweet_id, seq")
COUNTS = """
  CASE WHEN seq % 11 = 1 THEN 0 ELSE CAST(trunc(CAST(like_count AS DOUBLE)) AS BIGINT) END AS like_count"""
ORACLE["clean_posts"] = select(
    RAW,
    VALID,
    BY_ID,
    BY_URL,
    body=f"""SELECT tweet_id, username, CAST(NULL AS VARCHAR) AS handle, t AS ts, tidy AS content, {COUNTS},
  CAST(retweet_count AS BIGINT) AS retweet_count,
  coalesce(CAST(reply_count AS BIGINT), 0) AS reply_count,
  {json_list('h')} AS hashtags_json, {json_list('m')} AS mentions_json, url, query, CAST(t AS DATE) AS date
FROM by_url""",
)
ORACLE["clean_counts"] = select(
    RAW,
    VALID,
    BY_ID,
    BY_URL,
    body="""SELECT 'landed' AS step, count(*) AS posts FROM raw
UNION ALL SELECT 'valid', count(*) FROM valid
UNION ALL SELECT 'unique', count(*) FROM by_url""",
)
ORACLE["accepted_posts"] = select(
    POSTS,
    f"""fresh AS (
  SELECT p.* FROM posts p, clock
  WHERE date_trunc('milliseconds', ts) >= now - INTERVAL 7 DAYS AND {KEPT}
)""",
    first_by("fresh", "first", "tweet_id", "query, seq"),
    body="SELECT seq, tweet_id, query FROM first",
)
ORACLE["merged_batches"] = select(
    POSTS,
    first_by("posts", "by_id", "tweet_id", "seq"),
    first_by("by_id", "by_url", "url", "seq"),
    body="""SELECT seq, tweet_id, CASE WHEN query <> 'Q1' THEN username END AS username, url
FROM by_url, clock WHERE date_trunc('milliseconds', ts) >= now - INTERVAL 30 DAYS""",
)

STOP = ", ".join(quoted(w) for w in v.ENGLISH_STOP_WORDS)
VOCABULARY = f"""
word_lists AS MATERIALIZED (
  SELECT seq, list_filter(regexp_extract_all(lower(content), '{WORD}{{2,}}'),
                          lambda w: w NOT IN ({STOP})) AS w
  FROM posts
),
term_lists AS (
  SELECT seq, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t
  FROM word_lists
),
term_tf AS MATERIALIZED (
  SELECT seq, term, count(*) AS tf FROM (SELECT seq, unnest(t) AS term FROM term_lists) GROUP BY seq, term
),
corpus AS (SELECT count(*) AS n FROM posts),
vocab AS MATERIALIZED (
  SELECT term, total, df, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1 AS idf
  FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM term_tf GROUP BY term), corpus
  WHERE df >= 2 AND df <= 0.7::DOUBLE * n
  ORDER BY total DESC, term LIMIT 200
)"""
WEIGHTS = """
plain AS (SELECT seq, term, (1 + ln(tf)) * idf AS w FROM term_tf JOIN vocab USING (term)),
weights AS MATERIALIZED (
  SELECT seq, term, w / sqrt(sum(w * w) OVER (PARTITION BY seq)) AS weight FROM plain
)"""
ORACLE["tfidf_vocab"] = select(
    POSTS, VOCABULARY, body="SELECT term, total, df, round(idf, 6) AS idf FROM vocab"
)
ORACLE["tfidf_weights"] = select(
    POSTS, VOCABULARY, WEIGHTS, body="SELECT seq, term, round(weight, 6) AS weight FROM weights"
)


def leading_direction(doublings=8):
    """Leading eigenvector of the Gram matrix from its 2^8-th power, by repeated squaring.

    The other directions shrink with (second / first eigenvalue)^256.
    """
    ctes = [
        """gram AS (
  SELECT a.term AS i, b.term AS j, sum(a.weight * b.weight) AS g
  FROM weights a JOIN weights b USING (seq) GROUP BY 1, 2
),
g0 AS MATERIALIZED (SELECT i, j, g / sum(g) FILTER (i = j) OVER () AS g FROM gram)"""
    ]
    for k in range(1, doublings + 1):
        ctes.append(
            f"""s{k} AS (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM g{k - 1} a JOIN g{k - 1} b ON a.j = b.i GROUP BY 1, 2),
g{k} AS MATERIALIZED (SELECT i, j, g / sum(g) FILTER (i = j) OVER () AS g FROM s{k})"""
        )
    ctes.append(
        f"""direction AS (SELECT i, sum(g) AS y FROM g{doublings} GROUP BY i),
loading AS MATERIALIZED (SELECT i, y / sqrt(sum(y * y) OVER ()) AS x FROM direction),
latent AS (
  SELECT p.seq, coalesce(r.raw, 0) AS raw FROM posts p
  LEFT JOIN (SELECT seq, sum(weight * x) AS raw FROM weights JOIN loading ON i = term GROUP BY seq) r
  USING (seq)
),
z AS MATERIALIZED (
  SELECT seq, (raw - avg(raw) OVER ()) / stddev_pop(raw) OVER () AS tfidf_signal FROM latent
)"""
    )
    return ",\n".join(ctes)


ORACLE["tfidf_score"] = select(
    POSTS,
    VOCABULARY,
    WEIGHTS,
    leading_direction(),
    body="SELECT seq, round(tfidf_signal, 6) AS tfidf_signal FROM z",
)
ORACLE["stored_model_score"] = ORACLE["tfidf_score"]

ORACLE["hourly_keyword"] = select(
    POSTS,
    SCORED,
    body="""SELECT time, round(avg(sentiment * weight), 6) AS keyword_signal, count(*) AS tweet_count
FROM scored GROUP BY time""",
)
ORACLE["hourly_dense"] = select(
    POSTS,
    SCORED,
    """filled AS (
  SELECT time, round(avg(sentiment * weight), 6) AS keyword_signal, count(*) AS tweet_count
  FROM scored GROUP BY time
)""",
    """hours AS (
  SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM filled
)""",
    body="""SELECT time, keyword_signal, coalesce(tweet_count, 0) AS tweet_count
FROM hours LEFT JOIN filled USING (time)""",
)

# The Poisson bootstrap of pulsemill.operators.bootstrap, step by step.
POISSON_STEPS = (
    1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276,
    4294962463,
)
METRICS = ("keyword", "tfidf", "combined")
COUNT_OF = "CASE " + " ".join(f"WHEN h < {s} THEN {n}" for n, s in enumerate(POISSON_STEPS)) + " ELSE 9 END"


def hash_steps():
    """CTEs d1..d7 from the seeded word to the Poisson count."""
    word = "4294967295"
    steps = (
        f"(xor(h, h >> 16) * 2146121005) & {word}",
        f"(xor(h, h >> 15) * 569420461) & {word}",
        "xor(xor(h, h >> 16), high)",
        f"(xor(h, h >> 16) * 2146121005) & {word}",
        f"(xor(h, h >> 15) * 569420461) & {word}",
        "xor(h, h >> 16)",
    )
    keep = "time, high, k, t, c"
    ctes = [
        f"""d0 AS (
  SELECT time, k, t, c, (id >> 32) & {word} AS high,
         ((id & {word}) + b * 506952113) & {word} AS h, b
  FROM signals, generate_series(0, 999) AS r(b)
)"""
    ]
    for n, step in enumerate(steps, start=1):
        ctes.append(f"d{n} AS (SELECT {keep}, b, {step} AS h FROM d{n - 1})")
    ctes.append(f"drawn AS (SELECT {keep}, b, {COUNT_OF} AS w FROM d{len(steps)})")
    return ",\n".join(ctes)


SIGNALS = """
signals AS MATERIALIZED (
  SELECT CAST(tweet_id AS BIGINT) AS id, time, sentiment * weight AS k, tfidf_signal AS t,
         0.6::DOUBLE * sentiment * weight + 0.4::DOUBLE * tfidf_signal * weight AS c
  FROM scored JOIN z USING (seq)
)"""
HOURLY = """
replicates AS (
  SELECT time, b, sum(w * k) / nullif(sum(w), 0) AS k, sum(w * t) / nullif(sum(w), 0) AS t,
         sum(w * c) / nullif(sum(w), 0) AS c
  FROM drawn GROUP BY time, b
),
bounds AS (
  SELECT time, quantile_cont(k, [0.025, 0.975]) AS k, quantile_cont(t, [0.025, 0.975]) AS t,
         quantile_cont(c, [0.025, 0.975]) AS c
  FROM replicates GROUP BY time
),
means AS (
  SELECT time, avg(k) AS k, avg(t) AS t, avg(c) AS c, count(*) AS n FROM signals GROUP BY time
),
hourly AS MATERIALIZED (
  SELECT m.time,
         round(m.k, 6) AS keyword_signal, round(b.k[1], 6) AS keyword_ci_low, round(b.k[2], 6) AS keyword_ci_high,
         round(m.t, 6) AS tfidf_signal, round(b.t[1], 6) AS tfidf_ci_low, round(b.t[2], 6) AS tfidf_ci_high,
         round(m.c, 6) AS combined_signal, round(b.c[1], 6) AS combined_ci_low,
         round(b.c[2], 6) AS combined_ci_high, m.n AS tweet_count
  FROM means m JOIN bounds b USING (time)
)"""
KEYWORD_ONLY = """
signals AS MATERIALIZED (
  SELECT CAST(tweet_id AS BIGINT) AS id, time, sentiment * weight AS k, 0.0::DOUBLE AS t, 0.0::DOUBLE AS c
  FROM scored
)"""
ORACLE["hourly_bootstrap"] = select(
    POSTS,
    SCORED,
    KEYWORD_ONLY,
    hash_steps(),
    HOURLY,
    body="SELECT time, keyword_signal, keyword_ci_low, keyword_ci_high, tweet_count FROM hourly",
)
ORACLE["combined_signal"] = select(
    POSTS,
    SCORED,
    VOCABULARY,
    WEIGHTS,
    leading_direction(),
    body="""SELECT seq, time, round(sentiment * weight, 6) AS keyword_signal, round(tfidf_signal, 6) AS tfidf_signal,
  round(0.6::DOUBLE * sentiment * weight + 0.4::DOUBLE * tfidf_signal * weight, 6) AS combined_signal
FROM scored JOIN z USING (seq)""",
)
FLAGSHIP = (POSTS, SCORED, VOCABULARY, WEIGHTS, leading_direction(), SIGNALS, hash_steps(), HOURLY)
ORACLE["hourly_signals"] = select(*FLAGSHIP, body="SELECT * FROM hourly")
ORACLE["signals_csv"] = ORACLE["hourly_signals"]
ORACLE["signals_long"] = select(
    *FLAGSHIP,
    body=" UNION ALL ".join(
        f"SELECT time, '{m}' AS metric, {m}_signal AS value, {m}_ci_low AS ci_low, {m}_ci_high AS ci_high FROM hourly"
        for m in METRICS
    ),
)

# --- sources and sinks --------------------------------------------------------------------------

ORACLE["pages_extract"] = select(
    POSTS,
    body=f"""SELECT regexp_extract(url, '([0-9]+)$', 1) AS tweet_id, username, timestamp_utc,
  regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') AS content,
  CAST(like_count AS VARCHAR) AS like_count, CAST(retweet_count AS VARCHAR) AS retweet_count,
  CAST(reply_count AS VARCHAR) AS reply_count,
  array_to_string(regexp_extract_all(content, '#{WORD}+'), ',') AS hashtags,
  array_to_string(regexp_extract_all(content, '@{WORD}+'), ',') AS mentions, url
FROM posts""",
)

ORACLE["page_cards"] = """
SELECT page_id, 'no_time' AS card_problem, CAST(len(regexp_extract_all(html, '<article[ >]')) AS BIGINT) AS cards
FROM pages WHERE contains(html, '<article')"""

RAW_COLUMNS = """tweet_id, username, CAST(NULL AS VARCHAR) AS handle, timestamp_utc, content, like_count,
  retweet_count, reply_count, hashtags, mentions, url, query"""
# An empty field of a CSV file is read as NULL.
ORACLE["csv_roundtrip"] = select(
    RAW,
    body=f"SELECT * REPLACE (nullif(hashtags, '') AS hashtags) FROM (SELECT {RAW_COLUMNS} FROM raw)",
)
ORACLE["csv_by_query"] = select(
    RAW,
    body="""SELECT query, count(*) AS posts, CAST(sum(length(content)) AS BIGINT) AS content_chars
FROM raw GROUP BY query""",
)
ORACLE["parquet_by_date"] = select(
    RAW,
    VALID,
    body=f"SELECT tweet_id, tidy AS content, {COUNTS}, query, CAST(t AS DATE) AS date FROM valid",
)
ORACLE["upsert_by_date"] = select(
    RAW,
    VALID,
    """early AS (SELECT v.* FROM valid v, clock WHERE t < now - INTERVAL 36 HOURS)""",
    first_by("early", "e1", "tweet_id", "t DESC, tweet_id, seq"),
    first_by("e1", "e2", "url", "t DESC, tweet_id, seq"),
    """late AS (SELECT v.* FROM valid v, clock WHERE t >= now - INTERVAL 48 HOURS)""",
    """touched AS (
  SELECT CAST(t AS DATE) AS d FROM late
  UNION SELECT CAST(t AS DATE) FROM e2 WHERE tweet_id IN (SELECT tweet_id FROM late) OR url IN (SELECT url FROM late)
)""",
    """both_loads AS (
  SELECT * FROM e2 WHERE CAST(t AS DATE) IN (SELECT d FROM touched) UNION ALL SELECT * FROM late
)""",
    first_by("both_loads", "b1", "tweet_id", "t DESC, tweet_id, seq"),
    first_by("b1", "b2", "url", "t DESC, tweet_id, seq"),
    body="""SELECT tweet_id, url, tidy AS content, query, CAST(t AS DATE) AS date FROM (
  SELECT tweet_id, url, tidy, query, t FROM e2 WHERE CAST(t AS DATE) NOT IN (SELECT d FROM touched)
  UNION ALL SELECT tweet_id, url, tidy, query, t FROM b2
)""",
)

# --- streams ------------------------------------------------------------------------------------

CLOSED = "time + INTERVAL 1 HOUR <= now - INTERVAL 24 HOURS"
ORACLE["stream_hourly"] = select(
    POSTS,
    SCORED,
    body=f"""SELECT time, round(avg(sentiment * weight), 6) AS keyword_signal, count(*) AS tweet_count
FROM scored, clock WHERE {CLOSED} GROUP BY time""",
)
ORACLE["stream_signals"] = select(*FLAGSHIP, body=f"SELECT hourly.* FROM hourly, clock WHERE {CLOSED}")
ORACLE["stream_new_posts"] = select(
    POSTS, body="SELECT DISTINCT tweet_id FROM posts, clock WHERE ts >= now - INTERVAL 7 DAYS"
)

# Other ways to the same rows.
ORACLE["unseen_by_keys"] = ORACLE["unseen_posts"]
ORACLE["upsert_by_keys"] = ORACLE["stream_upsert"] = ORACLE["upsert_by_date"]

# The watermark that a load meets is a day behind the newest post of the loads before it, to the millisecond.
ORACLE["stream_post_counts"] = select(
    POSTS,
    """landed AS (
  SELECT tweet_id, ts, seq // (((SELECT count(*) FROM events) + 79) // 80 * 20) + 1 AS load,
         coalesce(ts >= now - INTERVAL 21 DAYS, false) AS recent
  FROM posts, clock
)""",
    """newest AS (SELECT load, date_trunc('milliseconds', max(ts)) AS t FROM landed GROUP BY load)""",
    """mark AS (SELECT load, max(t) OVER (ORDER BY load ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 24 HOURS AS mark FROM newest)""",
    """told AS (SELECT landed.*, coalesce(ts <= mark, false) AS late FROM landed JOIN mark USING (load))""",
    body="""SELECT CAST(load AS INTEGER) AS load, count(*) AS posts, count(*) FILTER (NOT recent) AS old_posts,
       count(*) FILTER (recent AND late) AS late_posts, count(DISTINCT tweet_id) FILTER (recent AND NOT late) AS accepted_posts
FROM told GROUP BY load""",
)
