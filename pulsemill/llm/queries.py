"""One registered query for each operator, over its whole table, and the pipeline."""

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from pulsemill.llm import (
    decontaminate,
    language_id,
    license_scan,
    mixing,
    onebit_search,
    pii,
    quality_gam,
    secret_scan,
    simhash_dedup,
    source_audit,
    token_counts,
    warc,
    whitening,
)
from pulsemill.session import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= quality_gam.THRESHOLD).cast("int")
    return scored.select("doc_id", quality_gam.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"))


def op3_onebit_search(spark, sf_dir):
    return onebit_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    place = F.transform("found", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))
    return found.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_found"),
        F.array_join(names, ",").alias("licenses"),
        F.array_max(F.transform("found", lambda x: x["containment"])).alias("containment"),
        F.array_join(place, ",").alias("spans"),
    )


def op8_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op9_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"), everywhere=True)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{pii.KINDS[k]}")
    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        "doc_id",
        *[number(k) for k in range(len(pii.KINDS) - 1)],
        F.sha2(pii.shown(F.col("base")), 256).alias("base_sha256"),
        pii.shown(F.array_sort(F.concat("base", plain))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_term"),
    )


def op11_source_audit(spark, sf_dir):
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_warc(spark, sf_dir):
    root = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), root)
    return warc.read_archives(spark, root, payloads=False).drop("url", "payload")


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_gam,
        op2_token_counts,
        op3_onebit_search,
        op4_decontamination,
        op5_mixing,
        op6_language_id,
        op7_license_scan,
        op8_secret_scan,
        op9_simhash_dedup,
        op10_pii,
        op11_source_audit,
        op12_warc,
        op13_whitening,
        pipeline,
    )
}

# op4, op11 and op12 have a SQL form; the others are tested against brute force or held-out rows.
ORACLE = {
    "op4_decontamination": r"""
        WITH item AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL
        ),
        piece AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS words
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM item WHERE len(w) > 0)
        ),
        doc AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        place AS (
            SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS words
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
                  FROM doc, (SELECT DISTINCT n FROM piece) WHERE len(w) >= n)
        ),
        found AS (SELECT doc_id, place.n, k, item_id FROM place JOIN piece USING (n, words)),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM found) GROUP BY doc_id
        ),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op11_source_audit": r"""
        WITH doc AS (
            SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        word AS (SELECT d, lang, source, unnest(w) AS term FROM doc),
        counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM word GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 10),
        kinds AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM doc),
        place AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
        ),
        total AS (SELECT lang, source, sum(n) AS n FROM place GROUP BY ALL),
        share AS (
            SELECT lang, source, term, place.n,
                1 + (1000000000::HUGEINT * (place.n + 2)) // (total.n + 2 * kinds.v) AS p,
                1 + (1000000000::HUGEINT * (place.lang_n + 2)) // (kinds.n + 2 * kinds.v) AS q
            FROM place JOIN total USING (lang, source) JOIN kinds USING (lang)
        ),
        summed AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ),
        term AS (
            SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM share WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
        )
        WHERE part = 'pair' OR rank <= 10
    """,
    "op12_warc": """
        WITH page AS (
            SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages
        ),
        told AS (
            SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first
            FROM page WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST)
        )
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
            CASE WHEN size >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN size >= 100 AND k > 1 THEN first END AS refers_to
        FROM told
    """,
}
