"""One query for each operator, over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import decode, encode
from millrace.llm.collocations import collocations
from millrace.llm.common import table
from millrace.llm import ann, quality
from millrace.llm.licenses import find_licenses
from millrace.llm.lm_scoring import cross_entropy_difference
from millrace.llm.merkle import compare_with_next
from millrace.llm.mixing import mix
from millrace.llm.simhash import near_duplicates
from millrace.llm.token_counts import count_tokens
from millrace.llm.url_filter import canonical_edges, judge_urls
from millrace.llm.variants import MANGLED, spelling_variants
from millrace.llm.warc import archived

#: A document is predicted good from this score on.
GOOD = 0.3


def held_out() -> Column:
    """Whether a document's label is only for evaluation."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~held_out()))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts are the target, all documents the background."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op4_ann_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids_sha256 is taken over decimal ids joined by commas, decoded_sha256 over the decoded bytes."""
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mixture that reads every document at least once and no source more than twice."""
    return mix(table(spark, sf_dir, "documents"), repeat_limit=2.0).select("doc_id", "source", "tokens", "pass", "block", "position")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


#: Fixed value: the rules of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, URL_RULES, canonical_edges(pages))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are small enough that the larger pages have several."""
    return archived(table(spark, sf_dir, "pages"), segment_bytes=16_384)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), mangled=MANGLED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_token_counts": op3_token_counts,
    "op4_ann_multi_index": op4_ann_multi_index,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_license_scan": op6_license_scan,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_merkle_fingerprints": op9_merkle_fingerprints,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_warc": op12_warc,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op10_url_filter": r"""
        WITH RECURSIVE tags AS (
            SELECT url AS u, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>')) AS tag
            FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')),
        raw_aims AS (
            SELECT u, replace(CASE
                WHEN regexp_matches(tag, '(?is)^<link\b.*\srel\s*=\s*(?:"[^">]*\bcanonical\b|''[^''>]*\bcanonical\b|[^\s"''>]*\bcanonical\b)') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^\s"''>]+)', 1)
                WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^\s"''>]+)', 1) END, '&amp;', '&') AS v
            FROM tags),
        split AS (
            SELECT u, v AS link, regexp_extract(v, '(?s)^([^?#]*)', 1) AS p, regexp_extract(v, '(?s)^[^?#]*(.*)$', 1) AS rest, regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1) AS root,
                regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS own FROM raw_aims),
        paths AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE CASE WHEN contains(own, '/') THEN regexp_extract(own, '(?s)^(.*/)', 1) ELSE '/' END || p END AS joined FROM split),
        aims AS (
            SELECT u, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|#|$)') OR root = '' THEN NULL
                WHEN starts_with(link, '//') THEN regexp_extract(u, '(?s)^(.*?:)//', 1) || link
                ELSE root || CASE WHEN p = '' THEN own ELSE list_reduce(list_prepend('', string_split(CASE WHEN regexp_matches(joined, '/\.\.?$') THEN joined || '/' ELSE joined END, '/')[2:]),
                    lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '(?s)/[^/]*$', '') ELSE a || '/' || x END) END || rest END AS v
            FROM paths),
        edges AS (SELECT u, v FROM aims WHERE contains(v, '://') UNION SELECT v, u FROM aims WHERE contains(v, '://')),
        reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
        nodes AS (SELECT url FROM pages UNION SELECT u FROM edges),
        parts AS (
            SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM nodes),
        rules(rule_host, rule_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (
            SELECT url, rule_host || rule_path AS rule, action FROM parts JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, action) = 1),
        aliases AS (
            SELECT r.u AS url FROM reach r JOIN best b ON b.url = r.v GROUP BY r.u
            HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow'))
        SELECT p.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, b.rule, coalesce(b.action, CASE WHEN a.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM pages p LEFT JOIN parts s ON s.url = p.url LEFT JOIN best b ON b.url = p.url LEFT JOIN aliases a ON a.url = p.url
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL),
        runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        f1 AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(w) AS g FROM runs) GROUP BY ALL),
        f2 AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM runs WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM runs WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10),
        counts AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        cuts AS (
            SELECT lang, g, f AS a, 1 AS k, split_part(g, ' ', 1) AS lg, split_part(g, ' ', 2) AS rg FROM f2
            UNION ALL SELECT lang, g, f, 1, split_part(g, ' ', 1), split_part(g, ' ', 2) || ' ' || split_part(g, ' ', 3) FROM f3
            UNION ALL SELECT lang, g, f, 2, split_part(g, ' ', 1) || ' ' || split_part(g, ' ', 2), split_part(g, ' ', 3) FROM f3),
        scored AS (
            SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.lg JOIN counts y ON y.lang = c.lang AND y.g = c.rg),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        held AS (
            SELECT lang, g, max(f) AS f FROM (
                SELECT lang, split_part(g, ' ', 1) || ' ' || split_part(g, ' ', 2) AS g, f FROM f3
                UNION ALL SELECT lang, split_part(g, ' ', 2) || ' ' || split_part(g, ' ', 3), f FROM f3) GROUP BY ALL)
        SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank, s.g AS phrase, a, l, r, t.n, score
        FROM lowest s JOIN totals t ON t.lang = s.lang LEFT JOIN held h ON h.lang = s.lang AND h.g = s.g
        WHERE h.f IS NULL OR 100 * h.f < 50 * a
        QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) <= 2000
    """,
    "op12_warc": r"""
        WITH own AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        alike AS (SELECT payload, max(page_id) AS newest FROM own GROUP BY payload)
        SELECT o.page_id, octet_length(encode(o.payload))::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(o.h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN o.page_id < a.newest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN o.page_id < a.newest THEN a.newest END AS refers_to
        FROM own o JOIN alike a ON a.payload = o.payload
    """,
}
