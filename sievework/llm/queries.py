"""The registered query of each operator, with its production parameters, and its DuckDB twin where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fill_middle, merge_dropout, ngram_join, packing, quality_classifier, quality_rules, resharding, token_counts, topk, toxicity, url_filters, warc
from .shared import own_session, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    """Registers a query, which runs in a session of its own, with bounded batches."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(own_session(spark), sf_dir)

    QUERIES[f.__name__] = run
    return run


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.joined(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


ORACLES["op2_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = quality_classifier.grades(table(spark, sf_dir, "labels"))
    return quality_classifier.rated(table(spark, sf_dir, "documents"), ratings)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    return token_counts.counted(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), vocabulary())


@query
def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.digests(table(spark, sf_dir, "documents"), scratch(spark, "shards"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "archives"))


ORACLES["op9_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS first,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS INTEGER) >> CAST(5 * (3 - k % 4) AS INTEGER)) & 31), 1)), '') AS digest
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLES["op10_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS MATERIALIZED (SELECT doc, lang, source, unnest(terms) AS term FROM d
), k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 3
), v AS MATERIALIZED (SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d
), t AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
  FROM g LEFT JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), lt AS (SELECT lang, CAST(sum(total) AS HUGEINT) AS total FROM t GROUP BY lang
), lc AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL
), s AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (t.total + t.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (lc.n + 1)) // (lt.total + t.v) AS q
  FROM t JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
  JOIN lt ON lt.lang = t.lang JOIN lc ON lc.lang = t.lang AND lc.term = k.term
), p AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


#: The rules of the query, with their verdicts.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no rule fits, urls are blocked whose pages all repeat the html of pages with smaller ids."""
    pages = table(spark, sf_dir, "pages")
    return url_filters.judged(pages, url_filters.rule_table(spark, RULES), url_filters.only_copies(pages))


ORACLES["op12_url_filters"] = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, sha256(coalesce(html, '')) AS digest,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, page_id = min(page_id) OVER (PARTITION BY digest) AS first
  FROM p
), u AS (SELECT url, bool_or(first) AS own FROM h GROUP BY url
), r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT page_id, max_by({'rule': r.host || r.path, 'verdict': verdict}, length(r.host || r.path)) AS best
  FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY page_id
)
SELECT h.page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN own THEN 'allow' ELSE 'block' END) AS verdict
FROM h JOIN u USING (url) LEFT JOIN f USING (page_id)
"""


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


ORACLES["op13_fill_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), n AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
    coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS suffix
  FROM n
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
