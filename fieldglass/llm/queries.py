"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import decontamination, html, langid, neighbours, packing, pii, repeats, simhash, token_files, urls
from fieldglass.llm.common import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat 50-byte strings of smaller ones, removed."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


SQL["op1_repeats"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
c AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE m < doc_id),
s AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
r AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


@query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data: doc_id, text, n_entities."""
    return pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities", cards="valid")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rows = langid.sample(docs)
    found = langid.predict(docs, langid.train(rows) if rows else None)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing of all documents into sequences of 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    docs, folder = table(spark, sf_dir, "documents"), token_files.fresh_folder(spark)
    files = token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), added=True)
    return token_files.read(spark, files)


@query
def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of all embeddings."""
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op5_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN n ON vec_id = n.a
"""


@query
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, site templates removed."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, cut(html.templates(pages)))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.hex("fp"))  # little-endian
    number = F.concat(*[F.substring(digits, 2 * byte + 1, 2) for byte in range(7, -1, -1)])
    return found.select("doc_id", number.alias("fingerprint"), "component_id")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op8_decontamination"] = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
  SELECT DISTINCT id AS item_id, array_to_string(w[i:i + 9], ' ') AS gram, least(len(w), 10) AS n
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words WHERE kind = 'b' AND len(w) > 0 AND id IS NOT NULL)
), sizes AS (SELECT DISTINCT n FROM items), starts AS (
  SELECT id AS doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= n)
), hits AS (SELECT doc_id, i, starts.n, item_id FROM starts JOIN items ON starts.gram = items.gram AND starts.n = items.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON id = covered.doc_id LEFT JOIN named ON id = named.doc_id WHERE kind = 'd'
"""


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return urls.judge(table(spark, sf_dir, "pages"))


SQL["op9_urls"] = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS query FROM parts
), named AS (
  SELECT host, path, host || path || query AS a, unnest([
    regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b') AND regexp_matches(x, '(?is)\bhref\s*='))[1], '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') AND regexp_matches(x, '(?is)\burl\s*='))[1], '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS link
  FROM split WHERE host <> '' AND html IS NOT NULL
), targets AS (
  SELECT a, CASE WHEN instr(link, '://') > 0 THEN substr(link, instr(link, '://') + 3) WHEN starts_with(link, '//') THEN substr(link, 3) WHEN starts_with(link, '/') THEN host || link
                 WHEN starts_with(link, '?') THEN host || path || link ELSE host || regexp_replace(path, '[^/]*$', '') || link END AS rest
  FROM named WHERE link <> ''
), edges AS (
  SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM targets
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), places AS (
  SELECT DISTINCT host, path FROM split UNION SELECT regexp_extract(node, '^([^/?#]*)', 1), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) FROM reach
), fits AS (
  SELECT host, path, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule, first(verdict ORDER BY length(rule_host || rule_path) DESC) AS own
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path
), bad AS (
  SELECT DISTINCT node FROM reach JOIN fits ON regexp_extract(other, '^([^/?#]*)', 1) = host AND regexp_extract(other, '^[^/?#]*([^?#]*)', 1) = path WHERE own = 'block'
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits USING (host, path) LEFT JOIN bad ON host <> '' AND host || path || query = node
"""
