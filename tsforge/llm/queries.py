"""The queries of the operators over the given tables, by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import ann, bpe, decontaminate, divergence, exact_dedup, html_text, language_id, line_dedup, minhash, repeats, token_alignment, toxicity, url_rules
from tsforge.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), RANKS, PATTERN, with_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("line_dedup.n_lines").cast("long").alias("n_lines"), F.col("line_dedup.n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), categories)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_main_text, op2_byte_bpe, op3_decontamination, op4_nearest, op5_language_id, op6_minhash, op7_suffix_array, op8_line_dedup, op9_toxicity, op10_url_filters,
        op11_exact_dedup, op12_source_divergence, op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, parts, unnest(range(len(parts))) AS pos FROM split),
lines AS (
    SELECT doc_id, pos, trim(translate(parts[pos + 1], chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS line FROM places),
runs AS (
    SELECT doc_id, pos, line, lead(line) OVER w AS next_line, lead(pos) OVER w AS next_pos
    FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
    SELECT doc_id, pos, next_pos, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, pos) AS nth FROM runs WHERE next_pos IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([pos, next_pos]) AS pos FROM ranked WHERE nth > 1)
SELECT p.doc_id, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(p.parts[p.pos + 1], chr(10) ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos
GROUP BY p.doc_id
""",
    "op10_url_filters": r"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
    SELECT p.page_id, p.host, p.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM parts p LEFT JOIN rules r
      ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
    GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting
""",
    "op11_exact_dedup": r"""
WITH plain AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM plain WINDOW w AS (PARTITION BY norm)
""",
    "op12_source_divergence": r"""
WITH plain AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
           row_number() OVER () AS doc
    FROM documents),
in_doc AS (SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(terms) AS term FROM plain) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM in_doc GROUP BY lang, term HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM plain),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n
          FROM groups g JOIN kept k ON g.lang = k.lang
          LEFT JOIN (SELECT lang, source, term, sum(n)::BIGINT AS n FROM in_doc GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
    SELECT c.lang, source, term, n,
           1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY c.lang, source)::HUGEINT + 5 * v) AS p,
           1 + (1000000000::HUGEINT * (lang_n + 5)) // (total + 5 * v) AS q
    FROM cells c JOIN sizes s ON c.lang = s.lang),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
""",
}
