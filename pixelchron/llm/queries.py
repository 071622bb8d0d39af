"""The corpus queries, one for each operator, with the columns their contracts name, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup, normalised

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(normalised("text").cast("binary"), 256))
    return exact_dedup(docs, carry=["text_sha256"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), 8)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(_read(spark, sf_dir, "documents")).drop("failed_rule")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), 85)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify_quality

    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_read(spark, sf_dir, "documents"), path("word_bpe_49k.json")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .bpe import encode_documents, token_digests

    return token_digests(encode_documents(_read(spark, sf_dir, "documents"), path("byte_bpe_50k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_secret_scan, op4_quality_rules, op5_mixing, op6_minhash_near_dedup, op7_quality_classifier, op8_lm_scoring, op9_token_files, op10_bpe)}


ORACLES: dict[str, str] = {}

ORACLES["op1_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t
  FROM documents
), g AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

ORACLES["op5_mixing"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS total,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source
), f AS (
  SELECT *, sum(2.0 * total) OVER o AS full_, sum(w) OVER o AS wf, 1.5 * sum(total) OVER () AS budget, sum(w) OVER () AS wa
  FROM s WINDOW o AS (ORDER BY 2.0 * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (budget - coalesce(full_, 0)) / (wa - coalesce(wf, 0)) AS level_ FROM f
), t AS (
  SELECT source, total, least(2.0 * total, w * (SELECT arg_min(level_, coalesce(wf, 0)) FROM l WHERE level_ * w <= 2.0 * total)) AS target FROM l
), c AS (
  SELECT d.doc_id, d.source, d.size, t.total, t.target, d.k,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, (cum + pass * total)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) AS q(pass) WHERE size > 0 AND target > 0
), u AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS used FROM p
), v AS (
  SELECT doc_id, sum(size) AS taken FROM u WHERE used <= (SELECT sum(target) FROM t) + 1e-6 GROUP BY doc_id
)
SELECT c.doc_id, c.size::BIGINT AS size, c.total AS source_size, c.target, coalesce(v.taken, 0)::BIGINT AS taken
FROM c LEFT JOIN v ON c.doc_id = v.doc_id
"""

ORACLES["op4_quality_rules"] = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), c AS (
  SELECT *, len(w) AS nw, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS wc,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS ns, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs,
         length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) AS capitals, length(regexp_replace(t, '\\P{L}', '', 'g')) AS letters,
         list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_ls, len(list_distinct(w)) AS kinds
  FROM t
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, nw - 3)) AS i FROM c)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id
), f AS (
  SELECT c.*, coalesce(cov.n, 0) AS nr FROM c LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, nw::BIGINT AS n_words, wc::BIGINT AS word_chars, ns::BIGINT AS n_symbols,
       (len(full_ls) - len(list_distinct(full_ls)))::BIGINT AS n_dup_lines, nr::BIGINT AS n_repeat_words,
       nw < 10 OR 100 * nr > 20 * nw AS base_failed,
       NOT (nw < 10 OR 100 * nr > 20 * nw OR 10 * ns > 3 * nw OR 10 * bangs > 5 * nw OR 2 * capitals > letters OR 2 * letters < wc
            OR (nw >= 50 AND 10 * kinds < nw AND kinds < 40)
            OR (len(ls) >= 5 AND 2 * len(list_distinct(ls)) < len(ls))) AS kept
FROM f
"""

ORACLES["op6_minhash_near_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (
  SELECT doc_id, md5(string_agg(h, '' ORDER BY h)) AS c, count(*) AS n FROM (SELECT doc_id, md5(array_to_string(g, ' ')) AS h FROM s) GROUP BY doc_id
), cls AS (
  SELECT c, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY c
), rs AS (
  SELECT s.doc_id, s.g FROM s JOIN cls ON s.doc_id = cls.rep
), inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM inter JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)
), e AS (
  SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT rep AS u, rep AS r FROM cls UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.u WHERE reach.r < e.v
), root AS (
  SELECT u, min(r) AS r FROM reach GROUP BY u
), comp AS (
  SELECT sets.doc_id, root.r FROM sets JOIN cls USING (c) JOIN root ON root.u = cls.rep
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.r, d.doc_id) AS component_id, coalesce(comp.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
