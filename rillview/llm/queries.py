"""The queries of this folder: each applies its operator, with production parameters, to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillview.llm import decontaminate, language, language_model, licenses, neighbours, quality, simhash, suffixes, tokenize, toxicity
from rillview.llm.common import table

CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda s, d: toxicity.toxic_spans(_documents(s, d), table(s, d, "labels")),
    "op2_neighbours": lambda s, d: neighbours.nearest(table(s, d, "embeddings")),
    "op3_quality": lambda s, d: quality.quality_scores(_documents(s, d), table(s, d, "labels")),
    "op4_tokenize": lambda s, d: tokenize.encode_documents(_documents(s, d)),
    "op5_decontaminate": lambda s, d: decontaminate.contamination(_documents(s, d), table(s, d, "benchmark")).drop("text_hash"),
    "op6_simhash": lambda s, d: simhash.near_duplicates(_documents(s, d)),
    "op7_licenses": lambda s, d: licenses.scan(_documents(s, d)),
    "op8_language_model": lambda s, d: language_model.log_likelihoods(_documents(s, d)),
    "op9_language": lambda s, d: language.detect_languages(_documents(s, d)),
    "op10_suffixes": lambda s, d: suffixes.remove_repeats(_documents(s, d)),
}

ORACLE_SQL: dict[str, str] = {"op5_decontaminate": CONTAMINATION_SQL, "op7_licenses": licenses.oracle_sql()}
