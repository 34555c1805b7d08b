"""The driver's queries of this subpackage, op1 to op10, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosespark.llm import bpe, exact_dedup, html_extract, langid, mixing, neardup, quality, token_files, toxicity, url_filter
from prosespark.sources.io import spread


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_documents, _labels, _pages = _table("documents"), _table("labels"), _table("pages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda spark, d: langid.op1(_documents(spark, d)),
        "op2_html_extraction": lambda spark, d: html_extract.op2(_pages(spark, d)),
        "op3_bpe": lambda spark, d: bpe.op3(_documents(spark, d), _vocabulary()),
        "op4_mixing": lambda spark, d: mixing.op4(_documents(spark, d)),
        "op5_near_dedup": lambda spark, d: neardup.op5(_documents(spark, d)),
        "op6_quality": lambda spark, d: quality.op6(_documents(spark, d), _labels(spark, d)),
        "op7_exact_dedup": lambda spark, d: exact_dedup.op7(_documents(spark, d)),
        "op8_toxicity": lambda spark, d: toxicity.op8(_documents(spark, d), _labels(spark, d)),
        "op9_token_files": lambda spark, d: token_files.op9(_documents(spark, d), _vocabulary()),
        "op10_url_filter": lambda spark, d: url_filter.op10(_pages(spark, d)),
    }


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT h, count(*) AS group_size, first(doc_id ORDER BY n_cp DESC, doc_id) AS keep_id FROM t GROUP BY h
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g USING (h)
"""


#: All pairs with a shingle in common, counted in full, and the closure of the links among them.
OP5_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x
)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, t.doc_id = min(reach.b) AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = t.doc_id GROUP BY t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL}
