"""Findings: locations joined to units, one row a metric and span, with advice and evidence; decisions to edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosespark.operators import spans as S
from prosespark.operators.recommend import apply_overlay, metric_class, recommend


def build(locations: DataFrame, units: DataFrame, starts: DataFrame, genres: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """doc_id, finding_id, metric, metric_class, genre, recommendation, range, evidence: one row a metric and unit."""
    spans = S.unit_bytes(units.select("doc_id", "unit_idx", "line_start", "line_end"), starts)
    u = spans.select(F.col("doc_id").alias("__d"), F.col("line_start").alias("__a"), F.col("line_end").alias("__b"), "start_byte", "end_byte")
    hit = locations.join(u, (F.col("doc_id") == F.col("__d")) & (F.col("__b") >= F.col("line_start")) & (F.col("__a") <= F.col("line_end")))
    some = F.when(F.coalesce("evidence", F.lit("")) != "", F.struct("ord", "evidence"))
    got = hit.groupBy("doc_id", "metric", "start_byte", "end_byte").agg(F.sort_array(F.collect_list(some)).alias("seen"))
    got = got.join(genres.select("doc_id", "genre"), "doc_id").withColumn("recommendation", recommend(F.col("genre"), F.col("metric")))
    if overlay is not None:
        got = apply_overlay(got, overlay)
    evidence = F.array_join(F.array_distinct(F.transform("seen", lambda s: s["evidence"])), "; ")
    return got.select("doc_id", F.concat_ws(":", "metric", "start_byte", "end_byte").alias("finding_id"), "metric", F.coalesce(metric_class(F.col("metric")), F.lit("unclassified")).alias("metric_class"), "genre", "recommendation", F.col("start_byte").cast("bigint").alias("start_byte"), F.col("end_byte").cast("bigint").alias("end_byte"), evidence.alias("evidence"))


def precheck(cases: DataFrame, verified: DataFrame) -> DataFrame:
    """deterministic_pass or blocked of candidate edits, from verify(..., two_layer=True)."""
    return verified.select("doc_id", F.when(F.col("decision") == "ACCEPT", F.lit("deterministic_pass")).otherwise(F.lit("blocked")).alias("precheck"))


def edits_from_decisions(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, edits, conflicts from (doc_id, finding_id, user_action, replacement): discards go, equal spans merge.

    A span with two different edits is a conflict and its document gets none.
    """
    known = decisions.where("user_action in ('apply', 'edit')").join(findings.select("doc_id", "finding_id", "start_byte", "end_byte"), ["doc_id", "finding_id"])
    text = F.when(F.col("user_action") == "edit", F.try_to_binary("replacement", F.lit("base64"))).otherwise(F.lit(b""))
    rows = known.select("doc_id", "start_byte", "end_byte", text.alias("replacement")).distinct()
    spans = rows.groupBy("doc_id", "start_byte", "end_byte").agg(F.count("*").alias("n"), F.min("replacement").alias("replacement"))
    out = spans.groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("conflicts"), F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "replacement", F.lit(None).cast("string").alias("preimage_sha256")))).alias("edits"))
    return out.select("doc_id", "conflicts", F.when(F.col("conflicts") == 0, F.col("edits")).alias("edits"))


def feedback_rows(decisions: DataFrame, findings: DataFrame, now: str) -> DataFrame:
    """The feedback log's lines for decisions on known findings; spans are hashed, now is passed in."""
    rows = decisions.join(findings, ["doc_id", "finding_id"])
    span = F.substring(F.sha2(F.concat_ws(":", "start_byte", "end_byte"), 256), 1, 16)
    return rows.select(F.lit(1).alias("schema_version"), F.lit(now).alias("ts"), F.concat_ws(":", "metric", span).alias("finding_id"), F.col("metric_class").alias("category"), "metric", "genre", "recommendation", "user_action", "replacement", F.sha2(F.col("doc_id").cast("string"), 256).alias("doc_sha"))


