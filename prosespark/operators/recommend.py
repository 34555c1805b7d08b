"""Advice on findings: strip or keep by genre and metric class, and the learned overlay that only ever keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosespark.functions import fixed


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def metric_class(metric: Column) -> Column:
    return F.try_element_at(_map(fixed.METRIC_CLASS), metric)


def recommend(genre: Column, metric: Column) -> Column:
    """strip or keep; an unknown genre raises, an unmapped metric is kept, null or empty genre counts as general."""
    g = F.when(F.coalesce(genre, F.lit("")) == "", F.lit("general")).otherwise(genre)
    known = g.isin(*fixed.GENRE_KEEPS)
    kept = F.lit(False)
    for name, classes in fixed.GENRE_KEEPS.items():
        if classes:
            kept = kept | ((g == name) & metric_class(metric).isin(*classes))
    keep = metric_class(metric).isNull() | metric_class(metric).isin(*fixed.ALWAYS_KEPT) | kept
    return F.when(~known, F.raise_error(F.concat(F.lit("unknown genre "), g))).when(keep, F.lit("keep")).otherwise(F.lit("strip"))


def table(spark: SparkSession) -> DataFrame:
    """genre, metric, recommendation of all pairs."""
    genres = spark.createDataFrame([(g,) for g in fixed.GENRE_KEEPS], "genre string")
    return genres.select("genre", F.explode(F.array(*map(F.lit, fixed.METRIC_CLASS))).alias("metric")).withColumn("recommendation", recommend(F.col("genre"), F.col("metric")))


def learn(feedback: DataFrame, min_evidence: float = fixed.MIN_EVIDENCE) -> DataFrame:
    """genre, metric_class, score of classes to keep: evidence of strip advice that users turned down."""
    weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.ACTION_WEIGHT.items() for x in kv]), F.col("user_action"))
    signal = feedback.where("recommendation = 'strip'").select("genre", metric_class(F.col("metric")).alias("metric_class"), weight.alias("w")).where("metric_class is not null and w is not null")
    return signal.groupBy("genre", "metric_class").agg(F.sum("w").alias("score")).where(F.col("score") >= min_evidence)


def apply_overlay(findings: DataFrame, overlay: DataFrame) -> DataFrame:
    """findings with recommendation turned from strip to keep where the overlay says so, never the other way.

    The overlay has a row a genre and metric class at most, so it is broadcast.
    """
    o = F.broadcast(overlay.select(F.col("genre").alias("__g"), F.col("metric_class").alias("__c")).distinct())
    g = F.coalesce(F.nullif(F.col("genre"), F.lit("")), F.lit("general"))
    joined = findings.join(o, (g == F.col("__g")) & (metric_class(F.col("metric")) == F.col("__c")), "left")
    keep = (F.col("recommendation") == "strip") & F.col("__g").isNotNull()
    return joined.withColumn("recommendation", F.when(keep, F.lit("keep")).otherwise(F.col("recommendation"))).drop("__g", "__c")


def status(rows: DataFrame) -> DataFrame:
    """audit_status and has_strip of each document from metric rows (doc_id, metric, n_locations, soft_flag, genre)."""
    live = (F.col("n_locations") > 0) | F.coalesce("soft_flag", F.lit(False))
    strip = recommend(F.col("genre"), F.col("metric")) == "strip"
    return rows.groupBy("doc_id").agg(F.when(F.bool_or(live), F.lit("flagged")).otherwise(F.lit("clean")).alias("audit_status"), F.coalesce(F.bool_or(live & strip), F.lit(False)).alias("has_strip"))
