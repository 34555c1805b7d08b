"""Streams: audit on arrival (stateless), evidence from the feedback log, deduplicated feedback with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosespark.functions import fixed
from prosespark.operators import metrics
from prosespark.operators.recommend import metric_class
from prosespark.sources.io import FEEDBACK


def read_feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def audit_on_arrival(docs: DataFrame) -> DataFrame:
    """Punctuation and phrase counts of each arriving document; no state, so any document may come at any time."""
    d = metrics.prepared(docs)
    return d.select("doc_id", F.size("sentences").alias("n_sentences"), "n_words", *[F.size(metrics.hits_of(m)).alias(m) for m in metrics.PHRASE_METRICS])


def keep_evidence(feedback: DataFrame) -> DataFrame:
    """genre, metric_class, score so far: the batch learner's sum as a streaming aggregate (update or complete mode)."""
    weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.ACTION_WEIGHT.items() for x in kv]), F.col("user_action"))
    rows = feedback.where("recommendation = 'strip'").select("genre", metric_class(F.col("metric")).alias("metric_class"), weight.alias("w")).where("metric_class is not null and w is not null")
    return rows.groupBy("genre", "metric_class").agg(F.sum("w").alias("score"))


def deduplicated(feedback: DataFrame, late: str = "1 day") -> DataFrame:
    """One line a document, finding and action within the watermark."""
    stamped = feedback.withColumn("event_time", F.try_to_timestamp(F.regexp_replace("ts", "Z$", "+00:00")))
    return stamped.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["doc_sha", "finding_id", "user_action"])


