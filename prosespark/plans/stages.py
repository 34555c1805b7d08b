"""Stages of a run as rows: what follows a stage that isn't ok is aborted, and the whole has a status and an exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosespark.functions import fixed


def cascade(stages: DataFrame) -> DataFrame:
    """(doc_id, ord, stage, status, code) with every stage after the first that isn't ok aborted."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    broken = F.coalesce(F.max((F.col("status") != "ok").cast("int")).over(w), F.lit(0)) == 1
    return stages.withColumn("__broken", broken).select("doc_id", "ord", "stage", F.when(F.col("__broken"), F.lit("aborted")).otherwise(F.col("status")).alias("status"), F.when(F.col("__broken"), F.lit("upstream_not_ok")).otherwise(F.col("code")).alias("code"))


def roll_up(stages: DataFrame) -> DataFrame:
    """doc_id, status, exit_code, n_aborted: the worst status; the exit class of the first blocked or failed stage."""
    rank = F.create_map(*[F.lit(x) for kv in fixed.STATUS_RANK.items() for x in kv])
    exits = F.create_map(*[F.lit(x) for kv in fixed.EXIT_CLASS.items() for x in kv])
    first = F.min(F.when(F.col("status").isin("blocked", "failed"), F.struct("ord", "code")))
    got = stages.groupBy("doc_id").agg(F.max_by("status", rank[F.col("status")]).alias("status"), first.alias("first"), F.count_if(F.col("status") == "aborted").alias("n_aborted"))
    return got.select("doc_id", "status", F.when(F.col("first").isNull(), F.lit(0)).otherwise(exits[F.col("first.code")]).cast("bigint").alias("exit_code"), "n_aborted")
