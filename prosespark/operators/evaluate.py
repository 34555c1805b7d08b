"""Evaluation: judge medians and the beat criterion, gate-by-gate comparison, states of runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.functions import text as T
from prosespark.operators import edits as E

DIMENSIONS = 9
MIN_TRIALS = 3


def judge(trials: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """case, n_trials, errored, beat from (case_id, trial, side, dim, score): medians by dimension, then the criterion.

    The candidate beats the baseline if its medians' sum is no less, none is worse by more than 1, and one is better.
    Fewer than MIN_TRIALS trials, scores outside 0..2 or missing dimensions are errors, and an error never beats.
    """
    full = trials.groupBy("case_id", "trial").agg(F.count_distinct("side", "dim").alias("cells"), F.bool_and(F.col("score").isin(0, 1, 2)).alias("sound"))
    shape = full.groupBy("case_id").agg(F.count("*").alias("n_trials"), (~F.bool_and((F.col("cells") == 2 * dimensions) & F.coalesce("sound", F.lit(False)))).alias("bad"))
    median = trials.groupBy("case_id", "dim").agg(F.median(F.when(F.col("side") == "candidate", F.col("score"))).alias("c"), F.median(F.when(F.col("side") == "baseline", F.col("score"))).alias("b"))
    verdict = median.groupBy("case_id").agg((F.sum("c") >= F.sum("b")).alias("sum_ok"), F.bool_and(F.col("c") >= F.col("b") - 1).alias("none_worse"), F.bool_or(F.col("c") > F.col("b")).alias("one_better"))
    out = shape.join(verdict, "case_id").withColumn("errored", F.col("bad") | (F.col("n_trials") < MIN_TRIALS))
    return out.select("case_id", "n_trials", "errored", (~F.col("errored") & F.coalesce(F.col("sum_ok") & F.col("none_worse") & F.col("one_better"), F.lit(False))).alias("beat"))


def gate_rank(status: Column) -> Column:
    return F.when(status == "pass", F.lit(2)).when(status.isin("not_evaluated", "capability_unavailable"), F.lit(1)).otherwise(F.lit(0))


def compare_gates(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """fixture, gates_better, gates_worse, verdict over the gates (fixture, gate, status) that both have."""
    both = ours.select("fixture", "gate", gate_rank(F.col("status")).alias("a")).join(theirs.select("fixture", "gate", gate_rank(F.col("status")).alias("b")), ["fixture", "gate"])
    got = both.groupBy("fixture").agg(F.count_if(F.col("a") > F.col("b")).alias("gates_better"), F.count_if(F.col("a") < F.col("b")).alias("gates_worse"))
    return got.withColumn("verdict", F.when(F.col("gates_worse") > 0, F.lit("LOSES")).when(F.col("gates_better") > 0, F.lit("BEATS")).otherwise(F.lit("TIES")))


def acceptance(gates: DataFrame) -> DataFrame:
    """fixture, state: the worst of its gates' states; a gate not evaluated leaves a fixture incomplete."""
    rank = F.when(F.col("status") == "fixture_error", F.lit(0)).when(F.col("status") == "fail", F.lit(1)).when(F.col("status").isin("not_evaluated", "capability_unavailable"), F.lit(2)).otherwise(F.lit(3))
    names = F.array(*map(F.lit, ("FIXTURE_ERROR", "FAIL", "INCOMPLETE", "PASS")))
    return gates.groupBy("fixture").agg(F.min(rank).alias("r"), F.count("*").alias("n_gates")).select("fixture", "n_gates", F.element_at(names, (F.col("r") + 1).cast("int")).alias("state"))


def reconstruct(candidates: DataFrame, originals: DataFrame) -> DataFrame:
    """fixture, pass_index, revision, problem: envelopes applied to the original, second passes to the first's result.

    candidates: fixture, pass_index (1 or 2), base_hash, edits, revision_sha256. originals: fixture, content. A second
    pass must name the digest of the first pass's revision; a first pass must name its own revision's, a second may.
    """

    def applied(rows: DataFrame) -> DataFrame:
        rows = T.once(rows, revision=E.apply(F.col("content"), F.col("edits")))
        drifted = F.col("pass_index") == 2
        problem = (
            F.when(F.col("content").isNull(), F.lit("no_base"))
            .when(drifted & ~F.col("base_hash").eqNullSafe(F.sha2("content", 256)), F.lit("base_hash_mismatch"))
            .when(F.col("revision").isNull(), F.lit("invalid_edits"))
            .when(~(drifted & F.col("revision_sha256").isNull()) & ~F.sha2("revision", 256).eqNullSafe(F.col("revision_sha256")), F.lit("revision_sha256_mismatch"))
        )
        return rows.withColumn("problem", problem).select("fixture", "pass_index", "revision", "problem")

    first = applied(candidates.where("pass_index = 1").join(originals.select("fixture", "content"), "fixture", "left"))
    second = candidates.where("pass_index = 2").join(first.where("problem is null").select("fixture", F.col("revision").alias("content")), "fixture", "left")
    return first.unionByName(applied(second))


def gate_rows(fixtures: DataFrame, failed: dict[str, DataFrame], second: DataFrame | None = None) -> DataFrame:
    """fixture, gate, status: one row a fixture and gate.

    fixtures: fixture, control, content, revision. failed: for each gate a frame with the fixtures that break it.
    Controls must be unchanged; a second pass (fixture, revision) must change nothing, and without one that gate isn't
    evaluated.
    """
    names = fixtures.select("fixture")
    rows = [names.join(bad.select("fixture").distinct().withColumn("bad", F.lit(True)), "fixture", "left").select("fixture", F.lit(gate).alias("gate"), F.when(F.col("bad"), F.lit("fail")).otherwise(F.lit("pass")).alias("status")) for gate, bad in failed.items()]
    same = F.when(E.material_equal(F.col("content"), F.col("revision")), F.lit("pass")).otherwise(F.lit("fail"))
    rows.append(fixtures.where("control").select("fixture", F.lit("control_abstention").alias("gate"), same.alias("status")))
    if second is None:
        rows.append(names.select("fixture", F.lit("idempotence").alias("gate"), F.lit("not_evaluated").alias("status")))
    else:
        again = fixtures.join(second.select("fixture", F.col("revision").alias("twice")), "fixture", "left")
        rows.append(again.select("fixture", F.lit("idempotence").alias("gate"), F.when(F.col("twice").isNull(), F.lit("not_evaluated")).when(F.col("twice") == F.col("revision"), F.lit("pass")).otherwise(F.lit("fail")).alias("status")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def keyed_repair(docs: DataFrame, repairs: DataFrame) -> DataFrame:
    """doc_id, edits: each repair (doc_id, before, after) replaces the first place where before stands; others do nothing."""
    rows = docs.select("doc_id", "text").join(repairs, "doc_id")
    at = F.instr(F.col("text"), F.col("before"))
    start = F.octet_length(F.expr("substring(text, 1, instr(text, before) - 1)")).cast("bigint")
    edit = F.struct(start.alias("start_byte"), (start + F.octet_length("before")).alias("end_byte"), F.col("after").cast("binary").alias("replacement"), F.lit(None).cast("string").alias("preimage_sha256"))
    got = rows.where((at > 0) & (F.col("before") != "")).groupBy("doc_id").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    return docs.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce("edits", F.array().cast(got.schema["edits"].dataType)).alias("edits"))


def policy_revision(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """doc_id, original, revision: an ordered chain of literal replacements, for baselines without a script."""
    c = F.col("text")
    for before, after in rules:
        c = F.replace(c, F.lit(before), F.lit(after))
    return docs.select("doc_id", F.col("text").cast("binary").alias("original"), c.cast("binary").alias("revision"))


def matrix(fixtures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Every fixture with every baseline; baselines are a handful of names, so they are broadcast."""
    return fixtures.crossJoin(F.broadcast(baselines.select("baseline").distinct()))


def run_trials(cases: DataFrame, judge: Callable[[str, str, str], dict[str, dict[str, int]]], n: int = MIN_TRIALS) -> DataFrame:
    """case_id, trial, side, dim, score of n calls of a judge on (original, revision, baseline); a failing call gives a score of -1, which judge() takes for an error."""

    def call(row: tuple[str, str, str]) -> list[dict]:
        out = []
        for trial in range(n):
            try:
                got = judge(*row)
                out += [{"trial": trial, "side": side, "dim": dim, "score": int(score)} for side in ("candidate", "baseline") for dim, score in got[side].items()]
            except Exception:  # noqa: BLE001  whatever an injected judge raises
                out.append({"trial": trial, "side": "candidate", "dim": "error", "score": -1})
        return out

    def every(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([call(r) for r in zip(a, b, c, strict=True)], dtype=object)

    asked = F.pandas_udf(every, "array<struct<trial:int,side:string,dim:string,score:int>>")("original", "revision", "baseline")
    return cases.select("case_id", F.explode(asked).alias("t")).select("case_id", "t.*")
