"""Selective apply: withhold what the verifier blocks, verify again from the untouched original, until it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosespark.functions import text as T
from prosespark.operators import edits as E
from prosespark.operators import verify as V
from prosespark.sources.io import settled


def selective(cases: DataFrame, entries: DataFrame, spans: DataFrame, ranges: DataFrame, verdict: str | None = None) -> DataFrame:
    """doc_id, status (applied, unchanged, blocked), edits, withheld, revision.

    A finding without hunks blocks its document. Hunks that share a blocking finding go together. Every round verifies
    what is left against the original, for all documents at once, and can only take hunks away, so rounds go on until no
    document loses one: as many as the longest script has hunks, and one, at most.
    """
    state = settled(cases.withColumn("edits", E.ordered(F.col("edits"))), "apply")
    while True:
        l2 = V.layer2(state, entries).where("disposition in ('reject', 'ask')")
        drop = settled(V.withhold(state, l2).where("not applied").groupBy("doc_id").agg(F.collect_set("hunk").alias("__drop")), "withheld")
        if drop.isEmpty():
            break
        kept = F.transform(F.filter(F.transform("edits", lambda e, i: F.struct(e.alias("e"), i.cast("bigint").alias("i"))), lambda x: ~F.coalesce(F.array_contains("__drop", x["i"]), F.lit(False))), lambda x: x["e"])
        state = settled(T.once(state.join(drop, "doc_id", "left"), edits=kept).drop("__drop").select(*cases.columns), "apply")
    held = V.verify(state, entries, spans, ranges, verdict, two_layer=verdict is None)
    out = state.join(held.select("doc_id", "decision"), "doc_id").join(cases.select("doc_id", F.size("edits").alias("__before")), "doc_id")
    out = T.once(out, revision=E.apply(F.col("content"), F.col("edits")))
    status = F.when(F.col("decision") != "ACCEPT", F.lit("blocked")).when(F.size("edits") == 0, F.lit("unchanged")).otherwise(F.lit("applied"))
    final = F.when(status == "applied", F.col("revision")).otherwise(F.col("content"))
    return out.select("doc_id", status.alias("status"), "edits", (F.col("__before") - F.size("edits")).cast("bigint").alias("withheld"), final.alias("revision"))
