"""Mixing sources to target weights by subset sums over exact sizes.

Each source's documents are counted by exact size (words). A source whose budget passes its size takes every document
once and fits the rest of the budget with second copies; else it fits the budget with single copies. The fit is
bounded-knapsack dynamic programming over all counts of all sizes (divided by their common divisor): it takes the
largest sum that doesn't pass the budget. Only where budget times items passes WORK (or the budget SUMS), a fixed share
of each size's count and then larger sizes are taken first, until what is left of the budget is within those bounds or
no document fits it; the programme then closes the rest with all counts that are left. The sum then still misses the
budget by less than the smallest document left out. So many documents of each size are taken in the order of a seeded
hash of doc_id, found by counting hash buckets, so that no size's documents ever meet in one task; only the bucket where
the count runs out is ranked.

Sources are ranked in ranges and share the total in rounds of one small aggregate each; none is brought to the driver.

Null texts have size 0; documents of size 0 take nothing. A null source is a source of its own, last. Repeated rows
count each; in `mixed` rows with one doc_id, source and size all come as often as the one taken most. Empty tables give
no rows. Extra columns of any name are kept by `mixed` and ignored otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosespark.llm.common import materialize, packed

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 17
#: Sums that the dynamic programme holds at most, its cells (sums times items), and hash buckets a size.
SUMS, WORK, BUCKETS = 1 << 22, 500_000_000, 4096


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def items_of(sizes: list[int], counts: list[int], budget: int) -> int:
    """Items that the counts make when split into powers of two."""
    return sum(min(n, budget // z).bit_length() for z, n in zip(sizes, counts, strict=True))


def close_budget(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """Bounded knapsack: how many of each size sum nearest to budget from below; reachable sums are bits of a number."""
    taken = [0] * len(sizes)
    reach, mask = 1, (1 << (budget + 1)) - 1
    by = np.full(budget + 1, -1, np.int32)  # the first item that reached each sum
    items: list[tuple[int, int, int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        n, unit = min(counts[k], budget // sizes[k]), 1
        while n > 0:
            m = min(unit, n)
            new = (reach << (m * sizes[k])) & mask & ~reach
            if new:
                low = ((new & -new).bit_length() - 1) // 8 * 8
                bits = np.unpackbits(np.frombuffer((new >> low).to_bytes((new.bit_length() - low + 7) // 8, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits) + low] = len(items)
                reach |= new
                items.append((k, m, m * sizes[k]))
            n, unit = n - m, unit * 2
        if reach >> budget:
            break
    s = reach.bit_length() - 1
    while s:
        k, m, w = items[by[s]]
        taken[k] += m
        s -= w
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, their words summing to budget or just below it."""
    every = [(int(z), int(n)) for z, n in zip(sizes, counts, strict=True)]
    if budget >= sum(z * n for z, n in every):
        return np.array([n for _, n in every], np.int64)
    out = np.zeros(len(every), np.int64)
    used = [i for i, (z, n) in enumerate(every) if 0 < z <= budget and n > 0]
    if not used:
        return out
    unit = math.gcd(*(every[i][0] for i in used))
    z, n, budget = [every[i][0] // unit for i in used], [every[i][1] for i in used], budget // unit
    step = min(budget, SUMS)
    while step * items_of(z, n, step) > WORK and step > 1:
        step //= 2
    taken, left = [0] * len(z), budget
    if left > step:
        whole = sum(a * b for a, b in zip(z, n, strict=True))
        taken = [b * (budget - step) // whole for b in n]
        left -= sum(a * b for a, b in zip(z, taken, strict=True))
        for reserve in (step // 2, 0):
            for k in sorted(range(len(z)), key=lambda k: -z[k]):
                if left > step:
                    m = max(0, min(n[k] - taken[k], (left - reserve) // z[k]))
                    taken[k] += m
                    left -= m * z[k]
    open_ = [k for k in range(len(z)) if taken[k] < n[k] and z[k] <= left] if left <= step else []
    if open_:
        for k, m in zip(open_, close_budget([z[k] for k in open_], [n[k] - taken[k] for k in open_], left), strict=True):
            taken[k] += m
    out[used] = taken
    return out


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    source_size, budget = sum(int(z) * int(n) for z, n in zip(sizes, counts, strict=True)), int(pdf["target"].iloc[0])
    base = 1 if budget >= source_size else 0
    return pd.DataFrame({"source": pdf["source"].iloc[0], "size": sizes, "base": base, "n_more": fit(sizes, counts, budget - base * source_size)})


def targets(thin: DataFrame) -> DataFrame:
    """source, source_size, target of each source."""
    spark = thin.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = thin.groupBy("source").agg(F.sum("size").alias("n")).repartitionByRange(parts, *order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "sources")
    # a number a range: how many sources lie in the ranges before
    offsets, before = [], 0
    for r in sorted(dealt.groupBy("part").agg(F.count("*").alias("k")).collect()):
        offsets.append((r["part"], before))
        before += r["k"]
    starts = spark.createDataFrame(offsets, "part int, before bigint")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.lit(0.0)
    for i, x in enumerate(WEIGHTS):
        weight = F.when(F.pmod("rank", F.lit(len(WEIGHTS))) == i, F.lit(float(x))).otherwise(weight)
    ranked = materialize(dealt.join(starts, "part").withColumn("rank", rank).select("source", "n", weight.alias("w")), "ranked-sources")
    full = lambda unit: F.col("n") * F.lit(MOST) < F.lit(unit) * F.col("w")
    unit, stopped = 0.0, -1
    while True:  # sources that reach MOST times their size stay there; what is left is shared by the others
        got = ranked.agg(F.sum("n").alias("n"), F.sum(F.when(full(unit), F.col("n"))).alias("full"), F.count(F.when(full(unit), True)).alias("k"), F.sum(F.when((F.col("n") > 0) & ~full(unit), F.col("w"))).alias("w")).first()
        if got["k"] == stopped or not got["w"]:
            break
        stopped, unit = got["k"], (SHARE * got["n"] - MOST * (got["full"] or 0)) / got["w"]
    return ranked.select("source", F.col("n").alias("source_size"), F.when(F.col("n") == 0, F.lit(0.0)).when(full(unit), F.col("n") * F.lit(float(MOST))).otherwise(F.lit(unit) * F.col("w")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row; `copies` is how often the mix holds it."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED))
    thin = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of("text").alias("size"), h.alias("h")), "sizes")
    thin = thin.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    per_source = targets(thin)
    by_size = thin.groupBy("source", "size").agg(F.count("*").alias("n"))
    same = lambda a, b, *more: [a["source"].eqNullSafe(b["source"]), *[a[c] == b[c] for c in more]]
    t = materialize(per_source, "targets")
    plan = materialize(by_size.join(t, same(by_size, t), "left").select(by_size["source"], "size", "n", "target").groupBy("source").applyInPandas(_fit_source, "source string, size bigint, base int, n_more bigint"), "plan")
    # how many rows of a size come in the buckets before each
    buckets = thin.groupBy("source", "size", "bucket").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = buckets.withColumn("before", before).join(plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "base", "n_more"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select("source", "size", "bucket", "base", F.greatest(F.lit(0), F.least("k", F.col("n_more") - F.col("before"))).alias("want"), "k")
    cut = materialize(cut, "buckets")
    c = cut.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "base", "want", "k")
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b"))
    rows = thin.join(c, on)
    sure = rows.where("want = 0 or want = k").withColumn("copies", F.col("base") + (F.col("want") > 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    ranked = rows.where("want > 0 and want < k").withColumn("copies", F.col("base") + (rank <= F.col("want")).cast("int"))
    out = sure.unionByName(ranked).select("doc_id", "source", "size", "copies")
    return out.join(t, same(out, t), "left").select("doc_id", out["source"], "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).alias("copies"))


def op4(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns."""
    taken = mix(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).select(F.struct("doc_id", "source", "size").alias("k"), "copies")
    rows = packed(docs, F.struct(F.col("doc_id"), F.col("source").cast("string").alias("source"), size_of("text").alias("size")).alias("key"))
    on = rows["key.doc_id"].eqNullSafe(F.col("k.doc_id")) & rows["key.source"].eqNullSafe(F.col("k.source")) & (rows["key.size"] == F.col("k.size"))
    return rows.join(taken, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
