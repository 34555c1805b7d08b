"""Exact dedup against a history whose distinct digests sit in a minimal perfect hash.

Texts are compared without the characters [\\x20\\x09-\\x0D], by SHA-256. The history's digests are grouped to one row
each (rows, best locator) and dealt into shards by their first bytes. In a shard a minimal perfect hash is built by
levels: a level is a bit array of twice the digests that are left, a digest owns a bit that it alone hashes to, and the
others go on to the next level; the rank of its bit is a digest's slot. A slot holds the full digest, the winner's
locator (code points, doc_id) and the row count. New digests, one row each after map-side grouping, look up their slot
and compare all 32 bytes: members join the slot's group, others form groups of their own. Rows then take their group's
verdict by a join on the digest, which Spark splits where one group is hot.

The row with the most code points in its original text stays, then the smallest doc_id (null doc_ids last). Null texts
count as empty and form one group with blank ones. Repeated rows are copies too. An empty history sends all to grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import materialize, mix64, packed

#: Distinct digests a shard, about.
SHARD = 16_384
LEVELS = 40


def digest_of(text: str) -> Column:
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.unhex(F.sha2(bare.cast("binary"), 256))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(words[:, 0] ^ mix64(words[:, 1] + np.uint64(level * 0x9E3779B9 + 1))) % np.uint64(size)


class PerfectHash:
    """Slots 0..n-1 for n distinct digests of 32 bytes; any digest gets a slot, or -1."""

    def __init__(self, digests: np.ndarray):
        words, self.levels, base = digests.view(np.uint64).reshape(-1, 4), [], 0
        for level in range(LEVELS):
            if not len(words):
                break
            size = max(64, 2 * len(words))
            at = _places(words, level, size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            bits = hits == 1
            self.levels.append((np.packbits(bits), size, base))
            base += int(bits.sum())
            words = words[hits[at.astype(np.int64)] > 1]
        if len(words):
            raise ValueError("equal digests in the history")
        self.size = base

    def slots(self, digests: np.ndarray) -> np.ndarray:
        words = digests.view(np.uint64).reshape(-1, 4)
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (packed, size, base) in enumerate(self.levels):
            bits = np.unpackbits(packed, count=size)
            rank = np.cumsum(bits) - bits + base
            at = _places(words[open_], level, size).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def _matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32).copy()


class Shard:
    """The hash of a shard and its slots."""

    def __init__(self, digests: list[bytes], n_cp: np.ndarray, best: np.ndarray, rows: np.ndarray):
        keys = _matrix(digests)
        self.hash = PerfectHash(keys)
        slot = self.hash.slots(keys)
        order = np.empty(len(slot), np.int64)
        order[slot] = np.arange(len(slot))
        self.keys, self.n_cp, self.best, self.rows = keys[order], n_cp[order], best[order], rows[order]

    def find(self, digests: list[bytes]) -> np.ndarray:
        """Slots of members; -1 where the slot's digest differs in any byte."""
        if not len(self.keys):
            return np.full(len(digests), -1, np.int64)
        keys = _matrix(digests)
        slot = self.hash.slots(keys)
        same = (slot >= 0) & (self.keys[np.maximum(slot, 0)] == keys).all(axis=1)
        return np.where(same, slot, -1)


#: Sorts before every doc_id when negated ids are compared: a null doc_id.
NO_ID = -(1 << 63)
GROUP = "digest binary, n_cp bigint, neg_id bigint, n_rows bigint"


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest: the best locator (most code points, then the largest negated doc_id) and the row count."""
    return rows.groupBy("digest").agg(F.max(F.struct("n_cp", "neg_id")).alias("b"), F.count("*").alias("n_rows")).select("digest", "b.n_cp", "b.neg_id", "n_rows")


def _resolve(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """The groups of one shard: the history's, raised by members among the new digests, and the nonmembers' own."""
    shard = Shard(old["digest"].tolist(), old["n_cp"].to_numpy(np.int64), old["neg_id"].to_numpy(np.int64), old["n_rows"].to_numpy(np.int64)) if len(old) else None
    cols = ["digest", "n_cp", "neg_id", "n_rows"]
    if shard is None:
        return new[cols]
    at = shard.find(new["digest"].tolist()) if len(new) else np.zeros(0, np.int64)
    member = at >= 0
    cp, best = new["n_cp"].to_numpy(np.int64)[member], new["neg_id"].to_numpy(np.int64)[member]
    slot = at[member]
    better = (cp > shard.n_cp[slot]) | ((cp == shard.n_cp[slot]) & (best > shard.best[slot]))
    shard.rows[slot] += new["n_rows"].to_numpy(np.int64)[member]
    shard.n_cp[slot[better]], shard.best[slot[better]] = cp[better], best[better]
    kept = pd.DataFrame({"digest": [x.tobytes() for x in shard.keys], "n_cp": shard.n_cp, "neg_id": shard.best, "n_rows": shard.rows})
    return pd.concat([kept, new.loc[~member, cols]], ignore_index=True)


def resolve(history: DataFrame, fresh: DataFrame, n_distinct: int) -> DataFrame:
    """Groups of history and fresh digests (both as grouped() gives them), shard by shard."""
    shards = max(1, -(-n_distinct // SHARD))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint"), F.lit(shards)).alias("shard")
    a, b = history.select("*", shard), fresh.select("*", shard)
    return a.groupBy("shard").cogroup(b.groupBy("shard")).applyInPandas(_resolve, GROUP)


def thin(docs: DataFrame) -> DataFrame:
    """digest, n_cp, neg_id and doc_id of each row; no text."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest_of("text").alias("digest"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_cp"),
        F.coalesce(-F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("neg_id"),
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """Every row of thin() with keep_id and group_size.

    The earlier half of the doc_id range is the history that is hashed; the later half is looked up in it. Groups come
    out alike wherever the cut lies.
    """
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.approx_count_distinct("digest").alias("n")).first()
    middle = F.lit(None if ends["a"] is None else (ends["a"] + ends["b"]) // 2).cast("bigint")
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    groups = materialize(resolve(grouped(rows.where(early)), grouped(rows.where(~early)), ends["n"] or 1), "digest-groups")
    keep = groups.select("digest", F.when(F.col("neg_id") != NO_ID, -F.col("neg_id")).alias("keep_id"), F.col("n_rows").alias("group_size"))
    return rows.join(keep, "digest")


def op7(docs: DataFrame) -> DataFrame:
    rows = materialize(thin(docs), "digests")
    return verdicts(rows).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows one."""
    rows = materialize(thin(docs), "digests")
    stay = verdicts(rows).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("keep"), F.col("digest").alias("keep_digest")).distinct()
    marked = packed(docs, F.col("doc_id").cast("bigint").alias("id"), digest_of("text").alias("digest"))
    same = marked["id"].eqNullSafe(F.col("keep")) & (marked["digest"] == F.col("keep_digest"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
