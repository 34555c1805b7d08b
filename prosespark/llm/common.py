"""Shared pieces: the cluster's shared folder, bounded labelled samples, Arrow batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer text makes a step of its own.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, where none is set, a local one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="prosespark-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Paths that this process made in the shared folder.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables and files made so far; results that weren't written yet can't be computed afterwards."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """`row`, which holds all columns of docs, and more columns, whose names can't clash with those in it."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *more)


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % F.lit(folds)


#: Labels that a sample holds at most, the most frequent ones.
LABELS = 400


def sampled(rows: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """About per_class rows of each label, by a seeded hash of doc_id, and the row count of each label.

    The expected sample is 1.1 * per_class rows a label however long the table is; callers cut what they collect to
    per_class at most. Only the LABELS most frequent labels are sampled, equal ones by name.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(LABELS).collect()}
    if not counts:
        return rows.limit(0), counts
    span = 1 << 30
    shares = rows.sparkSession.createDataFrame([(k, min(span, int(span * 1.1 * per_class / n) + 1)) for k, n in counts.items()], f"own_label {dict(rows.dtypes)[label]}, own_share bigint")
    inside = (rows[label] == F.col("own_label")) & (F.pmod(F.xxhash64(rows["doc_id"], F.lit(seed)), F.lit(span)) < F.col("own_share"))
    return rows.join(F.broadcast(shares), inside).select(*[rows[c] for c in rows.columns]), counts


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int, seed: int) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """(doc_id, whole text, label) of a bounded sample of documents with label 0 or 1, and the rows of each label.

    per_class rows of each label at most, in the order of a seeded hash of doc_id; a text that would take a label's
    share of `chars` characters beyond half of them is passed over. Documents with conflicting labels are left out, and of
    rows with one doc_id that with the least hash of its text is taken.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).where("label = most").select("doc_id", "label")
    picked, counts = sampled(marks, "label", per_class, seed)
    # some 1.1 * per_class rows a class by construction, so the broadcast is bounded
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id")
    sizes = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.char_length("text").alias("n"))).alias("t")).select("doc_id", "label", "t.h", "t.n", F.xxhash64("doc_id", F.lit(seed)).alias("turn")).collect()
    taken, held, room = [], {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r["turn"], r["doc_id"])):
        if held[r["label"]] < per_class and room[r["label"]] + r["n"] <= chars // 2:
            held[r["label"]] += 1
            room[r["label"]] += r["n"]
            taken.append((r["doc_id"], r["h"]))
    if not taken:
        return [], counts
    chosen = docs.sparkSession.createDataFrame(taken, "d bigint, h bigint")
    texts = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("h")))
    got = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r["doc_id"], r["text"], r["label"]) for r in got), counts


@functools.cache
def _lower_letters() -> np.ndarray:
    """The first lower-case code point of each letter, -1 for what is none."""
    out = np.full(0x110000, -1, np.int32)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            out[x] = ord(c.lower()[0])
    return out


def letter_table(codes: dict[str, int], rest: int, other: int) -> np.ndarray:
    """The code of each code point: that of its lower-case letter, `rest` for other letters, `other` for what is none."""
    lower = _lower_letters()
    of = np.full(0x110000, rest, np.uint16)
    for c, k in codes.items():
        of[ord(c)] = k
    return np.where(lower < 0, np.uint16(other), of[lower])


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs whose sizes sum to limit at most, or that hold one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """First row, row after the last, and texts (empty for null) of runs of rows that hold `limit` bytes at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, k in slices(sizes, limit):
        yield i, k, [t or "" for t in column.slice(i, k - i).to_pylist()]


class Memory:
    """What a worker remembers by key, in two generations of half the bytes each: what isn't asked for again goes first."""

    def __init__(self, limit: int, longest: int):
        self.limit, self.longest = limit, longest
        self.forget()

    def forget(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def find(self, wanted: set, learn: Callable[[list], Iterable[tuple[Any, Any, int]]]) -> dict:
        """A dict that holds every wanted key; `learn` gives key, value and bytes of those that aren't remembered."""
        if self.held > self.limit // 2:
            self.young, self.old, self.held = {}, self.young, 0
        young, old, brief, new = self.young, self.old, {}, []
        for k in wanted - young.keys():
            if (kept := old.get(k)) is not None:
                young[k] = kept
                self.held += 250 + 2 * len(k)
            else:
                new.append(k)
        for k, value, size in learn(new) if new else ():
            if len(k) <= self.longest:
                young[k] = value
                self.held += size
            else:
                brief[k] = value
        return young | brief if brief else young


def release() -> None:
    """Give back what a finished task held: idle workers of an executor keep their memory otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
