"""Token ids in Arrow's file format: fixed-size lists of ids and of mask bits, for zero-copy access to any sequence.

The documents are dealt by ranges of doc_id and sorted, so files in order of their numbers hold the documents in order
of doc_id. A file is a run of record batches with two fixed-size-list columns: `ids` (uint16 where the vocabulary
allows, else uint32) and `mask` (bits; false only for what pads a file's last sequence). Documents follow each other
without a gap, each closed by the end id, and run on from one sequence into the next. A second file, `.idx`, holds
doc_id and id count of each document. Files are written under a name of the attempt and then moved, so a task that is
run again leaves one file.

Null and empty texts hold the end id only. Null doc_ids come first. Equal doc_ids keep one order within a file by their
text. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosespark.llm.bpe import Splitter, byte_symbols
from prosespark.llm.common import Memory, materialize, release, scratch_path, text_slices

END_ID, LENGTH, BATCH = 2, 2048, 64
#: Bytes that a worker's memory of pieces may take, about; longer ones than KEPT aren't remembered; bytes of text encoded
#: at a time.
MEMORY_BYTES, KEPT, STEP = 72 << 20, 64, 2 << 20
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class LibraryEncoder:
    """The tokenizers library, asked once for each different piece that the memory holds.

    The file's pre-tokenizer drops white space and never joins across it, so a text's ids are those of its pieces in
    turn. Texts of plain letters (the library was asked what it makes of each) are cut into pieces here, and the library's
    model gives a piece's ids; in other texts each word goes through the library whole, from normaliser to model. So do
    whole texts with special tokens, and all texts where the file is made otherwise.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            splitter = Splitter(json.load(f), self.library)
        self.special, self.plain, self.find = list(splitter.special), splitter.plain if splitter.usual else None, splitter.find
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.symbols = byte_symbols()
        self.memory = Memory(MEMORY_BYTES, KEPT)

    def _asked(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> Iterator[tuple[str, bytes, int]]:
        """A piece of plain letters is asked of the model; a word, known by a space before it, of all the library."""
        words = [p[1:] for p in pieces if p[0] == " "]
        whole = dict(zip(words, self._asked(words), strict=True))
        tokenize, symbols, code = self.library.model.tokenize, self.symbols, self.code
        for p in pieces:
            ids = whole[p[1:]] if p[0] == " " else array(code, [x.id for x in tokenize(p if p.isascii() and p.isprintable() else "".join([symbols[x] for x in p.encode()]))]).tobytes()
            yield p, ids, 200 + len(p) + len(ids)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in machine order; texts together should be of some MB at most."""
        cut = [self._pieces(t) for t in texts]
        memory = self.memory.find(set().union(*[own for own in cut if own is not None]), self._learn)
        for t, own in zip(texts, cut, strict=True):
            yield b"".join(map(memory.__getitem__, own)) if own is not None else self._asked([t])[0]

    def _pieces(self, text: str) -> list[str] | None:
        """The pieces of a text of plain letters; else, of a file of the usual kind, what white space parts; else None."""
        if not self.plain or ("<" in text and any(x in text for x in self.special)):
            return None
        return self.find(text.lower()) if self.plain(text) else [" " + w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]

    def encode(self, text: str) -> bytes:
        """The ids of one text in machine order."""
        return next(self.encode_all([text]))


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or of a plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class SequenceWriter:
    """Cuts a stream of ids into sequences of one length and writes them in batches."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int):
        self.dtype, self.length, self.rest, self.size = dtype, length, [], 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.size += len(ids)
        if self.size >= self.length * BATCH * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), self.dtype)
        keep = ids.size if last else ids.size - ids.size % (self.length * BATCH)  # all batches but the last are full
        rows = -(-keep // self.length)
        grid, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
        grid[:keep], mask[:keep] = ids[:keep], True
        for a in range(0, rows, BATCH):
            cut = slice(a * self.length, min(rows, a + BATCH) * self.length)
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(grid[cut]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), self.length)], schema=self.schema))
        self.rest = [ids[keep:].tobytes()]
        self.size = len(self.rest[0])

    def close(self) -> None:
        self._flush(True)
        self.out.close()


def write_files(docs: DataFrame, path: str, out: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids under out; returns a row a file: part, rows, n_ids."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs_path = TaskContext.get().partitionId(), open_fs(out)
        fs, base = fs_path
        encoder = library_encoder(path)
        dtype = np.dtype("uint16" if encoder.code == "H" else "uint32")
        end = np.array([end_id], dtype).tobytes()
        fs.create_dir(base, recursive=True)
        name, mine = f"{base}/part-{part:06d}", f".{uuid.uuid4().hex}"
        rows = total = 0
        try:
            with fs.open_output_stream(f"{name}.arrow{mine}") as sink, fs.open_output_stream(f"{name}.idx{mine}") as index_sink:
                writer = SequenceWriter(sink, dtype, length)
                schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(index_sink, schema)
                for b in batches:
                    sizes: list[int] = []
                    for _, _, texts in text_slices(b.column(1), STEP):
                        for ids in encoder.encode_all(texts):
                            sizes.append(len(ids) // dtype.itemsize + 1)
                            writer.add(ids + end)
                    index.write_batch(pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], schema=schema))
                    rows, total = rows + len(sizes), total + sum(sizes)
                writer.close()
                index.close()
        finally:
            encoder.memory.forget()
            release()
        for kind in ("arrow", "idx"):
            fs.move(f"{name}.{kind}{mine}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([total], pa.int64())], ["part", "rows", "n_ids"])

    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "part int, rows bigint, n_ids bigint"), "token-files")


class TokenFile:
    """A file of sequences, mapped into memory where its file system is local."""

    def __init__(self, out: str, part: int):
        fs, base = open_fs(out)
        name = f"{base}/part-{part:06d}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow"))
        self.index = pa.ipc.open_file(pa.memory_map(f"{name}.idx") if local else fs.open_input_file(f"{name}.idx"))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file's memory) and mask of sequence i; IndexError beyond the last."""
        if not 0 <= i // BATCH < self.file.num_record_batches:
            raise IndexError(i)
        b = self.file.get_batch(i // BATCH)
        if i % BATCH >= b.num_rows:
            raise IndexError(i)
        k, n = i % BATCH, b.schema.field("ids").type.list_size
        return b.column(0).values.to_numpy(zero_copy_only=True)[(b.column(0).offset + k) * n :][:n], b.column(1).values.to_numpy(zero_copy_only=False)[k * n : k * n + n]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document, holding a few batches at a time."""
        at, held = 0, np.zeros(0, np.uint16)
        for j in range(self.index.num_record_batches):
            b = self.index.get_batch(j)
            for doc_id, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts, size = [held], held.size
                while size < n:
                    x = self.file.get_batch(at)
                    at += 1
                    ids, mask = x.column(0).values.to_numpy(zero_copy_only=True), x.column(1).values
                    ids = ids if mask.true_count == len(mask) else ids[mask.to_numpy(zero_copy_only=False)]
                    parts.append(ids)
                    size += ids.size
                ids = np.concatenate(parts) if size > held.size else held
                held = ids[n:]
                yield doc_id, ids[:n]


def read_back(files: DataFrame, out: str) -> DataFrame:
    """A row a document, read from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in TokenFile(out, part).documents():
                    rows.append((doc_id, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += ids.size
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    offsets = files.where("rows > 0").withColumn("start", before).select("part", "start")
    return offsets.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op9(docs: DataFrame, path: str) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    assert sys.byteorder == "little"
    out = scratch_path(docs.sparkSession, "token-stream")
    return read_back(write_files(docs, path, out), out)
