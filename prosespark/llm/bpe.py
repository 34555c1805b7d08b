"""Byte-pair encoding by a tokenization automaton, and decoding from its arc labels.

The merge list is compiled into one deterministic automaton over token labels. It starts as a single state with an arc
for every base symbol. The gadget of merge (a, b) then (1) gives every state with an a-arc an arc labelled ab, which
leads where the b-arcs of the moment lead, and (2) redirects the a-arcs to a copy of their target without its b-arc.
So all arcs with a label lead to one state, and a token sequence is the tokenization of its text just if the automaton
runs through it. Copies are kept as versions: a state is the state it was copied from, at that time, and what gadgets
have cut since. Compiling gives four tables: the gadget that made a label, the two labels it joined, the cut arcs with
the gadget that cut them, and the labels by their bytes as a trie. A transition is read from these tables, for many
words at once; nothing else is remembered about it.

A word is encoded from left to right: of the tokens that end at a place just one can be reached by arcs, so each
place holds one label, and the labels are read back from the end. Decoding writes the arcs' labels.

Texts of ASCII and of letters that the library's normaliser and pre-tokenizer treat as plain ones (each was asked for)
are split by one pattern; all else is cut at [\\x20\\x09-\\x0D], which the pre-tokenizer drops and never joins across, and
normalised and split by the library's own normaliser and pre-tokenizer. Results of the words seen last stay in a memory
of MEMORY_BYTES a worker, given back when a task ends.

Null and empty texts have no tokens. Texts are encoded whole. Repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import Memory, release, text_slices

#: Bytes that a worker's memory of words may take, about; longer words than KEPT aren't remembered, and pieces of more
#: bytes than LONG are walked one by one.
MEMORY_BYTES, KEPT, LONG = 56 << 20, 64, 48
#: Bytes of text that are split at a time, and the first character that is always left to the library to split.
STEP, PLAIN = 1 << 20, 0x530
#: Fixed value: the pre-tokenizer's pattern that `find` stands for among plain letters.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
NEVER = np.int32(1 << 30)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(x) if x in plain else chr(next(spare)) for x in range(256)]


class Table:
    """Whole numbers by whole numbers, with open addressing, read for many keys at once; `none` where a key is missing."""

    def __init__(self, entries: dict[int, int], none: int):
        bits = max(4, (4 * len(entries)).bit_length())
        self.shift, self.mask, self.none = np.uint64(64 - bits), np.int64((1 << bits) - 1), none
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, none, np.int32)
        key, value = np.fromiter(entries.keys(), np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries))
        at = self._place(key)
        while key.size:
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            own = np.zeros(key.size, bool)
            own[first] = True
            own &= free
            self.keys[at[own]], self.values[at[own]] = key[own], value[own]
            key, value, at = key[~own], value[~own], (at[~own] + 1) & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _GOLD) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        at = self._place(key)
        found = self.keys.take(at)
        out = self.values.take(at)
        miss = np.flatnonzero((found != key) & (found >= 0))
        while miss.size:
            at[miss] = (at[miss] + 1) & self.mask
            found = self.keys[at[miss]]
            same = found == key[miss]
            out[miss] = np.where(same, self.values[at[miss]], self.none)
            miss = miss[~same & (found >= 0)]
        return out

    def one(self, key: int) -> int:
        at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while True:
            found = self.keys.item(at)
            if found == key:
                return self.values.item(at)
            if found < 0:
                return self.none
            at = (at + 1) & int(self.mask)


class MergeAutomaton:
    """Arcs between tokens, compiled from merges in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = size = max(vocab.values(), default=-1) + 1
        self.born = np.full(size, -1, np.int32)  # the rank of the gadget that made a label; -1 for base symbols
        self.left, self.copied = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        cut: dict[int, int] = {}  # (state, label) -> rank of the gadget that cut the arc
        for rank, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], rank, cut)
        self.cut = Table(cut, int(NEVER))
        self.twins = (self.left == self.copied) & (self.born >= 0)

    def _gadget(self, a: int, b: int, ab: int, rank: int, cut: dict[int, int]) -> None:
        cut.setdefault(a * self.size + b, rank)
        if self.born[ab] < 0 and ab not in (a, b):
            self.born[ab], self.left[ab], self.copied[ab] = rank, a, b

    def arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the state that each label of `state` leads to has an arc `label`."""
        out = np.ones(state.size, bool)
        at = np.arange(state.size)
        rank = np.full(state.size, NEVER, np.int32)
        while at.size:
            dead = self.cut.get(state.astype(np.int64) * self.size + label) < rank
            s, x = self.born.take(state), self.born.take(label)
            by_label = x >= s
            # the gadget of (a, a) gives no arc to the copy that it cuts
            dead |= by_label & self.twins.take(label) & (self.left.take(label) == state)
            out[at[dead]] = False
            go = np.flatnonzero(~dead & ((x >= 0) | (s >= 0)))
            at, by_label, s, x, state, label = at[go], by_label[go], s[go], x[go], state[go], label[go]
            rank = np.where(by_label, x, s)
            state, label = np.where(by_label, state, self.copied.take(state)), np.where(by_label, self.left.take(label), label)
        return out

    def arc(self, state: int, label: int) -> bool:
        """As arcs, for one pair."""
        rank, born, size = int(NEVER), self.born, self.size
        while True:
            if self.cut.one(state * size + label) < rank:
                return False
            s, x = born.item(state), born.item(label)
            if x < 0 and s < 0:
                return True
            if x >= s:
                if self.twins.item(label) and self.left.item(label) == state:
                    return False
                rank, label = x, self.left.item(label)
            else:
                rank, state = s, self.copied.item(state)


class Splitter:
    """The pieces of texts as the library's special tokens, normaliser and pre-tokenizer make them."""

    def __init__(self, spec: dict, library: Any):
        self.normalise, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.byte_of = {c: x for x, c in enumerate(byte_symbols())}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.usual = split["pattern"].get("Regex") == USUAL and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._plain()

    def _plain(self) -> None:
        """The letters beyond ASCII of which the library's normaliser and pre-tokenizer make what str.lower and a letter
        class make of them, wherever they stand; found by asking the library of each of them."""
        letters = ""
        for x in range(0x80, PLAIN):
            c = chr(x)
            low, around = c.lower(), (c, "a" + c, "a" + c + "a")
            if len(low) == 1 and all(self.normalise(t) == t.lower() and len(self.presplit(t.lower())) == 1 for t in around) and self.presplit("a1" + c)[-1][0] != "1":
                letters += c + low
        letters = "".join(sorted({c for c in letters if len(self.presplit("a" + c)) == 1}))
        self.plain = re.compile(f"[\\t-\\r -~{letters}]*").fullmatch
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9]|[^\\sa-z0-9{letters}]+").findall

    def split(self, text: str) -> list[str]:
        """The pieces of a text in order; special tokens with a space before them, which no piece holds."""
        if "<" not in text or not any(x in text for x in self.special):
            if self.usual and self.plain(text):
                return self.find(text.lower())
            return [p for w in text.encode("utf-8", "replace").split() for p in self.cut(w.decode("utf-8", "replace"))]
        out: list[str] = []
        for k, part in enumerate(self.cut_special.split(text)):
            out += [" " + part] if k % 2 else self.split(part) if part else []
        return out

    def cut(self, word: str) -> list[str]:
        """The pieces of what stands between white space and special tokens."""
        if self.usual and self.plain(word):
            return self.find(word.lower())
        of = self.byte_of
        return [bytes([of[c] for c in p]).decode("utf-8", "replace") for p, _ in self.presplit(self.normalise(word))]


class Encoder:
    """Encodes and decodes as the tokenizers library does with a word-level byte BPE file, without post-processing."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, library = spec["model"], Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.splitter = Splitter(spec, library)
        self.split, self.special, self.byte_of = self.splitter.split, self.splitter.special, self.splitter.byte_of
        self.end: str = model["end_of_word_suffix"] or ""
        self.automaton = MergeAutomaton(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.labels = [names.get(i) for i in range(max(names, default=-1) + 1)]
        self.digits = [b"%d" % i for i in range(len(self.labels))]
        self.names = [(x or "").encode("utf-8", "replace") for x in self.labels]
        self._trie(vocab)
        self.memory = Memory(MEMORY_BYTES, KEPT)

    def _trie(self, vocab: dict[str, int]) -> None:
        """Nodes by (node, byte); at each node the label that ends there inside a word, and at a word's end."""
        steps: dict[int, int] = {}
        inside, final, self.longest = [-1], [-1], 0
        for t, i in vocab.items():
            ends = bool(self.end) and t.endswith(self.end)
            bare = t.removesuffix(self.end) if ends else t
            if not bare or (self.automaton.born[i] < 0 and len(bare) > 1) or any(c not in self.byte_of for c in bare):
                continue
            node = 0
            for c in bare:
                key = node * 256 + self.byte_of[c]
                node = steps.setdefault(key, len(inside))
                if node == len(inside):
                    inside.append(-1)
                    final.append(-1)
            if not self.end:
                inside[node] = final[node] = i
            elif ends:
                final[node] = i
            else:
                inside[node] = i
            self.longest = max(self.longest, len(bare))
        self.steps = Table(steps, -1)
        self.inside, self.final = np.array(inside, np.int32), np.array(final, np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The labels of each pre-split word."""
        out: list[list[int]] = [[]] * len(pieces)
        short = [k for k, p in enumerate(pieces) if 0 < len(p) <= LONG]
        for k, p in enumerate(pieces):
            if len(p) > LONG:
                out[k] = self._long(p)
        for a in range(0, len(short), 1 << 15):
            some = short[a : a + (1 << 15)]
            for k, got in zip(some, self._walk([pieces[k] for k in some]), strict=True):
                out[k] = got
        return out

    def _walk(self, pieces: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(p) for p in pieces])
        buffer = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        last = np.repeat(np.cumsum(sizes), sizes)  # of each byte, where its piece ends
        place = np.arange(buffer.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # every label that may lie at each place
        starts, ends, labels = [], [], []
        at, node = np.arange(buffer.size), np.zeros(buffer.size, np.int64)
        for d in range(self.longest):
            node = self.steps.get(node * 256 + buffer[at + d]).astype(np.int64)
            live = node >= 0
            at, node = at[live], node[live]
            if not at.size:
                break
            whole = at + d + 1 == last[at]
            label = np.where(whole, self.final.take(node), self.inside.take(node))
            hit = label >= 0
            starts.append(at[hit])
            ends.append(at[hit] + d + 1)
            labels.append(label[hit])
            at, node = at[~whole], node[~whole]
        start, end, label = np.concatenate(starts), np.concatenate(ends), np.concatenate(labels)
        column = place[start].astype(np.uint8)
        order = np.argsort(column, kind="stable")
        start, end, label = start[order], end[order], label[order]
        cuts = np.searchsorted(column[order], np.arange(int(sizes.max(initial=0)) + 1))
        # one label and its beginning for the end of each byte
        held, back = np.full(buffer.size, -1, np.int32), np.zeros(buffer.size, np.int64)
        for j in range(len(cuts) - 1):
            s, e, x = start[cuts[j] : cuts[j + 1]], end[cuts[j] : cuts[j + 1]], label[cuts[j] : cuts[j + 1]]
            if j:
                before = held[s - 1]
                ok = before >= 0
                s, e, x, before = s[ok], e[ok], x[ok], before[ok]
                ok = self.automaton.arcs(before, x)
                s, e, x = s[ok], e[ok], x[ok]
            held[e - 1], back[e - 1] = x, s
        # read back from all ends, a label a round
        first = np.cumsum(sizes) - sizes
        here, owner, rounds = np.cumsum(sizes) - 1, np.arange(len(pieces)), []
        while here.size:
            if (held[here] < 0).any():
                raise ValueError("the vocabulary has no symbols for a piece")
            rounds.append((owner, held[here]))
            nxt = back[here]
            more = nxt > first[owner]
            here, owner = nxt[more] - 1, owner[more]
        owner, got = (np.concatenate(x[::-1]) for x in zip(*rounds, strict=True))
        order = np.argsort(owner, kind="stable")
        flat = got[order].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _long(self, piece: bytes) -> list[int]:
        """As _walk, for one long piece: a label a place, read back from the end."""
        n, arc, step = len(piece), self.automaton.arc, self.steps.one
        held, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int64)
        known: dict[int, bool] = {}
        for j in range(n):
            before = held.item(j)
            if j and before < 0:
                continue
            node = 0
            for i in range(j, min(n, j + self.longest)):
                node = step(node * 256 + piece[i])
                if node < 0:
                    break
                label = (self.final if i + 1 == n else self.inside).item(node)
                if label >= 0 and held.item(i + 1) < 0:
                    if j:
                        key = before * self.automaton.size + label
                        live = known.get(key)
                        if live is None:
                            if len(known) > 20_000:
                                known.clear()
                            live = known[key] = arc(before, label)
                    if not j or live:
                        held[i + 1], back[i + 1] = label, j
        out, i = [], n
        while i > 0:
            if held.item(i) < 0:
                raise ValueError("the vocabulary has no symbols for a piece")
            out.append(held.item(i))
            i = back.item(i)
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        got = iter(self.encode_pieces([p.encode("utf-8", "replace") for p in pieces if p[0] != " "]))
        return [[self.special[p[1:]]] if p[0] == " " else next(got) for p in pieces]

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        distinct = list(set(pieces))
        by = dict(zip(distinct, self.ids_of(distinct), strict=True))
        return [i for p in pieces for i in by[p]]

    def decode(self, ids: Iterable[int]) -> str:
        """The arcs' labels, as the library joins them when the file names no decoder."""
        return " ".join([x for i in ids if 0 <= i < len(self.labels) and (x := self.labels[i]) is not None])

    def _learn(self, pieces: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes], int]]:
        digits, names = self.digits, self.names
        for p, ids in zip(pieces, self.ids_of(pieces), strict=True):
            entry = (b" ".join([digits[i] for i in ids]), b" ".join([names[i] for i in ids]))
            yield p, entry, 300 + len(p) + len(entry[0]) + len(entry[1])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Token count, and SHA-256 of the ids and of the decoded text, of each text."""
        cut = [self.split(t) for t in texts]
        memory = self.memory.find(set().union(*cut), self._learn)
        out = []
        for own in cut:
            got = [*map(memory.__getitem__, own)]
            line = b" ".join([x for x, _ in got])
            out.append((line.count(b" ") + 1 if line else 0, hashlib.sha256(line).hexdigest(), hashlib.sha256(b" ".join([x for _, x in got])).hexdigest()))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, compiled once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def op3(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        try:
            for b in batches:
                for i, k, texts in text_slices(b.column(1), STEP):
                    got = e.digests(texts)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k - i), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            e.memory.forget()
            release()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
