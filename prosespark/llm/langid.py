"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A document is parsed against it
from left to right into longest matches: a phrase ends where the automaton has no further arc. The fewer phrases a
language needs per character, each weighed by the bits that name a place in its sample, the lower its cross entropy;
the lowest wins, equal ones by name. Texts are parsed whole: pieces of PIECE characters are first parsed side by side as
if each began a phrase, then the phrase left open before each piece is carried into it until both parses are in one
state, from where they are the same. So the counts are those of one parse from the first character on.

Each language has codes of its own for the LETTERS most frequent letters of its sample; the others share one. Null or
letterless texts give `und` with score 0; so does an empty set of labelled rows. Repeated rows give repeated results; of
labelled rows with one doc_id that with the least hash of its text teaches; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import fold_of, letter_table, sampled, text_slices

#: Labelled rows a language, characters of their whole texts at most, and the same of all languages together. A first
#: text that is longer is taken alone, up to the limit, so that no language goes without.
ROWS_PER_LANG, CHARS_PER_LANG, CHARS_IN_ALL = 200, 40_000, 800_000
LETTERS, PIECE, SEED = 62, 1024, 11
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def alphabet(texts: list[str]) -> str:
    """The most frequent lower-case letters of the samples."""
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    return "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])


class Coder:
    """Text to small codes: 0 for a run of anything but letters, 1.. for known letters, one more for other letters."""

    def __init__(self, letters: str):
        self.size = len(letters) + 2
        self.table = letter_table({c: i + 1 for i, c in enumerate(letters)}, self.size - 1, 0)

    def __call__(self, text: str) -> np.ndarray:
        codes = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if codes.size:
            codes = codes[(codes != 0) | np.concatenate([[False], codes[:-1] != 0])]
        return codes


def suffix_automaton(codes: np.ndarray, size: int) -> np.ndarray:
    """Arcs of the suffix automaton, a row a state, -1 where there is none; state 0 is the start."""
    arcs, link, length = [{}], [-1], [0]
    last = 0
    for c in codes.tolist():
        cur = len(arcs)
        arcs.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p != -1:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and arcs[p].get(c) == q:
                    arcs[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    out = np.full((len(arcs), size), -1, np.int32)
    for s, row in enumerate(arcs):
        for c, t in row.items():
            out[s, c] = t
    return out


#: Table entries hold, above this bit, how many phrases their step ends: the open one, and one of an unknown letter.
COUNT_BIT = 28


class CrossParser:
    """The parsing tables of all languages, one after another."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        own = [alphabet([samples[x]]) for x in self.langs]
        self.coder = Coder("".join(sorted(set("".join(own)))))
        size = self.size = LETTERS + 2
        # the codes of all languages' letters in each language
        self.codes = np.full((len(own), self.coder.size), size - 1, np.int32)
        self.codes[:, 0] = 0
        every = {c: i + 1 for i, c in enumerate(sorted(set("".join(own))))}
        tables, self.starts, self.bits, base = [], [], [], 0
        for k, (lang, letters) in enumerate(zip(self.langs, own, strict=True)):
            for i, c in enumerate(letters):
                self.codes[k, every[c]] = i + 1
            codes = self.codes[k][self.coder(samples[lang])]
            arcs = suffix_automaton(codes, size)
            known = arcs[0] >= 0
            again = (np.where(known, arcs[0], 0) + base) | (np.where(known, 1, 2) << COUNT_BIT)
            rows = np.where(arcs >= 0, arcs + base, again)
            rows[0] = np.where(known, arcs[0] + base, base | (1 << COUNT_BIT))  # no phrase is open here
            tables.append(rows)
            self.starts.append(base)
            self.bits.append(math.log2(max(2, codes.size)))
            base += len(arcs)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)

    def _step(self, state: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        step = self.table.take(state * self.size + self.codes[:, codes])
        ends += step >> COUNT_BIT
        return step & ((1 << COUNT_BIT) - 1)

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each coded text in each language."""
        n = len(self.langs)
        out = np.zeros((len(docs), n), np.int64)
        pieces = [(i, a, d[a : a + PIECE]) for i, d in enumerate(docs) for a in range(0, d.size, PIECE)]
        if not pieces or not n:
            return out
        pieces.sort(key=lambda x: -x[2].size)
        sizes = np.array([p.size for _, _, p in pieces])
        place = {(i, a): k for k, (i, a, _) in enumerate(pieces)}
        before = np.array([place.get((i, a - PIECE), -1) for i, a, _ in pieces])
        after = np.array([place.get((i, a + PIECE), -1) for i, a, _ in pieces])
        grid = np.zeros((sizes[0], len(pieces)), np.uint16)
        for k, (_, _, p) in enumerate(pieces):
            grid[: p.size, k] = p
        start = np.array(self.starts, np.int32)[:, None]
        fresh = np.repeat(start, len(pieces), 1)
        ends = np.zeros((n, len(pieces)), np.int32)
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for j in range(sizes[0]):
            live = alive[j]
            fresh[:, :live] = self._step(fresh[:, :live], grid[j, :live], ends[:, :live])
        last, more = fresh.copy(), np.zeros_like(ends)
        asked = np.flatnonzero(before >= 0)
        while asked.size:  # pieces whose beginning state is another than the last time
            carried, own = last[:, before[asked]], np.repeat(start, asked.size, 1)
            a, b = np.zeros_like(carried), np.zeros_like(carried)
            for j in range(sizes[asked[0]]):
                live = int(np.searchsorted(-sizes[asked], -j, side="left"))
                some = grid[j, asked[:live]]
                carried[:, :live] = self._step(carried[:, :live], some, a[:, :live])
                own[:, :live] = self._step(own[:, :live], some, b[:, :live])
                if (carried[:, :live] == own[:, :live]).all():
                    break
            more[:, asked] = a - b
            now = np.where(carried == own, fresh[:, asked], carried)
            moved = (now != last[:, asked]).any(axis=0)
            last[:, asked] = now
            asked = np.sort(after[asked[moved]])
            asked = asked[asked >= 0]
        total = ends + more + ((last != start) & (after < 0))
        owner = np.array([i for i, _, _ in pieces])
        for k in range(n):
            out[:, k] = np.bincount(owner, total[k], minlength=len(docs))
        return out

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        docs = [self.coder(t) for t in texts]
        out: list[tuple[str, float]] = []
        for d, row in zip(docs, self.phrases(docs), strict=True):
            if not d.any() or not self.langs:
                out.append(("und", 0.0))
                continue
            costs = [float(x) * b for x, b in zip(row, self.bits, strict=True)]
            best = min(range(len(costs)), key=lambda k: costs[k])
            rest = min((c for k, c in enumerate(costs) if k != best), default=None)
            out.append((self.langs[best], 1.0 if rest is None else max(0.0, min(1.0, 1 - costs[best] / rest))))
        return out


_PARSERS: dict[int, CrossParser] = {}


def parser_of(samples: dict[str, str]) -> CrossParser:
    """The worker's parser for these samples, built once."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def learn(docs: DataFrame) -> dict[str, str]:
    """Sample text by language from rows of docs whose lang is not null, bounded by the constants above."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    picked, counts = sampled(rows, "lang", ROWS_PER_LANG, SEED)
    if not counts:
        return {}
    room = min(CHARS_PER_LANG, CHARS_IN_ALL // len(counts))
    # a row of the most that can be used of each text: longer ones are passed over, or cut where they come first
    got: dict[str, dict[int, tuple]] = {x: {} for x in counts}
    for r in picked.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(SEED)).alias("h"), F.xxhash64("text").alias("th"), F.char_length("text").alias("n"), F.substring("text", 1, room).alias("t")).collect():
        best = got[r["lang"]].get(r["doc_id"])
        mine = (r["h"], r["doc_id"], r["th"], r["n"], r["t"])
        got[r["lang"]][r["doc_id"]] = mine if best is None else min(best, mine)
    out = {}
    for lang, texts in got.items():
        taken, left = [], room
        for *_, n, t in sorted(texts.values())[:ROWS_PER_LANG]:
            if n + 1 <= left or not taken:
                taken.append(t)
                left -= n + 1
        if taken:
            out[lang] = " ".join(taken)
    return out


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for b in batches:
            judged: list[tuple[str, float]] = []
            for _, _, texts in text_slices(b.column(1), 1 << 21):
                judged += parser.judge(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in judged], pa.string()), pa.array([x for _, x in judged], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op1(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 5 is not 0, judge all; a null doc_id is never learned from or held out."""
    samples = learn(docs.where(fold_of("doc_id", 5) != 0))
    return identify(docs, samples).select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
