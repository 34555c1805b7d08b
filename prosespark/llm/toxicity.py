"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A sentence is compared by its windows: each word, neighbouring words of up to PHRASE letters together (three at most,
more where they have JOINED letters together or are single letters). What is no letter is left out (`i.d-iot`), and so
are the breaks inside a window (`i d iot`, `sc um`), so that insults cut by marks or white space and insults of several
words are compared whole. The kernel of two windows counts the subsequences of ORDER letters that they share, gaps
allowed within SPAN letters, each weighed by DECAY to the power of the span it covers in either, with marks for their
ends, and is scaled by the root of the summed squares of the weights in each (its own kernel, where no subsequence comes
twice). Inserted letters leave most subsequences standing.

Training: labelled sentences enter as bags of windows. In each toxic document the window that tells it apart best is its
witness; so is any that comes in too many toxic and no clean documents for chance. Witnesses, and copies of them with a
letter inserted, stand against windows of clean documents, first by frequency, then also those the machine finds worst;
the machine is fitted, witnesses are chosen anew, and again. Windows are mapped by K(x, L) K(L, L)^(-1/2) for LANDMARKS
windows L, where a linear machine with squared hinge loss is fitted by Newton steps. A document's margin is that of its
worst window, over all sentences; Platt's method turns it into a probability. For scoring, machine and map fold into
one weight a subsequence, which gives the same decision; nothing is remembered between batches.

Null, empty and letterless texts have the margin of a window without subsequences. Without labels of both kinds the
score is 0. Documents whose labels conflict teach nothing; of repeated doc_ids one row teaches. Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import fold_of, labelled, letter_table, mix64, release, slices, text_slices
from prosespark.llm.quality import platt, sigmoid

ORDER, SPAN, DECAY, LANDMARKS, LETTERS = 4, 6, 0.75, 320, 40
#: Labelled rows a class that training sees, whole, and characters that they hold together at most.
ROWS_PER_CLASS, CHARS_IN_ALL, SEED, THRESHOLD = 800, 8_000_000, 31, 0.3
#: Letters of windows of several words: any number, and up to three, of them.
JOINED, PHRASE = 12, 20
SIZE = LETTERS + 4  # 0 parts words; then letters, other letters, and the two marks
HEAD, TAIL = LETTERS + 2, LETTERS + 3
PATTERNS = [(a, a + b, a + b + c) for a in range(1, SPAN) for b in range(1, SPAN) for c in range(1, SPAN) if a + b + c < SPAN]
#: Fits with witnesses chosen anew; bytes of text scored at a time.
TURNS, STEP = 3, 1 << 19
SCHEMA = "doc_id bigint, score double, predicted int"


class Coder:
    """Text to bytes: 0 between words, a code for each letter; what is neither is left out."""

    def __init__(self, letters: str):
        known = {c: i + 1 for i, c in enumerate(letters)}
        self.table = letter_table(known, LETTERS + 1, 255).astype(np.uint8)
        self.table[[x for x in range(0x3001) if chr(x).isspace()]] = 0

    def codes(self, text: str) -> np.ndarray:
        codes = self.table.take(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
        return codes[codes != 255]

    def words(self, text: str) -> set[bytes]:
        """The distinct windows of a text."""
        letters, start, size, _ = windows([self.codes(text)])
        flat = letters.tobytes()
        return {flat[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)}


def spans(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All letters of coded texts without breaks, where each word begins in them (and their end), and for each window its
    first word, the word after its last, and its text."""
    sizes = np.array([x.size for x in texts])
    codes = np.concatenate([np.append(x, np.uint8(0)) for x in texts]) if texts else np.zeros(0, np.uint8)
    of_text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    inside = codes > 0
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    letters = codes[inside]
    before = np.cumsum(inside) - inside  # letters before each place
    bound = np.append(before[begins], letters.size)
    text = of_text[begins]
    at = np.arange(begins.size)
    first, last = [at], [at + 1]
    for k in range(2, PHRASE + 1):
        at = at[at + k <= begins.size]
        at = at[text[at] == text[at + k - 1]]
        n = bound[at + k] - bound[at]
        fits = n <= PHRASE
        at, n = at[fits], n[fits]
        if not at.size:
            break
        wanted = at[(n <= JOINED) | (k <= 3) | (n == k)]
        first.append(wanted)
        last.append(wanted + k)
    first = np.concatenate(first)
    return letters, bound, first, np.concatenate(last), text[first] if first.size else np.zeros(0, np.int32)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All letters of coded texts without breaks, and the first letter, length and text of each window, words first."""
    letters, bound, first, last, own = spans(texts)
    return letters, bound[first], bound[last] - bound[first], own


def _entries(buffer: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each pattern of gaps: its span, the subsequences at all places, and whether each lies in one word."""
    for c in sorted({c for _, _, c in PATTERNS}):
        n = buffer.size - c
        if n > 0:
            inner = owner[:n] == owner[c:]
            for a, b, _ in (p for p in PATTERNS if p[2] == c):
                yield c + 1, ((buffer[:n] * SIZE + buffer[a : a + n]) * SIZE + buffer[b : b + n]) * SIZE + buffer[c : c + n], inner


def _scale(lens: np.ndarray) -> np.ndarray:
    own = np.zeros(len(lens))
    for _, _, c in PATTERNS:
        own += np.maximum(0, lens - c) * DECAY ** (2 * c + 2)
    return 1 / np.sqrt(np.maximum(own, 1e-12))


def _marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all windows with their marks, the window of each, and each window's scale."""
    lens = np.array([len(w) + 2 for w in words], np.int64)
    head, tail = bytes((HEAD,)), bytes((TAIL,))
    buffer = np.frombuffer(b"".join([head + w + tail for w in words]), np.uint8).astype(np.int32)
    return buffer, np.repeat(np.arange(len(words), dtype=np.int32), lens), _scale(lens)


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, scaled weight) of each occurrence, in order of words."""
    buffer, owner, scale = _marked(words)
    got = [(owner[: key.size][inner], key[inner], np.full(int(inner.sum()), DECAY**span)) for span, key, inner in _entries(buffer, owner)]
    if not got:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
    word, key, weight = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(word, kind="stable")
    word = word[order]
    return word, key[order], weight[order] * scale[word]


class Machine:
    """Weights by subsequence, bias, and calibration."""

    def __init__(self, letters: str, keys: np.ndarray, weights: np.ndarray, bias: float, a: float, b: float):
        self.letters, self.keys, self.weights, self.bias, self.a, self.b = letters, keys, weights, bias, a, b
        self._ready = False

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("letters", "keys", "weights", "bias", "a", "b")} | {"_ready": False}

    def _get_ready(self) -> None:
        if not self._ready:
            self.coder = Coder(self.letters)
            self.table = np.zeros(SIZE**4, np.float32)
            self.table[self.keys] = self.weights
            self._ready = True

    def margins(self, words: list[bytes]) -> np.ndarray:
        """The margin of each window."""
        self._get_ready()
        buffer, owner, scale = _marked(words)
        at = np.zeros(buffer.size, np.float32)
        for span, key, inner in _entries(buffer, owner):
            at[: key.size] += self.table.take(key) * (inner * np.float32(DECAY**span))
        return np.bincount(owner, at, len(scale)) * scale + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of each text by its worst window."""
        return sigmoid(self.a * self.worst(texts) + self.b)

    def worst(self, texts: list[str]) -> np.ndarray:
        """The margin of the worst window of each text.

        Windows share what lies inside them: the weights of all subsequences of letters are summed along the text, those
        with a mark at each word's ends, and a window takes the difference of two sums, and the ends that are its own.
        """
        self._get_ready()
        letters, bound, first, last, own = spans([self.coder.codes(t) for t in texts])
        if not first.size:
            return np.full(len(texts), self.bias)
        count, edge = letters.size, max(c for _, _, c in PATTERNS)
        x = np.concatenate([np.zeros(edge, np.int32), letters, np.zeros(edge, np.int32)])  # letter i stands at edge + i
        start, size = bound[first], bound[last] - bound[first]
        total = np.zeros(first.size)
        look = lambda a, b, c, d: self.table.take(((a * SIZE + b) * SIZE + c) * SIZE + d)
        for c in sorted({c for _, _, c in PATTERNS}):
            inner, heads, tails = np.zeros(count, np.float32), np.zeros(bound.size, np.float32), np.zeros(bound.size, np.float32)
            short = np.flatnonzero(size == c - 1)  # both marks lie c apart
            both = np.zeros(short.size, np.float32)
            at, before, after = np.arange(count) + edge, bound + edge - 1, bound + edge - c
            s = start[short] + edge - 1
            for i, j, _ in (p for p in PATTERNS if p[2] == c):
                inner += look(x[at], x[at + i], x[at + j], x[np.minimum(at + c, x.size - 1)])
                heads += look(HEAD, x[np.minimum(before + i, x.size - 1)], x[np.minimum(before + j, x.size - 1)], x[np.minimum(before + c, x.size - 1)])
                tails += look(x[after], x[after + i], x[after + j], TAIL)
                both += look(HEAD, x[s + i], x[s + j], TAIL)
            sums = np.concatenate([[0.0], np.cumsum(inner, dtype=np.float64)])
            some = np.zeros(first.size)
            long = np.flatnonzero(size > c)
            some[long] = sums[start[long] + size[long] - c] - sums[start[long]]
            marked = np.flatnonzero(size >= c)
            some[marked] += heads[first[marked]] + tails[last[marked]]
            some[short] += both
            total += some * DECAY ** (c + 1)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, own, total * _scale(size + 2) + self.bias)
        return np.where(np.isinf(worst), self.bias, worst)


def _hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss: Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1), z.dtype)])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(25):
        live = y * (x @ w) < 1
        xs, cs = x[live], cost[live]
        new = np.linalg.solve((xs * cs[:, None]).T @ xs + np.diag(reg), xs.T @ (cs * y[live]))
        if np.abs(new - w).max() < 1e-5:
            w = new
            break
        w = new
    return w[:-1], float(w[-1])


def _hashes(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window."""
    codes, letters, power = letters, letters.astype(np.uint64), 1
    out = np.zeros(start.size, np.uint64)
    live = np.flatnonzero(size <= 2 * PHRASE)
    for k in range(2 * PHRASE):
        live = live[size[live] > k]
        out[live] += letters[start[live] + k] * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 % (1 << 64)
    for i in np.flatnonzero(size > 2 * PHRASE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(codes[start[i] : start[i] + size[i]].tobytes())
    return mix64(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _unlike(bags: list[np.ndarray]) -> list[int]:
    """Rows that share fewer than 10 of the 12 least window hashes with each row kept before: copies would count twice."""
    seen: dict[int, list[int]] = {}
    kept = []
    for i, bag in enumerate(bags):
        least = bag[:12].tolist()
        shared = Counter(k for h in least for k in seen.get(h, ()))
        if max(shared.values(), default=0) < min(10, max(1, len(least))):
            kept.append(i)
            for h in least:
                seen.setdefault(h, []).append(i)
    return kept


def _bags(codes: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes]]:
    """The windows of each text as places in a list of windows: single words, and what comes in two texts at least."""
    hashed, single = [], []
    for c in codes:
        letters, start, size, _ = windows([c])
        h = _hashes(letters, start, size)
        hashed.append(np.unique(h))
        single.append(np.unique(h[: np.count_nonzero((c > 0) & ~np.concatenate([[False], c[:-1] > 0]))]))
    every, n = np.unique(np.concatenate(hashed), return_counts=True)
    every = every[(n > 1) | np.isin(every, np.concatenate(single))]
    names: list[bytes] = [b""] * every.size
    bags = []
    for c in codes:
        letters, start, size, _ = windows([c])
        h, first = np.unique(_hashes(letters, start, size), return_index=True)
        at = np.minimum(np.searchsorted(every, h), every.size - 1)
        ok = every[at] == h if every.size else np.zeros(0, bool)
        at, first = at[ok], first[ok]
        bags.append(at)
        flat = letters.tobytes()
        for k, s, m in zip(at.tolist(), start[first].tolist(), size[first].tolist(), strict=True):
            if not names[k]:
                names[k] = flat[s : s + m]
    return bags, names


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Machine | None:
    if len(set(y.tolist())) < 2:
        return None
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    letters = "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
    coder = Coder(letters)
    codes = [coder.codes(t) for t in texts]
    alone = _unlike([np.unique(_hashes(*windows([c])[:3])) for c in codes])
    texts, codes, y, weight = [texts[i] for i in alone], [codes[i] for i in alone], y[alone], weight[alone]
    if len(set(y.tolist())) < 2:
        return None
    bags, names_of = _bags(codes)
    size, marked = len(names_of), y.astype(bool)
    count = lambda keep: np.bincount(np.concatenate([b for b, k in zip(bags, keep, strict=True) if k] or [np.zeros(0, np.int64)]), minlength=size)
    toxic, clean = count(marked), count(~marked)
    n_toxic, n_clean = int(marked.sum()), int((~marked).sum())
    odds = np.log((toxic + 0.1) / n_toxic) - np.log((clean + 0.1) / n_clean) + 0.3 * np.log(np.maximum(toxic, 1))
    toxic_bags = [b for b, k in zip(bags, marked, strict=True) if k and b.size]
    witnesses = [int(b[np.argmax(odds[b])]) for b in toxic_bags]
    witnesses = [w for w in witnesses if clean[w] == 0 and toxic[w] > 1] or witnesses
    chance = n_toxic / (n_toxic + n_clean)
    telling = np.flatnonzero((clean == 0) & (toxic > 2) & (chance ** np.minimum(toxic, 60) < 1e-4)).tolist()
    rng = np.random.default_rng(SEED)
    known = np.flatnonzero(clean > 0)
    known = known[np.lexsort((known, -clean[known]))].tolist()
    hard = known[:3000] + known[3000 :: max(1, len(known) // 3000)]
    edge = known  # windows of clean documents that the machine should know first
    machine = None
    for turn in range(TURNS):
        positive = Counter(witnesses)
        positive.update({w: int(toxic[w]) for w in telling})
        chosen = sorted(positive, key=lambda w: (-positive[w], w))[:2000]
        names = [names_of[w] for w in chosen]
        whole = len(names)
        for w in names[:300]:
            if len(w) > 3:
                cut = int(rng.integers(1, len(w)))
                names.append(w[:cut] + bytes((int(rng.integers(1, LETTERS)),)) + w[cut:])
        marks = [*names[: min(whole, LANDMARKS // 2)]]
        marks += [names_of[w] for w in edge[:LANDMARKS] if w not in positive][: LANDMARKS - len(marks)]
        against = [w for w in dict.fromkeys(hard) if w not in positive]
        rows = names + [names_of[w] for w in against]
        target = np.concatenate([np.ones(len(names)), -np.ones(len(against))])
        lw, lk, lx = subsequences(marks)
        keys, at = np.unique(lk, return_inverse=True)
        land = np.zeros((len(keys), len(marks)), np.float32)
        np.add.at(land, (at, lw), lx)
        gram = land.T @ land
        value, vector = np.linalg.eigh(gram.astype(float) + 1e-4 * np.eye(len(marks)))
        root = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
        fold = land @ root.astype(np.float32)  # a row a subsequence: its share in each mapped feature
        z = np.zeros((len(rows), len(marks)), np.float32)
        rw, rk, rx = subsequences(rows)
        place = np.minimum(np.searchsorted(keys, rk), max(0, len(keys) - 1))
        ok = keys[place] == rk if len(keys) else np.zeros(len(rk), bool)
        rw, place, rx = rw[ok], place[ok], rx[ok]
        for a in range(0, len(rows), 150):
            lo, hi = np.searchsorted(rw, [a, a + 150])
            if hi > lo:
                cuts = np.flatnonzero(np.concatenate([[True], rw[lo + 1 : hi] != rw[lo : hi - 1]]))
                z[rw[lo:hi][cuts]] = np.add.reduceat(fold[place[lo:hi]] * rx[lo:hi, None], cuts)
        cost = np.concatenate([10.0 * np.sqrt([positive[w] for w in chosen]), np.full(len(names) - whole, 10.0 * np.sqrt(0.05)), 6.0 * np.sqrt(1.0 + clean[against])])
        w, bias = _hinge(z, target, cost)
        machine = Machine(letters, keys, (fold @ w).astype(np.float32), bias, 1.0, 0.0)
        if turn < TURNS - 1:
            margin = np.concatenate([machine.margins(names_of[i:k]) for i, k in slices(np.array([len(x) for x in names_of]), 1 << 18)])
            best = [int(b[np.argmax(margin[b] - 0.5 * np.minimum(4, clean[b]))]) for b in toxic_bags]
            witnesses = [x for x in best if margin[x] > -0.5 and clean[x] * n_toxic <= toxic[x] * n_clean * 0.2] or witnesses
            worst = sorted(known, key=lambda x: (-margin[x], x))[:3000]
            edge = worst
            hard = list(dict.fromkeys([*known[:2000], *known[2000 :: max(1, len(known) // 2000)], *worst]))
    worst_window = np.concatenate([machine.worst(texts[i:k]) for i, k in slices(np.array([len(t) for t in texts]), STEP)])
    machine.a, machine.b = platt(worst_window, y.astype(float), weight)
    return machine


def learn(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Fit on a bounded sample: ROWS_PER_CLASS labelled rows a class, whole, of CHARS_IN_ALL characters in all."""
    rows, counts = labelled(docs, labels, "toxic", ROWS_PER_CLASS, CHARS_IN_ALL, SEED)
    if not rows:
        return None
    y = np.array([r[2] for r in rows])
    share = {k: counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([share[k] for k in y.tolist()])
    return fit([r[1] for r in rows], y, weight / weight.mean())


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score, predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(machine, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])
        release()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def probabilities(machine: Machine | None, texts: pa.Array) -> np.ndarray:
    if machine is None:
        return np.zeros(len(texts))
    out = [machine.score(some) for _, _, some in text_slices(texts, STEP)]
    return np.concatenate(out) if out else np.zeros(0)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn labels of rows whose crc32(doc_id) mod 4 is not 2; score all rows."""
    machine = learn(docs, labels.where(fold_of("doc_id", 4) != 2))
    return score(docs, machine).select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not judged toxic, with all their columns."""
    machine = learn(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(probabilities(machine, b.column(at)) < THRESHOLD))
        release()

    return docs.mapInArrow(run, docs.schema)
