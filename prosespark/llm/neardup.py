"""Near-duplicate components by bottom-k sketches of one hash function.

A text's set holds the 64-bit hashes of its word shingles. Texts with the same set form a class; one row stands for
it. A class's sketch is the K least hashes of its set, whole sets of K or fewer included.

1. Inverted lists. Sketches of two sets with a Jaccard similarity of 0.8 or more share at least NEED of K values but
   for a chance of about 1e-6 (1e-8 at 0.85), so they share one of each one's K - NEED + 1 rarest values (rarity counted
   over all sketches; a value that only one class holds needs no list). Small sets use the exact bound.
2. Stars. In each list the class with the least salted hash is the center; each other member makes one candidate with
   it, so lists of any length give as many candidates as members. Sizes and the sketch of the union filter candidates,
   full sets confirm links. Two members of a list that are both linked to its center are in one component whatever they
   share; any other pair of the list has a loose member.
3. Lists with loose members are split: their members get new lists, of the rarest values of their full sets (so many of
   each that linked sets must share one), and new stars. What many unlike texts share is common, so it lies outside
   these lists, however large a part of a text it is, up to the similarity asked for.
4. Blocks. Members that are loose in a new list, too, are compared with all its members in blocks of at most BLOCK
   shingles a side; in a block, too, only sets that share one of their rarest values are compared.
5. Components. Links become components by alternating large and small stars (each node's larger, then smaller
   neighbours move to its least neighbour), with a written table after each, until only stars are left.

No list, block or component is collected; every step between tables is a join or a group by key that Spark can split,
or a block. Row order and partitions don't matter.

Null texts and texts without words have an empty set, are linked with nothing and are components of their own. With
fewer words than a shingle takes the whole sequence is one. Repeated rows and equal texts are one class. A class's text
is found again by doc_id and a hash of the text, so rows of one doc_id may hold different texts: each is linked by its
own, and a component's id is the least doc_id of its rows. Rows without a doc_id are linked like others; a component of
such rows alone has a null component_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import materialize, mix64, packed, release, slices, text_bytes
from prosespark.llm.quality import word_hashes

K, NEED, SALT = 32, 14, 41
#: Shingles a side that one block compares.
BLOCK = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (signed, as Spark stores them)."""
    out = []
    for t in texts:
        words = t.lower().split()  # of bytes: A-Z only, and the white space [\x20\x09-\x0D]
        if not words:
            out.append(np.zeros(0, np.int64))
            continue
        h = word_hashes(words)
        n = min(width, h.size)
        x = np.full(h.size - n + 1, np.uint64(n))
        for i in range(n):
            x = mix64(x * _STEP + h[i : h.size - n + 1 + i])
        out.append(np.unique(x.view(np.int64)))
    return out


def _fingerprint(s: np.ndarray) -> bytes:
    u = s.view(np.uint64)
    return np.array([np.add.reduce(mix64(u)), np.bitwise_xor.reduce(mix64(u * _STEP + np.uint64(7)))], np.uint64).tobytes() + len(s).to_bytes(4, "little")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), fp (of the set), sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(2))
            for i, k in slices(np.array([len(t) for t in texts])):
                sets = shingle_sets(texts[i:k], width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k - i), b.column(1).slice(i, k - i), pa.array([s.size for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s[:K] for s in sets], pa.list_(pa.int64()))], ["doc_id", "th", "n", "fp", "sketch"])
        release()

    return located(docs).mapInArrow(run, "doc_id bigint, th bigint, n bigint, fp binary, sketch array<bigint>")


def located(docs: DataFrame) -> DataFrame:
    """doc_id, th, text of each row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _prefix(n: Column, percent: int) -> Column:
    """How many of a sketch's rarest values any linked set shares one of."""
    k = F.least(n, F.lit(K))
    exact = n - F.ceil(n * F.lit(percent) / 100) + 1
    return F.when(n * F.lit(100) <= F.lit(K * percent), exact).otherwise(k - F.lit(NEED) + 1)


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * F.lit(percent))


def _rarest(postings: DataFrame, take: Column) -> DataFrame:
    """fp, value: each fp (of n values) under its `take` rarest values, but for those that nothing else holds."""
    shared = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = postings.join(shared, "value").groupBy("fp").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    spare = F.col("own") - F.size("held")  # rarer values, which nothing else holds
    return held.select("fp", F.explode(F.slice("held", F.lit(1), F.greatest(F.lit(0), take - spare).cast("int"))["value"]).alias("value"))


def inverted(classes: DataFrame, percent: int) -> DataFrame:
    """fp, value: each class under its rarest sketch values that other classes hold too."""
    return _rarest(classes.select("fp", "n", F.size("sketch").alias("own"), F.explode("sketch").alias("value")), _prefix(F.col("n"), percent))


def split_lists(full: DataFrame, percent: int) -> DataFrame:
    """fp, value: each full set under its rarest values, of which linked sets share one."""
    exact = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    return _rarest(full.select("fp", "n", F.col("n").alias("own"), F.explode("set").alias("value")), exact)


def stars(lists: DataFrame) -> DataFrame:
    """center, fp: each member of a list with the list's center, once each pair."""
    salted = F.struct(F.xxhash64("fp", F.lit(SALT)).alias("h"), F.col("fp").alias("f"))
    centers = lists.groupBy("value").agg(F.min(salted).alias("c"), F.count("*").alias("m")).where("m > 1").select("value", F.col("c.f").alias("center"))
    return lists.join(centers, "value").select("center", "fp").distinct()


def _may_link(a: str, b: str) -> Column:
    """Whether the sketch of the union holds NEED values of both (all that is needed of small sets is checked later)."""
    both = F.array_intersect(F.col(a), F.col(b))
    least = F.slice(F.array_sort(F.array_union(F.col(a), F.col(b))), 1, K)
    found = F.size(F.array_intersect(least, both))
    return (found >= NEED) | (F.size(least) < K)


def _compare(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between a block's queries and its members, enough of them to join what is joined."""
    empty = pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object)})
    ask = pdf["ask"].to_numpy(bool)
    if ask.all() or not ask.any():
        return empty
    sets, names = pdf["set"].tolist(), pdf["fp"].tolist()
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(values.size, np.int64)
    rank[np.lexsort((values, df))] = np.arange(values.size)
    ranks, owner = rank[at], np.repeat(np.arange(len(sets)), sizes)
    ranks = ranks[np.lexsort((ranks, owner))]  # each set from its rarest value on
    rare = np.arange(ranks.size) - starts[owner] < (sizes - -(-sizes * percent // 100) + 1)[owner]
    listed = rare & ~ask[owner]
    order = np.argsort(ranks[listed], kind="stable")
    keys, members = ranks[listed][order], owner[listed][order]
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    mark = np.zeros(values.size, np.int8)
    for q in np.flatnonzero(ask).tolist():
        own = ranks[starts[q] : ends[q]]
        lead = own[rare[starts[q] : ends[q]]]
        spans = zip(np.searchsorted(keys, lead, "left").tolist(), np.searchsorted(keys, lead, "right").tolist(), strict=True)
        near = np.unique(np.concatenate([members[i:k] for i, k in spans]))
        n = sizes[q]
        near = near[100 * np.minimum(n, sizes[near]) >= percent * np.maximum(n, sizes[near])]
        mark[own] = 1
        for c in near.tolist():
            x, y = find(names[q]), find(names[c])
            if x == y:
                continue
            common = int(mark[ranks[starts[c] : ends[c]]].sum(dtype=np.int64))
            if 100 * common >= percent * (n + sizes[c] - common):
                root[x] = y
                out.append((names[q], names[c]))
        mark[own] = 0
    return pd.DataFrame(out, columns=["a", "b"]) if out else empty


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp, n, set of the wanted classes, each from the text of one of its rows."""
    texts = classes.join(wanted, "fp").select(F.col("fp").alias("want"), F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("h"))
    rows = located(docs).where("text is not null")
    chosen = rows.join(texts, rows["doc_id"].eqNullSafe(texts["d"]) & (rows["th"] == texts["h"])).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, want = text_bytes(b.column(0)), b.column(1).to_pylist()
            for i, k in slices(np.array([len(t) for t in raw])):
                got = [(f, s) for f, s in zip(want[i:k], shingle_sets(raw[i:k], width), strict=True) if _fingerprint(s) == f]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in got], pa.binary()), pa.array([s.size for _, s in got], pa.int64()), pa.array([s for _, s in got], pa.list_(pa.int64()))], ["fp", "n", "set"])
        release()

    return chosen.mapInArrow(run, "fp binary, n bigint, set array<bigint>").dropDuplicates(["fp"])


def star_links(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """center, fp of the pairs whose full sets are linked."""
    x = full.select(F.col("fp").alias("xf"), F.col("n").alias("xn"), F.col("set").alias("xs"))
    c = full.select(F.col("fp").alias("cf"), F.col("n").alias("cn"), F.col("set").alias("cs"))
    k = lambda s: F.slice(s, 1, K)  # noqa: E731  sets are sorted
    tested = pairs.where("fp <> center").join(x, F.col("fp") == F.col("xf")).join(c, (F.col("center") == F.col("cf")) & _similar_sizes(F.col("xn"), F.col("cn"), percent))
    tested = tested.withColumn("xk", k("xs")).withColumn("ck", k("cs")).where(_may_link("xk", "ck"))
    common = F.size(F.array_intersect("xs", "cs"))
    return tested.select("center", "fp", "xn", "cn", common.alias("common")).where(F.col("common") * 100 >= F.lit(percent) * (F.col("xn") + F.col("cn") - F.col("common"))).select("center", "fp")


def open_stars(pairs: DataFrame, linked: DataFrame, full: DataFrame) -> DataFrame:
    """center, fp, loose, n and block counts (mb, qb) of the members of stars that hold pairs not yet compared."""
    members = pairs.join(linked.withColumn("ok", F.lit(True)), ["center", "fp"], "left").select("center", "fp", (F.col("ok").isNull() & (F.col("fp") != F.col("center"))).alias("loose"))
    weigh = members.join(full.select("fp", "n"), "fp")
    groups = weigh.groupBy("center").agg(F.count("*").alias("m"), F.sum(F.col("loose").cast("int")).alias("q"), F.sum("n").alias("total"), F.sum(F.when(F.col("loose"), F.col("n"))).alias("ask"))
    # a lone loose member beside the center has been compared already
    groups = groups.where("q > 0 and m > 2").select("center", F.ceil(F.col("total") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("ask") / BLOCK).cast("int").alias("qb"))
    return weigh.join(groups, "center").select("center", "fp", "loose", "mb", "qb")


def block_links(stars_: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b: links of loose members with all members of their star."""
    spot = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = stars_.select("center", spot("mb").alias("i"), every("qb").alias("j"), "fp", F.lit(False).alias("ask"))
    asks = stars_.where("loose").select("center", every("mb").alias("i"), spot("qb").alias("j"), "fp", F.lit(True).alias("ask"))
    blocks = rows.unionByName(asks).join(full.select("fp", "set"), "fp")
    return blocks.groupBy("center", "i", "j").applyInPandas(lambda pdf: _compare(pdf, percent), "a binary, b binary")


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between classes that join what any links join."""
    pairs = materialize(stars(materialize(inverted(classes, percent), "lists")), "stars")
    wanted = pairs.select(F.col("center").alias("fp")).unionByName(pairs.where("fp <> center").select("fp")).distinct()
    full = materialize(full_sets(docs, classes, wanted, width), "sets")
    linked = materialize(star_links(pairs, full, percent), "star-links")
    split = open_stars(pairs, linked, full).select("fp").distinct()
    again = materialize(stars(materialize(split_lists(full.join(split, "fp", "left_semi"), percent), "split-lists")), "split-stars")
    more = materialize(star_links(again, full, percent), "split-links")
    rest = materialize(open_stars(again, more, full), "loose")
    ends = lambda e: e.select(F.col("center").alias("a"), F.col("fp").alias("b"))
    return materialize(ends(linked).unionByName(ends(more)).unionByName(block_links(rest, full, percent)), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component of edges a, b; nodes of any type that has an order.

    A large star links each node's larger neighbours to the least of it and its neighbours, a small star its smaller
    neighbours and itself; both keep what is connected, and alternating they leave stars around least nodes after some
    log(n) rounds, whatever the order of nodes along a chain. It ends when each node but the centers has one edge.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(ordered.distinct(), "edges")
    while True:
        parts = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if parts.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct(), "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-stars")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th, n, component_id, stays of each row; of a component the rows with the least (doc_id, th) stay."""
    rows = materialize(signatures(docs, width), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")
    classes = materialize(rows.where("n > 0").groupBy("fp").agg(F.min(first).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    named = components(links(docs, classes, width, percent))
    least = classes.select("fp", "rep").join(named, F.col("fp") == F.col("node")).select("fp", "label", "rep")
    of_label = least.groupBy("label").agg(F.min("rep").alias("first"))
    of_class = least.select("fp", "label").join(of_label, "label").select(F.col("fp").alias("f"), "first")
    of_class = classes.join(of_class, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("f"), F.coalesce("first", "rep").alias("first"))
    out = rows.join(of_class, (F.col("fp") == F.col("f")) & (F.col("n") > 0), "left")
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    return out.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays"))


def op5(docs: DataFrame) -> DataFrame:
    """Three-word shingles, links from 85 in 100."""
    got = grouped(docs, 3, 85)
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns; of rows with one id and text one."""
    stay = grouped(docs, width, percent).where("stays").select(F.col("doc_id").alias("keep"), F.col("th").alias("keep_th")).distinct()
    rows = packed(docs, F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    kept = rows.join(stay, rows["id"].eqNullSafe(F.col("keep")) & (rows["th"] == F.col("keep_th")), "left_semi")
    return kept.dropDuplicates(["id", "th"]).select("row.*")
