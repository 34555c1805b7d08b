"""Edit scripts over bytes: parse, validate, splice, derive, and map offsets and regions.

An edit is a struct (start_byte, end_byte, replacement, preimage_sha256); a script is an array of them on its document's
row, so all of this is narrow.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT = "struct<start_byte:bigint,end_byte:bigint,replacement:binary,preimage_sha256:string>"
WIRE = "array<struct<start_byte:bigint,end_byte:bigint,replacement_b64:string,preimage_b64:string,preimage_sha256:string>>"


def parse(json_: Column) -> Column:
    """Wire JSON to a script; a missing replacement deletes; base64 that doesn't decode gives a null replacement."""
    return F.transform(
        F.from_json(json_, WIRE),
        lambda e: F.struct(
            e["start_byte"].alias("start_byte"),
            e["end_byte"].alias("end_byte"),
            F.when(e["replacement_b64"].isNull(), F.lit(b"")).otherwise(F.try_to_binary(e["replacement_b64"], F.lit("base64"))).alias("replacement"),
            F.coalesce(F.sha2(F.try_to_binary(e["preimage_b64"], F.lit("base64")), 256), F.lower(F.trim(e["preimage_sha256"]))).alias("preimage_sha256"),
        ),
    )


def ordered(edits: Column) -> Column:
    """By start, then end."""
    keyed = F.array_sort(F.transform(edits, lambda e, i: F.struct(e["start_byte"].alias("a"), e["end_byte"].alias("b"), i.alias("i"))))
    return F.transform(keyed, lambda k: F.get(edits, k["i"]))


def piece(content: Column, start: Column, end: Column) -> Column:
    """content[start:end] of a binary."""
    return F.substring(content, (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))


def problems(content: Column, edits: Column) -> Column:
    """Codes of what is wrong with a script, empty where it may be applied."""
    n = F.octet_length(content).cast("bigint")
    bounds = F.exists(edits, lambda e: F.coalesce((e["start_byte"] < 0) | (e["end_byte"] < e["start_byte"]) | (e["end_byte"] > n), F.lit(True)))
    inside = lambda e: (e["start_byte"] >= 0) & (e["start_byte"] <= e["end_byte"]) & (e["end_byte"] <= n)
    stale = F.exists(edits, lambda e: F.coalesce(inside(e) & e["preimage_sha256"].isNotNull() & (F.sha2(piece(content, e["start_byte"], e["end_byte"]), 256) != e["preimage_sha256"]), F.lit(False)))
    o = ordered(edits)
    pairs = F.zip_with(F.slice(o, F.lit(1), F.greatest(F.lit(0), F.size(o) - 1)), F.slice(o, 2, F.greatest(F.lit(1), F.size(o))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    overlap = F.exists(pairs, lambda p: p["a"]["end_byte"] > p["b"]["start_byte"])
    empty = lambda e: e["start_byte"] == e["end_byte"]
    twin = F.exists(pairs, lambda p: empty(p["a"]) & empty(p["b"]) & (p["a"]["start_byte"] == p["b"]["start_byte"]))
    bad = F.exists(edits, lambda e: e["replacement"].isNull())
    return F.filter(F.array(F.when(bounds, F.lit("out_of_bounds")), F.when(stale, F.lit("preimage_mismatch")), F.when(overlap, F.lit("overlap")), F.when(twin, F.lit("double_insertion")), F.when(bad, F.lit("bad_replacement"))), lambda x: x.isNotNull())


def apply(content: Column, edits: Column) -> Column:
    """The revision: content with the script spliced in; null where the script has problems."""
    spliced = F.aggregate(
        ordered(edits),
        F.struct(F.lit(b"").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, e: F.struct(F.concat(acc["out"], piece(content, acc["at"], e["start_byte"]), e["replacement"]).alias("out"), e["end_byte"].alias("at")),
        lambda acc: F.concat(acc["out"], piece(content, acc["at"], F.octet_length(content).cast("bigint"))),
    )
    return F.when(F.size(problems(content, edits)) == 0, spliced)


def _grow(e: Column) -> Column:
    return F.octet_length(e["replacement"]).cast("bigint") - (e["end_byte"] - e["start_byte"])


def map_offset(edits: Column, at: Column) -> Column:
    """The revision's offset of an original one; null strictly inside a replaced range."""
    delta = F.aggregate(F.filter(edits, lambda e: e["end_byte"] <= at), F.lit(0).cast("bigint"), lambda acc, e: acc + _grow(e))
    inside = F.exists(edits, lambda e: (e["start_byte"] < at) & (e["end_byte"] > at))
    return F.when(~inside, at + delta)


def region_status(edits: Column, start: Column, end: Column) -> Column:
    """deleted, ambiguous, modified or unchanged."""
    deleted = F.exists(edits, lambda e: (e["end_byte"] > e["start_byte"]) & (e["start_byte"] <= start) & (e["end_byte"] >= end))
    ambiguous = map_offset(edits, start).isNull() | map_offset(edits, end).isNull()
    touched = F.exists(edits, lambda e: (e["end_byte"] > start) & (e["start_byte"] < end))
    return F.when(deleted, F.lit("deleted")).when(ambiguous, F.lit("ambiguous")).when(touched, F.lit("modified")).otherwise(F.lit("unchanged"))


def hunks_of(edits: Column, start: Column, end: Column) -> Column:
    """Numbers (in script order) of the edits that overlap a range."""
    hit = F.transform(ordered(edits), lambda e, i: F.when((e["end_byte"] > start) & (e["start_byte"] < end), i))
    return F.filter(hit, lambda i: i.isNotNull())


def material_equal(a: Column, b: Column, trailing_newline: str = "preserve") -> Column:
    """Equal bytes, or equal but for line feeds at the end."""
    if trailing_newline == "normalize":
        bare = lambda c: F.regexp_replace(F.hex(c), r"^((?:..)*?)(?:0A)*$", "$1")
        return bare(a) == bare(b)
    return a == b


def derive(pairs: DataFrame, original: str = "original", revision: str = "revision") -> DataFrame:
    """pairs with `edits`: the byte diff of two binaries, for revisions that come without a script."""

    @F.pandas_udf(f"array<{EDIT}>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes | None, y: bytes | None) -> list[dict]:
            x, y = x or b"", y or b""
            # equal ends carry no edit; the matcher then sees only what lies between
            lead = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            tail = next((i for i, (p, q) in enumerate(zip(reversed(x[lead:]), reversed(y[lead:]), strict=False)) if p != q), min(len(x), len(y)) - lead)
            inner = difflib.SequenceMatcher(a=x[lead : len(x) - tail], b=y[lead : len(y) - tail], autojunk=False)
            return [{"start_byte": lead + i1, "end_byte": lead + i2, "replacement": y[lead + j1 : lead + j2], "preimage_sha256": None} for tag, i1, i2, j1, j2 in inner.get_opcodes() if tag != "equal"]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("edits", diff(F.col(original), F.col(revision)))
