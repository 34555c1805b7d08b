"""Text expressions: words, sentences, units, line starts, invariant segments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.functions import fixed

#: Unicode letters with inner apostrophes; no digits, no underscore.
_LETTERS = r"(?:[a-zA-Z]++|[\p{L}\p{Nl}\p{No}])++"
WORD = rf"{_LETTERS}(?:['’]{_LETTERS})*+"
#: Stands where a sentence may end while abbreviations are sorted out.
MARK = "\x1f"
_ABBREVIATION = "|".join(re.escape(x) for x in sorted(fixed.ABBREVIATIONS, key=lambda x: (-len(x), x)))
# the lookahead asks for a mark behind the word at hand before any abbreviation is tried
_GLUE = rf"(?i)(^|[^A-Za-z.])(?=[A-Za-z.]++\s*+[.!?]*+{MARK})(\.*(?:{_ABBREVIATION})\.*\s*[.!?]+){MARK}"
_TRAIL = r".,:;!?}"
_URL_BODY = r"[^\s<>()\[\]]"
_URL_LAST = r"[^\s<>()\[\].,:;!?}]"
_TLD = "|".join(sorted(fixed.TLDS, key=lambda x: (-len(x), x)))
_URLS = (
    rf"(?iU)\bhttps?://(?:{_URL_BODY}*{_URL_LAST}|(?=[{_TRAIL}]))",
    rf"(?iU)\bwww(?:\.{_URL_BODY}*{_URL_LAST}|(?=\.[{_TRAIL}]))",
    rf"(?iU)(?<![\w@.])(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{_TLD})(?:[:/?#]{_URL_BODY}*{_URL_LAST}|[/#])?",
)
#: What (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Letters that (?iU) takes for s and i, as they are in lower case; lower-case text without them holds its matches' letters.
ODD = ("\u017f", "\u0131", "\u0307")


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode white space included."""
    edge = lambda x, at: F.contains(F.lit(SPACES), F.substring(x, at, 1))
    return let(c, lambda x: F.when(edge(x, 1) | edge(x, -1), F.btrim(x, F.lit(SPACES))).otherwise(x))


def is_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES)) == ""


def holds(low: Column, needles: tuple[str, ...]) -> Column:
    """Whether a lower-case text holds one of the needles: plain search, much cheaper than a pattern that needs one."""
    out = F.contains(low, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(low, F.lit(n))
    return out


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def strip_urls(c: Column) -> Column:
    """Each URL becomes one space; punctuation that ends it stays."""
    def without(pattern: str, may: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: F.when(may(x), F.regexp_replace(x, pattern, " ")).otherwise(x)

    for pattern, may in zip(_URLS, _MAY_BE_URL, strict=True):
        c = let(c, without(pattern, may))
    return c


#: What a text must have for each of _URLS to match.
_MAY_BE_URL = (lambda x: F.contains(x, F.lit("://")), lambda x: F.rlike(x, F.lit(r"[wW]{3}\.")), lambda x: F.rlike(x, F.lit(rf"(?iU)\.(?:{_TLD})")))


def sentences(c: Column) -> Column:
    """Sentences of one unit: split after runs of .!? before white space, but not after an abbreviation."""
    marked = F.regexp_replace(F.replace(c, F.lit(MARK), F.lit(" ")), r"(?U)([.!?])(\s)", f"$1{MARK}$2")
    parts = F.split(F.regexp_replace(marked, _GLUE, "$1$2"), MARK, -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, whatever later filters and projections make of them.

    The optimizer copies a column's expression into filters on it and into expressions that mention it. A generator of
    one row keeps it from doing so.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression that a lambda mentions is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_units(text: Column) -> Column:
    """Plain-text units: runs of lines that aren't blank, as (text, line_start, line_end)."""

    def units(lines: Column) -> Column:
        n = F.size(lines)
        # the places of blank lines, with one before the first line and one after the last
        blank = F.filter(F.transform(lines, lambda x, i: F.when(is_blank(x), i + 1)), lambda i: i.isNotNull())
        stops = F.concat(F.array(F.lit(0)), blank, F.array(n + 1))
        spans = F.filter(F.zip_with(F.slice(stops, F.lit(1), F.size(stops) - 1), F.slice(stops, F.lit(2), F.size(stops) - 1), lambda a, b: F.struct((a + 1).alias("a"), (b - 1).alias("b"))), lambda s: s["b"] >= s["a"])
        return F.transform(
            spans,
            lambda s: F.struct(
                strip(strip_urls(F.array_join(F.transform(F.slice(lines, s["a"], s["b"] - s["a"] + 1), strip), " "))).alias("text"),
                s["a"].cast("int").alias("line_start"),
                s["b"].cast("int").alias("line_end"),
                F.lit("paragraph").alias("structural_type"),
                F.lit(False).alias("is_label"),
            ),
        )

    return F.when(text.isNotNull(), F.filter(let(F.split(text, "\n", -1), units), lambda u: u["text"] != ""))


def unit_parts(units: Column) -> Column:
    """The sentences of each unit; headings and list items are one sentence each."""
    return F.transform(units, lambda u: F.when(u["structural_type"] == "paragraph", sentences(u["text"])).otherwise(F.array(u["text"])))


def unit_sentences(units: Column, parts: Column) -> Column:
    """All sentences of a document with their units' lines, from its units and their parts."""
    placed = F.zip_with(units, parts, lambda u, p: F.struct(u["line_start"].alias("line_start"), u["line_end"].alias("line_end"), p.alias("p")))
    return F.flatten(
        F.transform(
            placed,
            lambda u, i: F.transform(u["p"], lambda s: F.struct(s.alias("sentence"), i.cast("int").alias("unit_idx"), u["line_start"].alias("line_start"), u["line_end"].alias("line_end"))),
        )
    )


def runs(xs: Column, same: Callable[[Column, Column], Column]) -> Column:
    """(a, b) of each run in an array, first and last place: neighbours that are the same. xs is a column or a variable."""
    starts = F.filter(F.transform(xs, lambda x, i: F.when(~F.coalesce(same(F.get(xs, i - 1), x), F.lit(False)), i)), lambda i: i.isNotNull())
    return let(starts, lambda at: F.transform(at, lambda a, j: F.struct(a.alias("a"), (F.coalesce(F.get(at, j + 1), F.size(xs)) - 1).alias("b"))))


BLOCK = 256


def running(xs: Column) -> Column:
    """Running sums of an array of int, each with its own element; by blocks, as a fold that appends copies what it has."""

    def fold(ys: Column, before: Column) -> Column:
        return F.aggregate(
            ys,
            F.struct(before.cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, y: F.struct((acc["at"] + y).cast("int").alias("at"), F.concat(acc["out"], F.array((acc["at"] + y).cast("int"))).alias("out")),
            lambda acc: acc["out"],
        )

    def blocks(ys: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / BLOCK).cast("int")), lambda b: F.slice(ys, b * BLOCK + 1, F.lit(BLOCK)))
        return let(cut, lambda bs: let(fold(F.transform(bs, lambda b: total(b, "int")), F.lit(0)), lambda ends: F.flatten(F.transform(bs, lambda b, i: fold(b, F.coalesce(F.get(ends, i - 1), F.lit(0)))))))

    return let(xs, lambda ys: F.when(F.size(ys) == 0, F.array().cast("array<int>")).when(F.size(ys) > 0, blocks(ys)))


def segments(text: Column) -> Column:
    """Invariant segments, each with its text and byte range: cut at blank lines and after .!? before white space."""
    # a capital separator marks what lies between segments, so that byte offsets add up
    plain = F.replace(F.replace(text, F.lit(MARK), F.lit(" ")), F.lit("\x1e"), F.lit(" "))
    marked = F.regexp_replace(plain, r"(?U)(\n[ \t]*\n)|((?<=[.!?])\s+)", f"{MARK}$0\x1e")
    parts = F.split(marked, MARK, -1)  # all but the first begin with a gap that ends with \x1e
    rows = F.transform(parts, lambda p: F.struct(F.when(F.instr(p, "\x1e") > 0, F.substring_index(p, "\x1e", 1)).otherwise(F.lit("")).alias("gap"), F.substring_index(p, "\x1e", -1).alias("seg")))
    sizes = F.transform(rows, lambda r: F.octet_length(r["gap"]) + F.octet_length(r["seg"]))
    return F.struct(rows.alias("rows"), sizes.alias("sizes"))


def percentile_of(sorted_: Column, q: float) -> Column:
    """Linear interpolation in a sorted array of counts."""
    pos = F.lit(q) * (F.size(sorted_) - 1)
    lo = F.floor(pos).cast("int")
    a, b = F.get(sorted_, lo).cast("double"), F.get(sorted_, F.least(lo + 1, F.size(sorted_) - 1)).cast("double")
    return a + (pos - lo) * (b - a)


def total(xs: Column, kind: str = "bigint") -> Column:
    zero = F.lit(0).cast(kind)
    return F.aggregate(xs, zero, lambda acc, x: acc + x.cast(kind))
