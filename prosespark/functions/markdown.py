"""Markdown units: a block scanner of a documented CommonMark subset, run as an Arrow UDF.

Blocks: ATX and setext headings, paragraphs, block quotes (left out), bullet and ordered lists with nesting, fenced and
indented code, HTML blocks, thematic breaks. Inline: code spans, images, links, emphasis marks, breaks, escapes, inline
HTML. A document with what the scanner doesn't know (link reference definitions, a fence that never closes inside a
list item) has status `capability_unavailable` and no units rather than wrong ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.functions import text as T

PROFILE = "markdown-subset-v1"
UNIT = "struct<text:string,line_start:int,line_end:int,structural_type:string,is_label:boolean>"
SPAN = "struct<start_byte:int,end_byte:int,kind:string>"
RESULT = f"status string, units array<{UNIT}>, spans array<{SPAN}>, fence_lines int, code_blocks int, code_inline int, parsed_links int, broken_links int"

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}(?!.*`)|~{3,})")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
HTML = re.compile(r" {0,3}<(?:/?[a-zA-Z][^\s/>]*(?:\s|/?>|$)|!--|\?|![A-Z])")
DEFINITION = re.compile(r" {0,3}\[[^\]\n]+\]:\s*\S")
CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)*)\]\((?:<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
OPENER = re.compile(r"!?\[[^\]\n]*\]\(")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->", re.S)
IDENTIFIER = re.compile(r"[\w./\-]+\Z")
FENCE_LINE = re.compile(r"(?m)^\s{0,3}(?:`{3,}|~{3,})")


@dataclass
class Scan:
    """What one pass over a document finds."""

    units: list[tuple] = field(default_factory=list)
    code: list[tuple[int, int]] = field(default_factory=list)  # line ranges of code blocks, last exclusive
    quotes: list[tuple[int, int]] = field(default_factory=list)
    inline: list[tuple[int, int, str]] = field(default_factory=list)  # first and last line, raw text
    code_inline: int = 0
    links: int = 0
    sound: bool = True


def visible(raw: str) -> tuple[str, int, int]:
    """The text a reader sees, and the numbers of code spans and links; code, images and tags become a space."""
    n_code = n_links = 0

    def code(_: re.Match) -> str:
        nonlocal n_code
        n_code += 1
        return "\x00 \x00"

    def link(m: re.Match) -> str:
        nonlocal n_links
        n_links += 1
        return " " if m[1] else m[2]

    raw = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: chr(0xE000 + ord(m[1])), raw)
    out = CODE.sub(code, raw)
    before = None
    while before != out:
        before, out = out, LINK.sub(link, out)
    out = TAG.sub(" ", out).replace("\x00", "")
    out = re.sub(r"(?<!\w)(\*{1,3}|_{1,3})(?=\S)|(?<=\S)(\*{1,3}|_{1,3})(?!\w)", "", out)
    out = re.sub("[\ue000-\ue07f]", lambda m: chr(ord(m[0]) - 0xE000), out)
    return re.sub(r"[ \t]*\n[ \t]*", " ", out), n_code, n_links


def is_label(raw: str) -> bool:
    """A block that begins with bold text and a colon right behind it."""
    return bool(re.match(r"\s*(\*\*|__)(?=\S)(.+?)(?<=\S)\1\s*:", raw, re.S))


def scan(source: str) -> Scan:
    out = Scan()
    _blocks([(i, line) for i, line in enumerate(source.split("\n"))], out, "paragraph", False)
    return out


def _leaf(rows: list[tuple[int, str]], kind: str, quoted: bool, out: Scan) -> None:
    raw = "\n".join(line.strip() for _, line in rows)
    text, n_code, n_links = visible(raw)
    out.code_inline += n_code
    out.links += n_links
    out.inline.append((rows[0][0], rows[-1][0], raw))
    if not quoted and text.strip():
        out.units.append((text.strip(), rows[0][0] + 1, rows[-1][0] + 1, kind, is_label(raw)))


def _blocks(rows: list[tuple[int, str]], out: Scan, kind: str, quoted: bool) -> None:
    """Blocks of one container, given its lines without the container's own marks."""
    at, n = 0, len(rows)
    para: list[tuple[int, str]] = []

    def close() -> None:
        if para:
            _leaf(para[:], kind, quoted, out)
            para.clear()

    while at < n:
        line_no, line = rows[at]
        if not line.strip():
            close()
            at += 1
        elif (m := FENCE.match(line)) is not None:
            close()
            end = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            stop = next((k for k in range(at + 1, n) if end.match(rows[k][1])), n)
            if stop == n and kind == "list_item":
                out.sound = False
            last = rows[min(stop, n - 1)][0] + 1
            out.code.append((line_no, last))
            at = stop + 1
        elif QUOTE.match(line):
            close()
            stop = at
            while stop < n and rows[stop][1].strip() and (QUOTE.match(rows[stop][1]) or not _starts(rows[stop][1])):
                stop += 1
            if not quoted:
                out.quotes.append((line_no, rows[stop - 1][0] + 1))
            _blocks([(i, QUOTE.sub("", x, count=1)) for i, x in rows[at:stop]], out, kind, True)
            at = stop
        elif para and SETEXT.match(line):
            _leaf([*para], "heading", quoted, out)
            para.clear()
            at += 1
        elif RULE.match(line):
            close()
            at += 1
        elif (m := ATX.match(line)) is not None:
            close()
            _leaf([(line_no, m[2] or "")], "heading", quoted, out)
            at += 1
        elif (m := ITEM.match(line)) is not None and not (para and (not line[m.end() :].strip() or (m[2][0].isdigit() and m[2][:-1] != "1"))):
            close()
            pad = len(m[0]) if m[3].strip(" \t") == "" and 1 <= len(m[3]) <= 4 else len(m[1]) + len(m[2]) + 1
            body = [(line_no, line[pad:])]
            stop, blank = at + 1, False
            while stop < n:
                x = rows[stop][1]
                if not x.strip():
                    blank = True
                elif len(x) - len(x.lstrip(" ")) >= pad:
                    blank = False
                elif blank or _starts(x):
                    break
                body.append((rows[stop][0], x[pad:] if x[:pad].strip() == "" else x.lstrip()))
                stop += 1
            _blocks(body, out, "list_item", quoted)
            at = stop
        elif not para and line.startswith(("    ", "\t")):
            stop = at
            while stop < n and (rows[stop][1].startswith(("    ", "\t")) or not rows[stop][1].strip()):
                stop += 1
            while not rows[stop - 1][1].strip():
                stop -= 1
            out.code.append((line_no, rows[stop - 1][0] + 1))
            at = stop
        elif not para and HTML.match(line):
            while at < n and rows[at][1].strip():
                at += 1
        else:
            if not para and DEFINITION.match(line):
                out.sound = False
            para.append((line_no, line))
            at += 1
    close()


def _starts(line: str) -> bool:
    """Whether a line starts a block of its own, so that it doesn't continue a paragraph lazily."""
    return bool(FENCE.match(line) or ATX.match(line) or RULE.match(line) or ITEM.match(line) or QUOTE.match(line))


def describe(source: str | None) -> dict:
    """The row of RESULT for one document."""
    source = source or ""
    got = scan(source)
    raw, starts = source.encode(), [0]
    for line in source.split("\n"):
        starts.append(starts[-1] + len(line.encode()) + 1)
    size = len(raw)

    def span(a: int, b: int, kind: str) -> dict | None:
        s, e = starts[a], min(size, starts[b])
        while e > s and raw[e - 1 : e] in (b"\n", b"\r"):
            e -= 1
        return {"start_byte": s, "end_byte": e, "kind": kind} if e > s else None

    spans = [span(a, b, "code") for a, b in got.code] + [span(a, b, "blockquote") for a, b in got.quotes]
    lines = source.split("\n")
    for a, b, text in got.inline:
        found = list(CODE.finditer("\n".join(lines[a : b + 1])))
        if len(found) != visible(text)[1]:
            continue  # the block's code spans can't be told from escapes: leave them out rather than misplace them
        segment = "\n".join(lines[a : b + 1])
        for m in found:
            s = starts[a] + len(segment[: m.start()].encode())
            spans.append({"start_byte": s, "end_byte": s + len(m[0].encode()), "kind": "identifier" if IDENTIFIER.match(m[2].strip()) else "inline_code"})
    units = [{"text": t, "line_start": a, "line_end": b, "structural_type": k, "is_label": x} for t, a, b, k, x in got.units]
    return {
        "status": "ok" if got.sound else "capability_unavailable",
        "units": units if got.sound else None,
        "spans": [s for s in spans if s],
        "fence_lines": len(FENCE_LINE.findall(source)),
        "code_blocks": len(got.code),
        "code_inline": got.code_inline,
        "parsed_links": got.links,
        "broken_links": max(0, len(OPENER.findall(source)) - got.links),
    }


def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([describe(t) for t in texts], columns=["status", "units", "spans", "fence_lines", "code_blocks", "code_inline", "parsed_links", "broken_links"])


def parsed(text: Column) -> Column:
    """The scan of each document, as a struct of RESULT."""
    f = F.pandas_udf(_parse, RESULT)
    return f(text)


def with_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with md (the scan) and units; units are null where the scanner can't tell."""
    d = docs.withColumn("md", parsed(F.col(text)))
    cleaned = F.transform("md.units", lambda u: F.struct(T.strip(T.strip_urls(u["text"])).alias("text"), u["line_start"].alias("line_start"), u["line_end"].alias("line_end"), u["structural_type"].alias("structural_type"), u["is_label"].alias("is_label")))
    return d.withColumn("units", F.filter(cleaned, lambda u: u["text"] != ""))


def damage(original: Column, revision: Column) -> Column:
    """Codes of structural damage between two scans, empty where there is none."""
    tests = {
        "unbalanced_fences": revision["fence_lines"] % 2 != 0,
        "code_blocks_changed": revision["code_blocks"] != original["code_blocks"],
        "links_broken": revision["broken_links"] > original["broken_links"],
        "code_spans_dropped": revision["code_inline"] < original["code_inline"],
    }
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
