from __future__ import annotations

from pyspark.sql import functions as F

from prosespark.functions import markdown as M
from prosespark.operators import metrics, spans
from prosespark.operators.extract import with_sentences

DOC = """# Head `x` line

Para **one** with [a link](http://e.com/x) and ![pic](p.png).
Second line.

> quoted text
lazily on

- **Label**: item one
  more
  1. nested
- two

```py
code = 1
```

    indented

Setext
======
<div>
html
</div>

\\*not emphasis\\* ends."""


def test_blocks_and_inline():
    got = M.scan(DOC)
    assert got.sound and [(u[0], u[1], u[2], u[3]) for u in got.units] == [
        ("Head   line", 1, 1, "heading"),
        ("Para one with a link and  . Second line.", 3, 4, "paragraph"),
        ("Label: item one more", 9, 10, "list_item"),
        ("nested", 11, 11, "list_item"),
        ("two", 12, 12, "list_item"),
        ("Setext", 20, 20, "heading"),
        ("*not emphasis* ends.", 26, 26, "paragraph"),
    ]
    assert [u[4] for u in got.units] == [False, False, True, False, False, False, False]
    assert got.code == [(13, 16), (17, 18)] and got.quotes == [(5, 7)]


def test_spans_are_byte_exact():
    raw = DOC.encode()
    got = {raw[s["start_byte"] : s["end_byte"]].decode(): s["kind"] for s in M.describe(DOC)["spans"]}
    assert got == {"`x`": "identifier", "> quoted text\nlazily on": "blockquote", "```py\ncode = 1\n```": "code", "    indented": "code"}


def test_unknown_constructs_fail_closed(spark):
    df = spark.createDataFrame([(1, "[a]: http://x\n\ntext"), (2, None), (3, "**B**: x\n\nplain")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in M.with_units(df).select("doc_id", "md.status", "units").collect()}
    assert got[1].status == "capability_unavailable" and got[1].units is None and got[2].units == []
    d = with_sentences(M.with_units(df.where("doc_id = 3")))
    r = metrics.bold_label_density(d).first()
    assert (r.n_blocks, r.n_labels, r.rate) == (2, 1, 0.5)


def test_damage(spark):
    df = spark.createDataFrame([("a `b` c", "a `b c"), ("```\nx\n```", "```\nx"), ("[a](b)", "[a](b"), ("same", "same text")], "o string, r string")
    d = df.withColumn("o", M.parsed(F.col("o"))).withColumn("r", M.parsed(F.col("r")))
    assert [r[0] for r in d.select(M.damage(F.col("o"), F.col("r"))).collect()] == [["code_spans_dropped"], ["unbalanced_fences"], ["links_broken"], []]


def test_protected_kinds_resolve(spark):
    df = spark.createDataFrame([(1, DOC)], "doc_id bigint, text string").withColumn("md", M.parsed(F.col("text")))
    got = df.select(spans.resolve(F.col("md.spans"))).first()[0]
    assert [s.kind for s in got] == ["identifier", "blockquote", "code", "code"]
