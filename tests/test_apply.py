from __future__ import annotations

import json

from pyspark.sql import functions as F

from prosespark import __main__ as cli
from prosespark.operators import edits as E
from prosespark.operators import ledger, semantic, spans
from prosespark.plans import apply

TEXT = "It must not take 200 ms. Fine words here. Other words there."
SCHEMA = f"doc_id bigint, content binary, edits array<{E.EDIT}>"


def at(s):
    a = TEXT.index(s)
    return a, a + len(s)


def row(i, *edits):
    return (i, bytearray(TEXT.encode()), [(a, b, bytearray(r.encode()), None) for a, b, r in edits])


def test_selective_apply_withholds_and_verifies_again(spark):
    rows = [
        row(1, (*at("200"), "300 "), (*at("Fine"), "Good")),
        row(2, (*at("Fine"), "Good")),
        row(3, (*at("200"), "300")),
        row(4, (*at("Fine"), "Robust"), (*at("Other"), "More")),
        row(5, (*at("must not"), "may"), (*at("200 ms"), "it"), (*at("Other"), "Some")),
    ]
    cases = spark.createDataFrame(rows, SCHEMA)
    docs = spark.createDataFrame([(i, TEXT) for i in range(1, 6)], "doc_id bigint, text string")
    whole = docs.select("doc_id", F.lit(0).cast("bigint").alias("start_byte"), F.octet_length("text").cast("bigint").alias("end_byte"))
    got = {r.doc_id: (r.status, r.withheld, bytes(r.revision).decode()) for r in apply.selective(cases, ledger.entries(ledger.regions(docs)), spans.url_spans(docs), whole).collect()}
    good = TEXT.replace("Fine", "Good")
    assert got[2] == ("applied", 0, good) and got[3] == ("unchanged", 1, TEXT)
    assert got[4] == ("blocked", 0, TEXT)  # a new claim implicates no hunk
    assert got[5] == ("applied", 2, TEXT.replace("Other", "Some"))
    assert got[1] in (("applied", 1, good), ("blocked", 0, TEXT))


def test_judges_never_upgrade(spark):
    df = spark.createDataFrame([("a", "b", "{}")], "original string, revision string, ledger_json string")
    first = lambda judge: df.transform(lambda d: semantic.judged(d, judge)).first()
    r = first(semantic.offline_stub)
    assert (r.said, r.semantic_mode) == ("clean", "offline_stub")

    def broken(*_):
        raise RuntimeError("no")

    assert first(broken).said == "ambiguous" and first(lambda *_: "clean").said == "ambiguous"
    assert first(lambda *_: '```json\n{"verdict": "real"}\n```').said == "real"
    assert semantic.parse_answer(json.dumps({"verdict": "clean", "concerns": [{}] * 51})) is None
    m = spark.createDataFrame([("opal", "opal-4"), ("opal", "opalescent"), ("opal", None)], "a string, b string")
    assert [x[0] for x in m.select(semantic.confirms_model(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert json.loads(df.select(semantic.request(F.col("original"), F.col("revision"), F.col("ledger_json"))).first()[0]) == {"ledger": "{}", "original": "a", "revision": "b"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# Head\n\nHowever, it rains. Studies show it.\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    assert cli.main(["audit", "--format", "markdown", str(tmp_path / "a.md")]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert {m["metric"]: m["count"] for m in got["metrics"]}["transition_clusters"] == 1 and "rains" not in json.dumps(got)
    assert cli.main(["scan", "--format", "text", str(tmp_path / "b.txt")]) == 1
    (tmp_path / "c.md").write_text("[x]: http://y\n")
    assert cli.main(["scan", "--format", "markdown", str(tmp_path / "c.md")]) == 10
