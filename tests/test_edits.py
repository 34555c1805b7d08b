from __future__ import annotations

import base64
import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosespark.operators import edits as E
from prosespark.operators import ledger, spans, verify

SCHEMA = f"doc_id bigint, content binary, edits array<{E.EDIT}>"


def case(doc_id, text, *edits):
    return (doc_id, bytearray(text.encode()), [(a, b, bytearray(r.encode()), None) for a, b, r in edits])


def run(spark, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, SCHEMA).orderBy("doc_id").select(column).collect()]


def test_problems_and_splice(spark):
    rows = [case(0, "abcdef", (1, 3, "X"), (5, 5, "Y")), case(1, "abc", (2, 9, "")), case(2, "abcd", (0, 2, ""), (1, 3, "")), case(3, "abcd", (1, 1, "x"), (1, 1, "y")), case(4, "é", (0, 2, "e"))]
    assert run(spark, rows, E.problems(F.col("content"), F.col("edits"))) == [[], ["out_of_bounds"], ["overlap"], ["double_insertion"], []]
    got = run(spark, rows, E.apply(F.col("content"), F.col("edits")))
    assert [None if x is None else bytes(x) for x in got] == [b"aXdeYf", None, None, None, b"e"]


def test_region_status(spark):
    rows = [case(0, "0123456789", (2, 4, "")), case(1, "0123456789", (3, 5, "xyz")), case(2, "0123456789", (0, 10, "")), case(3, "0123456789", (1, 4, "")), case(4, "0123456789", (6, 6, "in"))]
    s, e = F.lit(2).cast("bigint"), F.lit(6).cast("bigint")
    assert run(spark, rows, E.region_status(F.col("edits"), s, e)) == ["modified", "modified", "deleted", "ambiguous", "unchanged"]
    assert run(spark, rows, E.map_offset(F.col("edits"), e)) == [4, 7, None, 3, 8]


def test_wire_scripts(spark):
    wire = json.dumps([{"start_byte": 0, "end_byte": 1, "replacement_b64": base64.b64encode(b"Z").decode(), "preimage_sha256": hashlib.sha256(b"a").hexdigest()}, {"start_byte": 2, "end_byte": 3}])
    row = spark.createDataFrame([(bytearray(b"abc"), wire)], "content binary, wire string").withColumn("edits", E.parse(F.col("wire"))).select(E.apply(F.col("content"), F.col("edits")), E.problems(F.lit(b"xbc"), F.col("edits"))).first()
    assert bytes(row[0]) == b"Zb" and row[1] == ["preimage_mismatch"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abé ", max_size=12), st.text("abé ", max_size=12)), min_size=1, max_size=8))
def test_derived_scripts_rebuild_the_revision(spark, pairs):
    df = spark.createDataFrame([(bytearray(a.encode()), bytearray(b.encode())) for a, b in pairs], "original binary, revision binary")
    for r in E.derive(df).withColumn("again", E.apply(F.col("original"), F.col("edits"))).collect():
        assert r.again == r.revision


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)), min_size=1, max_size=12))
def test_merged_ranges_are_disjoint_and_cover_the_same(spark, ranges):
    df = spark.createDataFrame([(1, a, a + n) for a, n in ranges], "doc_id bigint, start_byte bigint, end_byte bigint")
    got = sorted((r.start_byte, r.end_byte) for r in spans.merge(df).collect())
    assert all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))
    assert {i for a, b in got for i in range(a, b)} == {i for a, n in ranges for i in range(a, a + n)}


TEXT = "It must not take 200 ms. See https://example.com/a now. If it fails, stop. Fine words here."


def at(s):
    a = TEXT.index(s)
    return a, a + len(s)


@pytest.fixture(scope="module")
def verdicts(spark):
    hostile = [
        [(*at("200"), "300")],
        [(*at("must not"), "may not")],
        [(*at(" not"), "")],
        [(*at("example.com"), "example.org")],
        [(*at("If it fails, stop."), "")],
        [(*at("Fine words"), "Robust words")],
        [(*at("Fine words"), "Good words")],
        [(*at("take 200 ms. See"), "x")],
    ]
    cases = spark.createDataFrame([case(i, TEXT, *e) for i, e in enumerate(hostile)], SCHEMA).withColumn("said", F.lit("clean"))
    docs = spark.createDataFrame([(i, TEXT) for i in range(len(hostile))], "doc_id bigint, text string")
    whole = docs.select("doc_id", F.lit(0).cast("bigint").alias("start_byte"), F.octet_length("text").cast("bigint").alias("end_byte"))
    out = verify.verify(cases, ledger.entries(ledger.regions(docs)), spans.url_spans(docs), whole, "said")
    return {r.doc_id: r for r in out.collect()}, cases, docs, whole


def test_hostile_edits_are_rejected(verdicts):
    rows = verdicts[0]
    assert [rows[i].decision for i in range(8)] == ["REJECT"] * 6 + ["ACCEPT", "ASK"] or rows[7].decision in ("ASK", "REJECT")
    assert [rows[i].decision for i in range(7)] == ["REJECT"] * 6 + ["ACCEPT"]
    assert rows[6].shippable and not rows[0].shippable


def test_verdicts_fail_closed(verdicts):
    _, cases, docs, whole = verdicts
    none = whole.where("doc_id < 0")
    entries, urls = ledger.entries(ledger.regions(docs)), spans.url_spans(docs)
    got = {r.doc_id: r.decision for r in verify.verify(cases, entries, urls, none, "said").collect()}
    assert got[6] == "REJECT"  # no range authorizes it
    got = {r.doc_id: r.decision for r in verify.verify(cases.withColumn("has_ranges", F.lit(None).cast("boolean")), entries, urls, none, "said").collect()}
    assert got[6] == "ASK"
    assert {r.doc_id: r.decision for r in verify.verify(cases, entries, urls, whole).collect()}[6] == "SURFACE"
    assert {r.doc_id: (r.decision, r.shippable) for r in verify.verify(cases, entries, urls, whole, two_layer=True).collect()}[6] == ("ACCEPT", False)
    odd = cases.withColumn("said", F.lit("maybe"))
    assert {r.doc_id: r.decision for r in verify.verify(odd, entries, urls, whole, "said").collect()}[6] == "SURFACE"


def test_hunks_and_withheld_components(spark):
    rows = [case(1, TEXT, (*at("200"), "300"), (*at("Fine"), "Good"))]
    cases = spark.createDataFrame(rows, SCHEMA)
    docs = spark.createDataFrame([(1, TEXT)], "doc_id bigint, text string")
    l2 = verify.layer2(cases, ledger.entries(ledger.regions(docs)))
    assert [r.decision for r in verify.hunk_decisions(cases, l2.select("doc_id", "disposition", "hunks")).orderBy("hunk").collect()] == ["REJECT", "ACCEPT"]
    assert [(r.hunk, r.applied) for r in verify.withhold(cases, l2).orderBy("hunk").collect()] == [(0, False), (1, True)]


FENCED = "Plain words.\n\n```\ncode\n```\n\nMore `code` and [a](b) words."


def test_damage_to_markdown_is_rejected(spark):
    def edit(old, new):
        a = FENCED.index(old)
        return a, a + len(old), new

    scripts = [[edit("\n```\n\nMore", "\n\nMore")], [edit("`code` and", "`code and")], [edit("](b)", "](b")], [edit("Plain", "Simple")], []]
    cases = spark.createDataFrame([case(i, FENCED, *e) for i, e in enumerate(scripts)], SCHEMA).withColumn("said", F.lit("clean"))
    docs = spark.createDataFrame([(i, FENCED) for i in range(5)], "doc_id bigint, text string")
    whole = docs.select("doc_id", F.lit(0).cast("bigint").alias("start_byte"), F.octet_length("text").cast("bigint").alias("end_byte"))
    got = {r.doc_id: r for r in verify.verify(cases, ledger.entries(ledger.regions(docs)), spans.url_spans(docs), whole, "said").collect()}
    assert [got[i].decision for i in range(5)] == ["REJECT"] * 3 + ["ACCEPT"] * 2 and [got[i].n_structure > 0 for i in range(5)] == [True] * 3 + [False] * 2


def test_a_false_ledger_is_rejected_before_anything_else(verdicts):
    _, cases, docs, whole = verdicts
    few = cases.where("doc_id < 3")
    entries, urls = ledger.entries(ledger.regions(docs)), spans.url_spans(docs)
    false = entries.withColumn("text_hash", F.when(F.col("doc_id") == 0, F.lit("0" * 64)).otherwise(F.col("text_hash"))).withColumn("confidence", F.when(F.col("doc_id") == 1, F.lit(1001)).otherwise(F.col("confidence")))
    got = verify.verify(few, false, urls.withColumn("sha256", F.when(F.col("doc_id") == 2, F.lit("0")).otherwise(F.col("sha256"))), whole, "said").collect()
    assert len(got) == 3 and {(r.decision, r.n_ledger, r.semantic_status, r.n_reject, r.shippable) for r in got} == {("REJECT", 1, "not_run", 0, False)}


def test_findings_without_hunks_leave_none_revertable(spark):
    outputs = ["e0_numbers@0", "e0_numbers@other", "", '{"verdict":"real","concerns":"x"}', '{"verdict":"real","concerns":["x"]}', '{"verdict":"clean"}', '{"verdict":"clean"}', "whole"]
    texts = [(at("Fine words"), "Good words")] * 6 + [(at("Fine words"), "Robust words"), (at("200"), "")]
    cases = spark.createDataFrame([case(i, TEXT, (*place, new)) for i, (place, new) in enumerate(texts)], SCHEMA)
    docs = spark.createDataFrame([(i, TEXT) for i in range(8)], "doc_id bigint, text string")
    whole = docs.select("doc_id", F.lit(0).cast("bigint").alias("start_byte"), F.octet_length("text").cast("bigint").alias("end_byte"))
    entries, urls = ledger.entries(ledger.regions(docs)), spans.url_spans(docs)
    own, other = (tuple(r)[:2] for r in entries.where("doc_id = 0").select("start_byte", "end_byte").distinct().orderBy("start_byte").collect()[:2])

    def said(ids, *ranges):
        return json.dumps({"verdict": "real", "concerns": [{"entry_ids": ids, "original_ranges": [{"start_byte": a, "end_byte": b} for a, b in ranges]}]})

    outputs[0], outputs[1], outputs[2], outputs[7] = said(["e0_numbers"], own), said(["e0_numbers"], other), said([]), said(["e0_numbers"], own)
    cases = cases.join(spark.createDataFrame(list(enumerate(outputs)), "doc_id bigint, o string"), "doc_id")
    got = {r.doc_id: (r.decision, r.semantic_status) for r in verify.verify(cases, entries, urls, whole, output="o").collect()}
    hunks = {r.doc_id: (r.decision, r.revertable) for r in verify.hunk_decisions(cases, verify.found(cases, entries, urls, whole, output="o")).collect()}
    assert [got[i] for i in range(6)] == [("REJECT", "real"), ("SURFACE", "ambiguous"), ("REJECT", "real"), ("SURFACE", "ambiguous"), ("SURFACE", "ambiguous"), ("ACCEPT", "clean")]
    assert got[6] == ("REJECT", "clean") and got[7] == ("REJECT", "real")
    # a concern about another place, a global one and a new claim implicate no hunk
    assert [hunks[i][1] for i in range(8)] == [False, True, False, True, True, True, False, True] and hunks[7][0] == "REJECT" and hunks[6][0] == "ACCEPT"


def test_canonical_ledger_is_sorted_json(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Nothing here")], "doc_id bigint, text string")
    got = {r.doc_id: json.loads(r.ledger_json) for r in ledger.canonical(ledger.entries(ledger.regions(docs)), docs, spans=spans.url_spans(docs)).collect()}
    raw = ledger.canonical(ledger.entries(ledger.regions(docs)), docs, spans=spans.url_spans(docs)).where("doc_id = 1").first()
    assert raw.ledger_json == json.dumps(got[1], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[2]["entries"] == got[2]["protected_spans"] == [] and got[2]["schema_version"] == 1
    first = got[1]["entries"][0]
    assert first["source"]["start_byte"] == 0 and {e["id"]: e["extracted"] for e in got[1]["entries"]}["e0_numbers"] == {"200|ms": 1}
    assert [p["id"] for p in got[1]["protected_spans"]] == ["ps0"]


def test_semantic_verdicts(spark):
    given_ = ['{"verdict":"clean"}', '{"verdict":"real","concerns":[{"original_ranges":[{"start_byte":0,"end_byte":4}]}]}', '{"verdict":"real","concerns":[{"original_ranges":[{"start_byte":1,"end_byte":4}]}]}', "nonsense", None]
    df = spark.createDataFrame([(x,) for x in given_], "o string")
    ranges = F.array(F.struct(F.lit(0).cast("bigint").alias("start_byte"), F.lit(4).cast("bigint").alias("end_byte")))
    assert [r[0] for r in df.select(verify.semantic(F.col("o"), ranges)).collect()] == ["clean", "real", "ambiguous", "ambiguous", "ambiguous"]


def test_overlaps_resolve_greedily(spark):
    rows = [(0, 5, "url"), (0, 3, "code"), (4, 6, "url"), (5, 9, "inline_code")]
    df = spark.createDataFrame([(rows,)], "c array<struct<start_byte:int,end_byte:int,kind:string>>")
    got = df.select(spans.resolve(F.col("c"))).first()[0]
    assert [(r.start_byte, r.end_byte, r.kind) for r in got] == [(0, 3, "code"), (4, 6, "url")]
