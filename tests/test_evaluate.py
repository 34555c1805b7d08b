from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from prosespark.operators import edits as E
from prosespark.operators import evaluate

sha = lambda b: hashlib.sha256(b).hexdigest()


def test_envelopes_chain_by_digest(spark):
    edit = [(0, 1, bytearray(b"X"), None)]
    rows = [("a", 1, None, edit, sha(b"Xbc")), ("a", 2, sha(b"Xbc"), [], sha(b"Xbc")), ("b", 1, None, edit, "0" * 64), ("b", 2, sha(b"Xbc"), [], sha(b"Xbc")), ("c", 1, None, edit, sha(b"Xbc")), ("c", 2, "1" * 64, [], sha(b"Xbc"))]
    c = spark.createDataFrame(rows, f"fixture string, pass_index int, base_hash string, edits array<{E.EDIT}>, revision_sha256 string")
    o = spark.createDataFrame([(x, bytearray(b"abc")) for x in "abc"], "fixture string, content binary")
    got = {(r.fixture, r.pass_index): r.problem for r in evaluate.reconstruct(c, o).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("b", 1): "revision_sha256_mismatch", ("b", 2): "no_base", ("c", 1): None, ("c", 2): "base_hash_mismatch"}


def test_gates_and_states(spark):
    f = spark.createDataFrame([("a", False, bytearray(b"x"), bytearray(b"y")), ("b", True, bytearray(b"x"), bytearray(b"y")), ("c", True, bytearray(b"x"), bytearray(b"x"))], "fixture string, control boolean, content binary, revision binary")
    gates = evaluate.gate_rows(f, {"edit_locality": f.where("fixture = 'a'")}, f.where("fixture <> 'c'"))
    assert {r.fixture: r.state for r in evaluate.acceptance(gates).collect()} == {"a": "FAIL", "b": "FAIL", "c": "INCOMPLETE"}
    assert evaluate.matrix(f, spark.createDataFrame([("x",), ("y",)], "baseline string")).count() == 6


def test_candidates(spark):
    docs = spark.createDataFrame([(1, "é old old"), (2, "none")], "doc_id bigint, text string")
    r = spark.createDataFrame([(1, "old", "new"), (2, "old", "new")], "doc_id bigint, before string, after string")
    got = evaluate.keyed_repair(docs, r).join(docs, "doc_id").orderBy("doc_id").select(E.apply(F.col("text").cast("binary"), F.col("edits"))).collect()
    assert [bytes(x[0]).decode() for x in got] == ["é new old", "none"]
    pairs = evaluate.policy_revision(docs, [("old", "mid"), ("mid", "new")])
    assert sorted(bytes(x.revision).decode() for x in pairs.collect()) == ["none", "é new new"]


def test_trials_that_fail_are_errors(spark):
    df = spark.createDataFrame([("good", "o", "r", "b"), ("bad", "o", "boom", "b")], "case_id string, original string, revision string, baseline string")

    def judge(o, r, b):
        if r == "boom":
            raise RuntimeError
        return {"candidate": {str(i): 2 for i in range(9)}, "baseline": {str(i): 1 for i in range(9)}}

    got = {x.case_id: (x.errored, x.beat) for x in evaluate.judge(evaluate.run_trials(df, judge)).collect()}
    assert got == {"good": (False, True), "bad": (True, False)}
