from __future__ import annotations

import json

from prosespark.operators import recommend
from prosespark.streaming import feedback as S


def line(i, action="discard"):
    return {"schema_version": 1, "ts": f"2024-01-01T00:00:0{i % 10}Z", "finding_id": f"f{i % 4}", "category": "cadence", "metric": "rule_of_three", "genre": "general", "recommendation": "strip", "user_action": action, "doc_sha": "a" * 64}


def test_streamed_evidence_equals_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("".join(json.dumps(line(i)) + "\n" for i in range(k * 2, k * 2 + 2)))
    stream = S.keep_evidence(S.read_feedback_stream(spark, str(src)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("evidence").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = recommend.learn(spark.read.schema(S.FEEDBACK).json(str(src)), 0.0)
    assert spark.table("evidence").collect() == batch.collect()
    once = S.deduplicated(S.read_feedback_stream(spark, str(src)))
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 4


def test_audit_on_arrival(spark, tmp_path):
    src = tmp_path / "docs"
    spark.createDataFrame([(1, "However, it rains. In conclusion, it rains.")], "doc_id bigint, text string").write.json(str(src))
    stream = S.audit_on_arrival(spark.readStream.schema("doc_id bigint, text string").json(str(src)))
    q = stream.writeStream.format("memory").queryName("audited").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("audited").first()
    assert (r.n_sentences, r.transition_clusters, r.stock_lexical_clusters) == (2, 1, 1)
