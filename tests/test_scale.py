"""What must hold for queries to grow no faster than their input: work is done once, in its row, on all cores."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from prosespark.functions import atoms as A
from prosespark.functions import fixed
from prosespark.functions import text as T
from prosespark.operators import edits as E
from prosespark.operators import genre, ledger, metrics, spans, verify
from prosespark.sources.io import dealt

TEXT = "It must not take 200 ms. See https://example.com/a now. If it fails, stop. Fine words here."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def cases_of(spark, docs):
    edit = F.array(F.struct(F.lit(8).cast("bigint").alias("start_byte"), F.lit(11).cast("bigint").alias("end_byte"), F.lit(b"never").alias("replacement"), F.lit(None).cast("string").alias("preimage_sha256")))
    return docs.select("doc_id", F.col("text").cast("binary").alias("content"), edit.cast(f"array<{E.EDIT}>").alias("edits"), F.lit("clean").alias("said"))


def test_metrics_stay_in_their_row(spark):
    d = metrics.prepared(genre.classify(docs_of(spark, "One. Two.\n\nA. B.\n\nC. D.", "The cat sat. The cat ran. The cat hid.", None)))
    for rows in (metrics.paragraph_runs(d), metrics.opener_clusters(d), metrics.envelope(d, "genre", keep=("genre",)), metrics.locations(d, "genre")):
        assert "Exchange" not in plan(rows) and "Window" not in plan(rows)
    assert metrics.envelope(d, "genre").where("doc_id = 2").agg(F.sum("count")).first()[0] == 0


def test_openers_are_split_by_gaps_and_kept_apart_by_length(spark):
    text = "The cat sat. The dog ran. The cat hid. " + "Odd one out. Even two in. " * 5 + "The cat sat. The end."
    got = sorted((r.prefix_len, r.prefix, r.sentences, r.first_idx) for r in metrics.opener_clusters(metrics.prepared(docs_of(spark, text))).collect() if r.prefix.startswith("the"))
    assert got == [(1, "the", 3, 0)]


def test_verifying_makes_entries_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(kind):
        made.add(1)
        return kind

    docs = docs_of(spark, TEXT, TEXT)
    entries = ledger.entries(ledger.regions(docs))
    n = entries.count()
    marked = entries.withColumn("kind", F.udf(seen, "string")("kind"))
    whole = docs.select("doc_id", F.lit(0).cast("bigint").alias("start_byte"), F.octet_length("text").cast("bigint").alias("end_byte"))
    assert [r.decision for r in verify.verify(cases_of(spark, docs), marked, spans.url_spans(docs), whole, "said").collect()] == ["REJECT"] * 2
    assert made.value == n > 0


def test_claims_and_urls_are_searched_once(spark):
    docs = docs_of(spark, TEXT).repartition(2)
    found = verify.new_claims(cases_of(spark, docs))._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("[<>]=?|≤|≥|\\b") <= 2
    assert spans.url_spans(docs)._jdf.queryExecution().optimizedPlan().toString().count("https?") == 1


def test_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.range(1000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= 4 and read.groupBy(F.spark_partition_id()).count().count() == 1
        assert dealt(read).groupBy(F.spark_partition_id()).count().count() >= 16
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_plain_searches_spare_no_match(spark):
    """Letters that a pattern takes for others, against the bare patterns."""
    odd = ["It MUſT be", "İF so", "ıf it", "nothing", "CANNOT", "isn’t", "(Miller 2019)", "WWW.x.y", "Best-In-Claſſ", "Studieſ  show", "at  leaſt", "٣ ms", '"A" meanſ b', "HEREAFTER", None, "", "stop\nif"]
    df = spark.createDataFrame([(x,) for x in odd], "text string")
    bare = {"modality": (A.modality, A.MODAL), "negation": (A.negation, fixed.NEGATION), "conditions": (A.conditions, fixed.CONDITION), "urls": (A.urls, fixed.URL), "thresholds": (A.thresholds, fixed.THRESHOLD), "buzzwords": (A.buzzwords, A.BUZZWORD), "authority": (A.borrowed_authority, A.AUTHORITY)}
    for name, (f, pattern) in bare.items():
        for r in df.select("text", F.size(f(F.col("text"))).alias("a"), F.size(A.found(F.col("text"), pattern, "iU")).alias("b")).collect():
            assert r.a == r.b, (name, r)
    for r in df.select("text", F.size(A.quantities(F.col("text"))).alias("a"), F.size(A.found(F.col("text"), fixed.QUANTITY)).alias("b")).collect():
        assert r.a == r.b, r


def test_strip_and_words_are_the_patterns_they_replace(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace() or i in (0x200B, 0x180E, 0xFEFF)]
    df = spark.createDataFrame([(f"{c}a{c}b{c}\n{c}",) for c in spaces] + [("",), (" ",), ("été’s x'y 3² Ⅳ",)], "text string")
    for r in df.select("text", T.strip(F.col("text")).alias("a"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("b"), T.words(F.col("text")).alias("c"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)*"), F.lit(0)).alias("d")).collect():
        assert r.a == r.b and r.c == r.d, r


def test_running_sums_across_blocks(spark):
    xs = [i % 7 for i in range(2 * T.BLOCK + 5)]
    df = spark.createDataFrame([(xs,), ([],), ([3],), (None,)], "x array<int>")
    assert [r[0] for r in df.select(T.running(F.col("x"))).collect()] == [list(itertools.accumulate(xs)), [], [3], None]
