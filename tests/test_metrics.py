from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prosespark.operators import genre, metrics, recommend


def prepared(spark, *texts):
    return metrics.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_distribution_and_dispersion(spark):
    d = prepared(spark, "a b. a b c d. a.", "", None)
    rows = {r.doc_id: r for r in metrics.sentence_length_distribution(d).collect()}
    assert (rows[0].n_sentences, rows[0].min_words, rows[0].median, rows[0].max_words, rows[0].mean) == (3, 1, 2.0, 4, 2.333)
    assert rows[1].n_sentences == 0 and rows[1].mean is None
    got = {r.doc_id: r for r in metrics.sentence_length_dispersion(d).collect()}
    assert (got[0].iqr_over_median, got[0].median_adjacent_diff) == (0.75, 2.5)
    assert got[1].cov is None


def test_punctuation(spark):
    r = metrics.punctuation_rates(prepared(spark, "a — b -- c --- d; e")).first()
    assert (r.em_dash, r.semicolon, r.em_dash_per_1k, r.soft_flag) == (2, 1, 400.0, True)


@pytest.mark.parametrize(
    ("metric", "text", "n", "flag"),
    [
        ("negative_parallelism", "Care, not haste. It is not a toy, but a tool.", 2, False),
        ("rule_of_three", "red, green, and blue", 1, None),
        ("transition_clusters", "However, no. Howevering on. As a result it fell.", 2, True),
        ("vague_attribution", "Studies show it. Experts say so.", 2, None),
        ("stock_lexical_clusters", "In conclusion, it is not only big but also red.", 2, None),
        ("generic_diction", "A robust, scalable and truly bespoke thing; robustness.", 4, True),
        ("adjective_requirements", "It must be very fast. It should look odd.", 1, True),
    ],
)
def test_phrases(spark, metric, text, n, flag):
    r = metrics.phrase_counts(prepared(spark, text), metric).first()
    assert (r["count"], r.soft_flag) == (n, flag)


def test_runs_and_openers(spark):
    text = "One. Two.\n\nA. B.\n\nC. D.\n\nAlone."
    r = metrics.paragraph_runs(prepared(spark, text)).collect()
    assert [(x.sentences_each, x.paragraphs, x.line_start, x.line_end) for x in r] == [(2, 3, 1, 5)]
    got = metrics.opener_clusters(prepared(spark, "The cat sat. The cat ran. The cat hid. Odd one out.")).collect()
    assert sorted((x.prefix_len, x.prefix, x.sentences) for x in got) == [(1, "the", 3), (2, "the cat", 3)]


def test_locations_are_capped_and_counts_are_not(spark):
    d = prepared(spark, "Care, not haste. " * 30)
    assert metrics.locations(d).where("metric = 'negative_parallelism'").count() == 25
    assert metrics.phrase_counts(d, "negative_parallelism").first()["count"] == 30


def test_envelope_has_a_row_a_metric(spark):
    d = metrics.prepared(genre.classify(spark.createDataFrame([(1, "The user story has acceptance criteria.", )], "doc_id bigint, text string")))
    rows = metrics.envelope(d, "genre").collect()
    assert len(rows) == 13 and {r.purpose for r in rows} == {"candidate_selection_only"}


def test_genre_precedence(spark):
    df = spark.createDataFrame([("RFC", "a/prd.md", "x"), ("odd", "docs/prd.md", "x"), (None, None, "I me my I"), (None, None, "it must, it shall, it is required"), (None, None, "x")], "declared string, path string, text string")
    got = genre.classify(df, "declared", "path").select("genre", "genre_confidence").collect()
    assert [tuple(r) for r in got] == [("spec", "high"), ("prd", "medium"), ("personal", "medium"), ("spec", "medium"), ("spec", "low")]


def test_recommendations(spark):
    got = {(r.genre, r.metric): r.recommendation for r in recommend.table(spark).collect()}
    assert got["general", "rule_of_three"] == "strip" and got["spec", "rule_of_three"] == "keep"
    assert got["personal", "punctuation_rates"] == "keep" and got["prd", "sentence_length_distribution"] == "keep"
    df = spark.createDataFrame([("poem", "rule_of_three")], "genre string, metric string")
    with pytest.raises(Exception, match="unknown genre"):
        df.select(recommend.recommend(F.col("genre"), F.col("metric"))).collect()


def test_learning_only_ever_keeps(spark):
    log = spark.createDataFrame([("general", "rule_of_three", "strip", "discard")] * 3 + [("general", "generic_diction", "strip", "apply")] * 9, "genre string, metric string, recommendation string, user_action string")
    overlay = recommend.learn(log)
    assert [(r.genre, r.metric_class, r.score) for r in overlay.collect()] == [("general", "cadence", 3.0)]
    f = spark.createDataFrame([("general", "rule_of_three", "strip"), ("general", "generic_diction", "strip"), (None, "rule_of_three", "strip"), ("spec", "rule_of_three", "keep")], "genre string, metric string, recommendation string")
    assert [r.recommendation for r in recommend.apply_overlay(f, overlay).collect()] == ["keep", "strip", "keep", "keep"]
