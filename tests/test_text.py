from __future__ import annotations

from pyspark.sql import functions as F

from prosespark.functions import atoms as A
from prosespark.functions import text as T
from prosespark.operators import extract


def value(spark, text, column):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string").select(column(F.col("text")).alias("v")).first()["v"]


def test_units_keep_lines_and_skip_blank_ones(spark):
    got = value(spark, "one\n two \n\n \nthree\n", T.line_units)
    assert [(u.text, u.line_start, u.line_end) for u in got] == [("one two", 1, 2), ("three", 5, 5)]
    assert value(spark, "", T.line_units) == []
    assert value(spark, None, T.line_units) is None
    assert value(spark, "https://example.com/x", T.line_units) == []


def test_sentences_mind_abbreviations(spark):
    got = value(spark, "He met Dr. Smith at 5 p.m. today. Really?! Yes. e.g. this", T.sentences)
    assert got == ["He met Dr. Smith at 5 p.m. today.", "Really?!", "Yes.", "e.g. this"]
    assert value(spark, "   ", T.sentences) == []


def test_urls_go_and_punctuation_stays(spark):
    got = value(spark, "See https://a.example/b?c=1, or www.b.test/x. Or docs.example.io; not a@b.com!", T.strip_urls)
    assert got == "See  , or  . Or  ; not a@b.com!"


def test_words_have_letters_and_inner_apostrophes(spark):
    assert value(spark, "don't stop 3 naïve’s x_y", T.words) == ["don't", "stop", "naïve’s", "x", "y"]


def test_segments_give_byte_ranges(spark):
    text = "é one. Two 3!\n\n  four  "
    rows = extract.segments(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("seg_idx").collect()
    raw = text.encode()
    assert [raw[r.start_byte : r.end_byte].decode() for r in rows] == ["é one.", "Two 3!", "four"] == [r.text for r in rows]


def test_line_starts(spark):
    rows = extract.line_starts(spark.createDataFrame([(1, "é\n\nab")], "doc_id bigint, text string")).orderBy("line").collect()
    assert [(r.line, r.start_byte) for r in rows] == [(1, 0), (2, 3), (3, 4), (4, 6)]


def test_atoms(spark):
    assert value(spark, "≥ 1,200.5% and -3 of 10", A.numbers) == [">=1200.5%", "-3", "10"]
    assert value(spark, "200 ms or 5%", A.quantities) == ["200|ms", "5|%"]
    assert value(spark, "You MUST  not, may, cannot", A.modality) == ["must not", "may", "cannot"]
    assert value(spark, "It isn't no never", A.negation) == ["n't", "no", "never"]
    assert value(spark, "only if so, when", A.conditions) == ["only if", "when"]
    assert value(spark, "on 2024-01-02 or Mar 3, 2020", A.dates) == ["2024-01-02", "Mar 3, 2020"]
    assert value(spark, "[1] and (Miller 2019)", A.citations) == ["[1]", "(Miller 2019)"]
    assert value(spark, "at http://x.y/z, ok", A.urls) == ["http://x.y/z"]
    assert value(spark, "\"X\" means y if 3 must not", A.checks_in) == ["numbers", "units", "modality", "negation", "conditions", "defined_terms"]
