"""Documents to units, sentences, line starts and invariant segments. All narrow: nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.functions import text as T


def with_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `units`, an array of (text, line_start, line_end, structural_type, is_label)."""
    return T.once(docs, units=T.line_units(F.col(text)))


def with_sentences(docs: DataFrame) -> DataFrame:
    """docs that have units, with `sentences`, an array of (sentence, unit_idx, line_start, line_end), and `unit_sizes`, their number in each unit."""
    parts = T.once(docs, __parts=T.unit_parts(F.col("units")))
    return T.once(parts, sentences=T.unit_sentences(F.col("units"), F.col("__parts")), unit_sizes=F.transform("__parts", F.size)).drop("__parts")


def units(docs: DataFrame) -> DataFrame:
    """A row a unit, of documents that have units already or not."""
    return (docs if "units" in docs.columns else with_units(docs)).select("doc_id", F.posexplode("units").alias("unit_idx", "u")).select("doc_id", "unit_idx", "u.*")


def sentences(docs: DataFrame) -> DataFrame:
    """A row a sentence, in document order."""
    rows = with_sentences(with_units(docs)).select("doc_id", F.posexplode("sentences").alias("sent_idx", "s"))
    return rows.select("doc_id", "sent_idx", "s.*", T.count_words(F.col("s.sentence")).alias("n_words"))


def line_starts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The byte where each line starts, and a last row with the document's length."""
    rows = T.once(docs.select("doc_id", text), __starts=starts_of(F.col(text))).select("doc_id", F.posexplode("__starts").alias("line", "start_byte"))
    return rows.select("doc_id", (F.col("line") + 1).alias("line"), F.col("start_byte").cast("bigint").alias("start_byte"))


def starts_of(text: Column) -> Column:
    """The byte where each line starts, and the document's length, as an array."""
    ends = T.running(F.transform(F.split(text, "\n", -1), lambda x: (F.octet_length(x) + 1).cast("int")))
    return T.let(ends, lambda e: F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1), F.array(F.octet_length(text))))


def byte_spans(segs: Column) -> Column:
    """(text, start_byte, end_byte) of each segment's extent without white space at its ends."""
    rows, sizes = segs["rows"], segs["sizes"]
    ends = T.running(sizes)

    def one(r: Column, end: Column) -> Column:
        lead = F.octet_length(r["seg"]) - F.octet_length(F.ltrim(r["seg"], F.lit(T.SPACES)))
        body = T.strip(r["seg"])
        start = end - F.octet_length(r["seg"]) + lead
        return F.struct(body.alias("text"), start.alias("start_byte"), (start + F.octet_length(body)).alias("end_byte"))

    return F.filter(F.zip_with(rows, ends, one), lambda s: s["text"] != "")


def segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row an invariant segment: doc_id, seg_idx, text, start_byte, end_byte."""
    rows = T.once(docs, __segs=T.segments(F.col(text))).select("doc_id", F.posexplode(byte_spans(F.col("__segs"))).alias("seg_idx", "s"))
    return rows.select("doc_id", "seg_idx", "s.*")
