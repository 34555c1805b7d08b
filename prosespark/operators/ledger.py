"""Invariant regions and ledger entries: what an edit must preserve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosespark.functions import atoms as A
from prosespark.functions import fixed
from prosespark.functions import text as T
from prosespark.operators import extract


def regions(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row a region: doc_id, region_idx, start_byte, end_byte, checks, region_text."""
    segs = F.transform(extract.byte_spans(F.col("__segs")), lambda s: F.struct(s["text"].alias("text"), s["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte"), A.checks_in(s["text"]).alias("checks")))
    rows = T.once(T.once(docs, __segs=T.segments(F.col(text))), __found=F.filter(segs, lambda s: F.size(s["checks"]) > 0))
    rows = rows.select("doc_id", F.posexplode("__found").alias("region_idx", "s"))
    return rows.select("doc_id", F.col("region_idx").cast("bigint").alias("region_idx"), F.col("s.start_byte").cast("bigint").alias("start_byte"), F.col("s.end_byte").cast("bigint").alias("end_byte"), F.col("s.checks").alias("checks"), F.col("s.text").alias("region_text"))


def _pick(i: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in fixed.CHECK_KIND.items() for x in (k, v[i])])[F.col("check")]


def extracted(kind: Column, text: Column) -> Column:
    """What a region's kind compares: sorted atoms, each with its group before it."""
    tag = lambda name, xs: F.transform(A.multiset(xs), lambda a: F.concat(F.lit(name + ":"), a))
    return (
        F.when(kind == "number_or_quantity", A.multiset(A.quantities(text)))
        .when(kind == "normative_statement", F.concat(tag("modals", A.modality(text)), tag("neg", A.negation(text))))
        .when(kind.isin("condition", "exception"), A.multiset(A.conditions(text)))
        .when(kind.isin("literal", "defined_term"), A.defined_terms(text))
        .when(kind == "cross_reference", F.concat(tag("cites", A.citations(text)), tag("urls", A.urls(text))))
    )


def entries(regions_: DataFrame) -> DataFrame:
    """A row a region and check: doc_id, entry_id, kind, range, text_hash, extracted, preservation, confidence, region_text."""
    rows = regions_.select("*", F.explode("checks").alias("check"))
    kind = _pick(0)
    return rows.select(
        "doc_id", F.concat(F.lit("e"), F.col("region_idx"), F.lit("_"), F.col("check")).alias("entry_id"), kind.alias("kind"), "start_byte", "end_byte",
        F.sha2(F.col("region_text"), 256).alias("text_hash"), extracted(kind, F.col("region_text")).alias("extracted"), _pick(1).alias("preservation"), _pick(2).cast("int").alias("confidence"), "region_text",
    )


def _counted(xs: Column) -> Column:
    """A multiset as a map, its atoms in order."""
    return F.map_from_entries(A.counts(xs))


def _extracted_json(kind: Column, text: Column) -> Column:
    """What a kind compares, as a canonical JSON object: atoms by count."""
    counts = lambda xs: F.to_json(_counted(xs))
    pair = lambda a, x, b, y: F.concat(F.lit(f'{{"{a}":'), counts(x), F.lit(f',"{b}":'), counts(y), F.lit("}"))
    return (
        F.when(kind == "number_or_quantity", counts(A.quantities(text)))
        .when(kind == "normative_statement", pair("modals", A.modality(text), "neg", A.negation(text)))
        .when(kind.isin("condition", "exception"), counts(A.conditions(text)))
        .when(kind.isin("literal", "defined_term"), F.to_json(F.struct(F.array_join(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), " ").alias("text"))))
        .when(kind == "cross_reference", pair("cites", A.citations(text), "urls", A.urls(text)))
        .otherwise(F.lit("{}"))
    )


def canonical(entries_: DataFrame, docs: DataFrame, text: str = "text", spans: DataFrame | None = None) -> DataFrame:
    """doc_id, ledger_json, ledger_sha256: one canonical JSON a document: keys and atoms sorted, no white space.

    entries_ need region_text; entries come by place and id, protected spans (numbered in their order) too.
    """
    source = F.struct("end_byte", "start_byte", "text_hash")
    row = F.concat(F.lit('{"confidence":'), F.col("confidence"), F.lit(',"extracted":'), _extracted_json(F.col("kind"), F.col("region_text")), F.lit(","), F.substring(F.to_json(F.struct(F.col("entry_id").alias("id"), "kind", "preservation", source.alias("source"))), 2, 1 << 30))
    grouped = entries_.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "entry_id", row.alias("json")))).alias("entries"))
    out = docs.select("doc_id", F.sha2(F.col(text), 256).alias("source_sha256")).join(grouped, "doc_id", "left")
    if spans is None:
        out = out.withColumn("spans", F.lit(""))
    else:
        placed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "sha256"))).alias("s"))
        each = F.transform("s", lambda x, i: F.to_json(F.struct(x["end_byte"].alias("end_byte"), F.concat(F.lit("ps"), i).alias("id"), x["sha256"].alias("sha256"), x["start_byte"].alias("start_byte"))))
        out = out.join(placed.select("doc_id", F.array_join(each, ",").alias("spans")), "doc_id", "left")
    whole = F.concat(F.lit('{"entries":['), F.coalesce(F.array_join(F.transform("entries", lambda e: e["json"]), ","), F.lit("")), F.lit('],"protected_spans":['), F.coalesce("spans", F.lit("")), F.lit(f'],"schema_version":{fixed.LEDGER_SCHEMA_VERSION},"source_sha256":"'), F.col("source_sha256"), F.lit('"}'))
    return out.withColumn("ledger_json", whole).select("doc_id", "ledger_json", F.sha2("ledger_json", 256).alias("ledger_sha256"))


def validate(entries_: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, entry_id, problem: what is wrong with entries against their documents' bytes."""
    content = docs.select("doc_id", F.col(text).cast("binary").alias("__c"))
    same = F.count("*").over(Window.partitionBy("doc_id", "entry_id"))
    rows = entries_.withColumn("__same", same).join(content, "doc_id", "left")
    n = F.coalesce(F.octet_length("__c"), F.lit(-1))
    inside = (F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= n)
    sha = F.sha2(F.expr("substring(__c, cast(start_byte + 1 as int), cast(end_byte - start_byte as int))"), 256)
    found = F.array(
        F.when(F.col("__same") > 1, F.lit("duplicate_id")),
        F.when(~F.col("kind").isin(*fixed.LEDGER_KINDS), F.lit("bad_kind")),
        F.when(~F.col("preservation").isin(*fixed.LEDGER_PRESERVATIONS), F.lit("bad_preservation")),
        F.when(~inside, F.lit("out_of_bounds")).when(sha != F.col("text_hash"), F.lit("text_hash_mismatch")),
        F.when(~F.col("confidence").between(0, 1000), F.lit("bad_confidence")),
    )
    return rows.select("doc_id", "entry_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def validate_spans(spans: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start_byte, end_byte, problem: what is wrong with protected spans against their documents' bytes."""
    content = docs.select("doc_id", F.col(text).cast("binary").alias("__c"))
    ahead = Window.partitionBy("doc_id").orderBy("start_byte", "end_byte")
    rows = spans.withColumn("__a", F.lead("start_byte").over(ahead)).withColumn("__b", F.lead("end_byte").over(ahead)).join(content, "doc_id", "left")
    inside = (F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.coalesce(F.octet_length("__c"), F.lit(-1)))
    sha = F.sha2(F.expr("substring(__c, cast(start_byte + 1 as int), cast(end_byte - start_byte as int))"), 256)
    found = F.array(F.when(~inside, F.lit("span_out_of_bounds")).when(sha != F.col("sha256"), F.lit("span_hash_mismatch")), F.when((F.col("end_byte") > F.col("__a")) & (F.col("start_byte") < F.col("__b")), F.lit("spans_overlap")))
    return rows.select("doc_id", "start_byte", "end_byte", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))
