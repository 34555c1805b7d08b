"""Interval algebra: overlap semi-join, merge, containment, greedy resolution; byte ranges are half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosespark.functions import text as T
from prosespark.operators.recommend import recommend


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open overlap; a range of no width overlaps nothing at its edges."""
    return (a1 > b0) & (a0 < b1)


def diagnosed_lines(locations: DataFrame, genre: Column) -> DataFrame:
    """doc_id, line_start, line_end of locations whose metric the genre strips."""
    rows = locations.where(recommend(genre, F.col("metric")) == "strip").where("line_start is not null")
    return rows.select("doc_id", "line_start", F.coalesce("line_end", "line_start").alias("line_end")).distinct()


def units_diagnosed(units: DataFrame, lines: DataFrame) -> DataFrame:
    """Units that a diagnosed line range touches (interval-overlap semi-join within a document)."""
    d = lines.select(F.col("doc_id").alias("__d"), F.col("line_start").alias("__a"), F.col("line_end").alias("__b"))
    return units.join(d, (F.col("doc_id") == F.col("__d")) & (F.col("line_end") >= F.col("__a")) & (F.col("line_start") <= F.col("__b")), "left_semi")


def merge(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merge ranges that overlap or touch: key, start_byte, end_byte."""
    w = Window.partitionBy(key).orderBy("start_byte", "end_byte")
    reach = F.max("end_byte").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.coalesce((F.col("start_byte") > reach).cast("int"), F.lit(1)))
    return marked.withColumn("__run", F.sum("__new").over(w)).groupBy(key, "__run").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")).drop("__run")


def line_bytes(text: Column) -> Column:
    """Bytes before each line, as an array with the document's length last: one pass per line over its own prefix."""
    lines = F.split(text, "\n", -1)
    folded = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.octet_length(x) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.octet_length(x) + 1)).alias("out")),
        lambda acc: acc["out"],
    )
    return F.concat(F.slice(folded, F.lit(1), F.size(folded) - 1), F.array(F.octet_length(text)))


def unit_bytes(units: DataFrame, starts: DataFrame) -> DataFrame:
    """units with start_byte and end_byte; the end is where the next line starts, so it takes the line feed."""
    a = starts.select(F.col("doc_id").alias("__d"), F.col("line").alias("__l"), F.col("start_byte"))
    b = starts.select(F.col("doc_id").alias("__e"), F.col("line").alias("__m"), F.col("start_byte").alias("end_byte"))
    out = units.join(a, (F.col("doc_id") == F.col("__d")) & (F.col("line_start") == F.col("__l")))
    return out.join(b, (F.col("doc_id") == F.col("__e")) & (F.col("line_end") + 1 == F.col("__m"))).drop("__d", "__l", "__e", "__m")


def authorized_ranges(units: DataFrame, starts: DataFrame, locations: DataFrame, genre: Column) -> DataFrame:
    """The byte ranges that edits may touch: units under a diagnosis that the genre strips, merged."""
    spans = unit_bytes(units_diagnosed(units, diagnosed_lines(locations, genre)), starts)
    return merge(spans.select("doc_id", F.col("start_byte").cast("bigint").alias("start_byte"), F.col("end_byte").cast("bigint").alias("end_byte")))


def overlapping_neighbours(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Neighbours (by start) that overlap."""
    w = Window.partitionBy(key).orderBy("start_byte", "end_byte")
    rows = ranges.withColumn("next_start", F.lead("start_byte").over(w)).withColumn("next_end", F.lead("end_byte").over(w))
    return rows.where(overlaps(F.col("start_byte"), F.col("end_byte"), F.col("next_start"), F.col("next_end")))


PRIORITY = {"code": 0, "blockquote": 0, "inline_code": 1, "identifier": 1, "url": 2}


def resolve(candidates: Column) -> Column:
    """Greedy choice in an array of (start_byte, end_byte, kind): earlier start, then kind, then length; disjoint."""
    rank = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), c["kind"]), F.lit(9))
    keyed = F.array_sort(F.transform(candidates, lambda c: F.struct(c["start_byte"].alias("start_byte"), rank(c).alias("rank"), (-(c["end_byte"] - c["start_byte"])).alias("neg_len"), c["end_byte"].alias("end_byte"), c["kind"].alias("kind"))))
    kept = F.aggregate(
        keyed,
        F.struct(F.lit(-1).cast("int").alias("end"), F.slice(keyed, 1, 0).alias("out")),
        lambda acc, c: F.when(c["start_byte"] >= acc["end"], F.struct(F.greatest(acc["end"], c["end_byte"]).alias("end"), F.concat(acc["out"], F.array(c)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return F.transform(kept, lambda c: F.struct(c["start_byte"].alias("start_byte"), c["end_byte"].alias("end_byte"), c["kind"].alias("kind")))


def url_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row a protected URL: start_byte, end_byte, sha256, kind."""
    def places(pattern: str) -> Column:
        # cut the text at each match: pieces before matches and matches themselves give byte offsets
        marked = F.regexp_replace(F.replace(F.replace(F.col(text), F.lit("\x1e"), F.lit(" ")), F.lit("\x1f"), F.lit(" ")), pattern, "\x1f$0\x1e")
        parts = F.split(marked, "\x1f", -1)
        pieces = F.transform(parts, lambda p: F.struct(F.when(F.instr(p, "\x1e") > 0, F.octet_length(F.substring_index(p, "\x1e", 1))).otherwise(F.lit(0)).alias("m"), F.when(F.instr(p, "\x1e") > 0, F.octet_length(F.substring_index(p, "\x1e", -1))).otherwise(F.octet_length(p)).alias("rest")))
        folded = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_byte:int,end_byte:int,kind:string>>").alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + p["m"] + p["rest"]).alias("at"),
                F.when(p["m"] > 0, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start_byte"), (acc["at"] + p["m"]).alias("end_byte"), F.lit("url").alias("kind"))))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return folded

    none = F.array().cast("array<struct<start_byte:int,end_byte:int,kind:string>>")
    found = F.concat(*[F.when(may(F.col(text)), places(p)).otherwise(none) for p, may in zip(T._URLS, T._MAY_BE_URL, strict=True)])
    rows = T.once(T.once(docs.select("doc_id", text), __found=found), __kept=F.when(F.size("__found") > 0, resolve(F.col("__found"))))
    rows = rows.select("doc_id", F.col(text).cast("binary").alias("__c"), F.explode("__kept").alias("s"))
    sha = F.sha2(F.expr("substring(__c, s.start_byte + 1, s.end_byte - s.start_byte)"), 256)
    return rows.select("doc_id", F.col("s.start_byte").cast("bigint").alias("start_byte"), F.col("s.end_byte").cast("bigint").alias("end_byte"), sha.alias("sha256"), F.col("s.kind").alias("kind"))
