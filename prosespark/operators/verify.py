"""Gates and the verifier. A case is a row: doc_id, content (binary), edits, and what it is held against.

Fail closed: a script with problems, a missing verdict or an unmapped region never passes silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosespark.functions import atoms as A
from prosespark.functions import markdown as MD
from prosespark.functions import text as T
from prosespark.operators import edits as E
from prosespark.operators import ledger as L
from prosespark.sources.io import settled

DECISIONS = ("REJECT", "ASK", "SURFACE", "ACCEPT")
#: Dispositions of findings by rank; reject_global rejects without telling where.
RANK = {"reject": 0, "reject_global": 0, "ask": 1, "surface": 2}
FINDING = "doc_id bigint, layer int, severity string, code string, entry_id string, disposition string, hunks array<int>"


def decoded(c: Column) -> Column:
    """Bytes as text, what isn't UTF-8 replaced."""
    return F.make_valid_utf8(c.cast("string"))


def revised(cases: DataFrame) -> DataFrame:
    """doc_id, content, edits, rev: the script spliced in once a case, before any join multiplies its rows."""
    return T.once(cases.select("doc_id", "content", "edits"), rev=E.apply(F.col("content"), F.col("edits")))


def locality(cases: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, edit_idx, ok: each edit lies in an authorized range (an insertion also at either edge)."""
    e = cases.select("doc_id", F.posexplode("edits").alias("edit_idx", "e")).select("doc_id", F.col("edit_idx").cast("bigint").alias("edit_idx"), F.col("e.start_byte").alias("a"), F.col("e.end_byte").alias("b"))
    r = ranges.select(F.col("doc_id").alias("__d"), F.col("start_byte").alias("__s"), F.col("end_byte").alias("__t"))
    inside = e.join(r, (F.col("doc_id") == F.col("__d")) & (F.col("__s") <= F.col("a")) & (F.col("b") <= F.col("__t")), "left_semi").select("doc_id", "edit_idx", F.lit(True).alias("ok"))
    return e.join(inside, ["doc_id", "edit_idx"], "left").select("doc_id", "edit_idx", "a", "b", F.coalesce("ok", F.lit(False)).alias("ok"))


def protected_intact(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, start_byte, end_byte, ok: each protected span's bytes are unchanged in the revision."""
    rows = spans.join(revised(cases), "doc_id")
    a, b = E.map_offset(F.col("edits"), F.col("start_byte")), E.map_offset(F.col("edits"), F.col("end_byte"))
    rows = rows.withColumn("__a", a).withColumn("__b", b)
    same = F.sha2(E.piece(F.col("rev"), F.col("__a"), F.col("__b")), 256) == F.col("sha256")
    return rows.select("doc_id", "start_byte", "end_byte", F.coalesce(same, F.lit(False)).alias("ok"))


def new_claims(cases: DataFrame, allowed: Column | None = None) -> DataFrame:
    """doc_id, category, atom of claims that a revision adds."""
    none = F.array().cast("array<string>")
    rows = T.once(T.once(cases, rev=E.apply(F.col("content"), F.col("edits"))).where("rev is not null"), __before=decoded(F.col("content")), __after=decoded(F.col("rev")))
    found = A.new_claims(F.col("__before"), F.col("__after"), none if allowed is None else allowed)
    return T.once(rows, __claims=found).select("doc_id", F.explode("__claims").alias("c")).select("doc_id", "c.*")


def preservation(cases: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, region_idx, check, ok: each region's atoms are the same multiset in the revision."""
    rows = regions.select("doc_id", "region_idx", "start_byte", "end_byte", "checks").join(revised(cases), "doc_id")
    a, b = E.map_offset(F.col("edits"), F.col("start_byte")), E.map_offset(F.col("edits"), F.col("end_byte"))
    rows = rows.withColumn("__o", decoded(E.piece(F.col("content"), F.col("start_byte"), F.col("end_byte")))).withColumn("__r", decoded(E.piece(F.col("rev"), a, b)))
    rows = rows.select("doc_id", "region_idx", "__o", "__r", F.explode("checks").alias("check"))
    same = F.lit(False)
    for name, extract in A.CHECKS.items():
        same = F.when(F.col("check") == name, A.multiset(extract(F.col("__o"))) == A.multiset(extract(F.col("__r")))).otherwise(same)
    return rows.select("doc_id", "region_idx", "check", F.coalesce(same, F.lit(False)).alias("ok"))


def layer2(cases: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, entry_id, status, code, disposition, hunks of ledger entries that the script touches."""
    s, t, e = F.col("start_byte"), F.col("end_byte"), F.col("edits")
    # texts join only the entries that a script touches
    rows = entries.select("doc_id", "entry_id", "kind", "start_byte", "end_byte", "extracted").join(cases.select("doc_id", "edits"), "doc_id")
    rows = T.once(rows, status=E.region_status(e, s, t)).where("status <> 'unchanged'")
    rows = rows.join(revised(cases).select("doc_id", "rev"), "doc_id")
    after = decoded(E.piece(F.col("rev"), E.map_offset(e, s), E.map_offset(e, t)))
    rows = T.once(rows, __after=F.when(F.col("status") == "modified", L.extracted(F.col("kind"), after)))
    code = (
        F.when(F.col("status") == "deleted", F.lit("entry_dropped"))
        .when(F.col("status") == "ambiguous", F.lit("entry_unmappable"))
        .when(F.col("__after").isNull(), F.lit("entry_no_rule"))
        .when(F.col("__after") != F.col("extracted"), F.lit("entry_weakened"))
    )
    rows = rows.withColumn("code", code).where("code is not null")
    return rows.select("doc_id", "entry_id", "status", "code", F.when(F.col("code").isin("entry_dropped", "entry_weakened"), F.lit("reject")).otherwise(F.lit("ask")).alias("disposition"), E.hunks_of(e, s, t).alias("hunks"))


def structure(cases: DataFrame) -> DataFrame:
    """doc_id, code: what a revision damages of its document's Markdown; what can't be scanned counts as damage."""
    rows = revised(cases.where(F.size("edits") > 0)).where("rev is not null")
    rows = T.once(rows, before=MD.parsed(decoded(F.col("content"))), after=MD.parsed(decoded(F.col("rev"))))
    known = (F.col("before.status") == "ok") & (F.col("after.status") == "ok")
    codes = F.when(known, MD.damage(F.col("before"), F.col("after"))).otherwise(F.array(F.lit("capability_unavailable")))
    return rows.select("doc_id", F.explode(codes).alias("code"))


def judged(cases: DataFrame, entries: DataFrame, output: str) -> DataFrame:
    """doc_id, verdict, concerns of the semantic layer's JSON in column `output`, held against the ledger's ranges."""
    place = F.struct("start_byte", "end_byte")
    ledger = entries.groupBy("doc_id").agg(F.collect_set(place).alias("places"), F.collect_list(F.struct("entry_id", place.alias("place"))).alias("ids"))
    rows = cases.select("doc_id", F.col(output).alias("o")).join(ledger, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    return rows.select("doc_id", semantic(F.col("o"), none("places"), none("ids")).alias("verdict"), F.from_json("o", CONCERNS)["concerns"].alias("concerns"))


def found(cases: DataFrame, entries: DataFrame, spans: DataFrame, ranges: DataFrame, verdict: str | None = None, output: str | None = None) -> DataFrame:
    """Every finding of a case as a row of FINDING: layer 0 its script and ledger, 1 the gates, 2 entries, 3 semantics.

    A document whose ledger or script is unsound has findings of layer 0 only. cases may have has_ranges (null or false:
    locality can't be checked, which asks).
    """

    def rows(df: DataFrame, layer: int, severity: str, code: Column, disposition: Column, entry: Column | None = None, hunks: Column | None = None) -> DataFrame:
        empty = F.array().cast("array<int>")
        return df.select("doc_id", F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), code.alias("code"), (F.lit(None).cast("string") if entry is None else entry).alias("entry_id"), disposition.alias("disposition"), (empty if hunks is None else hunks.cast("array<int>")).alias("hunks"))

    reject, ask = F.lit("reject"), F.lit("ask")
    # every gate reads cases, entries and spans again: they are written once, or each gate would make them anew
    base = settled(T.once(cases, problems=E.problems(F.col("content"), F.col("edits"))), "cases")
    entries = settled(entries.select("doc_id", "entry_id", "kind", "start_byte", "end_byte", "text_hash", "extracted", "preservation", "confidence"), "entries")
    spans = settled(spans, "spans")
    docs = base.select("doc_id", "content")
    unsound = L.validate(entries.join(docs.select("doc_id"), "doc_id", "left_semi"), docs, "content").select("doc_id", "problem")
    unsound = unsound.unionByName(L.validate_spans(spans.join(docs.select("doc_id"), "doc_id", "left_semi"), docs, "content").select("doc_id", "problem"))
    bad_ledger = settled(unsound.select("doc_id").distinct(), "unsound")
    parts = [
        rows(bad_ledger, 0, "fixture", F.lit("invalid_ledger"), reject),
        rows(base.join(bad_ledger, "doc_id", "left_anti").select("doc_id", F.explode("problems").alias("p")), 0, "fixture", F.concat(F.lit("invalid_script:"), F.col("p")), reject),
    ]
    good = base.where(F.size("problems") == 0).join(bad_ledger, "doc_id", "left_anti")
    known = F.coalesce(F.col("has_ranges"), F.lit(False)) if "has_ranges" in cases.columns else F.lit(True)
    gates = {
        "protected_spans_intact": protected_intact(good, spans).where("not ok"),
        "no_new_claim_atoms": new_claims(good),
        "markdown_structure": structure(good),
        "edit_locality": locality(good.where(known), ranges).where("not ok"),
    }
    for name, failed in gates.items():
        parts.append(rows(failed, 1, "hard", F.lit(name), reject))
    parts.append(rows(good.where(~known & (F.size("edits") > 0)), 1, "uncertain", F.lit("locality_unverified"), ask))
    parts.append(rows(layer2(good, entries), 2, "entry", F.col("code"), F.col("disposition"), F.col("entry_id"), F.col("hunks")))
    if output:
        said = judged(good, entries, output)
    elif verdict:
        said = good.select("doc_id", status_of(F.col(verdict)).alias("verdict"), F.lit(None).cast(f"array<{CONCERN}>").alias("concerns"))
    if output or verdict:
        parts.append(rows(said.where("verdict = 'ambiguous'"), 3, "semantic", F.lit("semantic_ambiguous"), F.lit("surface")))
        one = F.when(F.size("concerns") > 0, F.col("concerns")).otherwise(F.array(F.lit(None).cast(CONCERN)))
        real = said.where("verdict = 'real'").select("doc_id", F.explode(one).alias("c")).join(good.select("doc_id", "edits"), "doc_id")
        told = (F.coalesce(F.size("c.entry_ids"), F.lit(0)) > 0) | (F.coalesce(F.size("c.original_ranges"), F.lit(0)) > 0)
        hit = F.array_distinct(F.flatten(F.transform(F.coalesce(F.col("c.original_ranges"), F.array().cast("array<struct<start_byte:bigint,end_byte:bigint>>")), lambda r: E.hunks_of(F.col("edits"), r["start_byte"], r["end_byte"]))))
        parts.append(rows(real, 3, "semantic", F.coalesce("c.code", F.lit("semantic")), F.when(told, reject).otherwise(F.lit("reject_global")), hunks=hit))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def status_of(verdict: Column) -> Column:
    """A verdict; anything but real, ambiguous or clean is ambiguous."""
    return F.when(verdict.isin("real", "ambiguous", "clean"), verdict).otherwise(F.lit("ambiguous"))


def verify(cases: DataFrame, entries: DataFrame, spans: DataFrame, ranges: DataFrame, verdict: str | None = None, two_layer: bool = False, output: str | None = None) -> DataFrame:
    """A row a case: counts by gate, decision, semantic_status, shippable, from the findings of `found`.

    verdict names a column of cases with real, ambiguous or clean, output one with the semantic layer's JSON; anything
    else counts as ambiguous, and without either the semantic layer hasn't run.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("disposition")]
    count = lambda name, test: F.count_if(test).alias(name)
    code = lambda x: F.col("code") == x
    got = found(cases, entries, spans, ranges, verdict, output).groupBy("doc_id").agg(
        count("n_ledger", code("invalid_ledger")), count("n_problems", F.col("code").startswith("invalid_script:")), count("n_protected", code("protected_spans_intact")), count("n_claims", code("no_new_claim_atoms")), count("n_outside", code("edit_locality")),
        count("n_structure", code("markdown_structure")), count("n_reject", (F.col("layer") == 2) & (F.col("disposition") == "reject")), count("n_ask", F.col("disposition") == "ask"), F.min(rank).alias("rank"),
        F.max(F.when(F.col("layer") == 3, F.when(F.col("disposition") == "surface", F.lit("ambiguous")).otherwise(F.lit("real")))).alias("said"),
    )
    names = ("n_problems", "n_ledger", "n_protected", "n_claims", "n_outside", "n_structure", "n_reject", "n_ask")
    rows = cases.select("doc_id").join(got, "doc_id", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names})
    ran = F.lit(bool(verdict or output)) & (F.col("n_problems") + F.col("n_ledger") == 0)
    status = F.when(~ran, F.lit("not_run")).otherwise(F.coalesce("said", F.lit("clean")))
    rest = F.lit("ACCEPT") if verdict or output or two_layer else F.lit("SURFACE")
    decision = F.when(F.col("rank").isNull(), rest).otherwise(F.element_at(F.array(*map(F.lit, DECISIONS)), (F.coalesce("rank", F.lit(3)) + 1).cast("int")))
    out = rows.withColumn("semantic_status", status).withColumn("decision", decision)
    return out.select("doc_id", *names, "semantic_status", "decision", ((F.col("decision") == "ACCEPT") & (F.col("semantic_status") == "clean")).alias("shippable"))


def hunk_decisions(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, hunk, range, decision, n_findings, revertable: the worst of the findings that implicate each hunk.

    A rejection that implicates no hunk, or a global one, leaves none of its document's hunks revertable.
    """
    hunks = cases.select("doc_id", F.posexplode(E.ordered(F.col("edits"))).alias("hunk", "e")).select("doc_id", F.col("hunk").cast("bigint").alias("hunk"), F.col("e.start_byte").alias("start_byte"), F.col("e.end_byte").alias("end_byte"))
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("disposition")]
    hit = findings.select("doc_id", F.explode("hunks").alias("hunk"), rank.alias("rank"))
    worst = hit.groupBy("doc_id", F.col("hunk").cast("bigint").alias("hunk")).agg(F.min("rank").alias("rank"), F.count("*").alias("n_findings"))
    stuck = findings.where((F.col("disposition") == "reject_global") | ((F.col("disposition") == "reject") & (F.size("hunks") == 0))).select("doc_id", F.lit(True).alias("stuck")).distinct()
    out = hunks.join(worst, ["doc_id", "hunk"], "left").join(stuck, "doc_id", "left")
    return out.select("doc_id", "hunk", "start_byte", "end_byte", F.element_at(F.array(*map(F.lit, DECISIONS)), (F.coalesce("rank", F.lit(3)) + 1).cast("int")).alias("decision"), F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"), F.col("stuck").isNull().alias("revertable"))


def withhold(cases: DataFrame, l2: DataFrame) -> DataFrame:
    """doc_id, hunk, component, applied: hunks that share a finding stand or fall together.

    A finding implicates hunks that follow each other in their document, so components are runs: the reach of a finding
    is its first to last hunk, and a running maximum joins what overlaps. A component with a blocked hunk is withheld.
    """
    reach = l2.select("doc_id", F.array_min("hunks").alias("a"), F.array_max("hunks").alias("b"), F.lit(1).alias("blocks")).where("a is not null")
    hunks = cases.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("edits") - 1))).alias("a"), F.size("edits").alias("n")).where("n > 0").select("doc_id", "a", F.col("a").alias("b"), F.lit(0).alias("blocks"))
    every = hunks.unionByName(reach)
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    far = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = every.withColumn("new", F.coalesce((F.col("a") > far).cast("int"), F.lit(1))).withColumn("component", F.sum("new").over(w))
    blocked = F.max("blocks").over(Window.partitionBy("doc_id", "component")) > 0
    return runs.withColumn("applied", ~blocked).join(hunks.select("doc_id", F.col("a").alias("hunk")), (F.col("blocks") == 0) & (F.col("a") == F.col("hunk")) & (runs["doc_id"] == hunks["doc_id"]), "left_semi").select("doc_id", F.col("a").cast("bigint").alias("hunk"), F.col("component").cast("bigint").alias("component"), "applied")


CONCERN = "struct<code:string,message:string,entry_ids:array<string>,original_ranges:array<struct<start_byte:bigint,end_byte:bigint>>>"
CONCERNS = f"struct<verdict:string,concerns:array<{CONCERN}>>"


def semantic(output: Column, places: Column, ids: Column | None = None) -> Column:
    """The verdict in a semantic layer's JSON; what is malformed, unknown, invented or mispaired is ambiguous.

    places is an array of (start_byte, end_byte) of the ledger's entries, ids one of (entry_id, place). A concern that
    names known entries and ranges may only name ranges of those entries.
    """
    o = F.from_json(output, CONCERNS)
    told = F.coalesce(o["concerns"], F.array().cast(f"array<{CONCERN}>"))
    ranges = lambda c: F.coalesce(c["original_ranges"], F.array().cast("array<struct<start_byte:bigint,end_byte:bigint>>"))
    wrong = F.exists(told, lambda c: F.coalesce(F.exists(ranges(c), lambda r: ~F.array_contains(places, r)), F.lit(True)))
    if ids is not None:
        def mispaired(c: Column) -> Column:
            own = F.transform(F.filter(ids, lambda i: F.array_contains(F.coalesce(c["entry_ids"], F.array().cast("array<string>")), i["entry_id"])), lambda i: i["place"])
            return (F.size(own) > 0) & F.exists(ranges(c), lambda r: ~F.array_contains(own, r))

        wrong = wrong | F.exists(told, lambda c: F.coalesce(mispaired(c), F.lit(True)))
    misshapen = (F.get_json_object(output, "$.concerns").isNotNull() & o["concerns"].isNull()) | F.exists(told, lambda c: c.isNull())
    return F.when(o["verdict"].isin("real", "ambiguous", "clean") & ~F.coalesce(wrong, F.lit(True)) & ~F.coalesce(misshapen, F.lit(True)), o["verdict"]).otherwise(F.lit("ambiguous"))
