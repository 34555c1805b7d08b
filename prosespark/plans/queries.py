"""The driver's queries over the reference's operators, on whole tables.

The tables' texts hold no phrase that is looked for, so most queries read a seasoned frame: lines become paragraphs and a paragraph
of our own, chosen by doc_id, is added. The same SQL text makes it in Spark and in the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosespark.functions import atoms as A
from prosespark.functions import text as T
from prosespark.operators import corpus, edits, evaluate, extract, findings, genre, ledger, metrics, recommend, spans, validate, verify
from prosespark.plans import stages
from prosespark.sources.io import dealt, settled, spread

Query = Callable[[SparkSession, str], DataFrame]

#: Paragraphs to add; ~ stands for an apostrophe.
PARAGRAPHS = (
    "Furthermore, the plan must ship by 2024-03-15. However, it must not cost more than 1,200 dollars. However, we shall never skip tests. The system must be fast.",
    "Quality, not expediency, matters here. Speed, not polish, wins. It is not a toy, but a tool. Care, not haste, pays. Trust, not fear, leads.",
    "Studies show the robust and scalable design is truly innovative. Experts say it is incredibly seamless. It is well known.",
    "In conclusion, it is important to note the rapidly evolving landscape. At its core, this paves the way for growth. It is not only quick but also cheap. In today~s fast-paced world it pays.",
    "I went home. I ate my bread. I told myself a story and I slept. I woke and I sang to me, myself and I.",
    "The user story has acceptance criteria. This is out of scope. The screen should feel intuitive; the page must look very clean; it shall be reliable.",
    "See https://example.com/a/b?x=1, and www.test.org/path. Visit docs.example.io for more; it cites [12] and (Miller 2019).",
    "The limit is at least 5 ms and at most 200 ms -- no more than 3.5% of -40 units. If it fails, stop unless told otherwise -- now.",
    "Our brand and pricing help customers. The market and competitors watch revenue, retention and adoption. Investors like the segment and the moat.",
    "The word \"Widget\" means a small part. Hereafter the widget is required. Each widget must work. Each widget must pass. Each widget must last. Each widget can fail.",
    "The cat sat. The cat ran. The cat hid. The dog sat. He came from Dr. Smith at 5 p.m. and left vs. stayed on 3 March 2021.",
    "Red, green, and blue are here. One, two, and three follow. We can~t go, you won~t stay; they don~t mind; it isn~t late; no one knows.",
)
SEASONED = (
    "SELECT doc_id, lang, source, replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || replace(CASE doc_id % 12 "
    + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PARAGRAPHS))
    + " END, '~', chr(39)) AS text FROM documents"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def seasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEASONED.replace("FROM documents", "FROM {documents}"), documents=dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prepared(seasoned(spark, sf_dir))


def judged_texts(spark: SparkSession, d: str) -> DataFrame:
    """Prepared documents with their genre."""
    return metrics.prepared(genre.classify(seasoned(spark, d)))


def text_units(spark: SparkSession, d: str) -> DataFrame:
    u = extract.units(seasoned(spark, d))
    return u.select("doc_id", F.col("unit_idx").cast("bigint").alias("unit_idx"), F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = extract.sentences(seasoned(spark, d))
    return s.select("doc_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), F.col("unit_idx").cast("bigint").alias("unit_idx"), F.col("n_words").cast("bigint").alias("n_words"), F.sha2("sentence", 256).alias("sha"))


def line_starts(spark: SparkSession, d: str) -> DataFrame:
    return extract.line_starts(seasoned(spark, d)).select("doc_id", F.col("line").cast("bigint").alias("line"), "start_byte")


def phrase(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return metrics.phrase_counts(prepared(spark, d), metric)

    return run


def adjectives(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.prepared(genre.classify(seasoned(spark, d))).where("genre = 'prd'")
    return metrics.phrase_counts(p, "adjective_requirements").select("doc_id", "count", "soft_flag")


def metric_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.envelope(judged_texts(spark, d), "genre")
    return rows.groupBy("metric", "metric_class", "confidence", "metric_version").agg(F.count("*").alias("n_docs"), F.sum("count").alias("total"), F.sum("eligible_units").alias("eligible"), F.count_if(F.col("soft_flag")).alias("n_soft"))


def genres(spark: SparkSession, d: str) -> DataFrame:
    g = genre.classify(seasoned(spark, d))
    return g.select("doc_id", "genre", "genre_confidence", "genre_reason")


def atoms(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = seasoned(spark, d).select("doc_id", F.explode(A.ALL[kind](F.col("text"))).alias("atom"))
        return rows.groupBy("doc_id", "atom").agg(F.count("*").alias("n"))

    return run


def new_claims(spark: SparkSession, d: str) -> DataFrame:
    before = dealt(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    pairs = seasoned(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("after")).join(before, "doc_id")
    found = A.new_claims(F.col("before"), F.col("after"), F.array(F.lit("2019")))
    return T.once(pairs, found=found).select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")


def regions(spark: SparkSession, d: str) -> DataFrame:
    return ledger.regions(seasoned(spark, d)).select("doc_id", "region_idx", "start_byte", "end_byte", F.array_join("checks", ",").alias("checks"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    e = ledger.entries(ledger.regions(seasoned(spark, d)))
    return e.select("doc_id", "entry_id", "kind", "start_byte", "end_byte", "text_hash", "preservation", F.col("confidence").cast("bigint").alias("confidence"), F.size("extracted").cast("bigint").alias("n_extracted"))


def ledger_hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = seasoned(spark, d)
    return ledger.canonical(ledger.entries(ledger.regions(docs)), docs, spans=spans.url_spans(docs)).select("doc_id", "ledger_sha256")


def ledger_problems(spark: SparkSession, d: str) -> DataFrame:
    """Entries falsified by their document's id and region: every way of being wrong comes up."""
    docs = seasoned(spark, d)
    e = ledger.entries(ledger.regions(docs))
    k = F.pmod(F.col("doc_id") + F.col("start_byte"), F.lit(9))
    false = e.withColumns({
        "text_hash": F.when(k == 1, F.lit("0")).otherwise(F.col("text_hash")), "confidence": F.when(k == 2, F.lit(1001)).otherwise(F.col("confidence")),
        "kind": F.when(k == 3, F.lit("poem")).otherwise(F.col("kind")), "preservation": F.when(k == 4, F.lit("none")).otherwise(F.col("preservation")), "end_byte": F.when(k == 5, F.lit(1 << 40)).otherwise(F.col("end_byte")),
        "entry_id": F.when(k == 6, F.lit("e")).otherwise(F.col("entry_id")),
    })
    return ledger.validate(false, docs)


def extracted_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The atoms of each entry with their counts."""
    e = ledger.entries(ledger.regions(seasoned(spark, d)))
    return e.select("doc_id", "entry_id", F.explode("extracted").alias("atom")).groupBy("doc_id", "entry_id", "atom").agg(F.count("*").alias("n"))


def _located(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents' genres, units, line starts and places of metrics. What is found is written once, without the texts."""
    docs = metrics.located(judged_texts(spark, d), "genre")
    lines = F.transform("units", lambda u: F.struct(u["line_start"].alias("line_start"), u["line_end"].alias("line_end")))
    found = settled(docs.select("doc_id", "genre", "places", lines.alias("units"), extract.starts_of(F.col("text")).alias("starts")), "located")
    starts = found.select("doc_id", F.posexplode("starts").alias("line", "start_byte")).select("doc_id", (F.col("line") + 1).alias("line"), F.col("start_byte").cast("bigint").alias("start_byte"))
    places = found.select("doc_id", "genre", F.explode("places").alias("p")).select("doc_id", "genre", "p.*")
    return found, extract.units(found), starts, places


def ranges(spark: SparkSession, d: str) -> DataFrame:
    docs, units, starts, places = _located(spark, d)
    return spans.authorized_ranges(units, starts, places, F.col("genre"))


def url_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.url_spans(seasoned(spark, d))


def feedback_log(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a feedback log."""
    e = table(spark, d, "events")
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))
    return e.select("event_id", pick(("discard", "edit", "apply"), F.col("event_id")).alias("user_action"), pick(FEEDBACK_GENRES, F.col("user_id")).alias("genre"), pick(FEEDBACK_METRICS, F.col("event_id")).alias("metric"), F.when(F.col("event_id") % 5 == 0, F.lit("keep")).otherwise(F.lit("strip")).alias("recommendation"))


FEEDBACK_GENRES = ("general", "spec", "prd", "personal", "marketing", "technical")
FEEDBACK_METRICS = ("negative_parallelism", "rule_of_three", "punctuation_rates", "transition_clusters", "vague_attribution", "bold_label_density", "unknown_metric")


def overlay(spark: SparkSession, d: str) -> DataFrame:
    return recommend.learn(feedback_log(spark, d))


def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    docs, units, starts, places = _located(spark, d)
    return findings.build(places.drop("genre"), units, starts, docs)


def learned_findings(spark: SparkSession, d: str) -> DataFrame:
    docs, units, starts, places = _located(spark, d)
    got = findings.build(places.drop("genre"), units, starts, docs, overlay(spark, d))
    return got.groupBy("genre", "metric", "recommendation").agg(F.count("*").alias("n"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """A candidate script a document: edits of the added paragraph by doc_id; every tenth is out of bounds."""
    docs = seasoned(spark, d)
    content = F.col("text").cast("binary")
    n, tail = F.octet_length("text").cast("bigint"), F.octet_length(F.substring_index("text", "\n\n", -1)).cast("bigint")
    start = n - tail
    edit = lambda a, b, s: F.struct(a.cast("bigint").alias("start_byte"), b.cast("bigint").alias("end_byte"), F.lit(s.encode()).alias("replacement"), F.lit(None).cast("string").alias("preimage_sha256"))
    kind = F.col("doc_id") % 10
    script = (
        F.when(kind == 0, F.array(edit(n - 2, n + 5, "x")))
        .when(kind == 1, F.array(edit(start, n, "")))
        .when(kind == 2, F.array(edit(start, start, "Now. ")))
        .when(kind == 3, F.array(edit(n, n, " It can save 99% of it.")))
        .when(kind == 4, F.array(edit(start, start + 4, "A "), edit(n - 4, n, "all.")))
        .when(kind == 5, F.array(edit(start + 10, start + 20, "plain")))
        .when(kind == 6, F.array(edit(n - 8, n - 1, "robust"), edit(start, start + 1, "W")))
        .otherwise(F.array(edit(start + 5, start + 6, "_")))
    )
    return T.once(docs.select("doc_id", "text"), content=content, edits=script, tail_start=start).drop("text")


def spliced(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).withColumn("p", edits.problems(F.col("content"), F.col("edits"))).withColumn("r", edits.apply(F.col("content"), F.col("edits")))
    return c.select("doc_id", F.array_join("p", ",").alias("problems"), F.octet_length("r").cast("bigint").alias("n_bytes"), F.sha2("r", 256).alias("sha"))


def statuses(spark: SparkSession, d: str) -> DataFrame:
    r = ledger.regions(seasoned(spark, d)).join(T.once(cases(spark, d), problems=edits.problems(F.col("content"), F.col("edits"))).select("doc_id", "edits", "problems"), "doc_id")
    s, e = F.col("start_byte"), F.col("end_byte")
    sound = lambda c: F.when(F.size("problems") == 0, c)  # noqa: E731  scripts with problems map nothing
    return r.select("doc_id", "region_idx", sound(edits.map_offset(F.col("edits"), s)).alias("rev_start"), sound(edits.map_offset(F.col("edits"), e)).alias("rev_end"), F.coalesce(sound(edits.region_status(F.col("edits"), s, e)), F.lit("invalid_script")).alias("status"))


def _tail_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Authorized: the added paragraph but its last 4 bytes, in documents of odd id; nothing elsewhere."""
    return cases(spark, d).where("doc_id % 2 = 1").select("doc_id", F.col("tail_start").alias("start_byte"), (F.octet_length("content").cast("bigint") - 4).alias("end_byte"))


def locality(spark: SparkSession, d: str) -> DataFrame:
    return verify.locality(cases(spark, d), _tail_ranges(spark, d)).select("doc_id", "edit_idx", "a", "b", "ok")


def _cases_held(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Cases with verdicts, and the entries, protected spans and ranges that they are held against."""
    docs = seasoned(spark, d)
    c = cases(spark, d).withColumn("has_ranges", F.col("doc_id") % 3 != 0).withColumn("said", F.when(F.col("doc_id") % 7 == 0, F.lit("ambiguous")).otherwise(F.lit("clean")))
    whole = c.select("doc_id", F.lit(0).cast("bigint").alias("start_byte"), F.octet_length("content").cast("bigint").alias("end_byte"))
    return c, (ledger.entries(ledger.regions(docs)), spans.url_spans(docs), whole)


def _verified(spark: SparkSession, d: str) -> DataFrame:
    c, held = _cases_held(spark, d)
    return verify.verify(c, *held, "said")


def hunks(spark: SparkSession, d: str) -> DataFrame:
    c, held = _cases_held(spark, d)
    return verify.hunk_decisions(c, verify.found(c, *held, "said"))


def withheld(spark: SparkSession, d: str) -> DataFrame:
    good = T.once(cases(spark, d), problems=edits.problems(F.col("content"), F.col("edits"))).where(F.size("problems") == 0)
    l2 = verify.layer2(good, ledger.entries(ledger.regions(seasoned(spark, d))))
    return verify.withhold(good, l2.where("disposition in ('reject', 'ask')"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Labelled points: a document's mean sentence length and others as metrics, quality 0 as positives."""
    m = metrics.sentence_length_distribution(prepared(spark, d))
    m = T.once(m, value=F.round(F.col("mean"), 1)).select("doc_id", "value")
    label = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = seasoned(spark, d).select("doc_id", "lang", "source", corpus.length_bucket(F.col("text")).alias("length"))
    rows = m.join(label, "doc_id").join(docs, "doc_id").where("value is not null")
    metric = F.element_at(F.array(*map(F.lit, ("transition_clusters", "negative_parallelism", "rule_of_three"))), (F.col("doc_id") % 3 + 1).cast("int"))
    tell = F.when(F.col("doc_id") % 3 == 2, F.lit("rule_of_three")).otherwise(F.lit("synthetic_cadence"))
    return rows.select(metric.alias("metric"), "value", (F.col("quality") == 0).alias("positive"), F.col("lang").alias("genre"), "length", tell.alias("tell"), F.col("doc_id").alias("item_id"))


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return corpus.fit_thresholds(points(spark, d).where("item_id % 4 <> 0"))


def strata(spark: SparkSession, d: str) -> DataFrame:
    p = settled(points(spark, d), "points")
    return corpus.evaluate(p.where("item_id % 4 = 0"), corpus.fit_thresholds(p.where("item_id % 4 <> 0")))


def disjointness(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("source_family"), F.when(F.col("doc_id") % 5 == 0, F.lit("calibration")).otherwise(F.lit("held_out")).alias("split"))
    return corpus.shared_families(items)


def claim_gate(spark: SparkSession, d: str) -> DataFrame:
    """Claims that the cases' revisions add; scripts with problems have no revision."""
    return verify.new_claims(cases(spark, d))


def told_genres(spark: SparkSession, d: str) -> DataFrame:
    """Genres of documents that may declare one, or lie under a telling path."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))
    docs = seasoned(spark, d).withColumn("said", pick(DECLARED, F.col("doc_id"))).withColumn("path", pick(PATHS, F.floor(F.col("doc_id") / 7)))
    return genre.classify(docs, "said", "path").select("doc_id", "genre", "genre_confidence", "genre_reason")


DECLARED = (None, " PRD ", "poem", "Spec", "", "blog", None, "Marketing", None, None, None)
PATHS = (None, "docs/prd/one.md", "a/specification.md", "my-spec_v2.txt", "home\\\\journal notes.md", "README.md", "x.y", "prd-spec.md")


def parsed_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts from wire JSON: with and without a replacement, a preimage or its hash, and base64 that doesn't decode."""
    k = F.col("doc_id")
    text = F.format_string('[{"start_byte":%d,"end_byte":%d%s},{"start_byte":0,"end_byte":1,"replacement_b64":"%s"}]', k, k + 3, F.element_at(F.array(F.lit(""), F.lit(',"preimage_b64":"YWJj"'), F.lit(',"preimage_sha256":" AB "')), (k % 3 + 1).cast("int")), F.when(k % 4 == 0, F.lit("@@")).otherwise(F.base64(k.cast("string").cast("binary"))))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(edits.parse(text)).alias("idx", "e"))
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "e.start_byte", "e.end_byte", F.col("e.replacement").cast("string").alias("replacement"), "e.preimage_sha256")


def equal_material(spark: SparkSession, d: str) -> DataFrame:
    """Texts against themselves with line feeds at the end taken off or added."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a"))
    other = F.when(F.col("doc_id") % 3 == 0, F.concat("a", F.lit("\n\n"))).when(F.col("doc_id") % 3 == 1, F.concat("a", F.lit(" "))).otherwise(F.col("a"))
    a, b = F.col("a").cast("binary"), other.cast("binary")
    return t.select("doc_id", edits.material_equal(a, b).alias("same"), edits.material_equal(a, b, "normalize").alias("alike"))


def voices(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return corpus.voice_features(t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Judge trials from events: a case an user, three trials, both sides, nine dimensions."""
    base = table(spark, d, "events").select(F.col("user_id").alias("case_id")).distinct()
    grid = base.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("trial")).select("case_id", "trial", F.explode(F.array(F.lit("candidate"), F.lit("baseline"))).alias("side")).select("case_id", "trial", "side", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("dim"))
    bonus = F.when(F.col("side") == "candidate", F.col("case_id") % 3).otherwise(F.lit(1))
    return grid.withColumn("score", ((F.col("case_id") * 7 + F.col("trial") * 3 + F.col("dim") * 5) % 2 + F.when(bonus > 1, F.lit(1)).otherwise(F.lit(0))).cast("int"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judge(trials(spark, d)).select(F.col("case_id").cast("bigint").alias("case_id"), "n_trials", "errored", "beat")


def gates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 40).alias("fixture"), F.col("event_type").alias("gate")).agg(F.count("*").alias("n"))
    status = lambda k: F.element_at(F.array(*map(F.lit, ("pass", "fail", "not_evaluated"))), (F.pmod(F.col("n") * k + F.col("fixture"), F.lit(3)) + 1).cast("int"))
    return rows.select("fixture", "gate", status(1).alias("status")), rows.select("fixture", "gate", status(2).alias("status"))


def compared(spark: SparkSession, d: str) -> DataFrame:
    a, b = gates(spark, d)
    return evaluate.compare_gates(a, b).select(F.col("fixture").cast("bigint").alias("fixture"), "gates_better", "gates_worse", "verdict")


def accepted(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.acceptance(gates(spark, d)[0]).select(F.col("fixture").cast("bigint").alias("fixture"), "n_gates", "state")


def rolled_up(spark: SparkSession, d: str) -> DataFrame:
    """Stages audit, candidate, verify, apply of the cases, from their problems and gates."""
    v = _verified(spark, d)
    rows = v.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("audit").alias("stage"), F.lit("ok").alias("status"), F.lit("ok").alias("code")),
        F.struct(F.lit(1).alias("ord"), F.lit("candidate").alias("stage"), F.when(F.col("n_problems") > 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"), F.when(F.col("n_problems") > 0, F.lit("invalid_edits")).otherwise(F.lit("ok")).alias("code")),
        F.struct(F.lit(2).alias("ord"), F.lit("verify").alias("stage"), F.when(F.col("shippable"), F.lit("ok")).otherwise(F.lit("blocked")).alias("status"), F.when(F.col("shippable"), F.lit("ok")).otherwise(F.lit("verify_not_shippable")).alias("code")),
        F.struct(F.lit(3).alias("ord"), F.lit("apply").alias("stage"), F.lit("ok").alias("status"), F.lit("ok").alias("code")),
    )).alias("s")).select("doc_id", "s.*")
    return stages.roll_up(stages.cascade(rows))


def audit_status(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.envelope(judged_texts(spark, d), "genre", keep=("genre",))
    located = F.when(F.col("metric").isin("sentence_length_distribution", "sentence_length_dispersion", "punctuation_rates"), F.lit(0)).otherwise(F.col("count"))
    return recommend.status(rows.select("doc_id", "metric", "genre", located.alias("n_locations"), "soft_flag"))


def feedback_problems(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    rows = e.select(
        k.alias("event_id"), F.when(k % 11 == 0, F.lit(2)).otherwise(F.lit(1)).alias("schema_version"),
        F.when(k % 7 == 0, F.lit("2024-01-05")).when(k % 13 == 0, F.lit("soon")).otherwise(F.lit("2024-01-05T10:00:00Z")).alias("ts"),
        F.when(k % 17 == 0, F.lit(" ")).otherwise(F.concat(F.lit("f"), k)).alias("finding_id"), F.lit("cadence").alias("category"), F.lit("rule_of_three").alias("metric"),
        F.when(k % 19 == 0, F.lit("poem")).otherwise(F.lit("spec")).alias("genre"), F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.lit("strip")).alias("recommendation"),
        F.when(k % 3 == 0, F.lit("edit")).otherwise(F.lit("apply")).alias("user_action"), F.when(k % 6 == 0, F.lit("YWJj")).when(k % 3 == 0, F.lit("@@")).when(k % 5 == 0, F.lit("YWJj")).alias("replacement"),
        F.when(k % 4 == 0, F.lit("a1")).alias("alternative"), F.when(k % 29 == 0, F.lit("bored")).alias("reason"), F.sha2(k.cast("string"), 256).alias("doc_sha"),
    )
    return validate.feedback(rows).select("event_id", F.array_join("problems", ",").alias("problems"))


def queries() -> dict[str, Query]:
    dist = lambda f: lambda spark, d: f(prepared(spark, d))
    return {
        "x1_text_units": text_units,
        "x7_sentences": sentences,
        "x9_line_starts": line_starts,
        "m1_sentence_length_distribution": dist(metrics.sentence_length_distribution),
        "m2_sentence_length_dispersion": dist(metrics.sentence_length_dispersion),
        "m3_punctuation_rates": dist(metrics.punctuation_rates),
        "m4_negative_parallelism": phrase("negative_parallelism"),
        "m5_rule_of_three": phrase("rule_of_three"),
        "m6_paragraph_runs": dist(metrics.paragraph_runs),
        "m8_repeated_openers": lambda spark, d: metrics.opener_clusters(prepared(spark, d)).drop("first_idx"),
        "m9_transition_clusters": phrase("transition_clusters"),
        "m10_vague_attribution": phrase("vague_attribution"),
        "m11_stock_clusters": phrase("stock_lexical_clusters"),
        "m12_generic_diction": phrase("generic_diction"),
        "m13_adjective_requirements": adjectives,
        "m14_metric_totals": metric_totals,
        "m17_recommendations": lambda spark, d: recommend.table(spark),
        "g1_told_genres": told_genres,
        "g4_genres": genres,
        **{f"a_{kind}_atoms": atoms(kind) for kind in A.ALL},
        "a15_new_claims": new_claims,
        "l2_invariant_regions": regions,
        "l3_ledger_entries": entries,
        "l4_extracted_atoms": extracted_atoms,
        "l5_ledger_hashes": ledger_hashes,
        "l6_ledger_problems": ledger_problems,
        "i2_url_spans": url_spans,
        "i6_authorized_ranges": ranges,
        "f1_findings": finding_rows,
        "f6_audit_status": audit_status,
        "e1_parsed_scripts": parsed_scripts,
        "e3_spliced": spliced,
        "e7_region_status": statuses,
        "e9_equal_material": equal_material,
        "l7_locality": locality,
        "l10_claim_gate": claim_gate,
        "l15_verified": _verified,
        "l17_hunks": hunks,
        "o1_withheld": withheld,
        "c5_thresholds": thresholds,
        "c6_strata": strata,
        "c2_split_disjointness": disjointness,
        "c8_overlay": overlay,
        "c9_learned_findings": learned_findings,
        "c10_voice_features": voices,
        "h4_judged": judged,
        "h6_gate_comparison": compared,
        "h2_acceptance": accepted,
        "o6_stage_rollup": rolled_up,
        "v1_feedback_problems": feedback_problems,
    }


