"""The scanner's metrics. Measures only: every row says it is for selecting candidates.

All are computed inside a document's row (arrays and regular expressions, no shuffle). A document without text has no
units: counts are 0.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.functions import atoms as A
from prosespark.functions import fixed
from prosespark.functions import text as T
from prosespark.operators import extract

def prepared(docs: DataFrame) -> DataFrame:
    """docs with units, sentences and word counts, which all metrics share."""
    return measured(extract.with_units(docs))


def measured(docs: DataFrame) -> DataFrame:
    """docs that have units already (of text or Markdown), with sentences, word counts and units' texts in lower case."""
    d = extract.with_sentences(docs)
    # cutting a unit into sentences takes no word apart and none away
    return T.once(T.once(d, lengths=F.transform("sentences", lambda s: T.count_words(s["sentence"]))), n_words=T.total(F.col("lengths"), "int"), lows=F.transform("units", lambda u: F.lower(u["text"])))


def per_unit(pattern: str, flags: str, needles: tuple[str, ...], low: bool = False) -> Column:
    """Matches in each unit with their lines, in document order; only units that hold a needle in lower case may match."""
    text = (lambda u: F.lower(u["text"])) if low else (lambda u: u["text"])
    may = F.filter(F.transform("lows", lambda t, i: F.when(T.holds(t, needles), i)), lambda i: i.isNotNull())
    of = lambda u: F.transform(A.found(text(u), pattern, flags), lambda m: F.struct(m.alias("match"), u["line_start"].alias("line_start")))
    return F.flatten(F.transform(may, lambda i: of(F.get("units", i))))


def _alternation(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda x: (-len(x), x))) + r")\b"


def rate(count: Column, words: Column) -> Column:
    return F.when(words > 0, F.round(F.lit(1000.0) * count / words, 3)).otherwise(F.lit(0.0))


def sentence_length_distribution(d: DataFrame) -> DataFrame:
    """Words a sentence: quantiles, mean, population deviation; nulls where there is no sentence."""
    d = T.once(d, v=F.array_sort("lengths"), n=F.size("lengths"), sum=T.total(F.col("lengths")), squares=T.total(F.transform("lengths", lambda x: x.cast("bigint") * x)))
    some = lambda c: F.when(F.col("n") > 0, c)
    q = lambda x: some(T.percentile_of(F.col("v"), x))
    mean = F.try_divide(F.col("sum").cast("double"), F.col("n"))
    var = F.greatest(F.lit(0.0), F.try_divide(F.col("squares").cast("double"), F.col("n")) - mean * mean)
    return d.select(
        "doc_id", F.col("n").cast("bigint").alias("n_sentences"), some(F.get("v", F.lit(0))).cast("bigint").alias("min_words"),
        q(0.10).alias("p10"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), q(0.90).alias("p90"),
        some(F.get("v", F.col("n") - 1)).cast("bigint").alias("max_words"), F.round(mean, 3).alias("mean"), some(F.round(F.sqrt(var), 3)).alias("sd"),
    )


def sentence_length_dispersion(d: DataFrame) -> DataFrame:
    """From two sentences on: IQR over median, deviation over mean, median step between neighbours."""
    d = T.once(d, v=F.array_sort("lengths"), n=F.size("lengths"), sum=T.total(F.col("lengths")), squares=T.total(F.transform("lengths", lambda x: x.cast("bigint") * x)))
    steps = F.array_sort(F.zip_with(F.slice("lengths", 2, F.greatest(F.lit(1), F.col("n"))), F.slice("lengths", 1, F.greatest(F.lit(0), F.col("n") - 1)), lambda a, b: F.abs(a - b)))
    d = T.once(d, steps=F.when(F.col("n") > 1, steps))
    many = lambda c: F.when(F.col("n") > 1, c)
    v = F.col("v")
    mean = F.col("sum").cast("double") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("squares").cast("double") / F.col("n") - mean * mean)
    return d.select(
        "doc_id", F.col("n").cast("bigint").alias("n_sentences"),
        many(F.round(F.try_divide(T.percentile_of(v, 0.75) - T.percentile_of(v, 0.25), T.percentile_of(v, 0.5)), 3)).alias("iqr_over_median"),
        many(F.round(F.try_divide(F.sqrt(var), mean), 3)).alias("cov"),
        many(T.percentile_of(F.col("steps"), 0.5)).alias("median_adjacent_diff"),
    )


def dashes() -> Column:
    may = lambda t: F.contains(t, F.lit("—")) | F.contains(t, F.lit("--"))
    return T.total(F.transform("units", lambda u: F.when(may(u["text"]), F.regexp_count(u["text"], F.lit(r"—|(?<!-)--(?!-)"))).otherwise(0)), "int")


def semicolons() -> Column:
    return T.total(F.transform("units", lambda u: F.when(F.contains(u["text"], F.lit(";")), F.regexp_count(u["text"], F.lit(";"))).otherwise(0)), "int")


def punctuation_rates(d: DataFrame) -> DataFrame:
    """Em dashes (and lone double hyphens) and semicolons per 1000 words."""
    d = T.once(d, em=dashes(), semi=semicolons())
    a, b = rate(F.col("em"), F.col("n_words")), rate(F.col("semi"), F.col("n_words"))
    return d.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.col("em").cast("bigint").alias("em_dash"), F.col("semi").cast("bigint").alias("semicolon"),
        a.alias("em_dash_per_1k"), b.alias("semicolon_per_1k"), ((a > fixed.EM_DASH_PER_1K) | (b > fixed.SEMICOLON_PER_1K)).alias("soft_flag"),
    )


NEGPAR = "|".join(fixed.NEGATIVE_PARALLELISM)
ADJECTIVE = rf"\b(?:{'|'.join(fixed.REQUIREMENT_MODALS)})\s+(?:{'|'.join(fixed.REQUIREMENT_VERBS)})\s+(?:(?:{'|'.join(fixed.REQUIREMENT_DEGREES)})\s+)?(?:{'|'.join(fixed.REQUIREMENT_ADJECTIVES)})\b"
TRANSITION = rf"(?i)^(?:{'|'.join(sorted(fixed.TRANSITION_OPENERS, key=lambda x: (-len(x), x)))})(?!\p{{L}})"


def transition_hits() -> Column:
    """Sentences that start with a transition opener, with the opener."""
    hit = lambda s: F.regexp_extract(s["sentence"], TRANSITION, 0)
    start = lambda t: F.exists(F.array(*map(F.lit, fixed.TRANSITION_OPENERS)), lambda o: F.startswith(t, o))
    some = F.filter("sentences", lambda s: T.let(F.lower(F.substring(s["sentence"], 1, 24)), start))
    return F.filter(F.transform(some, lambda s: F.struct(F.lower(hit(s)).alias("match"), s["line_start"].alias("line_start"))), lambda h: h["match"] != "")


def _kinded(hits: Column, kind: str, chars: int | None = None) -> Column:
    return F.transform(hits, lambda h: F.struct((h["match"] if chars is None else F.substring(h["match"], 1, chars)).alias("match"), h["line_start"].alias("line_start"), F.lit(kind).alias("kind")))


def stock_hits() -> Column:
    """Stock phrases and duality templates of all units, each with its cluster."""
    phrases = [_kinded(per_unit(_alternation(v), "U", v, low=True), k) for k, v in fixed.STOCK_CLUSTERS.items()]
    return F.concat(*phrases, *[_kinded(per_unit(p, "U", ("not only", "not just"), low=True), "duality_framing", fixed.DUALITY_CHARS) for p in fixed.DUALITY_TEMPLATES])


def diction_hits() -> Column:
    kinds = {"buzzword": fixed.BUZZWORDS, "intensifier": fixed.INTENSIFIERS}
    return F.concat(*[_kinded(per_unit(_alternation(v), "U", v, low=True), k) for k, v in kinds.items()])


def clipped(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(F.substring(F.regexp_replace(h["match"], r"(?U)\s+", " "), 1, fixed.MATCH_CHARS).alias("match"), h["line_start"].alias("line_start")))


def hits_of(metric: str) -> Column:
    """All matches of a phrase metric in a prepared frame, with lines; counts use all, locations may be capped."""
    return {
        "negative_parallelism": lambda: clipped(per_unit(NEGPAR, "iU", ("not",))),
        "rule_of_three": lambda: clipped(per_unit(fixed.RULE_OF_THREE, "U", ("and",))),
        "transition_clusters": transition_hits,
        "vague_attribution": lambda: per_unit(_alternation(fixed.VAGUE_ATTRIBUTION), "U", fixed.VAGUE_ATTRIBUTION, low=True),
        "stock_lexical_clusters": stock_hits,
        "generic_diction": diction_hits,
        "adjective_requirements": lambda: clipped(per_unit(ADJECTIVE, "iU", (*T.ODD, *fixed.REQUIREMENT_MODALS))),
    }[metric]()


CAPPED = ("negative_parallelism", "rule_of_three", "adjective_requirements")


def paragraph_run_places(d: DataFrame) -> DataFrame:
    """d with `runs`, an array of (n, paragraphs, line_start, line_end): RUN_MIN neighbours or more with n sentences each."""
    sized = F.zip_with("units", "unit_sizes", lambda u, n: F.struct(u["structural_type"].alias("kind"), u["line_start"].alias("line_start"), u["line_end"].alias("line_end"), n.alias("n")))
    d = T.once(d, __paras=F.filter(sized, lambda p: p["kind"] == "paragraph"))
    p = F.col("__paras")
    long = F.filter(T.runs(p, lambda x, y: x["n"] == y["n"]), lambda r: (r["b"] - r["a"] + 1 >= fixed.RUN_MIN) & (F.get(p, r["a"])["n"] >= 1))

    def run(r: Column) -> Column:
        own = F.slice(p, r["a"] + 1, r["b"] - r["a"] + 1)
        return F.struct(F.get(p, r["a"])["n"].cast("bigint").alias("n"), (r["b"] - r["a"] + 1).cast("bigint").alias("paragraphs"), F.array_min(F.transform(own, lambda x: x["line_start"])).cast("bigint").alias("line_start"), F.array_max(F.transform(own, lambda x: x["line_end"])).cast("bigint").alias("line_end"))

    return T.once(d, runs=F.transform(long, run)).drop("__paras")


def paragraph_runs(d: DataFrame) -> DataFrame:
    """Runs of RUN_MIN paragraphs or more with the same number of sentences."""
    rows = paragraph_run_places(d).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    return rows.select("doc_id", F.col("n").alias("sentences_each"), "paragraphs", "line_start", "line_end")


#: A sentence as far as its third word.
LEAD = rf"(?s)^(?:[^\p{{L}}\p{{Nl}}\p{{No}}]*+{T.WORD}){{1,3}}"


def opener_places(d: DataFrame) -> DataFrame:
    """d with `openers`, an array of (prefix_len, prefix, sentences, line_start, line_end, first_idx) as in opener_clusters.

    Sorted by opener and sentence, a cluster is a run of neighbours: nothing leaves its document's row.
    """

    def of(s: Column, i: Column) -> Column:
        words = F.transform(T.words(F.regexp_extract(s["sentence"], LEAD, 0)), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))
        one = lambda w, k: F.struct(F.array_join(F.slice(w, 1, k), " ").alias("prefix"), F.lit(k).alias("k"), i.cast("int").alias("i"), s["line_start"].alias("line_start"), s["line_end"].alias("line_end"))
        return T.let(words, lambda w: F.slice(F.array(*[one(w, k) for k in (1, 2, 3)]), F.lit(1), F.when(F.size(w) >= 2, F.size(w)).otherwise(0)))

    d = T.once(d, __openers=F.array_sort(F.flatten(F.transform("sentences", of))))
    o = F.col("__openers")
    near = lambda x, y: (x["k"] == y["k"]) & (x["prefix"] == y["prefix"]) & (y["i"] - x["i"] <= fixed.OPENER_GAP)
    many = F.filter(T.runs(o, near), lambda r: r["b"] - r["a"] + 1 >= fixed.OPENER_MIN)

    def cluster(r: Column) -> Column:
        first, last = F.get(o, r["a"]), F.get(o, r["b"])
        return F.struct(first["k"].cast("bigint").alias("prefix_len"), first["prefix"].alias("prefix"), (r["b"] - r["a"] + 1).cast("bigint").alias("sentences"), first["line_start"].cast("bigint").alias("line_start"), last["line_end"].cast("bigint").alias("line_end"), first["i"].cast("bigint").alias("first_idx"))

    return T.once(d, openers=F.transform(many, cluster)).drop("__openers")


def opener_clusters(d: DataFrame) -> DataFrame:
    """Openers of 1 to 3 words that come OPENER_MIN times or more, never more than OPENER_GAP sentences apart."""
    return opener_places(d).select("doc_id", F.explode("openers").alias("o")).select("doc_id", "o.*")


def bold_label_density(d: DataFrame) -> DataFrame:
    blocks = F.filter("units", lambda u: u["structural_type"].isin("paragraph", "list_item"))
    d = d.withColumn("blocks", F.size(blocks)).withColumn("labels", F.size(F.filter(blocks, lambda u: u["is_label"])))
    return d.select("doc_id", F.col("blocks").cast("bigint").alias("n_blocks"), F.col("labels").cast("bigint").alias("n_labels"), F.round(F.col("labels") / F.greatest(F.lit(1), F.col("blocks")), 3).alias("rate"))


def phrase_counts(d: DataFrame, metric: str) -> DataFrame:
    """doc_id, count, rate, soft_flag of a phrase metric."""
    d = T.once(d, n=F.size(hits_of(metric)))
    n = F.col("n")
    rates = {"negative_parallelism": rate(n, F.col("n_words")), "transition_clusters": rate(n, F.col("n_words"))}
    flags = {"negative_parallelism": n >= fixed.NEGATIVE_PARALLELISM_FLAG, "transition_clusters": n > 0, "generic_diction": n >= fixed.GENERIC_DICTION_FLAG, "adjective_requirements": n >= 1}
    return d.select("doc_id", n.cast("bigint").alias("count"), rates.get(metric, F.lit(None).cast("double")).alias("rate"), flags.get(metric, F.lit(None).cast("boolean")).alias("soft_flag"))


PHRASE_METRICS = ("negative_parallelism", "rule_of_three", "transition_clusters", "vague_attribution", "stock_lexical_clusters", "generic_diction")


def locations(d: DataFrame, genre: str | None = None) -> DataFrame:
    """doc_id, metric, ord, line_start, line_end, evidence of every metric that has places; capped where the metric is.

    genre names a column; rows where it is `prd` get adjective requirements too.
    """
    return located(d, genre).select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.*")


def located(d: DataFrame, genre: str | None = None) -> DataFrame:
    """d with `places`, what `locations` tells of a document as an array."""
    def placed(metric: str, hits: Column) -> Column:
        return F.transform(hits, lambda h, i: F.struct(F.lit(metric).alias("metric"), i.cast("bigint").alias("ord"), h["line_start"].cast("bigint").alias("line_start"), h["line_end"].cast("bigint").alias("line_end"), h["evidence"].alias("evidence")))

    def phrase(metric: str) -> Column:
        hits = hits_of(metric)
        hits = F.slice(hits, 1, fixed.MAX_LOCATIONS) if metric in CAPPED else hits
        return placed(metric, F.transform(hits, lambda h: F.struct(h["line_start"].alias("line_start"), h["line_start"].alias("line_end"), h["match"].alias("evidence"))))

    parts = [phrase(m) for m in PHRASE_METRICS]
    if genre:
        asks = phrase("adjective_requirements")
        parts.append(F.when(F.col(genre) == "prd", asks).otherwise(F.slice(asks, 1, 0)))
    labels = F.filter("units", lambda u: u["is_label"])
    parts.append(placed("bold_label_density", F.transform(labels, lambda u: F.struct(u["line_start"].alias("line_start"), u["line_end"].alias("line_end"), F.lit(None).cast("string").alias("evidence")))))
    place = lambda metric, ord_, h, evidence: F.struct(F.lit(metric).alias("metric"), ord_.alias("ord"), h["line_start"].alias("line_start"), h["line_end"].alias("line_end"), evidence.alias("evidence"))
    parts.append(F.transform("runs", lambda r: place("paragraph_sentence_count_runs", r["line_start"], r, F.lit(None).cast("string"))))
    parts.append(F.transform("openers", lambda o: place("repeated_openers", o["first_idx"] * 4 + o["prefix_len"], o, o["prefix"])))
    return T.once(opener_places(paragraph_run_places(d)), places=F.concat(*parts)).drop("runs", "openers")


def envelope(d: DataFrame, genre: str | None = None, profile: str = "text-v1", keep: tuple[str, ...] = ()) -> DataFrame:
    """All metrics in long form: doc_id, metric, metric_class, eligible_units, count, rate, soft_flag, versions, and columns to keep."""
    n_units, n_sents = F.size("units"), F.size("sentences")
    hits = F.struct(*[F.size(hits_of(m)).alias(m) for m in (*PHRASE_METRICS, *(["adjective_requirements"] if genre else []))])
    none, flag = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    h = lambda m: F.col("__hits")[m]
    p = T.once(opener_places(paragraph_run_places(d)), __hits=hits, __em=dashes(), __semi=semicolons())
    words = F.col("n_words")
    blocks = F.filter("units", lambda u: u["structural_type"].isin("paragraph", "list_item"))
    labels = F.size(F.filter(blocks, lambda u: u["is_label"]))

    def row(metric: str, eligible: Column, count: Column, rate_: Column = none, soft: Column = flag, keep: Column | None = None) -> Column:
        s = F.struct(F.lit(metric).alias("metric"), eligible.cast("bigint").alias("eligible_units"), count.cast("bigint").alias("count"), rate_.cast("double").alias("rate"), soft.cast("boolean").alias("soft_flag"))
        return s if keep is None else F.when(keep, s)

    rows = [
        row("sentence_length_distribution", n_sents, n_sents),
        row("sentence_length_dispersion", n_sents, n_sents),
        row("punctuation_rates", words, F.col("__em") + F.col("__semi"), none, (rate(F.col("__em"), words) > fixed.EM_DASH_PER_1K) | (rate(F.col("__semi"), words) > fixed.SEMICOLON_PER_1K)),
        row("negative_parallelism", words, h("negative_parallelism"), rate(h("negative_parallelism"), words), h("negative_parallelism") >= fixed.NEGATIVE_PARALLELISM_FLAG),
        row("rule_of_three", n_units, h("rule_of_three")),
        row("bold_label_density", F.size(blocks), labels, F.round(labels / F.greatest(F.lit(1), F.size(blocks)), 3)),
        row("transition_clusters", words, h("transition_clusters"), rate(h("transition_clusters"), words), h("transition_clusters") > 0),
        row("vague_attribution", n_units, h("vague_attribution")),
        row("stock_lexical_clusters", n_units, h("stock_lexical_clusters")),
        row("generic_diction", n_units, h("generic_diction"), none, h("generic_diction") >= fixed.GENERIC_DICTION_FLAG),
    ]
    if genre:
        rows.append(row("adjective_requirements", n_units, h("adjective_requirements"), none, h("adjective_requirements") >= 1, F.col(genre) == "prd"))
    paras = F.size(F.filter("units", lambda u: u["structural_type"] == "paragraph"))
    n_runs, n_openers = F.coalesce(F.size("runs"), F.lit(0)), F.coalesce(F.size("openers"), F.lit(0))
    rows += [row("paragraph_sentence_count_runs", paras, n_runs, none, n_runs > 0), row("repeated_openers", n_sents, n_openers, none, n_openers > 0)]
    p = T.once(p, __rows=F.filter(F.array(*rows), lambda x: x.isNotNull()))
    out = p.select("doc_id", *keep, F.explode("__rows").alias("m")).select("doc_id", *keep, "m.*")
    pick = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    return out.select("doc_id", *keep, "metric", pick(fixed.METRIC_CLASS).alias("metric_class"), "eligible_units", "count", "rate", "soft_flag", pick(fixed.METRIC_VERSION).alias("metric_version"), pick(fixed.METRIC_CONFIDENCE).alias("confidence"), F.lit(profile).alias("extraction_profile"), F.lit(fixed.PURPOSE).alias("purpose"))
