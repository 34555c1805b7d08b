"""Calibration: labelled points, threshold fits, stratified scores, split checks, voice features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosespark.functions import fixed
from prosespark.functions import text as T


def length_bucket(text: Column) -> Column:
    n = F.regexp_count(text, F.lit(r"(?U)\S++"))
    return F.when(n < 150, F.lit("short")).when(n < 600, F.lit("medium")).otherwise(F.lit("long"))


def points(items: DataFrame, metrics: DataFrame) -> DataFrame:
    """metric, value, positive, genre, length, tell, item_id from items (item_id, control, tells, genre, length) and metric rows.

    Controls and items without tells are negatives; an item with the metric's tell is a positive; others are skipped. A
    metric without a rate counts as 0.0.
    """
    tell = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.METRIC_TELL.items() for x in kv]), F.col("metric"))
    rows = items.join(metrics.select(F.col("doc_id").alias("item_id"), "metric", "rate"), "item_id").withColumn("tell", tell).where("tell is not null")
    clean = F.coalesce("control", F.lit(False)) | (F.size(F.coalesce("tells", F.array().cast("array<string>"))) == 0)
    rows = rows.withColumn("positive", F.when(clean, F.lit(False)).when(F.array_contains("tells", F.col("tell")), F.lit(True)))
    return rows.where("positive is not null").select("metric", F.coalesce("rate", F.lit(0.0)).alias("value"), "positive", "genre", "length", "tell", "item_id")


def fit_thresholds(points_: DataFrame) -> DataFrame:
    """metric, threshold, f1, n_pos, n_neg, reason: the cut that maximises F1, the smallest of equals.

    Points are counted by value first, so a metric's window holds its distinct values; running sums replace a scan of
    all points for each cut.
    """
    by_value = points_.groupBy("metric", "value").agg(F.count_if(F.col("positive")).alias("p"), F.count_if(~F.col("positive")).alias("q"))
    up = Window.partitionBy("metric").orderBy("value")
    every = Window.partitionBy("metric")
    rows = by_value.withColumn("pos", F.sum("p").over(every)).withColumn("neg", F.sum("q").over(every))
    after = up.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("tp_after", F.coalesce(F.sum("p").over(after), F.lit(0))).withColumn("fp_after", F.coalesce(F.sum("q").over(after), F.lit(0)))
    rows = rows.withColumn("next", F.lead("value").over(up)).withColumn("first", F.row_number().over(up) == 1)
    cut = lambda t, tp, fp: F.struct(t.cast("double").alias("t"), tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"))
    below = F.when(F.col("first"), cut(F.col("value") - 1e-9, F.col("pos"), F.col("neg")))
    above = cut(F.when(F.col("next").isNotNull(), (F.col("value") + F.col("next")) / 2).otherwise(F.col("value") + 1e-9), F.col("tp_after"), F.col("fp_after"))
    cuts = rows.select("metric", "pos", "neg", F.explode(F.filter(F.array(below, above), lambda x: x.isNotNull())).alias("c")).select("metric", "pos", "neg", "c.*")
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + (F.col("pos") - F.col("tp"))), F.lit(0.0))
    best = cuts.withColumn("f1", f1).groupBy("metric").agg(F.first("pos").alias("n_pos"), F.first("neg").alias("n_neg"), F.max(F.struct("f1", (-F.col("t")).alias("m"))).alias("b"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return best.select("metric", F.when(both, F.round(-F.col("b.m"), 6)).alias("threshold"), F.when(both, F.round("b.f1", 6)).alias("f1"), F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"), F.when(~both, F.lit("insufficient_labels")).alias("reason"))


def evaluate(points_: DataFrame, thresholds: DataFrame) -> DataFrame:
    """axis, stratum, n, abstained, abstention_rate, precision, recall: overall and by tell, genre and length.

    Thresholds have a row a metric, so they are broadcast.
    """
    rows = points_.join(F.broadcast(thresholds.select("metric", "threshold")), "metric", "left").withColumn("flagged", F.col("value") >= F.col("threshold"))
    rows = rows.select("positive", "flagged", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("stratum")) for a, c in (("overall", F.lit("all")), ("tell", F.col("tell")), ("genre", F.col("genre")), ("length", F.col("length")))])).alias("s")).select("positive", "flagged", "s.*")
    tp, fp = F.count_if(F.col("flagged") & F.col("positive")), F.count_if(F.col("flagged") & ~F.col("positive"))
    fn, out = F.count_if(~F.col("flagged") & F.col("positive")), F.count_if(F.col("flagged").isNull())
    got = rows.groupBy("axis", "stratum").agg(F.count("*").alias("n"), out.alias("abstained"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 4)
    return got.select("axis", "stratum", "n", "abstained", share(F.col("abstained"), F.col("n")).alias("abstention_rate"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def shared_families(items: DataFrame) -> DataFrame:
    """Source families in both splits; must be empty."""
    of = lambda s: items.where(F.col("split") == s).select("source_family")
    return of("calibration").intersect(of("held_out"))


# fixed values: pronouns that lean to the first or the second person
FIRST = ("i", "we", "me", "us", "my", "our", "mine", "ours", "i'm", "we're", "we'll", "i'll", "i've", "we've", "i'd", "we'd")
SECOND = ("you", "your", "yours", "you're", "you'll", "you've", "you'd", "yourself")


def voice_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measures of one voice sample a row; they never authorize an edit."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__w", T.words(t)).withColumn("__s", T.sentences(t))
    low = F.transform("__w", F.lower)
    n, sents = F.size("__w"), F.size("__s")
    per = lambda pattern: F.round(F.regexp_count(t, F.lit(pattern)) / F.greatest(F.lit(1), sents), 4)
    first = F.size(F.filter(low, lambda w: w.isin(*FIRST)))
    second = F.size(F.filter(low, lambda w: w.isin(*SECOND)))
    lean = F.when(n == 0, F.lit("none")).when((first == 0) & (second == 0), F.lit("third")).when(first >= second, F.lit("first")).otherwise(F.lit("second"))
    return d.select(
        "doc_id",
        F.coalesce(F.round(F.try_divide(F.size(F.filter("__w", lambda w: F.rlike(w, F.lit("['’]")))), n), 4), F.lit(0.0)).alias("contraction_rate"),
        F.coalesce(F.round(F.try_divide(T.total(F.transform("__s", T.count_words)).cast("double"), sents), 4), F.lit(0.0)).alias("mean_sentence_len"),
        lean.alias("person_lean"), per("!").alias("exclamation_rate"), per(r"\?").alias("question_rate"), per("—| -- ").alias("em_dash_rate"), per(";").alias("semicolon_rate"), n.cast("bigint").alias("sample_words"),
    )
