"""Validators: each gives an array of problem codes, empty where a row is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosespark.functions import fixed

HEX64 = r"^[0-9a-f]{64}$"


def _some(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def _among(c: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*names), F.lit(False))


def _listed(tests: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())


def _replacement(action: Column, replacement: Column) -> dict[str, Column]:
    raw = F.try_to_binary(replacement, F.lit("base64"))
    return {
        "replacement_missing": (action == "edit") & ~_some(replacement),
        "replacement_not_base64": (action == "edit") & _some(replacement) & raw.isNull(),
        "replacement_not_utf8": (action == "edit") & raw.isNotNull() & ~F.coalesce(F.is_valid_utf8(raw.cast("string")), F.lit(False)),
        "replacement_not_allowed": F.coalesce(action != "edit", F.lit(True)) & replacement.isNotNull(),
    }


def feedback(rows: DataFrame) -> DataFrame:
    """rows with `problems` of a feedback line."""
    c = F.col
    stamp = F.try_to_timestamp(F.regexp_replace(c("ts"), "Z$", "+00:00"))
    tests = {
        "schema_version": c("schema_version").isNotNull() & (c("schema_version") != 1),
        **{f"{x}_empty": ~_some(c(x)) for x in ("ts", "finding_id", "category", "metric")},
        "ts_not_iso": c("ts").isNotNull() & stamp.isNull(),
        "ts_without_time": stamp.isNotNull() & ~F.rlike(c("ts"), F.lit("[T ]")),
        "genre": ~_among(c("genre"), fixed.GENRES),
        "recommendation": ~_among(c("recommendation"), ("strip", "keep")),
        "user_action": ~_among(c("user_action"), fixed.USER_ACTIONS),
        "doc_sha": ~F.coalesce(F.rlike(c("doc_sha"), F.lit(HEX64)), F.lit(False)),
        **_replacement(c("user_action"), c("replacement")),
        "alternative_empty": c("alternative").isNotNull() & ~_some(c("alternative")),
        "alternative_not_allowed": _some(c("alternative")) & F.coalesce(c("user_action") != "edit", F.lit(True)),
        "reason": c("reason").isNotNull() & ~_among(c("reason"), fixed.REASONS),
    }
    return rows.withColumn("problems", _listed(tests))


def decisions(rows: DataFrame, findings: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, source_sha256, finding_id, user_action, replacement, alternative, reason) with `problems`.

    findings binds finding ids to their audit, sources (doc_id, sha) binds the file; both are needed before applying.
    """
    c = F.col
    out = rows.withColumn("__same", F.count("*").over(Window.partitionBy("doc_id", "finding_id")))
    if findings is not None:
        out = out.join(findings.select("doc_id", "finding_id", F.lit(True).alias("__known")).distinct(), ["doc_id", "finding_id"], "left")
    else:
        out = out.withColumn("__known", F.lit(True))
    if sources is not None:
        out = out.join(sources.select("doc_id", F.col("sha").alias("__sha")), "doc_id", "left")
    else:
        out = out.withColumn("__sha", c("source_sha256"))
    sound = F.coalesce(F.rlike(c("source_sha256"), F.lit(HEX64)), F.lit(False))
    tests = {
        "source_sha256": ~sound,
        "source_drifted": sound & ~c("source_sha256").eqNullSafe(c("__sha")),
        "finding_id_empty": ~_some(c("finding_id")),
        "finding_id_twice": _some(c("finding_id")) & (c("__same") > 1),
        "finding_id_unknown": _some(c("finding_id")) & c("__known").isNull(),
        "user_action": ~_among(c("user_action"), fixed.USER_ACTIONS),
        **_replacement(c("user_action"), c("replacement")),
        "alternative_not_allowed": _some(c("alternative")) & F.coalesce(c("user_action") != "edit", F.lit(True)),
        "reason": c("reason").isNotNull() & ~_among(c("reason"), fixed.REASONS),
    }
    return out.withColumn("problems", _listed(tests)).drop("__same", "__known", "__sha")


def alternatives(column: Column) -> Column:
    """Problems of an array of (id, text, claim_status, label)."""
    ids = F.transform(F.filter(column, lambda a: _some(a["id"])), lambda a: a["id"])
    return _listed({
        "id_empty": F.exists(column, lambda a: ~_some(a["id"])),
        "id_twice": F.size(F.array_distinct(ids)) < F.size(ids),
        "text_missing": F.exists(column, lambda a: a["text"].isNull()),
        "claim_status": F.exists(column, lambda a: ~_among(a["claim_status"], ("none", "scoped", "kept", "banned"))),
        "label_empty": F.exists(column, lambda a: a["label"].isNotNull() & ~_some(a["label"])),
    })


DIRECTIONS = ("ai_to_human", "human_to_ai", "before_only")
VALIDITIES = ("faithful", "fabricated", "indeterminate", "none")
LANES = ("fixture", "judge_reference", "calibration", "inspiration")
SPLITS = ("calibration", "held_out")
REDISTRIBUTION = ("permitted", "share-alike", "prohibited")


def manifest(items: DataFrame) -> DataFrame:
    """items with `problems`: enums, required texts, a split just for items of the calibration lane, one split a family."""
    c = F.col
    families = items.where("split is not null").groupBy("source_family").agg(F.count_distinct("split").alias("__splits"))
    out = items.join(families, "source_family", "left")
    tunable = F.coalesce(F.array_contains("artifact_lanes", F.lit("calibration")), F.lit(False))
    tests = {
        **{f"{x}_empty": ~_some(c(x)) for x in ("source_id", "item_id", "source_family", "license")},
        "redistribution": ~_among(c("redistribution"), REDISTRIBUTION),
        "direction": ~_among(c("direction"), DIRECTIONS),
        "after_validity": ~_among(c("after_validity"), VALIDITIES),
        "genre": ~_among(c("genre"), fixed.GENRES),
        "artifact_lanes": F.coalesce(F.exists("artifact_lanes", lambda x: ~_among(x, LANES)), F.lit(True)),
        "split": c("split").isNotNull() & ~_among(c("split"), SPLITS),
        "split_without_lane": c("split").isNotNull() & ~tunable,
        "lane_without_split": c("split").isNull() & tunable,
        "family_in_both_splits": F.coalesce(c("__splits") > 1, F.lit(False)),
    }
    return out.withColumn("problems", _listed(tests)).drop("__splits")


def fixture(fixtures: DataFrame) -> DataFrame:
    """fixtures (content, genre, control, editable_ranges, protected_spans) with `problems`."""
    n = F.octet_length("content")
    out_of = lambda r: (r["start_byte"] < 0) | (r["end_byte"] < r["start_byte"]) | (r["end_byte"] > n)
    piece = lambda r: F.substring(F.col("content"), (r["start_byte"] + 1).cast("int"), F.greatest(F.lit(0), r["end_byte"] - r["start_byte"]).cast("int"))
    clash = lambda a, b: (a["end_byte"] > b["start_byte"]) & (a["start_byte"] < b["end_byte"])

    def own(name: str) -> Column:
        o = F.array_sort(F.transform(name, lambda r: F.struct(r["start_byte"].alias("start_byte"), r["end_byte"].alias("end_byte"))))
        return F.exists(F.zip_with(F.slice(o, F.lit(1), F.greatest(F.lit(0), F.size(o) - 1)), F.slice(o, 2, F.greatest(F.lit(1), F.size(o))), lambda a, b: clash(a, b)), lambda x: x)

    tests = {
        "genre": ~_among(F.col("genre"), fixed.GENRES),
        "editable_out_of_bounds": F.exists("editable_ranges", out_of),
        "protected_out_of_bounds": F.exists("protected_spans", out_of),
        "editable_overlap": own("editable_ranges"),
        "protected_overlap": own("protected_spans"),
        "editable_in_protected": F.exists("editable_ranges", lambda e: F.exists("protected_spans", lambda p: clash(e, p))),
        "protected_hash": F.exists("protected_spans", lambda p: F.sha2(piece(p), 256) != p["sha256"]),
        "control_with_ranges": F.coalesce(F.col("control"), F.lit(False)) & (F.size("editable_ranges") > 0),
    }
    return fixtures.withColumn("problems", _listed(tests))
