"""The semantic layer's seam: an injected judge, the request it gets, and what may be believed of its answer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CONCERNS, MAX_MESSAGE = 50, 4000
#: Gets the original, the revision and the ledger's JSON; returns the answer's JSON text.
Judge = Callable[[str, str, str], str]


def offline_stub(original: str, revision: str, ledger: str) -> str:
    """Says clean without looking; its mode says so."""
    return '{"verdict":"clean","concerns":[]}'


def request(original: Column, revision: Column, ledger: Column) -> Column:
    """One JSON object with its keys in fixed order."""
    return F.to_json(F.struct(ledger.alias("ledger"), original.alias("original"), revision.alias("revision")))


def parse_answer(raw: str | None) -> dict | None:
    """The object in an answer, bare or in a code fence; None for anything else or over the limits."""
    try:
        m = re.search(r"```(?:json)?\s*\n(.*?)\n\s*```", raw or "", re.S)
        got = json.loads(m[1] if m else raw or "")
        concerns = got.get("concerns") or []
        if got.get("verdict") not in ("real", "ambiguous", "clean") or not isinstance(concerns, list) or len(concerns) > MAX_CONCERNS:
            return None
        for c in concerns:
            if not isinstance(c, dict) or not isinstance(c.get("message", ""), str) or len(c.get("message", "")) > MAX_MESSAGE:
                return None
        return got
    except (AttributeError, TypeError, ValueError):
        return None


def judged(cases: DataFrame, judge: Judge, original: str = "original", revision: str = "revision", ledger: str = "ledger_json") -> DataFrame:
    """cases with said (real, ambiguous or clean) and semantic_mode; a judge that fails says ambiguous, never clean."""
    mode = "offline_stub" if judge is offline_stub else "injected"

    def one(o: str, r: str, entries: str) -> str:
        try:
            got = parse_answer(judge(o, r, entries))
        except Exception:  # noqa: BLE001  whatever an injected judge raises
            got = None
        return got["verdict"] if got else "ambiguous"

    def ask(o: pd.Series, r: pd.Series, entries: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(o, r, entries, strict=True)], dtype=object)

    return cases.withColumn("said", F.pandas_udf(ask, "string")(original, revision, ledger)).withColumn("semantic_mode", F.lit(mode))


def confirms_model(asked: Column, reported: Column) -> Column:
    """Whether the reported model id is the alias asked for, or has it as a whole token."""
    return F.coalesce((reported == asked) | F.array_contains(F.split(F.lower(reported), r"[^a-z0-9]+"), F.lower(asked)), F.lit(False))
