"""Atom extractors: text to arrays of normalised atoms, and multisets of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosespark.functions import fixed
from prosespark.functions.text import ODD, holds, let


def _phrase(words: tuple[str, ...], space: str) -> str:
    return "|".join(space.join(re.escape(w) for w in p.split(" ")) for p in words)


MODAL = rf"\b(?:{_phrase(fixed.MODALS, r'\s+')})\b"
BUZZWORD = rf"\b(?:{_phrase(tuple(sorted(fixed.BUZZWORDS, key=lambda x: (-len(x), x))), ' ')})\b"
AUTHORITY = rf"\b(?:{_phrase(tuple(sorted(fixed.VAGUE_ATTRIBUTION, key=lambda x: (-len(x), x))), r'\s+')})\b"


#: What a text in lower case must hold for a pattern to match: plain searches spare most texts the pattern.
NEEDS = {
    "modality": (*ODD, "must", "shall", "should", "may", "will", "can", "required", "might", "could"),
    "negation": (*ODD, "no", "never", "neither", "without", "n't", "n’t"),
    "conditions": (*ODD, "if", "when", "unless", "provided", "case", "long", "where", "assuming"),
    "citations": ("[", "("),
    "urls": ("://", "www."),
    "thresholds": (*ODD, "<", ">", "≤", "≥", "least", "most", "more", "fewer", "greater", "less", "minimum", "maximum", "up"),
    "defined_terms": (*ODD, '"', "hereafter", "hereinafter"),
    "buzzwords": (*ODD, *fixed.BUZZWORDS),
    "borrowed_authority": (*ODD, *(max(x.split(" "), key=len) for x in fixed.VAGUE_ATTRIBUTION)),
}


def found(c: Column, pattern: str, flags: str = "U", need: str | None = None, low: Column | None = None) -> Column:
    """All matches; with a need, low is c in lower case if that is at hand."""
    every = F.regexp_extract_all(c, F.lit(f"(?{flags}){pattern}"), F.lit(0))
    return F.when(~(_may(c, need) if low is None else holds(low, NEEDS[need])), F.array().cast("array<string>")).otherwise(every) if need else every


def _may(c: Column, need: str) -> Column:
    return let(F.lower(c), lambda low: holds(low, NEEDS[need]))


def _digit(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?U)\d"))


def _of_digits(c: Column, pattern: str) -> Column:
    return F.when(~_digit(c), F.array().cast("array<string>")).otherwise(found(c, pattern))


def _spaced(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.regexp_replace(x, r"(?U)\s+", " "))


def _lower(xs: Column) -> Column:
    return F.transform(xs, F.lower)


def _plain_number(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.replace(F.replace(c, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">=")), "−", "-"), ",", "")


def numbers(c: Column, low: Column | None = None) -> Column:
    """Comparator, sign, digits without thousands separators, per cent sign."""
    return F.transform(_of_digits(c, fixed.NUMBER), lambda m: F.regexp_replace(_plain_number(m), r"(?U)\s+", ""))


def quantities(c: Column) -> Column:
    """value|unit, the unit lower-case or empty."""
    def one(m: Column) -> Column:
        unit = F.regexp_extract(m, r"(%|[A-Za-z]{1,12})$", 1)
        value = F.regexp_replace(_plain_number(F.regexp_replace(m, r"(?U)\s*(?:%|[A-Za-z]{1,12})?$", "")), r"(?U)\s+", "")
        return F.concat(value, F.lit("|"), F.lower(unit))

    return F.transform(_of_digits(c, fixed.QUANTITY), one)


def dates(c: Column, low: Column | None = None) -> Column:
    return _spaced(_of_digits(c, fixed.DATE))


def urls(c: Column, low: Column | None = None) -> Column:
    return F.transform(found(c, fixed.URL, "iU", "urls", low), lambda x: F.regexp_replace(x, r"[.,;:]+$", ""))


def citations(c: Column, low: Column | None = None) -> Column:
    return _spaced(found(c, fixed.CITATION, need="citations", low=low))


def thresholds(c: Column, low: Column | None = None) -> Column:
    return _lower(found(c, fixed.THRESHOLD, "iU", "thresholds", low))


def modality(c: Column, low: Column | None = None) -> Column:
    return _spaced(_lower(found(c, MODAL, "iU", "modality", low)))


def negation(c: Column, low: Column | None = None) -> Column:
    return _lower(found(c, fixed.NEGATION, "iU", "negation", low))


def conditions(c: Column, low: Column | None = None) -> Column:
    return _spaced(_lower(found(c, fixed.CONDITION, "iU", "conditions", low)))


def proper_nouns(c: Column) -> Column:
    return found(c, fixed.PROPER_NOUN)


def cross_refs(c: Column) -> Column:
    return F.concat(citations(c), urls(c))


def defined_terms(c: Column) -> Column:
    """The whole region as one atom, white space normalised."""
    norm = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(norm != "", F.array(norm)).otherwise(F.array().cast("array<string>"))


def buzzwords(c: Column, low: Column | None = None) -> Column:
    return _lower(found(c, BUZZWORD, "iU", "buzzwords", low))


def borrowed_authority(c: Column, low: Column | None = None) -> Column:
    return _spaced(_lower(found(c, AUTHORITY, "iU", "borrowed_authority", low)))


#: The extractor of each region check.
CHECKS = {
    "numbers": numbers,
    "units": quantities,
    "modality": modality,
    "negation": negation,
    "conditions": conditions,
    "cross_refs": cross_refs,
    "defined_terms": defined_terms,
}
#: Claim categories: a new atom of one of these is an invented claim.
CLAIMS = {"number": numbers, "date": dates, "url": urls, "citation": citations, "threshold": thresholds, "buzzword": buzzwords, "borrowed_authority": borrowed_authority}
ALL = CLAIMS | {"quantity": quantities, "modality": modality, "negation": negation, "condition": conditions, "proper_noun": proper_nouns, "cross_ref": cross_refs}


def multiset(atoms: Column) -> Column:
    """A canonical, comparable multiset: the atoms sorted, repeats kept."""
    return F.array_sort(atoms)


def counts(atoms: Column) -> Column:
    """(atom, n) of each distinct atom, sorted."""
    return let(atoms, lambda xs: F.transform(F.array_sort(F.array_distinct(xs)), lambda a: F.struct(a.alias("atom"), F.size(F.filter(xs, lambda b: b == a)).alias("n"))))


def new_claims(original: Column, revision: Column, allowed: Column) -> Column:
    """(category, atom) of claim atoms that the revision has and neither the original nor allowed has."""
    def of(kind: str, low: Column) -> Column:
        # an original is searched only where its revision has atoms
        fresh = lambda xs: F.when(F.size(xs) == 0, xs).otherwise(F.array_sort(F.array_except(F.array_except(xs, CLAIMS[kind](original)), allowed)))
        return F.transform(let(CLAIMS[kind](revision, low), fresh), lambda a: F.struct(F.lit(kind).alias("category"), a.alias("atom")))

    return let(F.lower(revision), lambda low: F.concat(*[of(k, low) for k in CLAIMS]))


def checks_in(segment: Column) -> Column:
    """The invariant checks that a segment calls for, in fixed order."""
    def of(low: Column) -> Column:
        some = lambda need, pattern, flags="iU": holds(low, NEEDS[need]) & F.rlike(segment, F.lit(f"(?{flags}){pattern}"))
        number = _digit(segment)  # quantities need a digit and nothing else, dates need one too
        tests = {
            "numbers": number,
            "units": number,
            "modality": some("modality", MODAL),
            "negation": some("negation", fixed.NEGATION),
            "conditions": some("conditions", fixed.CONDITION),
            "cross_refs": some("citations", fixed.CITATION, "U") | some("urls", fixed.URL),
            "defined_terms": some("defined_terms", fixed.DEFINED_TERM),
        }
        return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())

    return let(F.lower(segment), of)
