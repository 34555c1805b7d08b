"""Genre by precedence: declared, then path, then structure, then the most preserving one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.functions import atoms as A
from prosespark.functions import fixed
from prosespark.functions import text as T

UNICODE = "iU"
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: Whole words (text.WORD) of fixed.FIRST_PERSON.
FIRST_PERSON = rf"(?=[iImM])(?<!{_LETTER})(?<!{_LETTER}['’])(?i:{'|'.join(w.replace(chr(39), '[' + chr(39) + '’]') for w in sorted(fixed.FIRST_PERSON, key=len, reverse=True))})(?!['’]?{_LETTER})"
STRONG_NEEDS = (*T.ODD, "must", "shall", "required")
MARKET_NEEDS = (*T.ODD, "market", "competit", "invest", "brand", "position", "customer", "revenue", "monetiz", "moat", "segment", "pricing", "adoption", "value proposition", "class", "grade", "flywheel", "retention", "differentiat")


def declared(c: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in fixed.GENRE_ALIASES.items() for x in kv])
    return F.try_element_at(aliases, F.lower(T.strip(c)))


def from_path(c: Column) -> Column:
    tokens = F.split(F.lower(c), r"[/\\._\-\s]+")
    out = F.lit(None).cast("string")
    for genre, names in reversed(fixed.PATH_TOKENS):
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, names))), F.lit(genre)).otherwise(out)
    return out


def from_structure(text: Column) -> Column:
    """First-person density, then PRD phrases, then strong modals, then the marketing lexicon."""
    n = T.count_words(text)

    def of(low: Column) -> Column:
        prd = sum(F.contains(low, F.lit(m)).cast("int") for m in fixed.PRD_MARKERS)
        modals = F.when(T.holds(low, STRONG_NEEDS), F.regexp_count(text, F.lit(f"(?{UNICODE}){fixed.STRONG_MODALS}")))
        # words are counted only where enough of what is looked for was found
        few = lambda xs: F.when(F.size(xs) >= 8, (n > 0) & (F.size(xs) >= F.lit(0.008) * n) & (F.size(F.array_distinct(F.transform(xs, F.lower))) >= 4))
        market = F.when(T.holds(low, MARKET_NEEDS), T.let(A.found(text, fixed.MARKETING, UNICODE), few))
        return F.when(prd >= 2, F.lit("prd")).when(modals >= 3, F.lit("spec")).when(market, F.lit("marketing"))

    personal = T.let(F.regexp_count(text, F.lit(FIRST_PERSON)), lambda first: F.when(first >= 3, first >= F.lit(0.05) * n))
    return F.when(personal, F.lit("personal")).otherwise(T.let(F.lower(text), of))


def classify(docs: DataFrame, declared_col: str | None = None, path_col: str | None = None, text: str = "text") -> DataFrame:
    """docs with genre, genre_confidence, genre_reason."""
    none = F.lit(None).cast("string")
    a = declared(F.col(declared_col)) if declared_col else none
    b = from_path(F.col(path_col)) if path_col else none
    d = T.once(docs, __a=a, __b=b, __c=from_structure(F.col(text)))
    confidence = F.when(F.col("__a").isNotNull(), F.lit("high")).when(F.coalesce("__b", "__c").isNotNull(), F.lit("medium")).otherwise(F.lit("low"))
    reason = F.when(F.col("__a").isNotNull(), F.lit("declared")).when(F.col("__b").isNotNull(), F.lit("path")).when(F.col("__c").isNotNull(), F.lit("structure")).otherwise(F.lit("fallback"))
    return d.withColumns({"genre": F.coalesce("__a", "__b", "__c", F.lit(fixed.FALLBACK_GENRE)), "genre_confidence": confidence, "genre_reason": reason}).drop("__a", "__b", "__c")
