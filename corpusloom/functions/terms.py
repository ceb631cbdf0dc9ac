"""Terms of a translated text, and the flags by which hard rows are told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import text as T

#: Patterns of formulas, measures, headers and names in translations, without regard to case but for names.
FORMULA = r'\b(?:Seal of|Sealed by)\s+[^,.;:\n"]+'
MEASURE = (
    r"\b\d+(?:\.\d+)?\s+(?:mina(?:s)?|shekel(?:s)?|talent(?:s)?|textile(?:s)?|litre(?:s)?)\b"
    r"(?:\s+of\s+(?:silver|tin|copper|grain))?"
)
HEADER = r"\b(?:To|From)\s+([^:\n]+)"
NAME = r"^[A-ZĀĪŪŠṢṬḪ][A-Za-zĀĪŪŠṢṬḪāīūšṣṭḫ'`\-<>]+$"
#: Marks of damage, units and formulas in sources, without regard to case.
MARKER_RICH = r"<gap>|[\[\]{}<>]|[₀₁₂₃₄₅₆₇₈₉]|(?<!\w)x(?!\w)"
SOURCE_MEASURE = r"\b(?:ma-na|ma\.na|gin2|g[íi]n|gur|qa|sila3|iku|sar)\b"
SOURCE_FORMULA = r"\b(?:um-ma|q[ií]-bi|ki-a-am|li-mu-um)\b"
#: What is cut off both ends of a source token.
TOKEN_EDGE = r"""[\[\]{}()<>.,;:"'`]+"""
NAME_WORDS, FORMULA_CHARS = 4, 8


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("(?iU)" + pattern), group), T.fold_whitespace)


def _trimmed(found: Column, least: int) -> Column:
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "^[ ,.;:]+|[ ,.;:]+$", "")), lambda x: F.length(x) >= least)


def formulas(c: Column) -> Column:
    return _trimmed(_found(c, FORMULA), FORMULA_CHARS)


def measures(c: Column) -> Column:
    return _trimmed(_found(c, MEASURE), 1)


def names(c: Column) -> Column:
    """Names after To and From: parts between commas and ``and`` that are one to four capitalised words."""
    parts = F.flatten(F.transform(_found(c, HEADER, 1), lambda h: F.split(F.regexp_replace(h, r"(?iU)\b(?:to|from)\b", " "), r"(?U),|\band\b")))
    lists = F.transform(parts, T.words)
    whole = F.filter(lists, lambda w: (F.size(w) > 0) & (F.size(w) <= NAME_WORDS) & F.forall(w, lambda x: x.rlike(NAME)))
    return F.transform(whole, lambda w: F.array_join(w, " "))


def terms(c: Column) -> Column:
    """(type, term) of every formula, measure and name, in this order, repeats included."""
    c = T.blank(c)
    of = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("term")))
    return F.concat(of("formula", formulas(c)), of("measure", measures(c)), of("name_or_place", names(c)))


def marker_rich(source: Column) -> Column:
    return T.blank(source).rlike("(?iU)" + MARKER_RICH)


def has_measure(source: Column, reference: Column) -> Column:
    """A unit in the source, or a unit word anywhere in the reference."""
    low = F.lower(T.blank(reference))
    hit = T.blank(source).rlike("(?iU)" + SOURCE_MEASURE)
    for unit in T.UNIT_WORDS:
        hit = hit | low.contains(unit)
    return hit


def has_formula(source: Column, reference: Column) -> Column:
    return (M.formula_count(T.blank(reference)) > 0) | T.blank(source).rlike("(?iU)" + SOURCE_FORMULA)


def name_tokens(source: Column) -> Column:
    """Source tokens that may be rare names: without edge marks, four characters or more, no digit."""
    bare = F.transform(T.words(F.lower(T.blank(source))), lambda w: F.regexp_replace(w, f"^{TOKEN_EDGE}|{TOKEN_EDGE}$", ""))
    return F.filter(bare, lambda w: (w != "<gap>") & (F.length(w) >= 4) & ~w.rlike(r"[\p{Nd}₀-₉⁰¹²³⁴-⁹]"))
