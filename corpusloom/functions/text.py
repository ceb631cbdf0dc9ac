"""String functions as Catalyst expressions: every one takes and returns a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are never visible.
INVISIBLE = "​‌‍﻿"
#: Units of measure.
UNIT_WORDS = ["mina", "minas", "shekel", "shekels", "talent", "talents", "textile", "textiles", "litre", "litres", "silver", "tin", "copper"]
#: Stems of formulas.
FORMULA_STEMS = ["Seal of", "Sealed by", "send me the silver", "will pay the silver", "not paid the silver"]
SPACE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """``body`` of a value computed once: inside a lambda a plain expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def as_bool(c: Column) -> Column:
    """Truth written as text: 1, true, t, yes or y in any case; all else is false."""
    return F.lower(F.trim(blank(c.cast("string")))).isin("1", "true", "t", "yes", "y")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_spaces(c: Column) -> Column:
    """Without space separators (Zs) at both ends, as SQL's trim; tabs and line ends stay."""
    return F.regexp_replace(c, r"^\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")


def remove_invisible(c: Column) -> Column:
    for char in INVISIBLE:
        c = F.replace(c, F.lit(char), F.lit(""))
    return c


def normalize_whitespace(c: Column) -> Column:
    """Line ends as \\n, every other run of white space as one space."""
    lines = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(lines, r"(?U)[^\S\n ][^\S\n]*| [^\S\n]+", " ")  # a single space is left as it is


def fold_whitespace(c: Column) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def canonical_gaps(c: Column) -> Column:
    big = F.regexp_replace(c, r"(?i)<\s*big\s+gap\s*>", "<big_gap>")
    return F.regexp_replace(big, r"(?i)<\s*gap\s*>", "<gap>")


def canonical_braces(c: Column) -> Column:
    return F.regexp_replace(c, r"\{\s*([^{}\n]*?)\s*\}", "{$1}")


def pair_text(c: Column, lower: bool = False, fold: bool = True) -> Column:
    out = strip(F.regexp_replace(c, "\r\n?", "\n"))
    out = fold_whitespace(out) if fold else out
    return F.lower(out) if lower else out


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def head_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def tail_words(c: Column, n: int) -> Column:
    w = words(c)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def shorten(c: Column, n: int) -> Column:
    """Texts of over n characters end in an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def snippet(c: Column, needle: str, around: int) -> Column:
    """``around`` characters on both sides of the first occurrence of ``needle``; null without one."""
    at = F.instr(c, needle)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at - start + len(needle) + around))


def has_prefix(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


def apply_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def source_token(c: Column) -> Column:
    """Lower case, edge punctuation off; the gap mark is no token."""
    out = F.regexp_replace(F.lower(c), r"^[\p{Punct}…]+|[\p{Punct}…]+$", "")
    return F.when(F.lower(c) == "<gap>", F.lit("")).otherwise(out)


#: Patterns of prompt markup, each replaced by a space in any case.
PROMPT_MARKUP = [
    r"<parent_chunk_total>\d+</parent_chunk_total>",
    r"</?chunk_\d+>",
    r"/chunk_\d+>",
    r"\bchunk_idx\s*=\s*\d+\b",
    r"\bchunk_\d+\b",
    r"\bFinal translation:\b",
]


def has_markup(c: Column) -> Column:
    return c.rlike("(?iU)" + "|".join(PROMPT_MARKUP))


def without_markup(c: Column) -> Column:
    """Each piece of prompt markup as a space."""
    for pattern in PROMPT_MARKUP:
        c = F.regexp_replace(c, "(?iU)" + pattern, " ")
    return c


def strip_markup(c: Column) -> Column:
    """Prompt markup out, white space folded."""
    return fold_whitespace(without_markup(c))


def repair_gaps(c: Column) -> Column:
    """A gap mark without its bracket gets it; then adjacent marks merge, once."""
    whole = F.regexp_replace(c, r"(?i)(?<!<)\bgap>", "<gap>")
    return fold_whitespace(F.regexp_replace(whole, r"(?U)<gap>\s*<gap>", "<gap>"))


def stable_hash(c: Column) -> Column:
    """The first eight hex digits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def stable_split(c: Column) -> Column:
    r = stable_hash(c) % 10
    return F.when(r < 4, "tune").when(r < 7, "holdout").otherwise("report")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array, each joined by one space."""

    def of(t: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)])
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), gram)).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def char_grams(c: Column, n: int) -> Column:
    def of(t: Column) -> Column:
        gram = lambda i: F.concat(*[F.get(t, i + k) for k in range(n)])
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), gram)).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(c, ""), lambda x: x != ""), of)


def char_wb_grams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with a space on each side; a short word stands once a length."""
    padded = F.transform(words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int):
        return lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))
        )

    return F.concat(*[F.flatten(F.transform(padded, of(n))) for n in range(low, high + 1)])


def split_delimiters(c: Column, delimiters: Sequence[str]) -> Column:
    """Stripped non-blank parts between any of the delimiters; the whole text if none is left."""
    pattern = "|".join("\\Q" + d + "\\E" for d in delimiters)
    parts = F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(c)))


def split_equal(c: Column, n: Column | int) -> Column:
    """Words in n parts, cut at (i * words / n) rounded half to even."""
    n = F.lit(n) if isinstance(n, int) else n

    def of(w: Column) -> Column:
        cut = lambda i: F.bround(i * F.size(w) / n).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, cut(i) + 1, cut(i + 1) - cut(i)), " "))

    return let(words(c), of)
