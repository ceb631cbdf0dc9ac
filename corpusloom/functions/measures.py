"""Measures and features of texts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def byte_tokens(c: Column) -> Column:
    """Token length of a byte-level model with its end mark."""
    return (F.octet_length(c) + 1).cast("long")


def length_bin(n: Column, width: int, top: int) -> Column:
    return F.least(F.floor(n / width), F.lit(top)).cast("long")


def symbol_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\{\}\[\]\-]")).cast("long")


def symbol_density(c: Column) -> Column:
    return F.when(F.length(c) > 0, symbol_count(c) / F.length(c)).otherwise(0.0)


def missing_marker(c: Column) -> Column:
    return c.rlike(r"(?iU)\bx+\b|\.{3,}|[\[\]⸢⸣]")


def has_gap(c: Column) -> Column:
    return c.rlike(r"<gap>|\{")


def has_bracket(c: Column) -> Column:
    return c.rlike(r"\[|\]")


def has_subscript(c: Column) -> Column:
    return c.rlike("[₀-₉ₓ]")


def has_x(c: Column) -> Column:
    return F.lower(c).rlike(r"(?U)(?<!\w)x(?!\w)")


def marker_count(c: Column) -> Column:
    return sum((f(c).cast("long") for f in (has_gap, has_bracket, has_subscript, has_x)), F.lit(0).cast("long"))


def source_bucket(c: Column) -> Column:
    """First three lower-case tokens, a length class and a symbol class."""
    low = F.lower(T.fold_whitespace(c))
    symbols = F.regexp_count(low, F.lit(r"[\[\]{}<>\-]"))
    return F.concat(
        F.array_join(F.slice(T.words(low), 1, 3), "|"),
        F.lit("|l"),
        length_bin(F.length(low), 120, 50).cast("string"),
        F.lit("|s"),
        length_bin(symbols, 5, 50).cast("string"),
    )


def near_block(c: Column) -> Column:
    """Signature that near copies share: a prefix and a length class."""
    low = F.lower(F.trim(c))
    return F.concat(F.substring(low, 1, 24), F.lit("|"), F.floor(F.length(c) / 40).cast("string"))


def gram_set(c: Column, n: int = 4) -> Column:
    return F.array_distinct(T.char_grams(c, n))


def gram_jaccard(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Jaccard similarity of two texts by their gram sets; equal texts 1, a text without grams 0."""
    shared = F.size(F.array_intersect(grams_a, grams_b))
    return (
        F.when(a == b, 1.0)
        .when((F.size(grams_a) == 0) | (F.size(grams_b) == 0), 0.0)
        .otherwise(shared / (F.size(grams_a) + F.size(grams_b) - shared))
    )


def repeat_score(tokens: Column, n: int = 3, least: int = 4) -> Column:
    """How many n-grams stand beyond the (least - 1)th time, summed over those that stand ``least`` times.

    Among the sorted n-grams these are the ones that equal the one least - 1 places before.
    """
    back = least - 1

    def of(grams: Column) -> Column:
        again = F.filter(F.sequence(F.lit(back), F.size(grams) - 1), lambda i: F.get(grams, i) == F.get(grams, i - back))
        return F.when(F.size(grams) >= least, F.size(again)).otherwise(0).cast("long")

    return T.let(F.array_sort(T.ngrams(tokens, n)), of)


def repeat_penalty(tokens: Column) -> Column:
    """1 - distinct / all trigrams; 0 up to three tokens."""
    grams = T.ngrams(tokens, 3)
    return F.when(F.size(tokens) <= 3, 0.0).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))


def digit_match(source: Column, target: Column) -> Column:
    """Share of the source's numbers that the target has; 1 without any."""
    own = F.array_distinct(F.regexp_extract_all(source, F.lit(r"\d+"), 0))
    theirs = F.array_distinct(F.regexp_extract_all(target, F.lit(r"\d+"), 0))
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, theirs)) / F.size(own))


def outlier_penalty(x: Column, low: Column, high: Column) -> Column:
    """Relative distance from the band, at most 1."""
    return F.when(x < low, F.least((low - x) / F.greatest(low, F.lit(1e-6)), F.lit(1.0))).when(
        x > high, F.least((x - high) / F.greatest(high, F.lit(1e-6)), F.lit(1.0))
    ).otherwise(0.0)


def formula_count(c: Column, stems=tuple(T.FORMULA_STEMS)) -> Column:
    return sum((((F.length(c) - F.length(F.replace(c, F.lit(s)))) / len(s)).cast("long") for s in stems), F.lit(0).cast("long"))


def noise_score(source: Column, target: Column, short_aligned: Column, cost: Column, kind: Column, chunk_total: Column) -> Column:
    """Weighted signs of a bad pair."""
    sw, tw = T.words(source), T.words(target)
    ratio = F.size(tw) / F.greatest(F.size(sw), F.lit(1))
    penalty = F.when((ratio < 0.30) | (ratio > 2.20), 1.0).when((ratio < 0.45) | (ratio > 1.70), 0.5).otherwise(0.0)
    repeated = lambda w, k: (repeat_score(w, 3, 3) > 0).cast("double") * k
    gaps = (F.length(target) - F.length(F.replace(target, F.lit("<gap>")))) / 5
    return (
        short_aligned.cast("double") * 1.5
        + F.least(F.lit(2.0), F.coalesce(cost, F.lit(0.0)) / 0.4)
        + (kind == "1:2").cast("double") * 0.75
        + (kind == "2:1").cast("double") * 0.25
        + repeated(tw, 0.5)
        + repeated(sw, 0.25)
        + penalty
        + (gaps >= 3).cast("double") * 0.25
        + (chunk_total >= 8).cast("double") * 0.25
    )


def route_score(chunks: Column, ref_tokens: Column, markers: Column) -> Column:
    return (
        (chunks >= 4).cast("double") * 120
        + (ref_tokens >= 129).cast("double") * 120
        + markers * 45.0
        + F.least(ref_tokens, F.lit(512)) / 8
        + chunks * 2.0
    )


def route_reason(chunks: Column, ref_tokens: Column, markers: Column) -> Column:
    joined = F.concat_ws(
        "|",
        F.when(chunks >= 4, "chunks"),
        F.when(ref_tokens >= 129, "long_target"),
        F.when((markers >= 2) & (ref_tokens >= 96), "markers"),
    )
    return F.when(joined == "", "pass_a_only").otherwise(joined)


def proxy_score(c: Column, genre: Column, genres=("letter", "debt note", "account", "memorandum")) -> Column:
    return (
        c.contains("<gap>").cast("double") * 4
        + c.contains("{").cast("double") * 2
        + has_subscript(c).cast("double")
        + F.least(F.lit(4.0), T.word_count(c) / 40)
        + genre.isin(*genres).cast("double")
    )


def selector_score(chunks: Column, target_tokens: Column, marker: Column) -> Column:
    return (
        (chunks >= 4).cast("double") * 4
        + (target_tokens >= 129).cast("double") * 2
        + marker.cast("double")
        + F.least(F.lit(1.5), target_tokens / 129)
    )


def concat_score(c: Column, raw: Column) -> Column:
    """Penalty of a rebuilt candidate against the raw one; lower is better."""
    share = T.word_count(c) / F.greatest(T.word_count(raw), F.lit(1))
    gaps = (F.length(c) - F.length(F.replace(c, F.lit("gap>")))) / 4
    return (
        F.greatest(F.lit(0.0), 0.82 - share) * 120
        + gaps * 18
        + repeat_score(T.words(c)) * 4
        + F.greatest(F.lit(0.0), formula_count(c) - F.lit(18.0)) * 0.8
        + c.rlike(r"\bc\d+:").cast("double") * 40
    )


def alignment_cost(source_len: Column, target_len: Column, alpha: Column, penalty: Column) -> Column:
    return F.abs(F.log(F.greatest(F.lit(1e-6), ((target_len + 1) / (source_len + 1)) / alpha))) + penalty


def band(n: Column, cuts: list[int]) -> Column:
    """Name of the range that n falls in: le_a, a+1_b, .., gt_z."""
    out, low = F.when(n <= cuts[0], f"le_{cuts[0]}"), cuts[0]
    for cut in cuts[1:]:
        out, low = out.when(n <= cut, f"{low + 1}_{cut}"), cut
    return out.otherwise(f"gt_{low}")
