"""Audited cleaning: a chain of rules with an edit log, hit statistics, symbol and pattern profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import seq
from corpusloom.functions import text as T


def nfc(c: Column) -> Column:
    """NFC; texts below U+0300 are in it as they are, and only nulls go to Python in their place."""
    other = F.when(~c.rlike(r"^[\x00-\u02FF]*\z"), c)
    return F.coalesce(F.when(other.isNull(), c), seq.series(seq.nfc)(other))


@dataclass(frozen=True)
class Rules:
    nfc: bool = True
    invisible: bool = True
    whitespace: bool = True
    alert: bool = True
    gaps: bool = False
    braces: bool = False


ALERT = "t0_unknown_visible_char_alert"
#: Rule names and notes, in the order in which the rules run.
RULES = [
    ("t0_unicode_nfc", "nfc", nfc, "unicodedata.normalize('NFC')"),
    ("t0_remove_invisible", "invisible", T.remove_invisible, "remove ZWSP/ZWNJ/ZWJ/BOM"),
    ("t0_whitespace_normalize", "whitespace", T.normalize_whitespace, "normalize newlines + fold inline whitespace"),
    (ALERT, "alert", None, None),
    ("t1_gap_tag_canonicalize", "gaps", T.canonical_gaps, "canonicalize <gap>/<big_gap> tags"),
    ("t1_brace_whitespace_canonicalize", "braces", T.canonical_braces, "trim inner brace whitespace"),
]


EDIT = "struct<rule_id:string,before:string,after:string,note:string,pos:bigint,context:string,severity:string>"


def alerts(c: Column, known: Column, around: int = 20) -> Column:
    """An edit that changes nothing for each visible character outside the known array: its first place, context and count."""

    def alert(char: Column) -> Column:
        at = F.instr(c, char)
        start = F.greatest(at - around, F.lit(1))
        count = F.length(c) - F.length(F.replace(c, char))
        return F.struct(
            F.lit(ALERT).alias("rule_id"), char.alias("before"), char.alias("after"), F.concat(F.lit("count="), count.cast("string")).alias("note"),
            (at - 1).cast("long").alias("pos"), F.substring(c, start, at - start + around + 1).alias("context"), F.lit("warn").alias("severity"),
        ).cast(EDIT)

    visible = F.filter(F.array_except(F.array_distinct(F.split(c, "")), known), lambda x: (x != "") & ~x.rlike(r"[\p{C}]") & ~x.isin(" ", "\t", "\n", "\r"))
    return F.transform(visible, alert)


def clean(df: DataFrame, text: str = "text", rules: Rules = Rules(), known: DataFrame | None = None) -> DataFrame:
    """``df`` with its text cleaned and ``edits``: what each rule changed, and alerts of characters outside ``known(char)``.

    Each rule is a projection of its own, so that no expression is repeated inside the next. Without a known
    set there are no alerts; it rides along as one array, which Unicode bounds.
    """
    out, last, log = df.withColumn("_s0", T.blank(F.col(text))), "_s0", []
    columns = ["_s0"]
    alerting = rules.alert and known is not None
    if alerting:
        out = out.crossJoin(F.broadcast(known.agg(F.collect_set("char").alias("_known"))))
        columns += ["_known", "_alerts"]
    for name, toggle, rule, note in RULES:
        if name == ALERT:
            if alerting:
                out = out.withColumn("_alerts", F.when(F.size("_known") > 0, alerts(F.col(last), F.col("_known"))).otherwise(F.array().cast(f"array<{EDIT}>")))
                log.append(F.col("_alerts"))
        elif getattr(rules, toggle):
            column = f"_s{len(columns)}"
            out = out.withColumn(column, rule(F.col(last)))
            empty = F.lit(None)
            edit = F.struct(F.lit(name), F.col(last), F.col(column), F.lit(note), empty, empty, empty).cast(EDIT)
            log.append(F.when(F.col(last) != F.col(column), F.array(edit)).otherwise(F.array().cast(f"array<{EDIT}>")))
            columns.append(column)
            last = column
    edits = F.concat(*log) if log else F.array().cast(f"array<{EDIT}>")
    return out.withColumn("edits", edits).withColumn(text, F.col(last)).drop(*columns)


def edit_log(cleaned: DataFrame, key: str, split: str = "train") -> DataFrame:
    """A row per edit and alert; the note of an alert names its character.

    An outer explode: for an inner one Spark infers a filter on ``edits`` and pushes it below the rules, where each is repeated inside the next.
    """
    each = cleaned.select(F.lit(split).alias("split"), F.col(key).alias("sample_id"), F.explode_outer("edits").alias("e"))
    rows = each.where("e.rule_id IS NOT NULL").select("split", "sample_id", "e.*")
    point = F.lpad(F.hex(F.expr("bigint(conv(hex(encode(before, 'UTF-32')), 16, 10))")), 4, "0")
    name = F.when(F.col("rule_id") == ALERT, seq.series(seq.char_name)(F.when(F.col("rule_id") == ALERT, F.col("before")).otherwise("x")))
    note = F.concat(F.lit("unknown visible char '"), F.col("before"), F.lit("' ("), name, F.lit(", U+"), point, F.lit(") "), F.col("note"))
    return rows.withColumn("note", F.when(F.col("rule_id") == ALERT, note).otherwise(F.col("note")))


def first_examples(rows: DataFrame, group: str, order: str, example: Column, n: int) -> DataFrame:
    """(group, examples): the first n rows of each group; Spark drops the others before its shuffle."""
    ranked = rows.select(group, F.col(order).alias("_o"), example.alias("_e")).withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy("_o")))
    few = ranked.where(F.col("_rn") <= n).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rn", "_e"))).alias("_l"))
    return few.select(group, F.transform("_l", lambda x: x["_e"]).alias("examples"))


def hit_stats(log: DataFrame, examples: int = 3) -> DataFrame:
    """Per rule its hits and first examples, which Spark leaves out if they are not selected: the join is a left one on a unique key."""
    counts = log.groupBy("rule_id").agg(F.count("*").alias("hits"))
    return counts.join(first_examples(log, "rule_id", "sample_id", F.struct("sample_id", "before", "after"), examples), "rule_id", "left")


def known_characters(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(F.array_distinct(F.split(T.blank(F.col(text)), ""))).alias("char")).where("char <> ''").distinct()


def symbol_inventory(df: DataFrame, key: str, text: str = "text", examples: int = 5, width: int = 160) -> DataFrame:
    """(char, count, examples): every character with the first rows that have it, each (row_id, fragment).

    Counts combine where the texts are; texts are fetched for the few rows that are shown only.
    """
    chars = F.split(T.blank(F.col(text)), "")
    counts = df.select(F.explode(chars).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("count"))
    rows = df.select(key, F.explode(F.array_distinct(chars)).alias("char")).where("char <> ''")
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy("char").orderBy(key))).where(F.col("_rn") <= examples)
    shown = ranked.join(df.select(key, T.blank(F.col(text)).alias("_t")), key)
    fragment = fragment_around(F.col("_t"), F.col("char"), width)
    listed = shown.groupBy("char").agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(key).alias("row_id"), fragment.alias("fragment")))).alias("_l"))
    return counts.join(listed, "char").select("char", "count", F.transform("_l", lambda x: F.struct(x["row_id"].alias("row_id"), x["fragment"].alias("fragment"))).alias("examples"))


def truncated(c: Column, width: int) -> Column:
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, width - 1), F.lit("…")))


def fragment_around(c: Column, needle: Column, width: int) -> Column:
    """At most ``width`` characters around the first place of the needle, with marks where the text goes on."""
    at = F.instr(c, needle) - 1
    end = F.least(F.length(c), F.greatest(at - width // 2, F.lit(0)) + width)
    start = F.greatest(end - width, F.lit(0))
    body = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(c, start + 1, end - start), F.when(end < F.length(c), "…").otherwise(""))
    return truncated(body, width)


def with_names(inventory: DataFrame) -> DataFrame:
    """With code point and Unicode name; a row per character, so Python sees few."""
    c = F.col("char")
    point = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
    return inventory.withColumn("codepoint", point).withColumn("name", seq.series(seq.char_name)(c))


def unknown_alerts(df: DataFrame, key: str, known: DataFrame, text: str = "text", around: int = 20) -> DataFrame:
    """A warning per row and visible character outside the known set: count, first place and context.

    The known set rides along as one array, so texts are filtered where they are.
    """
    one = F.broadcast(known.agg(F.collect_set("char").alias("_known")))
    found = df.select(key, T.blank(F.col(text)).alias("_t")).crossJoin(one).select(key, F.explode(alerts(F.col("_t"), F.col("_known"), around)).alias("e"))
    count = F.substring("e.note", 7, 20).cast("long").alias("count")
    return found.select(F.col(key).alias("sample_id"), F.col("e.before").alias("char"), count, "e.pos", "e.context", "e.severity")


#: The profiled patterns.
PATTERNS = {
    "braces": r"\{[^}]*\}",
    "brackets": r"\[[^\]]*\]",
    "parens": r"\([^)]*\)",
    "angles": r"<[^>]*>",
    "pipes": r"\|[^|]*\|",
    "at_lines": r"(^|\n)\s*@\S+",
    "dollar_lines": r"(^|\n)\s*\$\s*\S+",
    "hash_lines": r"(^|\n)\s*#\S+",
    "percent_codes": r"%[a-zA-Z]{1,4}",
    "subscripts": "[₀₁₂₃₄₅₆₇₈₉]",
}


def pattern_profile(df: DataFrame, key: str, text: str = "text", patterns: dict[str, str] = PATTERNS, examples: int = 10, around: int = 50) -> DataFrame:
    """(pattern, hits, examples): matches in all rows, and the first ones by row and place, each (row_id, fragment).

    Matches are counted where the texts are; places are looked up in the first rows with a match only.
    """
    c = T.blank(F.col(text))
    counts = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(c, F.lit(f"(?m){p}")).cast("long").alias("n")) for n, p in patterns.items()])
    hits = df.select(key, F.explode(counts).alias("x")).select(key, "x.*")
    totals = hits.groupBy("pattern").agg(F.sum("n").alias("hits"))
    ranked = hits.where("n > 0").withColumn("_rn", F.row_number().over(W.partitionBy("pattern").orderBy(key))).where(F.col("_rn") <= examples)
    shown = ranked.join(df.select(key, c.alias("_t")), key)
    contexts = seq.series(lambda t, name: seq.match_contexts(t, patterns[name], around, examples), "array<string>")(F.col("_t"), F.col("pattern"))
    flat = shown.withColumn("_f", contexts).groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(key).alias("row_id"), "_f"))).alias("_l"))
    each = F.flatten(F.transform("_l", lambda x: F.transform(x["_f"], lambda f: F.struct(x["row_id"].alias("row_id"), f.alias("fragment")))))
    return totals.join(flat.select("pattern", F.slice(each, 1, examples).alias("examples")), "pattern", "left")


def only_in(left: DataFrame, right: DataFrame, on: str | Sequence[str] = "char") -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")
