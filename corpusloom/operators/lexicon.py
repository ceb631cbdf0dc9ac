"""Term lexicons: how often references' terms are missed, and which terms a lexicon should hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import terms as N
from corpusloom.functions import text as T
from corpusloom.operators.overlap import membership_flag


def term_statistics(df: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """(type, term, ref_count, hits, misses): rows whose reference has the term, and whose prediction has it too, in any case."""
    low = F.lower(T.blank(F.col(prediction))).alias("_p")
    rows = df.select(low, F.explode(F.array_distinct(N.terms(F.col(reference)))).alias("x")).select("_p", "x.type", "x.term")
    hit = F.col("_p").contains(F.lower("term"))
    return rows.groupBy("type", "term").agg(F.count("*").alias("ref_count"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def targeted_flags(df: DataFrame, key: str, source: str = "source", reference: str = "reference", rare: int = 2) -> DataFrame:
    """(key, marker_rich, measure, formula, rare_name): the targeted buckets that a row is in; a rare name is a token that sources hold ``rare`` times at most."""
    s, r = F.col(source), F.col(reference)
    tokens = df.select(key, F.explode(N.name_tokens(s)).alias("_t"))
    few = tokens.groupBy("_t").agg(F.count("*").alias("_n")).where(F.col("_n") <= rare)
    hit = tokens.join(few.select("_t"), "_t", "left_semi").select(key)
    flags = df.select(key, N.marker_rich(s).alias("marker_rich"), N.has_measure(s, r).alias("measure"), N.has_formula(s, r).alias("formula"))
    return membership_flag(flags, hit, key, "rare_name")


def select_lexicon(stats: DataFrame, types: Sequence[str] = ("measure",), refs: int = 5, misses: int = 2, rate: float = 0.4, hits: int = 2, most: int = 12) -> DataFrame:
    """The terms that are frequent, often missed and sometimes hit; most hits, then most references, then the lower miss rate first."""
    rows = stats.withColumn("miss_rate", F.col("misses") / F.greatest("ref_count", F.lit(1)))
    good = rows.where((F.col("ref_count") >= refs) & (F.col("misses") >= misses) & (F.col("miss_rate") >= rate) & (F.col("hits") >= hits))
    good = good.where(F.col("type").isin(*types)) if types else good
    action = F.when(F.col("type") == "name_or_place", "protect_case").otherwise("canonicalize").alias("action")
    return good.select("*", action).orderBy(F.desc("hits"), F.desc("ref_count"), "miss_rate", "type", "term").limit(most)
