"""Exact and near overlap with reference sets; removal logs; priority deduplication."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import text as T
from corpusloom.operators.sample import quantiles
from corpusloom.operators.topk import best_jaccard
from corpusloom.session import checkpointed


def membership_flag(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with a flag: is its key among ``keys``; null is not."""
    known = keys.select(F.col(on).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    joined = df.join(known, df[on] == known["_k"], "left")
    return joined.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def without_overlap(df: DataFrame, reference: DataFrame, text: str = "text", normal=T.strip) -> DataFrame:
    """Rows whose normalised text isn't in the reference set; duplicates inside ``df`` stay."""
    keys = reference.select(normal(F.col(text)).alias("_n")).distinct()
    return df.withColumn("_n", normal(F.col(text))).join(keys, "_n", "left_anti").drop("_n")


def best_in_block(df: DataFrame, reference: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """(text, similarity): for each different text of ``df`` its greatest similarity, by sets of 4-grams, to a reference text in its block.

    Texts whose best is under ``least``, or 0, are left out. Equal texts are 1 and go no further. The others meet the
    texts of their block by ``topk.best_jaccard``; a gram's id is a hash of it.
    """

    def side(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct()

    ours, theirs = side(df), side(reference)
    equal = ours.join(theirs, "t", "left_semi").select(F.col("t").alias(text), F.lit(1.0).alias("similarity"))
    blocked = lambda rows: rows.where(F.length("t") >= 4).withColumn("block", M.near_block(F.col("t")))
    left, right = blocked(ours.join(theirs, "t", "left_anti")), blocked(theirs)
    left = checkpointed(left.join(right.select("block"), "block", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    right = right.join(left.select("block").distinct(), "block", "left_semi")
    terms = F.transform(M.gram_set(F.col("t")), lambda g: F.xxhash64(g)).alias("terms")
    found = best_jaccard(left.select("block", "id", terms), right.select("block", terms), least)
    return equal.unionByName(left.join(found, "id").select(F.col("t").alias(text), "similarity"))


def without_near_overlap(df: DataFrame, reference: DataFrame, text: str = "text", least: float = 0.92) -> DataFrame:
    """Rows with no blocked reference text of a similarity of ``least`` or more."""
    return df.join(best_in_block(df, reference, text, least).select(text), text, "left_anti").select(*df.columns)


def best_similarity(df: DataFrame, reference: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``max_similarity``, 0 where the block holds no reference text."""
    best = best_in_block(df, reference, text).withColumnRenamed("similarity", "max_similarity")
    return df.join(best, text, "left").withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0)))


def similarity_summary(best: DataFrame, thresholds: Sequence[float] = (0.85, 0.90, 0.92, 0.95)) -> DataFrame:
    c = F.col("max_similarity")
    counts = best.agg(F.count("*").alias("n"), F.max(c).alias("most"), *[F.count_if(c >= t).alias(f"ge_{round(t * 100)}") for t in thresholds])
    return counts.crossJoin(F.broadcast(quantiles(best, "max_similarity", [0.95]).select(F.col("q0").alias("p95"))))


def first_by_priority(frames: Sequence[DataFrame], key: Column, order: str) -> DataFrame:
    """Union in which of equal keys the earlier frame's first row wins."""
    tagged = None
    for i, frame in enumerate(frames):
        one = frame.withColumn("_priority", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("_priority", order)
    return tagged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_priority")


def removal_log(df: DataFrame, text: str, order: str, reasons: Sequence[tuple[str, DataFrame]], duplicate_reason: str) -> DataFrame:
    """``df`` with ``reason``: the first reference set that holds its text, else whether it was seen before; null: kept.

    Only rows that no set removes count as seen; ``order`` is a unique key.
    """
    out = df
    for i, (_, keys) in enumerate(reasons):
        out = membership_flag(out, keys, text, f"_f{i}")
    chain = F.lit(None).cast("string")
    for i in range(len(reasons) - 1, -1, -1):
        chain = F.when(F.col(f"_f{i}"), reasons[i][0]).otherwise(chain)
    out = out.withColumn("reason", chain)
    first = out.where("reason IS NULL").groupBy(F.col(text).alias("_t")).agg(F.min(order).alias("_first"))
    out = out.join(first, out[text].eqNullSafe(first["_t"]), "left")
    again = F.col("reason").isNull() & (F.col(order) > F.col("_first"))
    out = out.withColumn("reason", F.when(again, duplicate_reason).otherwise(F.col("reason")))
    return out.drop("_t", "_first", *[f"_f{i}" for i in range(len(reasons))])


def dedup_summary(df: DataFrame, text: str = "text") -> DataFrame:
    n, unique = F.count("*"), F.count_distinct(text)
    return df.agg(n.alias("n_rows"), unique.alias("n_unique"), (n - unique).alias("n_duplicates"))


def containment_join(df: DataFrame, terms: DataFrame, text: str, term: str, most_terms: int = 1_000_000, most_chars: int = 16 << 20) -> DataFrame:
    """(rows, term) where the lower-cased text contains the lower-cased term.

    A lexicon of a checked size is broadcast, and each text goes once through its automaton (Aho-Corasick), whatever the number of terms. A larger one is
    joined by the first three characters of its terms with the distinct character trigrams of the texts; its
    terms of one or two characters, of which there can't be many, go by the automaton.
    """
    lexicon = terms.select(F.lower(term).alias("matched_term")).where(F.length(term) > 0).distinct()
    size = lexicon.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("matched_term")), F.lit(0)).alias("c")).first()
    small = size["n"] <= most_terms and size["c"] <= most_chars
    known = [r[0] for r in (lexicon if small else lexicon.where(F.length("matched_term") < 3)).collect()]
    low = F.lower(text)
    out = df.withColumn("matched_term", F.explode(matcher(df.sparkSession, known)(low)))
    if small:
        return out
    keyed = lexicon.where(F.length("matched_term") >= 3).withColumn("_g", F.substring("matched_term", 1, 3))
    grams = df.withColumn("_g", F.explode(F.array_distinct(T.char_grams(low, 3))))
    return out.unionByName(grams.join(keyed, "_g").where(low.contains(F.col("matched_term"))).drop("_g"))


_automata: dict = {}


def _automaton(number: int, terms: Sequence[str]):
    """The automaton of a broadcast lexicon; a worker keeps the last one."""
    import ahocorasick

    if number not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton()
        for t in terms:
            built.add_word(t, t)
        built.make_automaton()
        _automata[number] = built
    return _automata[number]


def matcher(spark: SparkSession, terms: Sequence[str]):
    """A function of a text column: the distinct terms that it contains, in order."""
    shared = spark.sparkContext.broadcast(list(terms))
    number = shared._jbroadcast.id()

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        if not shared.value:
            return texts.map(lambda _: [])
        built = _automaton(number, shared.value)
        return texts.map(lambda t: sorted({x for _, x in built.iter(t)}) if t else [])

    return found
