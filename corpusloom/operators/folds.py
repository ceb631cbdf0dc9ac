"""Leak-free grouped folds, fold profiles and length statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import text as T
from corpusloom.operators.sample import draw, group_rank, numbered
from corpusloom.session import checkpointed


def group_quality(df: DataFrame, column: str) -> tuple[int, float]:
    row = df.agg(F.count_distinct(column).alias("d"), F.count("*").alias("n")).first()
    return row["d"], (row["d"] / row["n"] if row["n"] else 1.0)


def choose_groups(df: DataFrame, candidates: Sequence[str], key: str, text: str, least: int = 5, quality: float = 0.98) -> tuple[DataFrame, str]:
    """``df`` with ``group_key`` and the rung that gave it: a metadata column, an id prefix, or the text's bucket."""
    for column in candidates:
        if column in df.columns:
            distinct, ratio = group_quality(df, column)
            if distinct >= least and ratio < quality:
                return df.withColumn("group_key", F.coalesce(F.col(column).cast("string"), F.lit("NA"))), column
    prefixed = df.withColumn("group_key", F.substring(F.col(key).cast("string"), 1, 8))
    if group_quality(prefixed, "group_key")[1] < quality:
        return prefixed, "id_prefix8"
    return df.withColumn("group_key", M.source_bucket(F.col(text))), "source_bucket"


def fold_plan(histogram: dict[int, int], k: int) -> list[tuple[int, int, list[int]]]:
    """(size, first rank, folds in turn): which fold the groups of a size get, by their rank among the groups of that size.

    Groups go from the largest down, each to the lightest fold, the lowest of equal ones. Groups of
    one size add the same to every fold, so the folds they reach take turns, in the order of their weights; another fold joins
    once the turns have come up to it. A size has at most ``k`` such runs, however many groups it has.
    """
    weights, out = [0] * k, []
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            lowest = min(weights)
            turns = sorted((i for i in range(k) if weights[i] < lowest + size), key=lambda i: (weights[i], i))
            above = [w for w in weights if w >= lowest + size]
            # Whole rounds until a round would start at or above another fold.
            rounds = left // len(turns)
            if above:
                rounds = min(rounds, max(1, (min(above) - max(weights[i] for i in turns)) // size))
            rounds = max(1, rounds)
            count = min(left, rounds * len(turns))
            out.append((size, rank, turns))
            for j, i in enumerate(turns):
                weights[i] += size * (count // len(turns) + (j < count % len(turns)))
            left, rank = left - count, rank + count
    return out


def balanced_group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups from the largest down (of equal ones by key, null first), each to the lightest fold, the lowest of equal ones.

    The driver plans on the histogram of group sizes alone; groups are ranked within their size and looked up where they are.
    """
    sizes = checkpointed(df.groupBy(group).agg(F.count("*").alias("n")))
    histogram = {r["n"]: r["c"] for r in sizes.groupBy("n").agg(F.count("*").alias("c")).collect()}
    runs = sorted(fold_plan(histogram, k))
    kind = "size long, first long, folds array<int>, after long"
    after = [b[1] if b[0] == a[0] else 1 << 62 for a, b in zip(runs, [*runs[1:], (None, 0, None)], strict=True)]
    plan = df.sparkSession.createDataFrame([(size, first, folds, stop) for (size, first, folds), stop in zip(runs, after, strict=True)], kind)
    ranked = group_rank(sizes, "n", [F.col(group).isNotNull(), F.col(group)], "_rank").withColumn("_rank", F.col("_rank") - 1)
    joined = ranked.join(plan, (F.col("n") == F.col("size")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("after")))
    turn = ((F.col("_rank") - F.col("first")) % F.size("folds")).cast("int")
    return joined.select(group, F.get("folds", turn).alias("fold"))


def shuffled_folds(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """(key, fold): rows in the order of a draw, cut into k parts as equal as can be."""
    n = df.count()
    big, small = n % k, n // k
    edge = big * (small + 1)
    placed = numbered(df.select(key, draw(key, seed).alias("_d")), "_d")
    fold = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (small + 1))).otherwise(big + F.floor((F.col("_pos") - edge) / max(1, small)))
    return placed.select(key, fold.cast("int").alias("fold"))


def assign_folds(df: DataFrame, key: str, group: str, k: int = 5, seed: str = "42", ratio: float = 0.995) -> DataFrame:
    """``df`` with ``fold`` and ``group_kind``: by groups if there are enough of them, else shuffled."""
    distinct, share = group_quality(df, group)
    if distinct >= k and share < ratio:
        return df.join(balanced_group_folds(df, group, k), group).withColumn("group_kind", F.lit("group"))
    return df.join(shuffled_folds(df, key, k, seed), key).withColumn("group_kind", F.lit("shuffled"))


def profile_folds(df: DataFrame, fold: str, group: str, text: str) -> DataFrame:
    """Per fold: rows, groups, share of the largest group, lengths, symbols, missing markers."""
    c = F.col(text)
    per_group = df.select(fold, group, F.length(c).alias("chars"), T.word_count(c).alias("words"), M.symbol_density(c).alias("density"), M.missing_marker(c).alias("missing"))
    largest = per_group.groupBy(fold, group).agg(F.count("*").alias("n")).groupBy(fold).agg(F.max("n").alias("largest"), F.count("*").alias("n_groups"))
    stats = per_group.groupBy(fold).agg(
        F.count("*").alias("n_rows"),
        F.avg("chars").alias("mean_chars"),
        F.percentile("chars", F.lit(0.95)).alias("p95_chars"),
        F.avg("words").alias("mean_words"),
        F.percentile("words", F.lit(0.95)).alias("p95_words"),
        F.avg("density").alias("mean_density"),
        (F.avg(F.col("missing").cast("double")) * 100).alias("missing_pct"),
    )
    return stats.join(largest, fold).withColumn("largest_share", F.col("largest") / F.col("n_rows")).drop("largest")


def length_stats(df: DataFrame, length: Column, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Per limit: percentiles, maximum, rows over it and their share."""
    grid = F.explode(F.array(*[F.lit(x) for x in limits]))
    rows = df.select(*by, length.alias("_l"))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.avg("_l").alias("mean"),
        F.percentile("_l", F.lit(0.5)).alias("p50"),
        F.percentile("_l", F.lit(0.9)).alias("p90"),
        F.percentile("_l", F.lit(0.95)).alias("p95"),
        F.percentile("_l", F.lit(0.99)).alias("p99"),
        F.max("_l").cast("long").alias("longest"),
        *[F.count_if(F.col("_l") > x).alias(f"_over{x}") for x in limits],
    )
    over = F.coalesce(*[F.when(F.col("limit") == x, F.col(f"_over{x}")) for x in limits])
    out = base.withColumn("limit", grid).withColumn("n_over", over).withColumn("over_pct", F.try_divide(over * 100, F.col("n_rows")))
    return out.drop(*[f"_over{x}" for x in limits])


def inconsistent_parents(df: DataFrame, parent: str, fold: str = "fold") -> DataFrame:
    """Parents whose rows are in more than one fold."""
    return df.groupBy(parent).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")
