"""Neighbour joins: TF-IDF cosine over character n-grams, dense vectors, hints, gates, vote tallies.

Both joins are exact and go by ``topk``: shards of the corpus meet blocks of queries, and upper bounds leave out
what can't reach a query's k-th score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.sample import quantiles
from corpusloom.operators.topk import dense_top_k, sparse_top_k
from corpusloom.session import checkpointed


def term_counts(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    grams = df.select(F.col(key).alias("doc"), F.explode(T.char_wb_grams(F.col(text), low, high)).alias("term"))
    return grams.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: int, most_df: float = 1.0) -> DataFrame:
    """(term, idf) of the corpus: ln((1 + n) / (1 + df)) + 1."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= most_df * n_docs)
    return df.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weighted(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc, term, w): sublinear tf times idf, each document of unit length; unknown terms are dropped first."""
    raw = counts.join(weights, "term").select("doc", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def term_ids(weights: DataFrame) -> Column:
    """The id of a term: a hash of it; where two terms of ``weights(term, ..)`` would share one, another hash."""
    for seed in range(8):
        row = weights.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(F.lit(seed), "term")).alias("ids")).first()
        if row["n"] == row["ids"]:
            break
    return F.xxhash64(F.lit(seed), "term")


def vectors(weights: DataFrame, term_id: Column) -> DataFrame:
    """(key, terms, weights) of ``weights(doc, term, w)``: each document's term ids and weights as arrays."""
    pairs = F.collect_list(F.struct(term_id.alias("t"), "w")).alias("p")
    return weights.groupBy(F.col("doc").cast("long").alias("key")).agg(pairs).select("key", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))


def tfidf_neighbours(queries: DataFrame, corpus: DataFrame, key: str, text: str, k: int, same: bool = False, most_df: float = 1.0) -> DataFrame:
    """The k most similar corpus rows of each query; fitted on the corpus alone. ``same``: a row isn't its own neighbour.

    Keys are numbers, each of one row of its side.
    """
    counts = term_counts(corpus, key, text)
    weights = checkpointed(idf(counts, corpus.count(), most_df))
    own = term_ids(weights)
    docs = checkpointed(vectors(weighted(counts, weights), own))
    asked = docs if same else checkpointed(vectors(weighted(term_counts(queries, key, text), weights), own))
    return sparse_top_k(asked, docs, k, same)


def merged_neighbours(ranked: DataFrame, target: str, pool: int, k: int, query_target: str | None = None) -> DataFrame:
    """Of each query's pool the first k distinct targets, scores of repeats added, and weights that sum to 1.

    Blank targets and the query's own are skipped. A repeat is added only while it stands before the
    k-th distinct target is reached, as a scan in rank order would find it.
    """
    used = ranked.where((F.col("rank") <= pool) & (F.trim(target) != ""))
    if query_target:
        used = used.where(F.col(target) != F.col(query_target))
    first = used.withColumn("_first", F.min("rank").over(W.partitionBy("query", target)))
    dense = first.withColumn("_d", F.dense_rank().over(W.partitionBy("query").orderBy("_first")))
    stop = F.min(F.when(F.col("_d") == k, F.col("_first"))).over(W.partitionBy("query"))
    scanned = dense.withColumn("_stop", stop).where((F.col("_d") <= k) & (F.col("_stop").isNull() | (F.col("rank") <= F.col("_stop"))))
    merged = scanned.groupBy("query", target).agg(F.sum("score").alias("score"), F.min("_d").alias("rank"))
    clipped = F.greatest("score", F.lit(0.0))
    total = F.sum(clipped).over(W.partitionBy("query"))
    n = F.count("*").over(W.partitionBy("query"))
    return merged.withColumn("weight", F.when(total <= 1e-12, 1 / n).otherwise(clipped / total))


def hint_fields(source: Column, neighbour_source: Column, neighbour_target: Column, source_chars: int = 160, target_chars: int = 220) -> Column:
    return F.concat(
        source, F.lit("\n\nRetrieved source: "), T.shorten(neighbour_source, source_chars), F.lit("\nRetrieved English hint: "), T.shorten(neighbour_target, target_chars)
    )


def hint_triplets(neighbours: DataFrame, query: str = "query") -> DataFrame:
    """(query, hints): ``[rank|score] source => target`` lines."""
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("|"), F.format_string("%.4f", "score"), F.lit("] "), "source", F.lit(" => "), "target"
    )
    grouped = neighbours.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return grouped.select(query, F.concat(F.lit("Retrieved neighbors:\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("hints"))


def gate_hints(df: DataFrame, threshold: float, prefix: str) -> DataFrame:
    """Below the threshold the augmented source becomes the plain one, and hints are blanked; a missing score is 0."""
    on = F.coalesce("top1_score", F.lit(0.0)) >= threshold
    return (
        df.withColumn("source", F.when(on, F.col("source")).otherwise(T.apply_prefix(F.col("source_raw"), prefix)))
        .withColumn("hint", F.when(on, F.col("hint")).otherwise(""))
        .withColumn("mode", F.when(on, F.col("mode")).otherwise("gate_off"))
        .withColumn("gate_enabled", on)
    )


def gate_coverage(df: DataFrame, thresholds: Sequence[float], split: str, buckets: Sequence[str]) -> DataFrame:
    """(threshold, split, bucket): rows, enabled, disabled, ratio; ``buckets`` are flag columns."""
    flags = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("in")) for b in buckets]))
    long = df.select(split, F.coalesce("top1_score", F.lit(0.0)).alias("s"), flags.alias("b")).where("b.in")
    counts = long.groupBy(split, F.col("b.bucket").alias("bucket")).agg(F.count("*").alias("total"), *[F.count_if(F.col("s") >= t).alias(f"_e{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_e{i}").alias("enabled")) for i, t in enumerate(thresholds)]))
    out = counts.select(split, "bucket", "total", rows.alias("r")).select("r.threshold", split, "bucket", "total", "r.enabled")
    return out.withColumn("disabled", F.col("total") - F.col("enabled")).withColumn("ratio", F.col("enabled") / F.col("total"))


def score_quantiles(df: DataFrame, split: str, score: str) -> DataFrame:
    """Per split and overall: p05, p50, p95 and mean."""
    rows = df.select(F.explode(F.array(F.coalesce(F.col(split), F.lit("overall")), F.lit("overall"))).alias(split), F.col(score).alias("_s"))
    means = rows.groupBy(split).agg(F.count("*").alias("n"), F.avg("_s").alias("mean"))
    found = quantiles(rows, "_s", [0.05, 0.5, 0.95], [split]).select(split, *[F.col(f"q{i}").alias(p) for i, p in enumerate(("p05", "p50", "p95"))])
    return means.join(found, split, "left").select(split, "n", "p05", "p50", "p95", "mean")


def token_votes(neighbours: DataFrame, tokens: str) -> DataFrame:
    """(query, step, token, votes, rank): weights of the neighbours that have the token at the step."""
    steps = neighbours.select("query", "weight", F.posexplode(tokens).alias("step", "token")).where("token IS NOT NULL")
    votes = steps.groupBy("query", "step", "token").agg(F.sum("weight").alias("votes"))
    return votes.withColumn("rank", F.row_number().over(W.partitionBy("query", "step").orderBy(F.desc(F.round("votes", 9)), "token")))


def vote_recall(votes: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Share of the true tokens among the first k voted, over ``truth(query, step, token)``."""
    joined = truth.join(votes.select("query", "step", "token", "rank"), ["query", "step", "token"], "left")
    return joined.agg(*[F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in ks])


def dense_neighbours(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the k greatest dot products of each query against all other rows, exactly."""
    side = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return dense_top_k(side(queries), side(corpus), k)
