"""Candidate selection: votes, reranking, minimum risk, policies, row gates, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import seq
from corpusloom.functions import text as T
from corpusloom.operators import metrics as S
from corpusloom.operators.sample import numbered, order_statistic
from corpusloom.session import checkpointed

#: Actions in the order that breaks ties.
ACTIONS = ["pass_a_prediction", "selective_patch_light", "looptrim_concat", "raw_concat"]


def column_by_name(name: Column, columns: Sequence[str]) -> Column:
    """The value of the column that ``name`` names; null if it names none."""
    out = F.lit(None).cast("string")
    for c in columns:
        out = F.when(name == c, F.col(c)).otherwise(out)
    return out


def measured(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """With ``_w_``, ``_r_`` and ``_f_`` columns: words, repeats and formulas of each text, computed once."""
    columns = {}
    for n in names:
        c = F.col(n)
        columns |= {f"_w_{n}": T.word_count(c), f"_r_{n}": M.repeat_score(T.words(c)), f"_f_{n}": M.formula_count(c)}
    return df.withColumns(columns)


def unmeasured(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[f"_{k}_{n}" for n in names for k in "wrf"])


def vote(df: DataFrame, key: str, text: str, weight: Column | None = None) -> DataFrame:
    """(key, text, votes, strength): the text with most votes; ties to the shorter, then the lesser one."""
    w = F.lit(1.0) if weight is None else weight
    votes = df.groupBy(key, text).agg(F.sum(w).alias("votes"))
    order = W.partitionBy(key).orderBy(F.desc(F.round("votes", 12)), F.length(text), F.col(text))
    total = F.sum("votes").over(W.partitionBy(key))
    ranked = votes.withColumn("strength", F.col("votes") / total).withColumn("_rn", F.row_number().over(order))
    return ranked.where("_rn = 1").drop("_rn")


def vote_summary(votes: DataFrame) -> DataFrame:
    return votes.agg(F.avg("strength").alias("mean_strength"), F.avg((F.col("strength") > 1 - 1e-12).cast("double")).alias("unanimity"))


def weight_search(df: DataFrame, key: str, label: str, text: str, reference: str, weights: Sequence[dict[str, float]]) -> DataFrame:
    """(weight_id, scores): the weighted vote under each weight vector, and its corpus scores.

    Statistics are computed once per distinct candidate; the vectors, a list made by the caller, ride as an array column.
    """
    stats = S.with_statistics(df.select(key, text, reference).distinct(), text, reference)
    vectors = F.array(*[F.struct(F.lit(i).alias("i"), F.create_map(*[F.lit(x) for kv in w.items() for x in kv]).alias("w")) for i, w in enumerate(weights)])
    long = df.select(key, label, text, F.explode(vectors).alias("v")).select(key, text, F.col("v.i").alias("weight_id"), F.coalesce(F.element_at("v.w", F.col(label)), F.lit(0.0)).alias("w"))
    votes = long.groupBy("weight_id", key, text).agg(F.round(F.sum("w"), 12).alias("votes"))
    order = W.partitionBy("weight_id", key).orderBy(F.desc("votes"), F.length(text), F.col(text))
    chosen = votes.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return S.corpus_scores(chosen.join(stats, [key, text]), ["weight_id"])


def min_max(x: str, within: str) -> Column:
    """Scaled to 0..1 within the group, 0.5 where it is flat."""
    w = W.partitionBy(within)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high - low <= 1e-12, 0.5).otherwise((F.col(x) - low) / (high - low))


def rerank(df: DataFrame, key: str, order: str, weights=(1.0, 0.8, 0.6, 0.5)) -> DataFrame:
    """The candidate with the best model + digit - repeat - length score; of equal ones the first."""
    a, b, c, d = weights
    scored = df.withColumn("score", a * min_max("model_score", key) + b * F.col("digit_score") - c * F.col("repeat_penalty") - d * F.col("length_penalty"))
    w = W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), order)
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def minimum_risk(df: DataFrame, key: str, label: str, text: str, margin: float = 0.35) -> DataFrame:
    """The candidate with the best mean sentence score against the others.

    Among those within ``margin`` of the best: fewer repeats, fewer formulas, the higher utility,
    the shorter text, the label.
    """
    left, right = df.select(key, F.col(label).alias("_a"), F.col(text).alias("_ta")), df.select(key, F.col(label).alias("_b"), F.col(text).alias("_tb"))
    pairs = left.join(right, key).where("_a <> _b")
    scored = S.row_scores(S.with_statistics(pairs, "_ta", "_tb"))
    utility = scored.groupBy(key, F.col("_a").alias(label)).agg(F.round(F.avg("geom"), 9).alias("utility"))
    c = F.col(text)
    rows = df.join(utility, [key, label], "left").withColumn("utility", F.coalesce("utility", F.lit(0.0)))
    near = rows.withColumn("_best", F.max("utility").over(W.partitionBy(key))).where(F.col("utility") >= F.col("_best") - margin)
    order = [F.col(f"_r_{text}"), F.col(f"_f_{text}"), F.desc("utility"), F.length(c), F.col(label)]
    ranked = measured(near, [text]).withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return unmeasured(ranked.where("_rn = 1").drop("_rn", "_best"), [text])


def heuristic_pick(left: Column, right: Column, source: Column) -> Column:
    """The better of two texts by repeats, formulas and a length floor; ties to the longer, then the left."""

    def rank(c: Column) -> Column:
        floor = F.greatest(F.lit(0.0), T.word_count(source) * 0.12 - T.word_count(c))
        return F.struct((-4 * M.repeat_score(T.words(c))).alias("a"), (-2 * M.formula_count(c)).alias("b"), (-floor).alias("c"), F.length(c).alias("d"))

    return F.when(rank(right) > rank(left), right).otherwise(left)


def oracle_pick(df: DataFrame, key: str, label: str, text: str, reference: str) -> DataFrame:
    """The candidate with the best sentence score against the reference; ties by label."""
    scored = S.row_scores(S.with_statistics(df, text, reference))
    w = W.partitionBy(key).orderBy(F.desc(F.round("geom", 9)), label)
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "stats")


def learn_policy(df: DataFrame, bucket: str, actions: Sequence[str], reference: str, switchable: Sequence[str]) -> DataFrame:
    """(bucket, action): the action with the best corpus score per bucket; only some buckets may leave the first action."""
    long = df.select(bucket, reference, F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(a).alias("action"), F.col(a).alias("text")) for i, a in enumerate(actions)])).alias("x"))
    stats = S.with_statistics(long.select(bucket, reference, "x.*"), "text", reference)
    scores = S.corpus_scores(stats, [bucket, "o", "action"])
    w = W.partitionBy(bucket).orderBy(F.desc(F.round("geom", 9)), "o")
    best = scores.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select(bucket, F.when(F.col(bucket).isin(*switchable), F.col("action")).otherwise(actions[0]).alias("action"))


def apply_policy(df: DataFrame, policy: DataFrame, bucket: str, actions: Sequence[str], least_ratio: float = 0.8, least_gain: int = 1) -> DataFrame:
    """The policy's text where it is safe: long enough, and with fewer repeats or formulas than the first action's."""
    joined = df.join(policy, bucket, "left").withColumn("action", F.coalesce("action", F.lit(actions[0])))
    rows = measured(joined.withColumn("_t", column_by_name(F.col("action"), actions)), ["_t", actions[0]])
    of = lambda k, n: F.col(f"_{k}_{n}")
    ratio = of("w", "_t") / F.greatest(of("w", actions[0]), F.lit(1))
    gain = of("r", actions[0]) - of("r", "_t") + of("f", actions[0]) - of("f", "_t")
    switch = (F.col("action") != actions[0]) & (ratio >= least_ratio) & (gain >= least_gain)
    out = rows.withColumn("switched", switch).withColumn("policy_text", F.when(F.col("switched"), F.col("_t")).otherwise(F.col(actions[0])))
    return unmeasured(out, ["_t", actions[0]]).drop("_t")


def row_gate(df: DataFrame, key: str, base: str, candidates: Sequence[str], least_ratio: float = 0.85, least_gain: int = 1, threshold: float = 1.0, cap: int = -1) -> DataFrame:
    """Rows with the chosen text: the best candidate by score where it passes, for the ``cap`` best rows (-1: all).

    ``gate_rank`` and ``gate_score`` are of the rows that pass, the rank up to the cap. Texts are measured once; ranks are found
    on keys and scores alone.
    """
    df0, of = df, lambda k, n: F.col(f"_{k}_{n}")

    def option(i: int, name: str) -> Column:
        gain = of("r", base) - of("r", name)
        score = gain + 0.5 * (of("f", base) - of("f", name)) + 0.002 * (of("w", name) - of("w", base))
        ok = (of("w", name) >= of("w", base) * least_ratio) & (gain >= least_gain)
        return F.struct(F.when(ok, F.round(score, 9)).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name"), F.col(name).alias("text"))

    df = measured(df, [base, *candidates])
    best = F.array_max(F.filter(F.array(*[option(i, n) for i, n in enumerate(candidates)]), lambda x: x["s"].isNotNull()))
    rows = df.withColumn("_b", best).withColumn("gate_score", F.col("_b.s"))
    # Filtered only behind the checkpoint: a pushed-down filter would measure every text again.
    every = rows.select(F.col(key).alias("_k"), F.col("gate_score").alias("_s"), F.col("_b.name").alias("_n"))
    scored = checkpointed(every).where(F.col("_s") >= threshold)
    if cap < 0:
        placed = numbered(scored.withColumn("_o", F.struct((-F.col("_s")).alias("s"), "_k")), "_o").withColumn("gate_rank", F.col("_pos") + 1).drop("_o", "_pos")
    else:  # ``cap`` rows at most
        first = scored.orderBy(F.desc("_s"), "_k").limit(cap)
        ranks = first.select("_k", F.row_number().over(W.orderBy(F.desc("_s"), "_k")).cast("long").alias("gate_rank"))
        placed = scored.join(F.broadcast(ranks), "_k", "left")
    # Keys, scores and ranks are put together first: the texts are joined once.
    out = df0.join(placed.withColumnRenamed("_s", "gate_score"), F.col(key) == F.col("_k"), "left").withColumn("switched", F.col("gate_rank").isNotNull())
    chosen = F.when(F.col("switched"), column_by_name(F.col("_n"), candidates)).otherwise(F.col(base))
    return out.withColumn("chosen", chosen).drop("_k", "_n")


def gate_grid(df: DataFrame, key: str, base: str, candidate: str, reference: str, ratios: Sequence[float], gains: Sequence[int], thresholds: Sequence[float], caps: Sequence[int]) -> DataFrame:
    """(parameters, switched, scores) of every row gate of the grid, from one pass over statistics taken once a row.

    A row goes into one bin: of each parameter the strictest value that it passes. A cell is the sum over all rows of the base plus what switching changes
    in the bins that are as strict as the cell, so its cost depends on the grid and not on the rows. Capped cells (``cap`` best rows;
    -1: all) are cut from the best rows of each bin of ratio and gain, at most the largest cap a bin.
    """
    rows = S.with_statistics(S.with_statistics(df, base, reference, "_s0"), candidate, reference, "_s1")
    of = lambda k, n: F.col(f"_{k}_{n}")
    gain = of("r", base) - of("r", candidate)
    score = F.round(gain + 0.5 * (of("f", base) - of("f", candidate)) + 0.002 * (of("w", candidate) - of("w", base)), 9)
    change = F.zip_with("_s1", "_s0", lambda a, b: a - b)
    ratio = of("w", candidate) / F.greatest(of("w", base), F.lit(1))
    steps = [sorted({float(r) for r in ratios}), sorted(set(gains)), sorted({float(t) for t in thresholds})]
    passed = lambda value, values: sum((F.coalesce(value >= v, F.lit(False)).cast("int") for v in values), F.lit(0))
    values = [F.col("_r"), F.col("_g"), F.col("_x")]
    rows = measured(rows, [base, candidate]).select(key, "_s0", change.alias("_s1"), gain.alias("_g"), score.alias("_x"), ratio.alias("_r"))
    rows = checkpointed(rows.select("*", *[passed(v, s).alias(n) for v, s, n in zip(values, steps, ("_i", "_j", "_k"), strict=True)]))
    sums = lambda column, name: [F.coalesce(F.sum(F.col(column)[i]), F.lit(0)).alias(f"_{name}{i}") for i in range(S.WIDTH)]
    bins = checkpointed(rows.groupBy("_i", "_j", "_k").agg(F.count("*").alias("_n"), *sums("_s0", "b"), *sums("_s1", "c")))
    whole = bins.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), *[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(S.WIDTH)])
    names = ["ratio", "gain", "threshold", "cap"]
    grid = [(r, g, t, c, i, j, k) for i, r in enumerate(steps[0]) for j, g in enumerate(steps[1]) for k, t in enumerate(steps[2]) for c in caps]
    cells = F.broadcast(df.sparkSession.createDataFrame(grid, "ratio double, gain long, threshold double, cap long, i int, j int, k int"))
    strict = (F.col("_i") > F.col("i")) & (F.col("_j") > F.col("j")) & (F.col("_k") > F.col("k"))
    open_cells = bins.join(cells.where("cap < 0"), strict).groupBy(*names).agg(F.sum("_n").alias("switched"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(S.WIDTH)])
    best = W.partitionBy("_i", "_j").orderBy(F.desc("_x"), key)
    top = rows.where("_i > 0 AND _j > 0 AND _k > 0").withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= max([0, *caps]))
    first = W.partitionBy(*names).orderBy(F.desc("_x"), key)
    of_cell = top.select(key, "_s1", "_x", "_i", "_j", "_k").join(cells.where("cap >= 0"), strict).withColumn("_rn", F.row_number().over(first)).where("_rn <= cap")
    capped = of_cell.groupBy(*names).agg(F.count("*").alias("switched"), *sums("_s1", "c"))
    total = cells.join(open_cells.unionByName(capped), names, "left").crossJoin(F.broadcast(whole)).where("n_rows > 0")  # one row
    total = total.withColumns({f"_m{i}": F.col(f"_b{i}") + F.coalesce(F.col(f"_c{i}"), F.lit(0)) for i in range(S.WIDTH)})
    scored = total.withColumn("bleu", S.bleu()).withColumn("chrfpp", S.chrf())
    return scored.withColumn("geom", S.geometric(F.col("bleu"), F.col("chrfpp"))).select(*names, F.coalesce("switched", F.lit(0)).alias("switched"), "n_rows", "bleu", "chrfpp", "geom")


def shortlist(grid: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """The grid's cells within the tolerance of the best: fewest switches, smaller cap, stricter gate first."""
    best = grid.agg(F.max("geom").alias("_best"))
    near = grid.join(F.broadcast(best)).where(F.col("geom") >= F.col("_best") - tolerance).drop("_best")
    cap = F.when(F.col("cap") < 0, F.lit(float("inf"))).otherwise(F.col("cap").cast("double"))
    return near.orderBy("switched", cap, F.desc("threshold"), F.desc("ratio"), F.desc("geom"))


def random_policy_p95(scores: DataFrame, value: str) -> DataFrame:
    """The order statistic at round(0.95 * (n - 1)), not interpolated."""
    return order_statistic(scores, value, 0.95).select(F.col(value).alias("p95"))


def concat_candidates(chunks: DataFrame, parent: str, order: str, text: str) -> DataFrame:
    """(parent, raw, gapfix, looptrim, looptrim_dedupe): rebuilt texts under four clean-ups."""
    from corpusloom.operators.reconstruct import ordered

    grouped = chunks.groupBy(parent).agg(ordered(text, order).alias("_c"))
    parts = F.filter(F.transform("_c", lambda x: T.fold_whitespace(T.blank(x[text]))), lambda t: t != "")
    dedupe = F.filter(F.col("_p"), lambda x, i: (i == 0) | (x != F.element_at("_p", F.greatest(i, F.lit(1)))))
    out = grouped.withColumn("_p", parts).withColumn("raw", F.array_join("_p", " ")).withColumn("_d", F.array_join(dedupe, " "))
    trim = seq.series(seq.patch_light)
    out = out.select(parent, "raw", T.repair_gaps(F.col("raw")).alias("gapfix"), T.repair_gaps(F.col("_d")).alias("_d"))
    return out.select(parent, "raw", "gapfix", trim(F.col("gapfix")).alias("looptrim"), trim(F.col("_d")).alias("looptrim_dedupe"))


def best_concat(candidates: DataFrame, parent: str, names=("raw", "gapfix", "looptrim", "looptrim_dedupe")) -> DataFrame:
    """The candidate with the least penalty; ties prefer raw, then the name."""
    options = F.array(*[F.struct(F.round(M.concat_score(F.col(n), F.col("raw")), 9).alias("score"), F.lit(int(n != "raw")).alias("o"), F.lit(n).alias("name"), F.col(n).alias("text")) for n in names])
    return candidates.select(parent, F.array_min(options).alias("b")).select(parent, "b.name", "b.score", "b.text")


def repetition_fallback(df: DataFrame, key: str, fallback: DataFrame, times: int = 5, short_times: int = 4, length: int = 180) -> DataFrame:
    """Predictions that stand too often in the table are replaced by the fallback's."""
    joined = S.with_repeat_count(df, "prediction", "_n").join(fallback.select(key, F.col("prediction").alias("_f")), key, "left")
    bad = (F.col("_n") >= times) | ((F.col("_n") >= short_times) & (F.length("prediction") <= length))
    use = bad & F.col("_f").isNotNull()
    return joined.withColumn("fell_back", use).withColumn("prediction", F.when(use, F.col("_f")).otherwise(F.col("prediction"))).drop("_f", "_n")


def override(base: DataFrame, candidate: DataFrame, key: str, text: str) -> DataFrame:
    """The candidate's text for the ids that it has, else the base's."""
    other = candidate.select(key, F.col(text).alias("_o"))
    joined = base.join(other, key, "left")
    return joined.withColumn("overridden", F.col("_o").isNotNull()).withColumn(text, F.coalesce("_o", text)).drop("_o")


def changed_rows(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    joined = before.select(key, F.col(text).alias("before")).join(after.select(key, F.col(text).alias("after")), key)
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))


def merge_ladder(left: DataFrame, right: DataFrame, ladder: Sequence[tuple[str, Sequence[str]]]) -> tuple[DataFrame, str]:
    """The first rung of keys under which rows match, right side unique by them, and its name."""
    for name, keys in ladder:
        side = right.dropDuplicates(list(keys)).select(*keys, F.col("prediction").alias("prediction_right"))
        joined = left.join(side, list(keys))
        if joined.limit(1).count():
            return joined, name
    return left.limit(0).withColumn("prediction_right", F.lit(None).cast("string")), "none"
