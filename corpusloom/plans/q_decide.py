"""Decisions: votes, reranking, policies, gates, mixes, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import text as T
from corpusloom.operators import folds as G
from corpusloom.operators import gates as Y
from corpusloom.operators import metrics as S
from corpusloom.operators import overlap as O
from corpusloom.operators import sample as P
from corpusloom.operators import select as D
from corpusloom.operators.lexicon import select_lexicon
from corpusloom.plans import fixtures as X
from corpusloom.plans.q_aggs import TERMS, term_stats
from corpusloom.plans.q_text import repeat_score, words
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("D1_majority_vote", f"WITH {X.CANDIDATES}, v AS (SELECT id, text, count(*) AS n FROM candidates GROUP BY 1, 2) SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, length(text), text) AS r FROM v) WHERE r = 1")
def d1(spark, d):
    return D.vote(X.candidates(spark, d), "id", "text").select("id", "text")


@query("D2_weighted_vote", f"WITH {X.CANDIDATES}, v AS (SELECT id, text, sum(CASE label WHEN 'a' THEN 0.25::DOUBLE WHEN 'b' THEN 0.25::DOUBLE ELSE 0.4::DOUBLE END) AS n FROM candidates GROUP BY 1, 2) SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(n, 12) DESC, length(text), text) AS r FROM v) WHERE r = 1")
def d2(spark, d):
    weight = F.when(F.col("label") == "c", 0.4).otherwise(0.25)
    return D.vote(X.candidates(spark, d), "id", "text", weight).select("id", "text")


@query("D3_vote_strength", f"WITH {X.CANDIDATES}, v AS (SELECT id, count(*) AS n FROM candidates GROUP BY id, text), s AS (SELECT id, max(n) / CAST(sum(n) AS DOUBLE) AS s FROM v GROUP BY 1) SELECT avg(s) AS mean_strength, avg(CASE WHEN s > 1 - 1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unanimity FROM s")
def d3(spark, d):
    return D.vote_summary(D.vote(X.candidates(spark, d), "id", "text"))


@query("D4_weight_search")
def d4(spark, d):
    scores = D.weight_search(X.candidates(spark, d), "id", "label", "text", "reference", P.dirichlet_weights(["a", "b", "c"], 8, "7"))
    return scores.orderBy(F.desc(F.round("geom", 6)), "weight_id").select("weight_id", F.round("bleu", 6).alias("bleu"), F.round("chrfpp", 6).alias("chrfpp"), F.round("geom", 6).alias("geom"))


@query(
    "D5_rerank",
    "WITH s AS (SELECT l_orderkey AS id, l_partkey AS cand, l_quantity AS q, CASE WHEN max(l_quantity) OVER w - min(l_quantity) OVER w <= 1e-12 THEN 0.5 ELSE (l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w) END AS m, l_discount, l_tax FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT id, cand FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(m + 0.8 * l_discount - 0.6 * l_tax - 0.5 * 0.1, 9) DESC, cand, q) AS r FROM s) WHERE r = 1",
)
def d5(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("cand"), F.col("l_quantity").alias("model_score"), F.col("l_discount").alias("digit_score"), F.col("l_tax").alias("repeat_penalty"), F.lit(0.1).alias("length_penalty")
    )
    return D.rerank(lines, "id", "cand").select("id", "cand")


@query("D6_minimum_risk")
def d6(spark, d):
    return D.minimum_risk(X.candidates(spark, d), "id", "label", "text").select("id", "label", F.round("utility", 6).alias("utility"))


@query("D7_heuristic_pick")
def d7(spark, d):
    return X.chunks(spark, d).select("id", D.heuristic_pick(F.col("prediction"), F.col("source"), F.col("reference")).alias("text"))


@query("D7_oracle_pick")
def d7_oracle(spark, d):
    return D.oracle_pick(X.candidates(spark, d), "id", "label", "text", "reference").select("id", "label", F.round("geom", 6).alias("geom"))


def _actions(spark, d):
    c = X.chunks(spark, d).withColumn("bucket", M.band(F.col("chunk_total"), [3, 6]))
    return c.select("id", "parent", "bucket", "reference", F.concat_ws(" ", "prediction", "prediction", "prediction").alias("pass_a_prediction"), F.col("prediction").alias("selective_patch_light"), F.col("source").alias("looptrim_concat"))


@query("D8_bucket_policy")
def d8(spark, d):
    rows, actions = _actions(spark, d), D.ACTIONS[:3]
    policy = D.learn_policy(rows.where(T.stable_split(F.col("parent")) == "tune"), "bucket", actions, "reference", ["4_6"])
    return D.apply_policy(rows, policy, "bucket", actions).select("id", "bucket", "action", "switched")


def _formulas(c: str) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in T.FORMULA_STEMS)


#: A candidate's gain in repeats, its words, and its score against the base.
GATE = f"""{X.CHUNKS}, t AS (SELECT id, prediction || ' ' || prediction || ' ' || prediction AS a, prediction AS b, source AS c FROM chunks),
w AS (SELECT *, {words('a')} AS wa, {words('b')} AS wb, {words('c')} AS wc, {_formulas('a')} AS fa, {_formulas('b')} AS fb, {_formulas('c')} AS fc FROM t),
r AS (SELECT *, {repeat_score('wa')} AS ra, {repeat_score('wb')} AS rb, {repeat_score('wc')} AS rc FROM w),
o AS (SELECT id, len(wa) AS na, ra - rb AS gain, len(wb) AS n, fa - fb AS f FROM r UNION ALL SELECT id, len(wa), ra - rc, len(wc), fa - fc FROM r),
s AS (SELECT id, max(round(gain + 0.5::DOUBLE * f + 0.002::DOUBLE * (n - na), 9)) AS score FROM o WHERE n >= na * 0.3::DOUBLE AND gain >= 1 GROUP BY id),
k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS gate_rank FROM s WHERE score >= 1.0)"""


@query("D9_row_gate", f"WITH {GATE} SELECT c.id, gate_rank, gate_rank IS NOT NULL AS switched FROM chunks c LEFT JOIN (SELECT * FROM k WHERE gate_rank <= 40) USING (id)")
def d9(spark, d):
    return D.row_gate(_actions(spark, d), "id", "pass_a_prediction", ["selective_patch_light", "looptrim_concat"], least_ratio=0.3, cap=40).select("id", "gate_rank", "switched")


@query("D10_gate_grid")
def d10(spark, d):
    grid = D.gate_grid(_actions(spark, d), "id", "pass_a_prediction", "selective_patch_light", "reference", [0.3, 0.8], [1, 2], [0, 1], [10, -1])
    rounded = grid.withColumns({c: F.round(c, 6) for c in ("bleu", "chrfpp", "geom")})
    return D.shortlist(rounded)


@query("D11_random_policy_p95", "WITH s AS (SELECT l_suppkey AS it, sum(l_quantity) AS v FROM lineitem GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM s) SELECT v AS p95 FROM r WHERE k = round_even(0.95 * (n - 1), 0)")
def d11(spark, d):
    draws = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return D.random_policy_p95(draws, "v")


@query("D12_concat_rerank")
def d12(spark, d):
    return D.best_concat(D.concat_candidates(X.chunks(spark, d), "parent", "chunk_index", "prediction"), "parent").select("parent", "name", "score", "text")


@query(
    "D13_repetition_fallback",
    f"WITH {X.CHUNKS}, k AS (SELECT id, prediction, count(*) OVER (PARTITION BY prediction) AS n FROM chunks), b AS (SELECT *, n >= 5 OR (n >= 2 AND length(prediction) <= 180) AS bad FROM k) SELECT b.id, b.bad AS fell_back, CASE WHEN b.bad THEN c.reference ELSE b.prediction END AS prediction FROM b JOIN chunks c USING (id)",
)
def d13(spark, d):
    c = X.chunks(spark, d)
    return D.repetition_fallback(c.select("id", "prediction"), "id", c.select("id", F.col("reference").alias("prediction")), 5, 2, 180)


@query("D14_no_regression", "SELECT a.s_suppkey, round(a.s_acctbal - b.s_acctbal, 4) <= 0 AND round(a.s_nationkey - b.s_nationkey, 4) >= 0 AS ok FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def d14(spark, d):
    s = table(spark, d, "supplier")
    left = s.select("s_suppkey", F.col("s_acctbal").alias("c_x"), F.col("s_nationkey").alias("c_y"))
    right = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_acctbal").alias("b_x"), F.col("s_nationkey").alias("b_y"))
    return left.join(right, "s_suppkey").select("s_suppkey", Y.no_regression(less=["x"], more=["y"]).alias("ok"))


@query("D15_gate_verdicts", "SELECT s_suppkey, CASE WHEN delta >= 0.10 AND bucket >= 0.20 THEN 'accept' WHEN delta >= -0.05 AND (bucket >= 0.20 OR hard >= 0.20) THEN 'review' ELSE 'reject' END AS term_patch, CASE WHEN delta >= 0.2 AND health THEN 'accept' WHEN delta >= 0 THEN 'review' ELSE 'reject' END AS promote FROM (SELECT s_suppkey, s_acctbal / 10000 AS delta, s_nationkey / 25.0 AS bucket, s_nationkey / 50.0 AS hard, s_suppkey % 2 = 0 AS health FROM supplier)")
def d15(spark, d):
    m = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("delta"), (F.col("s_nationkey") / 25).alias("bucket"), (F.col("s_nationkey") / 50).alias("hard"), (F.col("s_suppkey") % 2 == 0).alias("health"))
    return m.select("s_suppkey", Y.verdict("term_patch").alias("term_patch"), Y.verdict("promote").alias("promote"))


@query("D16_stage_constraints", "SELECT c_custkey, CASE WHEN NOT c_acctbal >= 0 THEN 'c_acctbal >= 0' ELSE '' END AS issues, CASE WHEN NOT c_nationkey <= 20 THEN 'c_nationkey <= 20' ELSE '' END AS warnings, c_acctbal >= 0 AS ok FROM customer")
def d16(spark, d):
    return Y.violations(table(spark, d, "customer"), [("c_acctbal", ">=", 0.0, "issue"), ("c_nationkey", "<=", 20.0, "warning")], ["c_custkey"])


@query("D17_acceptance", f"WITH {X.CHUNKS}, m AS (SELECT chunk_mode, 0.0 AS e, avg(CASE WHEN length(prediction) < length(reference) * 0.5 THEN 100.0 ELSE 0 END) AS s, avg(CASE WHEN prediction = '' THEN 100.0 ELSE 0 END) AS m, avg(CASE WHEN prediction = source THEN 100.0 ELSE 0 END) AS c FROM chunks GROUP BY 1) SELECT chunk_mode, e <= 1 AND s <= 55 AND m <= 5 AND c <= 15 AS ok FROM m")
def d17(spark, d):
    health = S.health_by_chars(X.chunks(spark, d), ["chunk_mode"]).withColumn("extra_id_pct", F.col("bad_pct"))
    metrics = health.withColumn("src_trunc_pct", F.lit(0.0)).withColumn("tgt_trunc_pct", F.lit(0.0))
    return Y.acceptance(metrics, "smoke", ["chunk_mode"]).select("chunk_mode", "ok")


@query(
    "D18_config_consistency",
    """WITH r AS (SELECT o_orderpriority, CAST(year(min(o_orderdate)) AS VARCHAR) AS since, CAST(count(*) AS VARCHAR) AS n, min(o_orderstatus) AS task FROM orders GROUP BY 1),
v AS (SELECT 'data.since' AS setting, since AS v FROM r UNION ALL SELECT 'rows', n FROM r UNION ALL SELECT 'task', task FROM r UNION ALL SELECT 'data.seed', NULL FROM r)
SELECT setting, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n_values, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) <= 1 AS consistent FROM v GROUP BY 1""",
)
def d18(spark, d):
    """Settings of one run a priority of orders, as the runs' JSON records have them."""
    data = F.struct(F.year(F.min("o_orderdate")).alias("since"))
    runs = table(spark, d, "orders").groupBy("o_orderpriority").agg(data.alias("data"), F.count("*").alias("rows"), F.min("o_orderstatus").alias("task"))
    return Y.consistent_settings(runs.select(F.to_json(F.struct("data", "rows", "task")).alias("config")), "config", ["data.since", "rows", "task", "data.seed"])


@query("D19_lexicon_selection", f"WITH {TERMS} SELECT type, term, hits, 'canonicalize' AS action FROM ts WHERE type = 'measure' AND ref_count >= 5 AND misses >= 2 AND misses / CAST(ref_count AS DOUBLE) >= 0.4 AND hits >= 2 ORDER BY hits DESC, ref_count DESC, misses / CAST(ref_count AS DOUBLE), term LIMIT 12")
def d19(spark, d):
    return select_lexicon(term_stats(spark, d)).select("type", "term", "hits", "action")


@query("D20_pseudo_mix", f"WITH {X.PAIRS}, n AS (SELECT count(*) AS n FROM pairs) SELECT id, 0 AS fold FROM pairs UNION ALL (SELECT id, -1 FROM pairs ORDER BY id LIMIT (SELECT CAST(least(512, greatest(64, round_even(n * 0.12, 0))) AS BIGINT) FROM n))")
def d20(spark, d):
    p = X.pairs(spark, d).select("id")
    n = min(512, max(64, round(p.count() * 0.12)))
    return p.withColumn("fold", F.lit(0)).unionByName(p.orderBy("id").limit(n).withColumn("fold", F.lit(-1)))


@query("D21_noise_filter", "WITH n AS (SELECT count(*) AS n FROM part), f AS (SELECT fr, CAST(greatest(32, round_even(fr * n, 0)) AS BIGINT) AS k FROM n, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) v(fr)), r AS (SELECT p_size, row_number() OVER (ORDER BY p_size, p_partkey) AS r FROM part) SELECT fr AS fraction, count(*) AS n_rows, max(p_size) AS worst FROM f JOIN r ON r.r <= f.k GROUP BY 1")
def d21(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("noise"))
    placed = P.numbered(part.withColumn("_o", F.struct("noise", "p_partkey")), "_o")
    n = part.count()
    fractions = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(max(32, round(f * n))).alias("k")) for f in (0.5, 0.8)]))
    kept = placed.withColumn("f", fractions).where(F.col("_pos") < F.col("f.k"))
    return kept.groupBy("f.fraction").agg(F.count("*").alias("n_rows"), F.max("noise").alias("worst"))


@query("D22_ratio_mix", "WITH g AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), c AS (SELECT source, n, sum(n) OVER (ORDER BY md5('143' || source), source) AS cum FROM g), b AS (SELECT min(abs(cum - 130)) AS gap FROM c), k AS (SELECT max(cum) AS best FROM c, b WHERE abs(cum - 130) = gap), par AS (SELECT doc_id, 'parent' AS kind FROM documents d JOIN c ON c.source = d.source CROSS JOIN k WHERE d.lang = 'en' AND cum <= best) SELECT * FROM par UNION ALL SELECT * FROM (SELECT doc_id, 'sentence' AS kind FROM documents WHERE lang = 'de' ORDER BY md5('244' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 70)")
def d22(spark, d):
    """200 rows: 35 % sentences, the rest whole groups of parents up to the nearest cumulative size."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    groups = docs.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n")).withColumn("_o", P.draw("source", "143"))
    sentences = round(200 * 0.35)
    chosen = P.prefix_to_target(groups, "n", "_o", 200 - sentences).select("source")
    parents = docs.where("lang = 'en'").join(chosen, "source", "left_semi").select("doc_id", F.lit("parent").alias("kind"))
    rest = P.hash_sample(docs.where("lang = 'de'"), "doc_id", sentences, "244").select("doc_id", F.lit("sentence").alias("kind"))
    return parents.union(rest)


@query("D23_fair_assets", "WITH f AS (SELECT doc_id, text, source, CASE WHEN text IN (SELECT text FROM documents WHERE source = 'src3') THEN 'val_overlap' WHEN text IN (SELECT text FROM documents WHERE source = 'src4') THEN 'test_source' END AS r FROM documents WHERE source NOT IN ('src3', 'src4')), g AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY text, r IS NULL ORDER BY doc_id) > 1 THEN 'published_duplicate' ELSE r END AS reason FROM f) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM g GROUP BY 1")
def d23(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    sets = [("val_overlap", docs.where("source = 'src3'").select("text")), ("test_source", docs.where("source = 'src4'").select("text"))]
    log = O.removal_log(docs.where("source NOT IN ('src3', 'src4')"), "text", "doc_id", sets, "published_duplicate")
    return log.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("D24_group_ladder", "SELECT doc_id, source AS group_key, 'source' AS kind FROM documents")
def d24(spark, d):
    docs = table(spark, d, "documents").withColumn("one", F.lit("x"))
    grouped, kind = G.choose_groups(docs, ["text_id", "one", "source"], "doc_id", "text")
    return grouped.select("doc_id", "group_key", F.lit(kind).alias("kind"))


@query("D25_group_folds")
def d25(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return G.assign_folds(docs, "doc_id", "source").select("doc_id", "fold", "group_kind")


@query("D25_shuffled_folds", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || CAST(doc_id AS VARCHAR))) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // greatest(1, n // 5) END AS INT) AS fold FROM p")
def d25_shuffled(spark, d):
    return G.shuffled_folds(table(spark, d, "documents").select("doc_id"), "doc_id", 5, "42")
