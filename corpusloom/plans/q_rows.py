"""Windows, order, samples, set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import seq
from corpusloom.functions import text as T
from corpusloom.operators import metrics as S
from corpusloom.operators import overlap as O
from corpusloom.operators import reconstruct as R
from corpusloom.operators import sample as P
from corpusloom.operators import select as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.q_text import words
from corpusloom.plans.registry import query
from corpusloom.session import table


@query(
    "W1_route_rank",
    f"WITH {X.CHUNKS}, m AS (SELECT id, parent % 3 AS split, chunk_total AS c, len({words('reference')}) AS t FROM chunks), r AS (SELECT *, c >= 4 OR t >= 129 AS hard, 2 * c + t AS score FROM m) SELECT id, split, CASE WHEN hard THEN row_number() OVER (PARTITION BY split, hard ORDER BY score DESC, t DESC, c DESC, id) ELSE 0 END AS route_rank FROM r",
)
def w1(spark, d):
    r = X.chunks(spark, d).select("id", (F.col("parent") % 3).alias("split"), F.col("chunk_total").alias("c"), T.word_count(F.col("reference")).alias("t"))
    r = r.withColumn("hard", (F.col("c") >= 4) | (F.col("t") >= 129)).withColumn("score", 2 * F.col("c") + F.col("t"))
    hard = P.group_rank(r.where("hard"), "split", [-F.col("score"), -F.col("t"), -F.col("c"), F.col("id")], "route_rank")
    return hard.select("id", "split", "route_rank").union(r.where("NOT hard").select("id", "split", F.lit(0).cast("long")))


@query("W2_first_rank", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 64")
def w2(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size").orderBy("p_size", "p_partkey").limit(64)


@query("W3_policy_rank", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN row_number() OVER (PARTITION BY s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey) ELSE 0 END AS policy_rank FROM supplier")
def w3(spark, d):
    ranked = P.group_rank(table(spark, d, "supplier").withColumn("on", F.col("s_acctbal") > 0), "on", [-F.col("s_acctbal"), F.col("s_suppkey")], "rank")
    return ranked.select("s_suppkey", F.when(F.col("on"), F.col("rank")).otherwise(0).alias("policy_rank"))


@query("W4_repeat_counts", "SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents")
def w4(spark, d):
    """Counts by an aggregate and a join: a text that stands in a third of the rows is no single window."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    return S.with_repeat_count(docs, "m", "n").select("doc_id", "n")


@query("W5_next_anchor", "SELECT conv_id, turn, coalesce((SELECT min(n.turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.role = 'user' AND n.turn > c.turn), -1) AS next_user FROM conversations c")
def w5(spark, d):
    ahead = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.min(F.when(F.col("role") == "user", F.col("turn"))).over(ahead), F.lit(-1)).alias("next_user"))


@query("W6_cursor_scan")
def w6(spark, d):
    find = seq.series(lambda text: [-1 if x is None else x[0] for x in seq.anchor_spans(text.split(), [line.split(" ")[0] for line in text.split("\n")])], "array<int>")
    return table(spark, d, "documents").select("doc_id", find(F.col("text")).alias("starts"))


@query(
    "W7_cumulative_prefix",
    "WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT source, n, sum(n) OVER (ORDER BY md5('143' || source), source) AS cum FROM g), b AS (SELECT min(abs(cum - 300)) AS gap FROM c), k AS (SELECT max(cum) AS best FROM c, b WHERE abs(cum - 300) = gap) SELECT source, n FROM c, k WHERE cum <= best",
)
def w7(spark, d):
    groups = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("_o", P.draw("source", "143"))
    return P.prefix_to_target(groups, "n", "_o", 300).select("source", "n")


#: A window starts at every chunk, or, of a parent with three chunks at most, behind the one before; it grows while both sides fit.
WINDOWS = f"""{X.CHUNKS}, l AS (SELECT parent, source, reference, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY parent) AS total,
  lead(source) OVER w AS s1, lead(source, 2) OVER w AS s2, lead(reference) OVER w AS r1, lead(reference, 2) OVER w AS r2 FROM chunks WINDOW w AS (PARTITION BY parent ORDER BY chunk_index)),
n AS (SELECT *, CASE WHEN s1 IS NULL OR greatest(strlen(source) + strlen(s1), strlen(reference) + strlen(r1)) + 2 > 2000 THEN 1
  WHEN s2 IS NULL OR greatest(strlen(source) + strlen(s1) + strlen(s2), strlen(reference) + strlen(r1) + strlen(r2)) + 3 > 2000 THEN 2 ELSE 3 END AS n FROM l),
f AS (SELECT *, max(CASE WHEN i = 0 THEN n END) OVER (PARTITION BY parent) AS n0 FROM n),
g AS (SELECT *, n0 + max(CASE WHEN i = n0 THEN n END) OVER (PARTITION BY parent) AS n1 FROM f),
t AS (SELECT parent, i AS first_chunk, n AS n_chunks, concat_ws(' ', source, CASE WHEN n > 1 THEN s1 END, CASE WHEN n > 2 THEN s2 END) AS source,
  concat_ws(' ', reference, CASE WHEN n > 1 THEN r1 END, CASE WHEN n > 2 THEN r2 END) AS reference FROM g WHERE total > 3 OR i = 0 OR i = n0 OR i = n1)"""


@query("W8_chunk_windows", f"WITH {WINDOWS} SELECT parent, min(first_chunk) AS first_chunk, CAST(arg_min(n_chunks, first_chunk) AS BIGINT) AS n_chunks, source, reference FROM t GROUP BY parent, source, reference")
def w8(spark, d):
    return R.windows(X.chunks(spark, d), "parent", "chunk_index", "source", "reference", 2000)


@query("W9_first_of_group", "SELECT lang, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1")
def w9(spark, d):
    by = W.partitionBy("lang").orderBy("doc_id")
    back = W.partitionBy("lang").orderBy(F.desc("doc_id"))
    docs = table(spark, d, "documents").select("lang", "doc_id")
    first = docs.withColumn("r", F.row_number().over(by)).where("r = 1").select("lang", F.col("doc_id").alias("first_doc"))
    last = docs.withColumn("r", F.row_number().over(back)).where("r = 1").select("lang", F.col("doc_id").alias("last_doc"))
    return first.join(last, "lang")


@query("W10_min_max", "SELECT s_suppkey, CASE WHEN max(s_acctbal) OVER w - min(s_acctbal) OVER w <= 1e-12 THEN 0.5 ELSE (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) END AS scaled FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def w10(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", D.min_max("s_acctbal", "s_nationkey").alias("scaled"))


@query("W11_argmax", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, length(c_mktsegment), c_custkey) AS r FROM customer) WHERE r = 1")
def w11(spark, d):
    best = F.max_by("c_custkey", F.struct("c_acctbal", -F.length("c_mktsegment"), -F.col("c_custkey")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(best.alias("c_custkey"))


@query("L1_multi_key_sort", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey")
def l1(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 400000").orderBy(F.desc("o_orderpriority"), "o_totalprice", "o_orderkey").select("o_orderkey")


@query("L2_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 40")
def l2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(40)


@query("L3_ranked_pool", f"SELECT doc_id FROM (SELECT doc_id, n_chars % 7 AS s, len({words('text')}) AS w FROM documents) ORDER BY s DESC, w DESC, doc_id LIMIT 150")
def l3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 7).alias("s"), T.word_count(F.col("text")).alias("w"))
    return docs.orderBy(F.desc("s"), F.desc("w"), "doc_id").limit(max(100, 3 * 50)).select("doc_id")


@query("L4_hash_sample", "SELECT doc_id FROM documents ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def l4(spark, d):
    return P.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, "42")


@query("L5_with_replacement", "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), n AS (SELECT count(*) AS n FROM orders) SELECT i AS draw, o_orderkey FROM range(200) t(i), n JOIN p ON pos = CAST('0x' || substr(md5('42' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % n.n")
def l5(spark, d):
    return P.sample_with_replacement(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 200, "42").select("draw", "o_orderkey")


@query("L6_take_or_repeat", "SELECT n_nationkey FROM nation ORDER BY md5('7' || CAST(n_nationkey AS VARCHAR)), n_nationkey LIMIT 10")
def l6(spark, d):
    return P.take_or_repeat(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 10, "7")


@query("L7_cap_per_group", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 3")
def l7(spark, d):
    return P.cap_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3, "42")


@query(
    "L8_balanced_sample",
    """WITH g AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS c, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source) - 1 AS p FROM documents),
d AS (SELECT CAST('0x' || substr(md5('42' || i), 1, 8) AS BIGINT) % (SELECT count(DISTINCT source) FROM documents) AS p, CAST('0x' || substr(md5('42child' || i), 1, 8) AS BIGINT) AS h FROM range(400) r(i))
SELECT source, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM d JOIN g ON g.p = d.p AND g.c = d.h % g.n GROUP BY source""",
)
def l8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    drawn = P.balanced_sample(docs, "source", "doc_id", 400, "42")
    return drawn.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("L9_group_shuffle", "SELECT source, row_number() OVER (ORDER BY md5('143' || source), source) AS pos FROM (SELECT DISTINCT source FROM documents)")
def l9(spark, d):
    groups = table(spark, d, "documents").select("source").distinct().withColumn("_d", P.draw("source", "143"))
    return P.numbered(groups, "_d", "pos").select("source", (F.col("pos") + 1).alias("pos"))


@query("L10_shuffled_column", f"WITH {X.PAIRS}, a AS (SELECT id, source, row_number() OVER (ORDER BY id) AS p FROM pairs), b AS (SELECT target, row_number() OVER (ORDER BY md5('42' || CAST(id AS VARCHAR))) AS p FROM pairs) SELECT id, source, target FROM a JOIN b USING (p)")
def l10(spark, d):
    return P.shuffle_column(X.pairs(spark, d).select("id", "source", "target"), "id", "target", "42")


@query(
    "L11_stratified_draws",
    """WITH r AS (SELECT i, lang, doc_id, md5('42|' || i || '|' || doc_id) AS d FROM documents, range(20) t(i)),
m AS (SELECT *, row_number() OVER (PARTITION BY i, lang ORDER BY d) <= CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 ELSE 0 END AS needed FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY needed DESC, d) AS k FROM m)
SELECT i AS iteration, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM k WHERE k <= 10 GROUP BY i""",
)
def l11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    need = spark.createDataFrame([("en", 5), ("de", 3)], "lang string, need int")
    return P.stratified_draws(docs, "lang", "doc_id", need, 20, "42", 10).groupBy("iteration").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("L12_weight_search")
def l12(spark, d):
    c = X.candidates(spark, d)
    return D.weight_search(c, "id", "label", "text", "reference", P.dirichlet_weights(["a", "b", "c"], 12, "42")).select("weight_id", "n_rows", F.round("geom", 6).alias("geom"))


@query("L13_best_worst", "(SELECT 'best' AS side, p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) UNION ALL (SELECT 'worst', p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 5)")
def l13(spark, d):
    part = table(spark, d, "part")
    best = part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select(F.lit("best").alias("side"), "p_partkey")
    return best.union(part.orderBy("p_retailprice", "p_partkey").limit(5).select(F.lit("worst").alias("side"), "p_partkey"))


@query("L14_prefix_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= least(round_even(count(*) OVER () * 0.1, 0), count(*) OVER () // 5) THEN 'val' ELSE 'train' END AS split FROM documents")
def l14(spark, d):
    return P.prefix_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1)


@query("U1_union_by_name", "SELECT doc_id AS id, text, lang, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, NULL, url FROM pages")
def u1(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return docs.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("U2_text_set_union", "SELECT text FROM documents WHERE lang = 'de' UNION SELECT text FROM benchmark")
def u2(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").select("text").union(table(spark, d, "benchmark").select("text")).distinct()


@query("U3_symbols_only_in_test", "SELECT DISTINCT char FROM (SELECT unnest(string_split(text, '')) AS char FROM documents WHERE lang <> 'en') WHERE char NOT IN (SELECT unnest(string_split(text, '')) FROM documents WHERE lang = 'en')")
def u3(spark, d):
    from corpusloom.operators.clean import known_characters, only_in

    docs = table(spark, d, "documents")
    return only_in(known_characters(docs.where("lang <> 'en'")), known_characters(docs.where("lang = 'en'")))


@query("U4_intersections", "SELECT (SELECT count(*) FROM (SELECT text FROM documents WHERE lang = 'en' INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 0)) AS n")
def u4(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select("text").intersect(docs.where("doc_id % 2 = 0").select("text")).agg(F.count("*").alias("n"))


@query("U5_first_frame_wins", "SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY p, id) AS r FROM (SELECT item_id AS id, text, 'benchmark' AS kind, 0 AS p FROM benchmark UNION ALL SELECT doc_id, text, 'document', 1 FROM documents)) WHERE r = 1")
def u5(spark, d):
    first = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("kind"))
    second = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("document").alias("kind"))
    return O.first_by_priority([first, second], F.col("text"), "id").select("id", "kind")


@query("U6_priority_dedupe", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) AS r FROM documents) WHERE r = 1")
def u6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    held = F.col("source") == "src0"
    return O.first_by_priority([docs.where(held), docs.where(~held)], F.lower(F.trim("text")), "doc_id").select("doc_id")


@query(
    "U7_removal_log",
    "WITH f AS (SELECT doc_id, text, CASE WHEN text IN (SELECT text FROM documents WHERE source = 'src1') THEN 'val_overlap' WHEN text IN (SELECT text FROM documents WHERE source = 'src2') THEN 'test_source' END AS r FROM documents WHERE source NOT IN ('src1', 'src2')) SELECT doc_id, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY text, r IS NULL ORDER BY doc_id) > 1 THEN 'published_duplicate' ELSE r END AS reason FROM f",
)
def u7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    sets = [("val_overlap", docs.where("source = 'src1'").select("text")), ("test_source", docs.where("source = 'src2'").select("text"))]
    return O.removal_log(docs.where("source NOT IN ('src1', 'src2')"), "text", "doc_id", sets, "published_duplicate").select("doc_id", "reason")


@query("U8_list_dedupe", "WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]), ',') AS flags FROM l")
def u8(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("f")
    )
    kept = F.filter("f", lambda x, i: (i == 0) | (x != F.element_at("f", F.greatest(i, F.lit(1)))))
    return lines.select("l_orderkey", F.array_join(kept, ",").alias("flags"))


@query("U9_corpus_dedupe", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def u9(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


