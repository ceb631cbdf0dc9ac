"""Joins: folds, overlap audits, near copies, neighbours, ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gates as Y
from corpusloom.operators import knn as K
from corpusloom.operators import overlap as O
from corpusloom.operators import reconstruct as R
from corpusloom.operators import select as S
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("J1_corpus_folds", f"WITH {X.FOLDS} SELECT d.doc_id, d.lang, f.fold FROM documents d JOIN folds f USING (doc_id)")
def j1(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(X.folds(spark, d).select("doc_id", "fold"), "doc_id")


@query("J2_chunk_parent_folds", f"WITH {X.CHUNKS}, pf AS (SELECT DISTINCT conv_id AS parent, conv_id % 5 AS fold FROM conversations) SELECT id, parent, fold FROM chunks LEFT JOIN pf USING (parent)")
def j2(spark, d):
    folds = table(spark, d, "conversations").select(F.col("conv_id").alias("parent"), (F.col("conv_id") % 5).alias("fold"))
    return R.join_parent_folds(X.chunks(spark, d).select("id", "parent"), folds, "parent").select("id", "parent", "fold")


@query("J3_metadata_lookup", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'NA') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("NA")).alias("quality"))


REFERENCE = "ref AS (SELECT DISTINCT trim(text) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3'))"


@query("J4_exact_overlap_anti", f"WITH {REFERENCE} SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3') AND trim(text) NOT IN (SELECT n FROM ref)")
def j4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    held = F.col("source").isin("src0", "src1", "src2", "src3")
    return O.without_overlap(docs.where(~held), docs.where(held)).select("doc_id")


@query(
    "J5_overlap_counts",
    "SELECT b.lang AS reference, count(*) AS n FROM documents a JOIN (SELECT DISTINCT lang, text FROM documents WHERE doc_id % 2 = 0) b ON a.text = b.text WHERE a.doc_id % 2 = 1 GROUP BY 1",
)
def j5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    reference = docs.where("doc_id % 2 = 0").select(F.col("lang").alias("reference"), "text").distinct()
    return docs.where("doc_id % 2 = 1").select("doc_id", "text").join(reference, "text").groupBy("reference").agg(F.count("*").alias("n"))


GRAMS = """g AS (SELECT doc_id, text, lower(trim(text)) AS low, length(text) AS n FROM documents),
b AS (SELECT doc_id, text, substr(low, 1, 24) || '|' || CAST(n // 40 AS VARCHAR) AS block,
  CASE WHEN n >= 4 THEN list_distinct(list_transform(range(1, n - 2), lambda i: substr(text, i, 4))) ELSE [] END AS grams FROM g),
sims AS (SELECT l.doc_id, CASE WHEN l.text = r.text THEN 1.0::DOUBLE WHEN len(l.grams) = 0 OR len(r.grams) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(l.grams, r.grams)) / CAST(len(l.grams) + len(r.grams) - len(list_intersect(l.grams, r.grams)) AS DOUBLE) END AS sim
  FROM b l JOIN b r ON l.block = r.block AND l.doc_id % 3 <> 0 AND r.doc_id % 3 = 0)"""


@query("J6_near_overlap_anti", f"WITH {GRAMS} SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM sims WHERE sim >= 0.92)")
def j6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return O.without_near_overlap(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")).select("doc_id")


@query(
    "J7_similarity_summary",
    f"""WITH {GRAMS}, best AS (SELECT d.doc_id, coalesce(max(sim), 0.0::DOUBLE) AS s FROM documents d LEFT JOIN sims USING (doc_id) WHERE d.doc_id % 3 <> 0 GROUP BY 1)
SELECT count(*) AS n, max(s) AS most, quantile_cont(s, 0.95) AS p95, count(*) FILTER (WHERE s >= 0.85) AS ge_85, count(*) FILTER (WHERE s >= 0.9) AS ge_90,
 count(*) FILTER (WHERE s >= 0.92) AS ge_92, count(*) FILTER (WHERE s >= 0.95) AS ge_95 FROM best""",
)
def j7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return O.similarity_summary(O.best_similarity(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")))


@query("J8_tfidf_neighbours")
def j8(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    asked = X.pairs(spark, d).where("id % 50 = 0").select("id", F.col("source").alias("text"))
    return K.tfidf_neighbours(asked, texts, "id", "text", 5)


@query("J8_tfidf_self_neighbours")
def j8_self(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return K.tfidf_neighbours(texts, texts, "id", "text", 3, same=True)


@query(
    "J8_dense_neighbours",
    """WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT query, doc, round(list_dot_product(q.e, d.e), 6) AS score FROM q JOIN d ON query <> doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc, rank FROM r WHERE rank <= 5""",
)
def j8_dense(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = K.dense_neighbours(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", 5)
    return found.select("query", "doc", F.col("rank").cast("long").alias("rank"))


NEIGHBOURS = """nb AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank,
  CAST(l_quantity AS DOUBLE) AS score, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS target FROM lineitem)"""


@query(
    "J9_merged_neighbours",
    f"""WITH {NEIGHBOURS}, u AS (SELECT *, min(rank) OVER (PARTITION BY query, target) AS f FROM nb WHERE rank <= 6 AND target <> ''),
dd AS (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY f) AS d FROM u), st AS (SELECT *, min(CASE WHEN d = 2 THEN f END) OVER (PARTITION BY query) AS stop FROM dd),
m AS (SELECT query, target, sum(score) AS score, min(d) AS rank FROM st WHERE d <= 2 AND (stop IS NULL OR rank <= stop) GROUP BY 1, 2)
SELECT query, target, score, CAST(rank AS BIGINT) AS rank, CASE WHEN sum(greatest(score, 0)) OVER w <= 1e-12 THEN 1.0 / count(*) OVER w ELSE greatest(score, 0) / sum(greatest(score, 0)) OVER w END AS weight
FROM m WINDOW w AS (PARTITION BY query)""",
)
def j9(spark, d):
    from pyspark.sql import Window as W

    lines = table(spark, d, "lineitem")
    ranked = lines.select(
        F.col("l_orderkey").alias("query"),
        F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("rank"),
        F.col("l_quantity").cast("double").alias("score"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("target"),
    )
    return K.merged_neighbours(ranked, "target", 6, 2).withColumn("rank", F.col("rank").cast("long"))


@query("J10_candidate_merge", f"WITH {X.CANDIDATES} SELECT a.id, a.text AS a, b.text AS b, c.text AS c FROM candidates a JOIN candidates b ON a.id = b.id AND b.label = 'b' JOIN candidates c ON a.id = c.id AND c.label = 'c' WHERE a.label = 'a'")
def j10(spark, d):
    return X.candidates(spark, d).groupBy("id").pivot("label", ["a", "b", "c"]).agg(F.first("text")).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")


@query("J11_merge_ladder", f"WITH {X.PAIRS} SELECT id, source, target AS reference, replace(target, 'e', 'E') AS prediction_right, 'id_source_reference' AS mode FROM pairs WHERE id % 2 = 0")
def j11(spark, d):
    left = X.pairs(spark, d).select("id", "source", F.col("target").alias("reference"))
    right = left.where("id % 2 = 0").withColumn("prediction", F.replace("reference", F.lit("e"), F.lit("E")))
    ladder = [("id_source_reference", ["id", "source", "reference"]), ("id_reference", ["id", "reference"]), ("source_reference", ["source", "reference"])]
    joined, mode = S.merge_ladder(left, right, ladder)
    return joined.withColumn("mode", F.lit(mode))


@query(
    "J12_fallback_join",
    f"WITH {X.CHUNKS} SELECT c.id, CASE WHEN count(*) OVER (PARTITION BY c.prediction) >= 2 THEN coalesce(f.reference, c.prediction) ELSE c.prediction END AS prediction FROM chunks c LEFT JOIN (SELECT id, reference FROM chunks WHERE id % 2 = 0) f USING (id)",
)
def j12(spark, d):
    c = X.chunks(spark, d)
    fallback = c.where("id % 2 = 0").select("id", F.col("reference").alias("prediction"))
    return S.repetition_fallback(c.select("id", "prediction"), "id", fallback, times=2, short_times=2).select("id", "prediction")


@query("J13_three_way_compare", f"WITH {X.CHUNKS} SELECT a.id, b.prediction AS before, c.reference AS after FROM chunks a JOIN chunks b USING (id) JOIN chunks c USING (id) WHERE b.prediction <> c.reference")
def j13(spark, d):
    c = X.chunks(spark, d)
    joined = c.select("id").join(c.select("id", F.col("prediction").alias("before")), "id").join(c.select("id", F.col("reference").alias("after")), "id")
    return joined.where("before <> after")


@query("J14_override", f"WITH {X.CHUNKS} SELECT id, CASE WHEN chunk_total >= 5 THEN reference ELSE prediction END AS prediction, chunk_total >= 5 AS overridden FROM chunks")
def j14(spark, d):
    c = X.chunks(spark, d)
    candidate = c.where("chunk_total >= 5").select("id", F.col("reference").alias("prediction"))
    return S.override(c.select("id", "prediction"), candidate, "id", "prediction")


@query("J15_parent_sentences", "SELECT o.o_orderkey, o.o_orderstatus, l.n, l.total FROM orders o JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def j15(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey").select("o_orderkey", "o_orderstatus", "n", "total")


@query("J16_reindex", "SELECT p.i AS pos, n_nationkey, n_name FROM (SELECT i, (i * 7) % 25 AS k FROM range(25) t(i)) p JOIN nation ON n_nationkey = p.k")
def j16(spark, d):
    order = spark.range(25).select(F.col("id").alias("pos"), ((F.col("id") * 7) % 25).cast("int").alias("n_nationkey"))
    return order.join(table(spark, d, "nation"), "n_nationkey", "left").select("pos", "n_nationkey", "n_name").orderBy("pos")


@query(
    "J17_mutual_overlap",
    "WITH a AS (SELECT * FROM documents WHERE doc_id % 2 = 0), b AS (SELECT * FROM documents WHERE doc_id % 2 = 1) SELECT (SELECT count(*) FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)) AS id_overlap, (SELECT count(*) FROM (SELECT text FROM a INTERSECT SELECT text FROM b)) AS text_overlap, (SELECT count(*) FROM a WHERE text IN (SELECT text FROM b)) AS rows_overlap",
)
def j17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    ids = count(a.select("doc_id").intersect(b.select("doc_id")), "id_overlap")
    texts = count(a.select("text").intersect(b.select("text")), "text_overlap")
    rows = count(a.join(b.select("text").distinct(), "text", "left_semi"), "rows_overlap")
    return ids.crossJoin(texts).crossJoin(rows)  # three rows of one count each


@query("J18_two_key_join", f"WITH {X.CHUNKS} SELECT a.id, a.parent, a.chunk_total AS total, b.chunk_mode AS mode_meta FROM chunks a LEFT JOIN (SELECT * FROM chunks WHERE chunk_index % 2 = 0) b ON a.id = b.id AND a.parent = b.parent")
def j18(spark, d):
    c = X.chunks(spark, d)
    meta = c.where("chunk_index % 2 = 0").select("id", "parent", F.col("chunk_mode").alias("mode_meta"))
    return c.select("id", "parent", F.col("chunk_total").alias("total")).join(meta, ["id", "parent"], "left")


@query(
    "J19_parameter_grid",
    """WITH l AS (SELECT lang, b.most, u.unit, CASE u.unit WHEN 'chars' THEN length(text) ELSE strlen(text) END AS n FROM documents, (VALUES (200), (1000), (5000)) b(most), (VALUES ('chars'), ('bytes')) u(unit))
SELECT lang, most, unit, count(*) AS n_rows, count(*) FILTER (WHERE n > most) * 100 / CAST(count(*) AS DOUBLE) AS pct_over FROM l GROUP BY 1, 2, 3""",
)
def j19(spark, d):
    """Rows over each candidate limit, in each unit, of each language; lengths are summed up before the lists multiply anything."""
    lengths = table(spark, d, "documents").groupBy("lang", F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).agg(F.count("*").alias("n"))
    grid = Y.parameter_grid(lengths, {"most": [200, 1000, 5000], "unit": ["chars", "bytes"]})
    size = F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes"))
    counts = grid.groupBy("lang", "most", "unit").agg(F.sum("n").alias("n_rows"), F.sum(F.when(size > F.col("most"), F.col("n")).otherwise(0)).alias("over"))
    return counts.select("lang", "most", "unit", "n_rows", (F.col("over") * 100 / F.col("n_rows")).alias("pct_over"))


@query("J20_candidate_pairs", f"WITH {X.CANDIDATES} SELECT a.id, a.label AS left_label, b.label AS right_label, a.text = b.text AS same FROM candidates a JOIN candidates b ON a.id = b.id AND a.label < b.label")
def j20(spark, d):
    c = X.candidates(spark, d).select("id", "label", "text")
    right = c.select("id", F.col("label").alias("right_label"), F.col("text").alias("_t"))
    return c.join(right, "id").where("label < right_label").select("id", F.col("label").alias("left_label"), "right_label", (F.col("text") == F.col("_t")).alias("same"))


@query("J21_hard_subset", f"WITH {X.CHUNKS} SELECT id, parent FROM chunks WHERE id IN (SELECT id FROM chunks WHERE chunk_total >= 6) OR parent IN (SELECT conv_id FROM conversations WHERE conv_id % 7 = 0)")
def j21(spark, d):
    c = X.chunks(spark, d)
    hard = c.where("chunk_total >= 6").select("id")
    parents = table(spark, d, "conversations").where("conv_id % 7 = 0").select(F.col("conv_id").alias("parent"))
    flagged = O.membership_flag(O.membership_flag(c, hard, "id", "_a"), parents, "parent", "_b")
    return flagged.where("_a OR _b").select("id", "parent")


@query("J22_term_containment", "SELECT d.doc_id, t.term AS matched_term FROM documents d JOIN (VALUES ('theran'), ('haed'), ('lea'), ('token'), ('licen')) t(term) ON contains(lower(d.text), t.term)")
def j22(spark, d):
    terms = spark.createDataFrame([("theran",), ("Haed",), ("lea",), ("token",), ("licen",)], "term string")
    return O.containment_join(table(spark, d, "documents").select("doc_id", "text"), terms, "text", "term").select("doc_id", "matched_term")
