"""Derived inputs of the queries: the same deterministic tables in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import table

#: Pairs of a user's turn and the assistant's answer.
PAIRS = """pairs AS (
  SELECT conv_id * 1000 + turn AS id, conv_id, turn, text AS source, nxt AS target FROM (
    SELECT conv_id, turn, role, text, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nrole = 'assistant')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.lead("text").over(w).alias("target"), F.lead("role").over(w).alias("nrole")
    )
    return turns.where("role = 'user' AND nrole = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.col("text").alias("source"), "target"
    )


#: Conversations as parents with ordered chunks; every fifth turn is marked short-aligned, and some predictions loop.
CHUNKS = """chunks AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS parent, turn AS chunk_index,
         count(*) OVER (PARTITION BY conv_id) AS chunk_total,
         CASE WHEN turn % 5 = 4 THEN 'short_aligned_gc' ELSE 'ratio' END AS chunk_mode,
         CASE WHEN turn % 5 = 3 THEN 'True' WHEN turn % 2 = 0 THEN 'no' ELSE '' END AS is_short_aligned,
         text AS source, replace(text, 'e', 'E') AS reference,
         CASE WHEN turn % 7 = 6 THEN '' WHEN turn % 4 = 1 AND conv_id % 5 = 0 THEN repeat(substr(text, 1, 30) || ' ', 5) WHEN turn % 3 = 0 THEN substr(text, 1, length(text) // 3) ELSE text END AS prediction
  FROM conversations)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("parent"),
        F.col("turn").alias("chunk_index"),
        F.count("*").over(W.partitionBy("conv_id")).alias("chunk_total"),
        F.when(F.col("turn") % 5 == 4, "short_aligned_gc").otherwise("ratio").alias("chunk_mode"),
        F.when(F.col("turn") % 5 == 3, "True").when(F.col("turn") % 2 == 0, "no").otherwise("").alias("is_short_aligned"),
        F.col("text").alias("source"),
        F.replace("text", F.lit("e"), F.lit("E")).alias("reference"),
        F.when(F.col("turn") % 7 == 6, "")
        .when((F.col("turn") % 4 == 1) & (F.col("conv_id") % 5 == 0), F.repeat(F.concat(F.substring("text", 1, 30), F.lit(" ")), 5))
        .when(F.col("turn") % 3 == 0, F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int")))
        .otherwise(F.col("text"))
        .alias("prediction"),
    )


#: Documents with a fold from a stable hash of their source.
FOLDS = """folds AS (
  SELECT doc_id, source AS group_key, CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 5 AS fold FROM documents)"""


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("group_key"), (T.stable_hash(F.col("source")) % 5).alias("fold"))


#: Documents with noise for the cleaning rules.
DIRTY = """dirty AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{ d }' ELSE '' END
      || CASE WHEN doc_id % 7 = 0 THEN '< gap >' ELSE '' END
      || CASE WHEN doc_id % 3 = 0 THEN chr(8203) ELSE '' END
      || replace(replace(text, ' the ', '  the' || chr(9)), chr(10), chr(13) || chr(10)) AS text
  FROM documents)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    noisy = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("  the\t")), F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.when(d % 5 == 0, "{ d }").otherwise(""),
            F.when(d % 7 == 0, "< gap >").otherwise(""),
            F.when(d % 3 == 0, "​").otherwise(""),
            noisy,
        ).alias("text"),
    )


#: Documents as translations with formulas, measures and names, and as sources with units and formulas of their own.
TRANSLATED = """translated AS (
  SELECT doc_id,
    CASE doc_id % 4 WHEN 0 THEN replace(text, ' the ', ' 5 ma-na ') WHEN 1 THEN replace(text, ' and ', ' qí-bi ') WHEN 2 THEN text || ' x [x]' ELSE text END AS source,
    CASE doc_id % 3 WHEN 0 THEN 'From Aššur-idi to Puzur and Ilī: ' WHEN 1 THEN 'To Šalim-ahum, the man of iron and Enlil-bani: ' ELSE '' END
      || CASE doc_id % 5 WHEN 0 THEN replace(text, ' the ', ' ' || (doc_id % 3 + 1) || ' minas of silver, ') WHEN 1 THEN replace(text, ' and ', '. Seal of  Nabû son of Iddin; ') ELSE text END AS reference
  FROM documents)"""


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.col("text")
    put = lambda a, b: F.replace(text, F.lit(a), F.lit(b))
    source = F.when(d % 4 == 0, put(" the ", " 5 ma-na ")).when(d % 4 == 1, put(" and ", " qí-bi ")).when(d % 4 == 2, F.concat(text, F.lit(" x [x]"))).otherwise(text)
    head = F.when(d % 3 == 0, "From Aššur-idi to Puzur and Ilī: ").when(d % 3 == 1, "To Šalim-ahum, the man of iron and Enlil-bani: ").otherwise("")
    weighed = F.replace(text, F.lit(" the "), F.concat(F.lit(" "), (d % 3 + 1).cast("string"), F.lit(" minas of silver, ")))
    body = F.when(d % 5 == 0, weighed).when(d % 5 == 1, put(" and ", ". Seal of  Nabû son of Iddin; ")).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), F.concat(head, body).alias("reference"))


#: Three candidates a pair, as label and text: a the first half, b the second half, c with every e in upper case; every third pair has a = b.
CANDIDATES = f"""{PAIRS}, candidates AS (
  SELECT id, label, CASE label WHEN 'a' THEN substr(target, 1, length(target) // 2)
      WHEN 'b' THEN CASE WHEN id % 3 = 0 THEN substr(target, 1, length(target) // 2) ELSE substr(target, length(target) // 2 + 1) END
      ELSE replace(target, 'e', 'E') END AS text, target AS reference
  FROM pairs CROSS JOIN (VALUES ('a'), ('b'), ('c')) AS l(label))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("target") / 2).cast("int")
    first = F.substring("target", F.lit(1), half)
    second = F.substring(F.col("target"), half + 1, F.length("target"))
    labels = F.explode(
        F.array(
            F.struct(F.lit("a").alias("label"), first.alias("text")),
            F.struct(F.lit("b").alias("label"), F.when(F.col("id") % 3 == 0, first).otherwise(second).alias("text")),
            F.struct(F.lit("c").alias("label"), F.replace("target", F.lit("e"), F.lit("E")).alias("text")),
        )
    )
    return pairs(spark, sf_dir).select("id", labels.alias("x"), F.col("target").alias("reference")).select("id", "x.label", "x.text", "reference")
