"""The minimal slice: parent reconstruction with a health report."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import table


@query(
    "entry_conversation_health",
    r"""
WITH p AS (
  SELECT conv_id, count(*) AS n_turns,
         coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS text
  FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, text, length(text) AS n_chars,
       len(list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '')) AS n_words,
       text = '' AS is_empty,
       count(*) OVER (PARTITION BY text) > 1 AS is_repeated
FROM p
""",
)
def entry_conversation_health(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    joined = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(
            F.filter(
                F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]),
                lambda t: F.trim(t) != "",
            ),
            "\n",
        ).alias("text"),
    )
    words = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    return joined.select(
        "conv_id",
        "n_turns",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.size(words).cast("long").alias("n_words"),
        (F.col("text") == "").alias("is_empty"),
        (F.count("*").over(W.partitionBy("text")) > 1).alias("is_repeated"),
    )
