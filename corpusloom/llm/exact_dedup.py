"""Exact deduplication with a heavy-hitter split (operator 4).

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D].
Digests of the normalised texts are counted with Misra-Gries summaries, one per partition and
at most ``counters`` entries each. The merged candidates are verified by exact counts, and the
verified winners (at most ``counters`` rows) are broadcast: rows of a frequent digest that are
not its winner are decided where they stand and never shuffled. All other rows, winners
included, go through one ordinary shuffle by digest. A digest that is not among the verified
ones has at most about 2/counters of all rows, so no shuffled group grows into a hot one.

Of equal texts the row with the most code points, then the smallest doc_id, stays.
Defined cases: a null text counts as empty, and all empty texts are one group; a null doc_id
loses every tie; of fully repeated rows (same doc_id and text) one stays; columns besides
doc_id and text are ignored here and kept by ``drop_exact_duplicates``; an empty table gives
an empty result.
"""

from __future__ import annotations

import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import ASCII_SPACE, Presence, checkpointed, map_rows, text_of

COUNTERS = 128


def text_digest(column: str = "text"):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.translate(text_of(column), ASCII_SPACE, "").cast("binary"), 256))


def misra_gries(counts: dict, more: dict, counters: int) -> dict:
    """Two summaries merged into one of at most ``counters`` entries."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates for frequent digests: every digest with over 2/counters of the rows is there."""

    def summarise(batches):
        kept: dict = {}
        for batch in batches:
            counted = pc.value_counts(batch["_digest"])
            more = dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True))
            kept = misra_gries(kept, more, counters)
        kept = {k: n for k, n in kept.items() if n > 1}
        yield {"_digest": list(kept), "n": list(kept.values())}

    local = map_rows(digests.select("_digest"), summarise, "_digest binary, n long", batch_rows=1 << 16)
    return local.groupBy("_digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_digest").limit(counters)


def _order():
    return [F.desc("_len"), F.col("_id").isNull(), F.col("_id")]


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(_digest, _hid, _hlen, _hn) of the verified frequent digests, at most ``counters`` rows.

    ``digests`` has (_id, _len, _digest) and should be cheap to read twice.
    """
    candidates = frequent_digests(digests, counters).select("_digest")
    best = F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i")))
    verified = (
        digests.join(F.broadcast(candidates), "_digest").groupBy("_digest").agg(F.count("*").alias("_hn"), best.alias("b"))
    )
    return verified.where("_hn > 1").select(
        "_digest", F.col("b.i").alias("_hid"), (-F.col("b.l")).alias("_hlen"), "_hn"
    )


def _is_winner():
    return F.col("_hn").isNull() | (F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_len") == F.col("_hlen")))


def exact_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    digests = checkpointed(
        docs.select(
            F.col(id_col).alias("_id"),
            F.char_length(text_of(text_col)).cast("long").alias("_len"),
            text_digest(text_col).alias("_digest"),
        )
    )
    heavy = checkpointed(heavy_winners(digests, counters))
    rows = digests.join(F.broadcast(heavy), "_digest", "left")
    losers = rows.where(~_is_winner()).select(
        "_id", F.col("_hid").alias("keep_id"), F.col("_hn").alias("group_size"), F.lit(False).alias("kept"), "_digest"
    )
    group = W.partitionBy("_digest")
    ranked = group.orderBy(*_order())
    rest = rows.where(_is_winner()).select(
        "_id",
        F.first("_id").over(ranked).alias("keep_id"),
        F.coalesce("_hn", F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        "_digest",
    )
    return rest.union(losers).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose digest no other row has are not shuffled, but for false alarms of a bitmap.
    """
    own = docs.columns
    tagged = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)],
        F.col(id_col).alias("_id"),
        F.char_length(text_of(text_col)).cast("long").alias("_len"),
        text_digest(text_col).alias("_digest"),
    )
    digests = checkpointed(tagged.select("_id", "_len", "_digest"))
    heavy = checkpointed(heavy_winners(digests, counters))
    left = digests.join(F.broadcast(heavy), "_digest", "left").where(_is_winner())
    shared = left.groupBy("_digest").agg(F.count("*").alias("n")).where("n > 1")
    wanted = Presence(checkpointed(shared.select(F.xxhash64("_digest").alias("probe"))), "probe")
    may = F.pandas_udf(lambda probe: pd.Series(wanted.may_hold(probe.to_numpy())), "boolean")
    rows = tagged.join(F.broadcast(heavy), "_digest", "left").where(_is_winner()).withColumn("_may", may(F.xxhash64("_digest")))
    first = rows.where("_may").withColumn("_rn", F.row_number().over(W.partitionBy("_digest").orderBy(*_order()))).where("_rn = 1")
    return rows.where(~F.col("_may")).unionByName(first.drop("_rn")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS d
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY d ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY d) AS group_size,
       row_number() OVER (PARTITION BY d ORDER BY n DESC, doc_id) = 1 AS kept,
       d AS text_sha256
FROM t
"""
