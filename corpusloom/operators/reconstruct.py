"""Parents and their chunks: filters, ids, ordered rebuilding, prompts, payloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def short_aligned() -> Column:
    return T.as_bool(F.col("is_short_aligned")) | F.lower(F.trim(T.blank(F.col("chunk_mode")))).startswith("short_aligned")


def original_chunks(df: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that are not short-aligned, a row of counts and the reason)."""
    marked = [c for c in ("is_short_aligned", "chunk_mode") if c in df.columns]
    short = short_aligned() if len(marked) == 2 else F.lit(False)
    n, dropped = F.count("*"), F.count_if(short)
    if not enabled:
        reason, dropped = F.lit("disabled"), F.lit(0).cast("long")
    else:
        reason = F.when(n == 0, "empty_frame").when(dropped == 0, "no_short_alignment_markers").otherwise("filtered")
    stats = df.agg(n.alias("rows_in"), (n - dropped).alias("rows_out"), dropped.alias("dropped"), reason.alias("reason"))
    return (df.where(~short) if enabled else df), stats


def ordered(child: Sequence[str] | str, order: str | Column) -> Column:
    """An aggregate: the children's structs in order of ``order``."""
    columns = [child] if isinstance(child, str) else list(child)
    key = F.col(order) if isinstance(order, str) else order
    return F.array_sort(F.collect_list(F.struct(key.alias("_o"), *columns)))


def rebuild(
    chunks: DataFrame, parent: str, order: str | Column, texts: Sequence[str], glue: str = "\n", strip: Callable[[Column], Column] = T.strip
) -> DataFrame:
    """A row per parent: each text column's stripped non-blank chunks, in order, joined by ``glue``; chunks without a place come last."""
    key = F.col(order) if isinstance(order, str) else order
    grouped = chunks.groupBy(parent).agg(ordered(texts, F.struct(key.isNull().alias("last"), key.alias("at"))).alias("_c"))

    def joined(c: str) -> Column:
        return F.array_join(F.filter(F.transform("_c", lambda x: strip(T.blank(x[c]))), lambda t: t != ""), glue)

    return grouped.select(parent, *[joined(c).alias(c) for c in texts])


def chunk_id(parent: str, index: str, total: str, tag: str = "c") -> Column:
    """<parent>__c<i+1>of<n>"""
    return F.concat(F.col(parent).cast("string"), F.lit(f"__{tag}"), (F.col(index) + 1).cast("string"), F.lit("of"), F.col(total).cast("string"))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def chunk_prompt(chunks: DataFrame, parent: str, order: str, text: str) -> DataFrame:
    """A row per parent: its chunks as numbered elements."""
    grouped = chunks.groupBy(parent).agg(ordered(text, order).alias("_c"))
    mark = lambda x: F.concat(F.lit("<chunk_"), x["_o"].cast("string"), F.lit(">"))
    close = lambda x: F.concat(F.lit("</chunk_"), x["_o"].cast("string"), F.lit(">"))
    lines = F.transform("_c", lambda x: F.concat(mark(x), x[text], close(x)))
    return grouped.select(parent, F.concat(F.lit("<source>\n"), F.array_join(lines, "\n"), F.lit("\n</source>")).alias("prompt"))


def flat_prompt(chunks: DataFrame, parent: str, order: str, text: str, labels: int = 6) -> DataFrame:
    """A row per parent: each distinct chunk text behind the labels of up to ``labels`` chunks that have it."""
    same = chunks.groupBy(parent, text).agg(
        F.min(order).alias(order), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, labels), lambda i: F.concat(F.lit("c"), (i + 1).cast("string"))), ",").alias("_l")
    )
    grouped = same.where(F.col(text) != "").groupBy(parent).agg(ordered(["_l", text], order).alias("_c"))
    return grouped.select(parent, F.array_join(F.transform("_c", lambda x: F.concat(x["_l"], F.lit(": "), x[text])), "\n").alias("prompt"))


def payload(chunks: DataFrame, parent: str, order: str, fields: Sequence[str]) -> DataFrame:
    """A row per parent: its ordered chunks as an array of structs, and their number."""
    grouped = chunks.groupBy(parent).agg(ordered(fields, order).alias("_c"))
    return grouped.select(
        parent, F.size("_c").cast("long").alias("n_chunks"), F.transform("_c", lambda x: F.struct(x["_o"].alias(order), *[x[f].alias(f) for f in fields])).alias("chunks")
    )


def windows(chunks: DataFrame, parent: str, order: str, source: str, target: str, limit: int, longest: int = 3) -> DataFrame:
    """Packs of up to ``longest`` consecutive chunks within the byte limits, the longest from each start.

    Parents of up to three chunks are packed greedily without overlap; longer ones from every start.
    """
    grouped = chunks.groupBy(parent).agg(ordered([source, target], order).alias("_c"))
    size = lambda x, c: F.octet_length(x[c])

    def fit(i: Column) -> Column:
        """How many chunks from the i-th (1-based) on stay within the limits; one at least."""
        def ok(k: int) -> Column:
            part = F.slice("_c", i, k)
            total = lambda c: F.aggregate(part, F.lit(k), lambda a, x: a + size(x, c))
            return (i + k - 1 <= F.size("_c")) & (total(source) <= limit) & (total(target) <= limit)

        out = F.lit(1)
        for k in range(2, longest + 1):
            out = F.when((out == k - 1) & ok(k), k).otherwise(out)
        return out

    starts = F.transform(F.sequence(F.lit(1), F.size("_c")), lambda i: F.struct(i.alias("start"), fit(i).alias("n")))
    greedy = F.aggregate(
        starts,
        F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<start:int,n:int>>").alias("out")),
        lambda a, x: F.when(x["start"] == a["next"], F.struct((x["start"] + x["n"]).alias("next"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a),
    )["out"]
    packs = grouped.withColumn("_w", F.explode(F.when(F.size("_c") <= 3, greedy).otherwise(starts)))
    part = F.slice("_c", F.col("_w.start"), F.col("_w.n"))
    glued = lambda c: F.array_join(F.transform(part, lambda x: x[c]), " ")
    return packs.select(
        parent,
        (F.col("_w.start") - 1).cast("long").alias("first_chunk"),
        F.col("_w.n").cast("long").alias("n_chunks"),
        glued(source).alias(source),
        glued(target).alias(target),
    ).dropDuplicates([parent, source, target])


def join_parent_folds(chunk_map: DataFrame, folds: DataFrame, parent: str) -> DataFrame:
    """The chunk map with its parents' folds; fails if a parent has none."""
    joined = chunk_map.join(folds.dropDuplicates([parent]), parent, "left")
    if joined.where("fold IS NULL").limit(1).count():
        raise ValueError("chunks without a parent fold")
    return joined
