"""Chunking and alignment as table operators: rows in, rows out, lineage kept."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import seq
from corpusloom.operators.sample import quantiles


def _train_chunks(sources: pd.Series, targets: pd.Series) -> pd.Series:
    return pd.Series([[{"mode": mode, "source": a, "target": b} for a, b in zip(left, right, strict=True)] for mode, left, right in (seq.chunk_pair(s or "", t or "") for s, t in zip(sources, targets, strict=True))])


def _source_chunks(sources: pd.Series) -> pd.Series:
    return pd.Series([[{"mode": mode, "source": p} for p in parts] for mode, parts in (seq.chunk_source(s or "") for s in sources)])


def _numbered(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    rows = df.select(key, F.size("_c").alias("_n"), F.posexplode("_c").alias("_i", "_x"))
    name = F.concat(F.col(key).cast("string"), F.lit("__c"), (F.col("_i") + 1).cast("string"), F.lit("of"), F.col("_n").cast("string"))
    return rows.select(
        F.when(F.col("_n") == 1, F.col(key).cast("string")).otherwise(name).alias("chunk_key"),
        F.col(key).alias("parent"),
        F.col("_i").cast("long").alias("chunk_index"),
        F.col("_n").cast("long").alias("chunk_total"),
        (F.col("_n") > 1).alias("is_chunk"),
        F.col("_x.mode").alias("chunk_mode"),
        *[F.col(f"_x.{f}").alias(f) for f in fields],
    )


def chunk_pairs(df: DataFrame, key: str, source: str = "source", target: str = "target") -> DataFrame:
    """Long pairs cut into aligned chunks, a row per chunk."""
    kind = "array<struct<mode:string,source:string,target:string>>"
    cut = F.pandas_udf(_train_chunks, kind)(F.col(source), F.col(target))
    return _numbered(df.select(key, cut.alias("_c")), key, ["source", "target"])


def chunk_sources(df: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Long sources without targets cut into chunks, a row per chunk."""
    cut = F.pandas_udf(_source_chunks, "array<struct<mode:string,source:string>>")(F.col(source))
    return _numbered(df.select(key, cut.alias("_c")), key, ["source"])


@F.arrow_udtf(returnType="key: bigint, mode: string, chunk_index: int, chunk_total: int, source: string, target: string")
class ChunkPairs:
    """The chunker as a table function for SQL, a batch at a time: chunk_pairs(TABLE(SELECT key, source, target FROM ..))."""

    def eval(self, batch: pa.RecordBatch):
        out = {name: [] for name in ("key", "mode", "chunk_index", "chunk_total", "source", "target")}
        for key, source, target in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            mode, left, right = seq.chunk_pair(source or "", target or "")
            for name, values in zip(out, ([key] * len(left), [mode] * len(left), range(len(left)), [len(left)] * len(left), left, right), strict=True):
                out[name] += values
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})


def truncation(df: DataFrame, limit: int = 384, source: str = "source", target: str = "target") -> DataFrame:
    """Rows and the share of each side over the limit."""
    pct = lambda c: F.avg((M.byte_tokens(F.col(c)) > limit).cast("double")) * 100
    return df.agg(F.count("*").alias("n_rows"), pct(source).alias("src_trunc_pct"), pct(target).alias("tgt_trunc_pct"))


def length_ratio(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """One row: the median length ratio, clamped to 0.2 .. 5."""
    ratio = (F.length(target) + 1) / (F.length(source) + 1)
    median = F.col("q0")
    found = quantiles(df.select(ratio.alias("ratio")), "ratio", [0.5])
    return found.select(F.when(median.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(0.2), median))).alias("alpha"))


def aligned_segments(df: DataFrame, key: str, source: str = "source", target: str = "target", alpha: float | None = None) -> DataFrame:
    """Segment pairs of each text pair, with type and cost."""
    if alpha is None:
        alpha = length_ratio(df, source, target).first()["alpha"] or 1.0

    def align(sources: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([seq.align_pair(s or "", t or "", alpha) for s, t in zip(sources, targets, strict=True)])

    kind = "array<struct<source:string,target:string,align_type:string,align_cost:double>>"
    cut = F.pandas_udf(align, kind)(F.col(source), F.col(target))
    return df.select(key, cut.alias("_a")).select(key, F.posexplode("_a").alias("segment", "_x")).select(key, "segment", "_x.*")


def filter_aligned(segments: DataFrame, most_cost: float = 1.2, tokens=(3, 256), ratio=(0.4, 2.5), digits: bool = False) -> DataFrame:
    """Segments within the cost, length and ratio bands, lengths in tokens; ``digits``: a source with a digit needs a target with one."""
    s, t = M.byte_tokens(F.col("source")), M.byte_tokens(F.col("target"))
    ok = (F.col("align_cost") <= most_cost) & s.between(*tokens) & t.between(*tokens) & (t / F.greatest(s, F.lit(1))).between(*ratio)
    if digits:
        ok = ok & (~F.col("source").rlike(r"\d") | F.col("target").rlike(r"\d"))
    return segments.where(ok)


def sentence_spans(tokens: DataFrame, sentences: DataFrame, text: str) -> DataFrame:
    """(text, sentence, span): each sentence's tokens, found by its first word behind the sentence before.

    One group is one text's sentences.
    """

    def spans(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("position")
        own = left.tokens.iloc[0] if len(left) else []
        found = seq.anchor_spans([seq.token_key(t) for t in own], [seq.token_key(w or "") for w in right.first_word])
        rows = [(key[0], int(p), a[0], a[1], " ".join(own[a[0] : a[1]])) for p, a in zip(right.position, found, strict=True) if a]
        return pd.DataFrame(rows, columns=[text, "position", "first_token", "last_token", "span"])

    return tokens.groupBy(text).cogroup(sentences.groupBy(text)).applyInPandas(spans, f"{text} long, position long, first_token long, last_token long, span string")
