"""Token counts by a map-side two-tier lookup (operator 2).

A sentencepiece BPE model whose pieces hold the space mark only as a leading run never merges
across the start of a run of spaces, so a text's count is the sum over its pre-tokens, each
a run of spaces with the characters up to the next one. Tier one is a broadcast table
of the lengths of frequent pre-tokens, at most ``TABLE_ROWS`` of at most ``TABLE_CHARS``
characters (a few MB); it is filled from a bounded number of documents all over the table and affects speed only.
Tier two is a bounded cache in each Python worker; what misses both is encoded by the library.
No pre-token is ever shuffled.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings in texts are
ordinary text, as the library has them; repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, text_of

TABLE_ROWS = 32_768
TABLE_CHARS = 32
TABLE_DOCS = 4_000
TABLE_TASKS = 500
CACHE_ROWS = 200_000
LIMIT = 4096

_SEGMENT = re.compile(" *[^ ]+| +")
_worker: dict = {}


def _processor(model: str):
    if _worker.get("model") != model:
        import sentencepiece

        _worker.update(model=model, processor=sentencepiece.SentencePieceProcessor(model_file=model), cache={})
    return _worker["processor"], _worker["cache"]


def check_model(model: str) -> None:
    """Raises if the model could merge across a pre-token's start."""
    processor, _ = _processor(model)
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} spans pre-tokens")


def segments(text: str) -> list[str]:
    """The pre-tokens of a text behind the mark that the library puts first."""
    return _SEGMENT.findall(" " + text.replace("▁", " "))


def _lengths(processor, parts: list[str]) -> list[int]:
    """Token counts of pre-tokens; the library puts their first space itself, but not to an empty rest."""
    return [len(ids) or 1 for ids in processor.encode([p[1:] for p in parts], num_threads=1)]


def count_text(text: str, table: dict, model: str) -> int:
    if not text:
        return 0
    processor, cache = _processor(model)
    parts = segments(text)
    counts = list(map(table.get, parts))
    total = 0
    if None in counts:
        missing = [p for p, n in zip(parts, counts, strict=True) if n is None]
        counts = [n for n in counts if n is not None]
        unseen = [p for p in set(missing) if p not in cache]
        if unseen:
            if len(cache) > CACHE_ROWS:
                cache.clear()
                unseen = list(set(missing))
            cache.update(zip(unseen, _lengths(processor, unseen), strict=True))
        total = sum(map(cache.__getitem__, missing))
    return total + sum(counts)


def frequent_lengths(docs: DataFrame, model: str, text_col: str = "text") -> dict[str, int]:
    """The broadcast tier: pre-token to token count, from about ``TABLE_DOCS`` documents.

    Each of at most ``TABLE_TASKS`` partitions counts its first few documents and reads no further;
    only counts are shuffled.
    """
    texts = docs.select(text_of(text_col).alias("text"))
    parts = texts.rdd.getNumPartitions()
    stride = max(1, parts // TABLE_TASKS)
    each = max(1, TABLE_DOCS // max(1, parts // stride))

    def count(batches):
        if TaskContext.get().partitionId() % stride:
            return
        seen: Counter = Counter()
        left = each
        for batch in batches:
            for text in batch["text"].slice(0, left).to_pylist():
                seen.update(p for p in segments(text) if len(p) <= TABLE_CHARS)
            left -= len(batch["text"])
            if left <= 0:
                break
        yield {"part": list(seen), "n": list(seen.values())}

    counts = map_rows(texts, count, "part string, n long", batch_rows=64).groupBy("part").agg(F.sum("n").alias("n"))
    best = [r["part"] for r in counts.where("n > 1").orderBy(F.desc("n"), "part").limit(TABLE_ROWS).collect()]
    processor, _ = _processor(model)
    return dict(zip(best, _lengths(processor, best), strict=True)) if best else {}


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``."""
    check_model(model)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, text_col))

    def count(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            known = table.value
            yield {
                "doc_id": batch["doc_id"],
                "n_bytes": pa.compute.binary_length(batch["text"].cast(pa.binary())).cast(pa.int64()),
                "n_tokens": [count_text(t, known, model) for t in texts],
            }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    counted = map_rows(rows, count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
