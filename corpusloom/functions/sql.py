"""The functions of this package under SQL names.

Expressions become temporary SQL functions, whose bodies the optimizer puts in place of the call, so a query in SQL has the plan of one in Python.
Sequential functions become Arrow-batched functions of a text, and the chunker a table function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import measures as M
from corpusloom.functions import seq
from corpusloom.functions import terms as N
from corpusloom.functions import text as T

#: SQL name -> (function of columns, arguments, type of the result).
EXPRESSIONS: dict[str, tuple[Callable[..., Column], str, str]] = {
    "loom_strip": (T.strip, "t STRING", "STRING"),
    "loom_remove_invisible": (T.remove_invisible, "t STRING", "STRING"),
    "loom_fold_whitespace": (T.fold_whitespace, "t STRING", "STRING"),
    "loom_normalize_whitespace": (T.normalize_whitespace, "t STRING", "STRING"),
    "loom_canonical_gaps": (T.canonical_gaps, "t STRING", "STRING"),
    "loom_canonical_braces": (T.canonical_braces, "t STRING", "STRING"),
    "loom_strip_markup": (T.strip_markup, "t STRING", "STRING"),
    "loom_repair_gaps": (T.repair_gaps, "t STRING", "STRING"),
    "loom_byte_tokens": (M.byte_tokens, "t STRING", "BIGINT"),
    "loom_symbol_count": (M.symbol_count, "t STRING", "BIGINT"),
    "loom_symbol_density": (M.symbol_density, "t STRING", "DOUBLE"),
    "loom_missing_marker": (M.missing_marker, "t STRING", "BOOLEAN"),
    "loom_marker_count": (M.marker_count, "t STRING", "BIGINT"),
    "loom_near_block": (M.near_block, "t STRING", "STRING"),
    "loom_formula_count": (M.formula_count, "t STRING", "BIGINT"),
    "loom_marker_rich": (N.marker_rich, "t STRING", "BOOLEAN"),
    "loom_has_measure": (N.has_measure, "t STRING, r STRING", "BOOLEAN"),
    "loom_has_formula": (N.has_formula, "t STRING, r STRING", "BOOLEAN"),
}
SEQUENTIAL: dict[str, Callable[[str], str]] = {
    "loom_nfc": seq.nfc,
    "loom_token_key": seq.token_key,
    "loom_collapse_spans": seq.collapse_spans,
    "loom_clamp_spans": seq.clamp_spans,
    "loom_collapse_formulas": seq.collapse_formulas,
}


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session's SQL."""
    from corpusloom.operators.chunk import ChunkPairs

    for name, (fn, arguments, kind) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {_body(spark, fn, arguments)}")
    for name, fn in SEQUENTIAL.items():
        spark.udf.register(name, _batched(fn))
    spark.udtf.register("chunk_pairs", ChunkPairs)


def _body(spark: SparkSession, fn: Callable[..., Column], arguments: str) -> str:
    """The function's expression as SQL text over its arguments."""
    names = [a.split()[0] for a in arguments.split(",")]
    frame = spark.createDataFrame([], arguments.lower())
    # As it is analysed, so with all casts in place; names lose the frame's ids.
    plan = frame.select(fn(*[F.col(n) for n in names]).alias("_out"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def _batched(fn: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return run
