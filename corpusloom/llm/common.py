"""What the operators share: checkpoints, Arrow row maps and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import checkpointed  # noqa: F401
from corpusloom.sources.files import scratch

#: Characters of the class [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows of a batch that goes back to the JVM.
OUT_ROWS = 1 << 13


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    """The text column, null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, batch_rows: int = 2000) -> DataFrame:
    """``mapInArrow`` for a function from batches of column lists to batches of column lists."""
    out = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, batch_rows):
                    part = batch.slice(start, batch_rows)
                    yield {n: part.column(i) for i, n in enumerate(part.schema.names)}

        for got in fn(columns()):
            whole = pa.RecordBatch.from_arrays([as_array(got[f.name], f.type) for f in out], schema=out)
            for start in range(0, whole.num_rows, OUT_ROWS):  # the JVM holds a batch at a time
                yield whole.slice(start, OUT_ROWS)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system: a worker process serves one task after another."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


_TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def pa_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as ``"doc_id long, ids array<int>"``."""
    fields = [part.strip().split(" ", 1) for part in ddl.split(",")]
    return pa.schema([pa.field(name, _TYPES[kind.strip()]) for name, kind in fields])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, without decoding."""
    return column.cast(pa.binary()).to_pylist()


class Presence:
    """A bitmap on every executor that tells of most absent values that they are absent.

    Two bits stand for a value, of sixteen or more a value and ``MOST_BITS`` (32 MB) at most. With many more values it lets
    everything through, which costs a larger join and changes no result: what passes is joined with the values themselves.
    """

    MOST_BITS = 1 << 28

    def __init__(self, values: DataFrame, column: str):
        """``values`` should be cheap to read: a checkpointed table of longs."""
        wanted = 16 * values.count()
        self.n = min(self.MOST_BITS, 1 << max(16, wanted.bit_length()))
        v = F.col(column)
        slots = values.select(F.explode(F.array(*[F.pmod(x, F.lit(self.n)).cast("int") for x in (v, F.shiftrightunsigned(v, 32))])).alias("s"))
        got = slots.groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1, s & 31))").alias("b")).toArrow()
        bits = np.zeros(self.n // 32, np.uint32)
        bits[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint32)
        self.bits = values.sparkSession.sparkContext.broadcast(bits.tobytes())

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        """Per 64-bit value, whether it may be among the values; for executors."""
        bits = np.frombuffer(self.bits.value, np.uint32)
        values = values.view(np.uint64)
        out = np.ones(len(values), bool)
        for shift in (0, 32):
            slot = values >> np.uint64(shift) & np.uint64(self.n - 1)
            out &= (bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
        return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(src, dst)``; root is the smallest reachable node.

    Large-star and small-star contraction alternate until the edge set stops changing. Each
    step takes a minimum per node (combined map-side) and joins it back, so a hub node is a
    skewed join that Spark splits, never one group in one task. Rounds are cut by checkpoints.
    """
    edges = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    edges = checkpointed(edges.distinct())
    before = _signature(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("m"))
    linked = both.where(F.col("dst") > F.col("src")).join(least, "src")
    return linked.select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    linked = edges.join(least, "src")
    out = linked.select(F.col("dst").alias("src"), F.col("m").alias("dst")).where(F.col("src") != F.col("dst"))
    return out.union(least.select("src", F.col("m").alias("dst"))).distinct()


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is run inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Stored:
    """A frame written as Parquet to the shared folder: smaller than a checkpoint, and removed by hand."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
