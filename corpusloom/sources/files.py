"""Sources and sinks: delimited, JSON and binary files, resumable appends, manifests, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """RFC-style CSV or TSV with a header; quoted line breaks stay in their field.

    A file is read in splits unless a field of it holds a line break. That shows in lines with an odd number of quotes, which
    a first pass counts; only files that have one are read whole, each by one task.
    """
    lines = spark.read.text(path)
    odd = lines.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    plain = lambda uri: unquote(uri).replace(":///", ":/")  # noqa: E731  (no authority)
    broken = sorted(plain(r[0]) for r in odd.select("_metadata.file_path").distinct().collect())
    read = lambda at, whole: spark.read.schema(schema).csv(at, header=True, sep=sep, multiLine=whole, quote='"', escape='"')
    if not broken:
        return read(path, False)
    rest = sorted({plain(f) for f in lines.inputFiles()} - set(broken))
    return read(rest, False).unionByName(read(broken, True)) if rest else read(path, True)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


#: Names under which source, target and id columns are known.
SYNONYMS = {
    "source": ["source", "transliteration", "akkadian", "input_text", "text"],
    "target": ["target", "translation", "english", "output_text"],
    "id": ["oare_id", "id", "text_id", "doc_id"],
}


def detect_column(df: DataFrame, role: str) -> str:
    """The first column known under the role, in any case."""
    by_name = {c.lower(): c for c in df.columns}
    for name in SYNONYMS[role]:
        if name in by_name:
            return by_name[name]
    raise ValueError(f"no {role} column among {df.columns}")


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: Sequence[str]) -> None:
    """Appends the rows whose key isn't at ``path`` yet; what is there already is done."""
    if path_exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(*key), list(key), "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(path)


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that comes last."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def list_files(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, content]) of all files below ``path`` that match."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found if content else found.drop("content")


def expand_paths(spark: SparkSession, specs: Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """Files named by globs, folders or prefixes, each once."""
    found = None
    for spec in specs:
        one = list_files(spark, spec, pattern).select("path")
        found = one if found is None else found.union(one)
    return found.distinct()


def latest(files: DataFrame) -> DataFrame:
    """The newest file; of equally new ones the last by path."""
    return files.agg(F.max(F.struct("modificationTime", "path", "length")).alias("f")).select("f.path", "f.modificationTime", "f.length")


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """(path, checkpoint, number): the folder checkpoint-N with the highest N that holds a file."""
    name = F.regexp_extract("path", r"/(checkpoint-(\d+))/", 1)
    named = files.select(F.regexp_extract("path", r"^(.*/checkpoint-\d+)/", 1).alias("path"), name.alias("checkpoint"), F.regexp_extract("path", r"/checkpoint-(\d+)/", 1).alias("n"))
    return named.where("n <> ''").agg(F.max(F.struct(F.col("n").cast("long").alias("number"), "path", "checkpoint")).alias("f")).select("f.path", "f.checkpoint", "f.number")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of each file."""
    files = list_files(spark, path, pattern, content=True)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def markdown_table(rows: DataFrame, fields: Sequence[str]) -> str:
    """A report table of all rows, in their order; they are fetched a partition at a time."""
    lines = ["| " + " | ".join(fields) + " |", "|" + " --- |" * len(fields)]
    lines += ["| " + " | ".join(str(r[f]) for f in fields) + " |" for r in rows.select(*fields).toLocalIterator()]
    return "\n".join(lines)


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document (a summary or a status record), through Spark so that any store works."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def submission(sample: DataFrame, predictions: DataFrame, key: str = "id", strict: bool = True) -> DataFrame:
    """The sample's ids, in its rows, with their predictions; ``strict`` fails if one is missing."""
    if strict and (missing := sample.join(predictions, key, "left_anti").select(key).take(5)):
        raise ValueError(f"ids without a prediction: {[r[0] for r in missing]}")
    return sample.select(key).join(predictions, key, "left")
