"""CSV in splits, reports, streams with late rows, and the SQL surface."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import sql
from corpusloom.operators import chunk, overlap
from corpusloom.sources import files
from corpusloom.streaming import events


@pytest.fixture
def folder(spark):
    return files.scratch(spark, "test")


def same(spark, folder, rows, parts=1):
    files.write_csv(spark.createDataFrame(rows, "i long, t string").repartition(parts), folder)
    got = files.read_csv(spark, folder, "i long, t string")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    return got


def test_quoted_breaks_stay_in_their_field(spark, folder):
    rows = [(1, 'a\nb "q" c'), (2, "x,y"), (3, '"'), (4, '""\r\n,"'), (5, "\r"), (6, 'ä"')]
    same(spark, folder, rows)


def test_only_files_with_breaks_are_read_whole(spark, folder):
    rows = [(i, f'row "{i}"') for i in range(40)] + [(99, "two\nlines")]
    got = same(spark, folder, rows, parts=6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_a_large_file_without_breaks_is_many_tasks(spark, folder):
    frame = spark.range(60_000).selectExpr("id AS i", "concat('a \"b\", ', id) AS t").coalesce(1)
    files.write_csv(frame, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_csv(spark, folder, "i long, t string")
        assert got.rdd.getNumPartitions() >= 5
        assert got.agg(F.count("*"), F.sum("i"), F.count_distinct("t")).first() == (60_000, 60_000 * 59_999 // 2, 60_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_with_spaces_in_its_path(spark, folder):
    same(spark, folder + "/with space", [(1, "a\nb"), (2, "c")], parts=2)


def test_reports_have_all_rows(spark):
    lines = files.markdown_table(spark.range(2_500).selectExpr("id", "id * 2 AS n").orderBy("id"), ["id", "n"]).split("\n")
    assert len(lines) == 2_502 and lines[-1] == "| 2499 | 4998 |"


# -- streams -------------------------------------------------------------------------------


START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def arriving(spark, folder, batches):
    """A stream of one file a batch, in this order."""
    for i, rows in enumerate(batches):
        times = [(k, n, START + datetime.timedelta(minutes=m)) for k, n, m in rows]
        spark.createDataFrame(times, "key string, n long, ts timestamp").coalesce(1).write.parquet(f"{folder}/in/b{i:02d}")
        files_of = spark.read.format("binaryFile").load(f"{folder}/in/b{i:02d}")
        assert files_of.count() >= 1
    schema = "key string, n long, ts timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_first_rows_agree_with_the_batch_where_rows_are_late(spark, folder):
    """Out of order within the lateness allowed; a row too late for it changes nothing."""
    rng = random.Random(3)
    batches = [[(rng.choice("abcdef"), 100 * b + i, 30 * b + rng.randint(-80, 20)) for i in range(12)] for b in range(6)]
    stream = events.first_of_key(arriving(spark, folder, batches), "key", "n", late_minutes=120)
    got = events.run_changes(stream, f"{folder}/out", f"{folder}/state", ["key"])
    first = {}
    for k, n, m in (r for b in batches for r in b):
        first[k] = min(first.get(k, (m, n)), (m, n))
    assert {r.key: r.n for r in got.collect()} == {k: n for k, (_, n) in first.items()}


def test_first_rows_are_settled_by_their_timer(spark, folder):
    batches = [[("a", 1, 0), ("b", 2, 0)], [("b", 3, 600)], [("b", 4, 605)], [("a", 5, -600), ("a", 6, 610), ("c", 7, 611)]]
    stream = events.first_of_key(arriving(spark, folder, batches), "key", "n", late_minutes=60)
    got = events.run_changes(stream, f"{folder}/out", f"{folder}/state", ["key"])
    assert {r.key: r.n for r in got.collect()} == {"a": 1, "b": 2, "c": 7}


def test_sliding_windows_of_late_rows(spark, folder):
    batches = [[("a", i, 10 * i) for i in range(6)], [("a", 9, 5), ("b", 8, 61)], [("a", 7, 44)]]
    stream = arriving(spark, folder, batches).select(F.col("key").alias("event_type"), F.col("n").cast("double").alias("value"), "ts")
    got = events.run_changes(events.sliding(stream, "60 minutes", "30 minutes"), f"{folder}/out", f"{folder}/state", ["window_start", "event_type"])
    want = {}
    for k, n, m in (r for b in batches for r in b):
        for s in range(-30, 90, 30):
            if s <= m < s + 60:
                c, t = want.get((s, k), (0, 0))
                want[s, k] = c + 1, t + n
    naive = START.replace(tzinfo=None)
    assert {((r.window_start - naive).total_seconds() / 60, r.event_type): (r.n, r.total) for r in got.collect()} == want


def test_sessions_of_late_rows(spark, folder):
    """Late rows that lengthen a session, start it earlier, or join two."""
    rng = random.Random(9)
    batches = [[(rng.choice("abc"), 0, 40 * b + rng.randint(-90, 60)) for _ in range(7)] for b in range(6)]
    batches += [[("d", 0, 300), ("d", 0, 350)], [("d", 0, 325)], [("d", 0, 290)]]
    stream = events.sessions(arriving(spark, folder, batches).select("key", "ts"), "key", 30, 600)
    got = events.run_changes(stream, f"{folder}/out", f"{folder}/state", ["key", "session_start"]).where("n > 0")
    want = {}
    for key in "abcd":
        times = sorted(m for b in batches for k, _, m in b if k == key)
        start = None
        for before, t in zip([None, *times], times):
            start = t if before is None or t - before > 30 else start
            want[key, start] = want.get((key, start), 0) + 1
    naive = START.replace(tzinfo=None)
    assert {(r.key, (r.session_start - naive).total_seconds() / 60): r.n for r in got.collect()} == want


def test_state_of_sessions_is_dropped_by_timers(spark, folder):
    batches = [[("a", 0, 0)], [("b", 0, 1000)], [("b", 0, 1001)], [("a", 0, 1002)]]
    stream = events.sessions(arriving(spark, folder, batches).select("key", "ts"), "key", 30, 60)
    got = events.run_changes(stream, f"{folder}/out", f"{folder}/state", ["key", "session_start"])
    assert sorted((r.key, r.n) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 2)]


def test_texts_on_a_stream_against_a_table(spark, folder):
    for i, texts in enumerate((["a", " b ", "c"], ["b", "d", None])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{folder}/in/b{i}")
    reference = spark.createDataFrame([("b",), (" c",)], "text string")
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    events.append_files(events.new_texts(stream, reference), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = [r[0] for r in spark.read.schema("text string").parquet(f"{folder}/out").collect()]
    batch = [r[0] for r in overlap.without_overlap(spark.read.schema("text string").parquet(f"{folder}/in/*"), reference).collect()]
    assert sorted(got, key=str) == sorted(batch, key=str) and "a" in got and "d" in got


# -- SQL -----------------------------------------------------------------------------------

ODD = ["", None, " a  b\t\nc ", "< gap >{ d }​x", "um-ma 5 ma-na", "it's 'q' \\ \"r\"", "[x] ₀₂ x", "Seal of a Seal of a Seal of a Seal of a x y z w", "a b a b a b a b", "<big_gap> gap> ... xx"]


def test_sql_functions_are_those_of_columns(spark):
    sql.register(spark)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, t string")
    frame.createOrReplaceTempView("odd")
    for name, (fn, arguments, kind) in sql.EXPRESSIONS.items():
        names = ["t"] * len(arguments.split(","))
        want = {r[0]: r[1] for r in frame.select("i", fn(*[F.col(c) for c in names])).collect()}
        got = spark.sql(f"SELECT i, {name}({', '.join(names)}) AS x FROM odd")
        assert got.dtypes[1][1].upper() == kind
        assert {r[0]: r[1] for r in got.collect()} == want
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for name, fn in sql.SEQUENTIAL.items():
        got = {r[0]: r[1] for r in spark.sql(f"SELECT i, {name}(t) AS x FROM odd").collect()}
        assert got == {i: None if t is None else fn(t) for i, t in enumerate(ODD)}


def test_chunk_table_function_is_the_operator(spark):
    sql.register(spark)
    long = " ".join(f"w{i}" for i in range(400))
    pairs = spark.createDataFrame([(1, "a", "b"), (2, long, long), (3, None, "x"), (4, "", "")], "id long, source string, target string").repartition(2)
    pairs.createOrReplaceTempView("pairs_of_test")
    got = spark.sql("SELECT * FROM chunk_pairs(TABLE(SELECT id, source, target FROM pairs_of_test))").collect()
    want = chunk.chunk_pairs(pairs, "id").collect()
    assert sorted((r.key, r.chunk_index, r.chunk_total, r["mode"], r.source, r.target) for r in got) == sorted((r.parent, r.chunk_index, r.chunk_total, r.chunk_mode, r.source, r.target) for r in want)
    assert len(got) > 4
