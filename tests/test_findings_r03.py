"""Queries against their SQL on tables that the small ones don't cover: groups beyond a target, odd spaces, markup of a text's own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import registry
from tests.test_queries import rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Checks a query against its SQL over one table of the given rows."""

    def check(query, table, schema, values):
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(values, schema).repartition(3).write.parquet(path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        got = QUERIES[query](spark, str(tmp_path))
        want = con.execute(SQL[query])
        columns = [c[0] for c in want.description]
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
        return got

    return check


#: Every group is more than twice the target of either query.
LARGE = [(i, f"t{i}", "de" if i % 2 else "en", f"s{i % 4}") for i in range(3000)]
DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_mix_keeps_a_first_group_beyond_twice_the_target(same_as_sql):
    got = same_as_sql("D22_ratio_mix", "documents", DOCUMENTS, LARGE)
    assert got.where("kind = 'parent'").count() == 750


def test_mix_takes_rows_without_an_id_last(same_as_sql):
    same_as_sql("D22_ratio_mix", "documents", DOCUMENTS, [*LARGE, *[(None, "x", lang, source) for lang in ("en", "de") for source in ("s1", None)]])


@pytest.mark.parametrize("sizes", [[1000, 1000, 1000], [50, 60, 70, 400, 9], [150, 150, 150]])
def test_prefix_ends_where_the_sql_ends(same_as_sql, sizes):
    names = [None, "a", "", "src1", "b"]
    values = [(i, "t", "en", name) for name, n in zip(names, sizes) for i in range(n)]
    assert same_as_sql("W7_cumulative_prefix", "documents", DOCUMENTS, values).count() > 0


@pytest.mark.parametrize(("groups", "kept"), [([(None, 700)], 1), ([("a", 100), (None, 280)], 2), ([("a", 200), ("b", 200), ("c", 200)], 2)])
def test_prefix_of_a_null_source_alone_or_last_and_of_equal_gaps(same_as_sql, groups, kept):
    values = [(i, "t", "en", name) for name, n in groups for i in range(n)]
    assert same_as_sql("W7_cumulative_prefix", "documents", DOCUMENTS, values).count() == kept


#: Texts that begin without a word, end in odd spaces, hold line ends that no set of the SQL has, or have markup of their own.
ODD = [
    "", " ", "+1 (168) 555", "(a", " a", "\ta\r\n b ", "\n\n", ">b", "é", "1", "_", "a ", "　a  ", "a  \n", "a\n \n", " ", "a  b", "a\fb\vc", "a\x85b",
    "a ", "a\t ", "\x1ca\x1c", "\f", "x﻿", "x​", "/chunk_3> a", "<chunk_3> a", "chunk_3", "chunk_idx = 4", "FINAL translation:b", "Final translation: b", "a Final translation:b",
    "5</parent_chunk_total>", "<parent_chunk_total>5</parent_chunk_total>", "= 4", None,
]


def test_prompt_markup_of_odd_texts(same_as_sql):
    same_as_sql("T12_prompt_markup", "documents", "doc_id long, text string", list(enumerate(ODD)))


def test_markup_operator_is_as_before(spark):
    from corpusloom.functions import text as T

    got = spark.createDataFrame([("a <chunk_3>b c Final translation:d /chunk_4>",)], "t string").select(T.strip_markup(F.col("t"))).first()[0]
    assert got == "a b c d"


def test_parents_keep_the_line_ends_of_their_chunks(same_as_sql):
    turns = [(i // 5, None if i == 7 else i % 5, "user", t) for i, t in enumerate([*ODD, *["one\ntwo \n three\n" * 4] * 5])]
    same_as_sql("A1_parent_reconstruction", "conversations", "conv_id long, turn int, role string, text string", turns)


def test_rule_hits_run_the_rules_once(spark, sf_dir):
    """Each rule stood many times in a filter below the explode, and all of them again for examples that nobody asked for."""
    plan = QUERIES["A9_rule_hits"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Window" not in plan
    assert plan.count("big_gap") <= 2


def test_nfc_of_texts_around_the_first_combining_mark(spark):
    import unicodedata

    from corpusloom.operators import clean

    assert all(unicodedata.is_normalized("NFC", chr(a) + chr(b)) for a in range(0x300) for b in (0x20, 0x41, 0x2B0, 0x2FF))
    texts = ["é", "˿", "̀", "å\n", "Å", "가", "x\n", "", "éʰ", "\U0001d15e", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clean.nfc(F.col("t")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == [unicodedata.normalize("NFC", t or "") for t in texts]
