"""Every registered query outside the optional subpackage against its oracle SQL, and rows for the rest."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import registry
from tests.plain_references import REFERENCES, Tables

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(row[i]) for i in order]) for row in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir)
    values = [tuple(r) for r in got.collect()]
    if name in SQL:
        want = oracle.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, values) == rows(columns, want.fetchall())
    elif name == "S11_artifact_scan":  # what Spark's writer leaves: three files, and their sizes
        assert [(r[got.columns.index("suffix")], r[got.columns.index("files")]) for r in values] == [("csv", 3)]
    else:
        want = REFERENCES[name](Tables(sf_dir))
        assert want and set(want[0]) <= set(got.columns)
        columns = sorted(want[0])
        mine = sorted(([plain(r[got.columns.index(c)]) for c in columns] for r in values), key=coarse)
        theirs = sorted(([plain(r[c]) for c in columns] for r in want), key=coarse)
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs, strict=True):
            assert same(a, b), (a, b)


def as_number(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def coarse(row):
    """An order that the last digits don't change."""
    return repr([x if (n := as_number(x)) is None else round(n, 3) + 0.0 for x in row])


def same(a, b):
    """Equal, numbers to the sixth place (queries round there)."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, list) or isinstance(b, list):
        return False
    x, y = as_number(a), as_number(b)
    return a == b or (str(a) == str(b) if x is None or y is None else math.isclose(x, y, rel_tol=1e-8, abs_tol=1.1e-6))


def test_every_query_has_a_reference():
    assert set(QUERIES) - set(SQL) - {"S11_artifact_scan"} <= set(REFERENCES)


def test_entry_imports_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "corpusloom.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


#: Its contract is to fail on fewer than 32 texts.
NEEDS_ROWS = {"L14_prefix_split"}


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(f"{folder}/{os.path.basename(path)}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NEEDS_ROWS))
def test_query_on_empty_tables(spark, empty_dir, name):
    QUERIES[name](spark, empty_dir).collect()
