"""Every reference query against its SQL, on the smallest of the driver's tables."""

import math
import os

import pytest

from corvane.plans import registry

SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    found = registry.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    left = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    right = sorted(tuple(norm(r[columns.index(c)]) for c in order) for r in want)
    assert left == right


def test_entry_names_every_query():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_data_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, dirs, names in os.walk(os.path.join(root, "corvane")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for n in names:
            if n.endswith(".py"):
                assert "corvane.llm" not in open(os.path.join(folder, n)).read(), n
