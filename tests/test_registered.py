"""Every registered query against its SQL, on the whole given tables."""

from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__
from suite import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    with connect(sf_dir) as c:
        yield c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, sf_dir, name):
    assert difference(spark, connection, QUERIES[name], sf_dir) is None


def test_entry_returns_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["n_name", "raca", "n_customers", "n_orders", "cents"]
    assert df.count() > 0


def test_every_query_has_sql():
    own = set(QUERIES)
    assert own <= set(__spark_entry__.oracle_sql()) and own <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__spark_entry__.__file__).parent
    others = [*(root / "veladura").rglob("*.py"), *(root / "suite").rglob("*.py"), root / "bench.py"]
    for path in others:
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
