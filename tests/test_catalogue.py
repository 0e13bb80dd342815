"""Every catalogued query against DuckDB on the same tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import compare, connect  # noqa: E402

from tidemark import catalogue  # noqa: E402

SF = "/root/testdata/sf0.01"  # where every rule has a row, unlike in the smallest tables


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    assert compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], SF, duck) == ""


def test_entry_imports_without_a_session():
    """A driver reads the names of all queries before there is any session."""
    import subprocess

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
