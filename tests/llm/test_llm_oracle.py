import __spark_entry__ as entry
import oracle
import pytest
from conftest import TESTDATA
from gapline.llm import queries

SF_DIR = f"{TESTDATA}/sf0.001"


def test_all_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.queries()) <= names and set(queries.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    df = queries.queries()[name](spark, SF_DIR)
    assert oracle.compare(df, oracle.connect(SF_DIR), queries.oracle_sql()[name]) is None
