import re

import __spark_entry__ as entry
import oracle
import pytest
from conftest import TESTDATA

SF_DIR = f"{TESTDATA}/sf0.01"
# Trained models have no SQL counterpart; test_model.py looks at them.
WITHOUT_SQL = {"train_cv", "forecast_batch", "model_scores", "demo_run"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def of_the_engine(names):
    """Without the queries of a subpackage that may be left out, which has tests of its own."""
    return {n for n in names if not re.match(r"op\d+_|pipeline$", n)}


def test_every_query_has_sql_or_a_reason():
    assert of_the_engine(entry.queries()) - set(entry.oracle_sql()) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(of_the_engine(entry.oracle_sql())))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert oracle.compare(df, con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 691
