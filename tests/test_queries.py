import pytest

from waymark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, agree):
    agree(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, small):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_the_rest_never_imports_the_training_operators():
    from pathlib import Path

    root = Path(catalogue.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "waymark.llm" not in f.read_text(), f
