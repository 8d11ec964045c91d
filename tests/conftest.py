import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from waymark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in sorted(Path(SMALL).glob("*.parquet")):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, SMALL)
        answer = duck.execute(sql)
        names = [d[0] for d in answer.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        ours = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
        theirs = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in answer.fetchall())
        assert ours == theirs

    return check
