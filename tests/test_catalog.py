"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from lexivar.plans import catalog, recovery, storage  # noqa: F401
from lexivar.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert got == rows(want.columns, want.fetchall())
