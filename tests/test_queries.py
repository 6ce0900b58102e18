import duckdb
import pytest

from noteweave.plans import registry


@pytest.fixture(scope="module")
def db(sf):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=_key)
    rel = db.sql(registry.oracle_sql()[name])
    order = [rel.columns.index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    assert sorted(rel.columns) == names
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(_same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def _plain(v):
    """Decimals as floats, lists as tuples; everything else as it is."""
    from decimal import Decimal

    return float(v) if isinstance(v, Decimal) else tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def _key(row):
    """An order of rows that rounding does not disturb."""
    return tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def _same(x, y) -> bool:
    """Equal, numbers but for rounding; texts must be the same."""
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    if number(x) and number(y):
        return x == y or abs(x - y) <= 1e-6 * max(1.0, abs(x), abs(y))
    return x == y


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, sf, name):
    rows = registry.queries()[name](spark, sf).collect()
    assert rows and all(v is not None for v in [any(c is not None for c in r) for r in rows])
