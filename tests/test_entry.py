"""Every registered query runs, and each with SQL agrees with it: exact columns to the letter, floats to 12 digits, NaN apart from null."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def cell(v):
    """A value as the driver sees it: (kind, text for exact ones, number for floats)."""
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if type(v).__name__ == "Decimal":
        return float(v)
    return str(v)[:10] if hasattr(v, "isoformat") and str(v)[11:] in ("", "00:00:00") else str(v)


def order(row):
    return [(0, "") if v is None else (1, f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else (2, str(v)) for v in row]


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) and not isinstance(b, bool):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return type(a) is type(b) and a == b


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got, cols = df.collect(), sorted(df.columns)
    if name in entry.oracle_sql():
        r = duck.execute(entry.oracle_sql()[name])
        theirs = [c[0] for c in r.description]
        assert sorted(theirs) == cols
        at = [theirs.index(c) for c in cols]
        want = sorted(([cell(x[i]) for i in at] for x in r.fetchall()), key=order)
        have = sorted(([cell(x[c]) for c in cols] for x in got), key=order)
        assert len(have) == len(want)
        wrong = [(a, b) for a, b in zip(have, want) if not all(map(same, a, b))]
        assert not wrong, (len(wrong), cols, wrong[:3])
