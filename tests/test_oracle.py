"""Every query that has an oracle, against DuckDB on the smallest tables; the others run and give rows."""

from __future__ import annotations

import duckdb
import pytest

from prosespark.operators import ledger
from prosespark.plans import oracle
from prosespark.plans import queries as prose

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "events", "conversations")
ORACLE = oracle.oracle_sql()
QUERIES = prose.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else format(v, ".9g") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["l2_invariant_regions", "l3_ledger_entries", "l15_verified", "f1_findings", "i6_authorized_ranges"])
def test_query_without_oracle_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_ledger_is_sound_and_regions_fit_their_bytes(spark):
    docs = prose.seasoned(spark, SF)
    assert ledger.validate(ledger.entries(ledger.regions(docs)), docs).isEmpty()
