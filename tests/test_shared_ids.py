"""Queries against their SQL where accounts of one user have equal masked numbers, so that their statements share an id."""

import duckdb
import pytest

from brookledger.plans.oracle import ORACLE_SQL
from brookledger.plans.queries import QUERIES

from test_oracle import SF, plain


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The smallest tables and once more, with customers 10,000 on, of the next bank, whose orders are a day later."""
    path = tmp_path_factory.mktemp("shared-ids")
    con = duckdb.connect()
    banks = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"
    con.execute(f"COPY (FROM '{SF}/customer.parquet' UNION ALL SELECT * REPLACE (c_custkey + 10000 AS c_custkey, {banks}[c_custkey % 5 + 1] AS c_mktsegment) FROM '{SF}/customer.parquet') TO '{path}/customer.parquet'")
    con.execute(f"COPY (FROM '{SF}/orders.parquet' UNION ALL SELECT * REPLACE (o_orderkey + 100000 AS o_orderkey, o_custkey + 10000 AS o_custkey, o_orderdate + INTERVAL 1 DAY AS o_orderdate) FROM '{SF}/orders.parquet') TO '{path}/orders.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ("e13_expanded_periods", "e1_balance_walk", "i11_card_integrity", "j2_promotion_counts"))
def test_statements_that_share_an_id(spark, shared, name):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM '{shared}/{t}.parquet'")
    df = QUERIES[name](spark, shared)
    got = con.execute(ORACLE_SQL[name])
    have = [d[0] for d in got.description]
    rows = got.fetchall()
    assert len(rows) > 1000
    assert plain(tuple(r[c] for c in have) for r in df.collect()) == plain(rows)


@pytest.fixture(scope="module")
def rich(tmp_path_factory):
    """The smallest tables with orders three thousand times as dear, as a user's year has of more orders."""
    path = tmp_path_factory.mktemp("rich")
    con = duckdb.connect()
    con.execute(f"COPY (FROM '{SF}/customer.parquet') TO '{path}/customer.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (o_totalprice * 3000 AS o_totalprice) FROM '{SF}/orders.parquet') TO '{path}/orders.parquet'")
    return str(path)


def test_overdrawn_passbooks_and_statements(spark, rich):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM '{rich}/{t}.parquet'")
    for name in ("k_passbook_rows", "k_passbook_balances", "k_statement_rows"):
        df = QUERIES[name](spark, rich)
        got = con.execute(ORACLE_SQL[name])
        have = [d[0] for d in got.description]
        assert plain(tuple(r[c] for c in have) for r in df.collect()) == plain(got.fetchall()), name
