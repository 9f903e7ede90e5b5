"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from brookledger.plans import desk
from brookledger.plans.oracle import ORACLE_SQL
from brookledger.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SOME = ("d1_monthly_summary", "d4_budget_usage", "e1_balance_walk", "e3_directions", "m12_checklist", "e5_net_worth", "c10_duplicates", "c13_sms_statement_match", "g1_fingerprints", "m4_ais_buckets", "l13_itr_form", "h13_search")


def plain(rows):
    return sorted((tuple("null" if v is None else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", (*SOME, *(n for n in desk.NAMES if n in ORACLE_SQL)))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(ORACLE_SQL[name])
    have = [d[0] for d in got.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in got.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
