import importlib
import os

import pytest

SF = "/root/testdata/sf0.001"


def test_contract():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "call_matcher", "rule_scan", "resolution_stats", "scan_compose", "reachable", "vdg_flows"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    rows = entry.queries()[name](spark, SF)
    got = rows.select(*sorted(rows.columns)).collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) >= 0
        return
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'" if os.path.isfile(f"{SF}/{f}") else f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}/*.parquet'")
    want = c.sql(sql)
    order = [want.columns.index(x) for x in sorted(want.columns)]
    clean = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, (clean(r) for r in got))) == sorted(map(repr, (clean([r[i] for i in order]) for r in want.fetchall())))
