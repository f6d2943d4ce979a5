"""The registry: every query with SQL agrees with it on the small tables (a quick choice here)."""

import os

import pytest

from kinmesh.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["p6_found", "p6_key_stats", "coauthor_lists", "consolidate_mode", "precision_recall_ids", "canonical_counts", "sequential_cluster_ids", "tfidf_cosine", "connected_components", "legal_ids"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    got = registry.QUERIES[name](spark, DATA)
    res = con.execute(registry.ORACLE[name])
    cols = [c[0] for c in res.description]
    norm = lambda rs: sorted(str([round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v for v in r]) for r in rs)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(res.fetchall())


def test_names_are_unique():
    assert set(registry.ORACLE) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
