"""Every query with a SQL twin against DuckDB on the driver's small tables, and the schema of the rest."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for f in os.listdir(SF):
        own.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return own


def key(row):
    return tuple("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    done = con.execute(ORACLES[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-5)), (a, b)


#: Queries without SQL that take a minute or so: their operators are tested against brute force elsewhere.
LONG = {
    "base_evaluation", "bootstrap_by_k", "bootstrap_jaccard", "bootstrap_runs", "bootstrap_stability", "consensus_deltas", "consensus_labels_whole", "consensus_search", "consensus_vs_best_base", "dbscan_choice", "gap_statistic",
    "hopkins_500", "hopkins_by_scaler", "kmeans_best_of_seeds", "kmeans_grid", "kmeans_labels_converged", "kmeans_search_converged", "mst_total_weight_all", "preprocessing_measures", "preprocessing_sensitivity", "repeated_hopkins_summary",
    "umap_trustworthiness", "unified_portfolio", "winner_refit", "permutation_importance",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_query_without_sql_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert all(any(r[c] is not None for c in df.columns) for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_the_drift_report(spark):
    assert entry.entry(spark).columns[:2] == ["feature", "psi"]
