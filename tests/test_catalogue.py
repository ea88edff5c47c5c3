"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = "flagship_two_hops out_1hop degree_out has_within hasrank_gt group_by_segment order_by_2 where_count_gt or_ local_limit path_3 repeat_until nearest_filtered bulk_rank_assign".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    found = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([row[names.index(c)] for c in columns]) for row in found.fetchall())
    assert got == want and got


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


WHOLE = "flagship_two_hops_all repeat_times3_emit_all repeat_until_all repeat_emit_if_all".split()


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_same_as_sql(spark, duck, name):
    test_same_as_sql(spark, duck, name)


STORED = "addv adde_arriving property_of_edges drop_edges commit_conflicts read_your_writes schema_ddl nearest_euclidean index_limits bulk_edges_multi bulk_sorted_files not_next e_by_ids_found".split()


@pytest.mark.parametrize("name", STORED)
def test_stored_same_as_sql(spark, duck, name):
    test_same_as_sql(spark, duck, name)


def test_neighbors_of_all_items(spark):
    import collections

    import numpy as np

    rows = [r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None]
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([8 * 10**12 + r.vec_id for r in rows])
    want = collections.Counter()
    for i, s in enumerate(np.round(x @ x.T, 12)):
        s[i] = -2
        want.update(ids[np.lexsort((ids, -s))[:3]].tolist())
    assert collections.Counter(r[0] for r in entry_points.queries()["neighbors_3_all"](spark, FOLDER).collect()) == want
