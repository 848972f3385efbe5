"""Queries and their SQL on keys beyond six digits and on profiles confirmed at one time."""

import duckdb

from findloom.plans import site_queries, table_queries
from tests.conftest import rows_of, rows_of_sql


def _same(spark, at, tables, query, sql):
    c = duckdb.connect()
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{at}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    have, want = rows_of(query(spark, str(at))), rows_of_sql(c, sql)
    assert have == want and have
    return have


def test_candidates_beyond_six_digits(spark, tmp_path):
    """part 1999000's number keeps its seven digits and is not that of part 199000."""
    parts = [(199000, 7), (1999000, 12), (998999, 12), (999000, 12)]
    lines = [(1, 1999000), (2, 998999), (2, 999000), (3, 199000)]
    tables = {"part": (parts, "p_partkey long, p_size int"), "lineitem": (lines, "l_orderkey long, l_partkey long")}
    got = _same(spark, tmp_path, tables, table_queries.primary_candidate, table_queries.PRIMARY_CANDIDATE)
    assert [r[0] for r in got] == ["CVE-2024-200000", "CVE-2024-2000000", "CVE-2024-999999"]


def test_profiles_of_one_time(spark, tmp_path):
    """revisions of one site and time, all of whose order is by their hash."""
    customers = [(k + 36000 * i,) for k in range(1, 60) for i in range(4)]
    orders = [(k, c) for k in range(1, 60) for c in (0, 20, 340)]
    tables = {"customer": (customers, "c_custkey long"), "orders": ([(k + 100 * i, c) for i, (k, c) in enumerate(orders)], "o_orderkey long, o_custkey long")}
    _same(spark, tmp_path, tables, site_queries.site_profile_lookup, site_queries.SITE_PROFILE_LOOKUP)
