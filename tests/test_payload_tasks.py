"""Results are made in as many tasks as the session has parts, however few bytes their orders are."""

from findloom.plans import run_queries
from tests.conftest import DATA


def test_results_are_many_tasks(spark):
    assert run_queries._payloads(spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
