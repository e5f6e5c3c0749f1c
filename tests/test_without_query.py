"""Searches of tables without any query: no rows, as their SQL says."""

import pytest
from pyspark.sql import functions as F

from humsearch.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["match_costs", "match_costs_by_columns", "search_matches", "vector_distances"])
def test_no_rows(spark, sf_dir, tmp_path, name):
    for table, key in (("events", "user_id"), ("embeddings", "vec_id"), ("customer", "c_custkey"), ("nation", "n_nationkey")):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.where(F.col(key) % 100 != 0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
