"""Catalogs of many models: what must not be broadcast, and must be dealt out and compiled."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from tests.test_odd_matrices import against_sql

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan_of(df, how="formatted"):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), how)


@tables
@pytest.mark.parametrize("name", [*[n for n in entry.queries() if n.startswith("select_")], "resume_remaining", "loader_contract", "validate_structure", "validate_summary", "importance_gate"])
def test_nothing_that_grows_is_broadcast(spark, name):
    assert "Broadcast" not in plan_of(entry.queries()[name](spark, FOLDER), "simple")


@tables
@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("policy_")])
def test_policies_shuffle_models_only_and_are_compiled(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert plan_of(df, "simple").count("Exchange") == 1  # models, before they become tensors
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whose plans show no code
    try:
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan_of(entry.queries()[name](spark, FOLDER), "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000  # the JVM never compiles longer ones


def models(spark, folder, keys):
    spark.createDataFrame([(k, 1 + abs(k or 3) % 50) for k in keys], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")


@pytest.mark.parametrize("name", ["tensor_catalog", "policy_q3_k_xs", "policy_q4_k_m", "select_int8", "resume_remaining", "importance_gate"])
def test_odd_models(spark, tmp_path, name):
    models(spark, tmp_path, (None, -9, -8, -1, 0, 1, 7, 23, 2**40))
    got, want = against_sql(spark, str(tmp_path), name)
    assert got == want and got


@pytest.mark.parametrize("name", ["validate_structure", "validate_summary", "loader_contract"])
def test_outputs_of_distant_models(spark, tmp_path, name):
    models(spark, tmp_path, (0, 1, 7, 23, 2**40, 2**40 + 1))  # formats of made-up outputs go by keys from 0 up
    got, want = against_sql(spark, str(tmp_path), name)
    assert got == want and got
