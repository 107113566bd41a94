"""Plans: what reaches the Parquet reader."""

import re

import pytest

from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, column", [("s2", "o_totalprice"), ("s2", "o_orderstatus"), ("s4", "o_orderdate"), ("s4", "o_orderstatus"), ("filter_range_in_notnull", "p_size"), ("filter_in_join_condition", "c_acctbal")])
def test_filters_reach_the_reader(spark, name, column):
    assert re.search(rf"PushedFilters: .*\({column},", plan(spark, name))


def test_scans_read_what_is_needed(spark):
    assert re.search(r"ReadSchema: struct<c_custkey:bigint,c_acctbal:double>|ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>", plan(spark, "filter_in_join_condition"))
    assert "o_orderpriority" not in plan(spark, "join_semi")
