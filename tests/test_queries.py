"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftgraph.plans import registry, table_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [sorted(names)] + sorted(([r[i] for i in order] for r in map(tuple, rows)), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert table(df.collect(), df.columns) == table(want.fetchall(), want.columns)


def test_every_query_has_columns_of_its_own(spark):
    for name, q in registry.queries().items():
        if name not in registry.oracle_sql():
            df = q(spark, DATA)
            assert len(set(df.columns)) == len(df.columns)


def test_star_is_one_scan(spark):
    plan = registry.queries()["bgp_star"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "PushedFilters" in plan and "BUILDING" in plan


def test_connected_patterns_are_never_multiplied(spark):
    text = "SELECT ?rn ?cn { ?r region:r_name ?rn . ?c customer:c_name ?cn ; customer:c_nationkey ?n . ?n nation:n_regionkey ?r }"
    for name in ("bgp_any_order", "bgp_chain3", "bgp_chain_fact", "values_join", "optional_chain3", "not_exists_filtered"):
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    assert text in table_queries.SPARQL["bgp_any_order"][0]


def test_a_variable_that_may_be_unbound_joins_by_equality(spark):
    q = "SELECT ?c ?o { { ?x customer:c_name ?c OPTIONAL { ?x customer:c_nationkey ?n } } OPTIONAL { ?y nation:n_name ?o ; nation:n_regionkey ?r BIND(?y AS ?n) } }"
    plan = table_queries.sparql(spark, DATA, q)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_flagship_without_the_optional_part(spark):
    assert registry.flagship(spark, DATA).count() == 150
