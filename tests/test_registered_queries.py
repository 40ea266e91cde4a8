"""Every registered query against its SQL check on the smallest tables, and checks of the plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from workloads import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")

DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
NARROW = ("x1_x6_project_mapping", "x2_chain_mapping", "a1_a2_file_names", "g4_g5_confidence", "s2_session_scan", "j2_owner_names")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_check():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF_DIR)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(registry.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    want = check.rows_of(list(types), result.fetchall())
    assert got == want
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    plan = plan_of(df)
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, f"{node} in the plan of {name}"


def test_entry(spark):
    df = entry.entry(spark)
    assert [t for _, t in df.dtypes] == ["string", "string", "date", "double", "string"] and df.count() == 1500


def test_flagship_is_one_narrow_stage(spark):
    plan = plan_of(entry.queries()["x1_x6_project_mapping"](spark, SF_DIR))
    assert "Exchange" not in plan and "o_orderpriority" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["l1_session_list_one_user"](spark, SF_DIR))
    assert "42" in plan and "o_totalprice" not in plan
    plan = plan_of(entry.queries()["s2_session_scan"](spark, SF_DIR))
    assert "o_orderstatus" not in plan


def test_file_work_does_not_shuffle(spark):
    """Past the spreading of a small unsplit input, file operators are narrow."""
    for name in ("a9_header_columns", "a13_file_statistics", "c3_c4_reduce_all_levels", "s5_delimited_scan"):
        plan = plan_of(entry.queries()[name](spark, SF_DIR))
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan, name


@pytest.mark.parametrize(
    "name,scans,exchanges,sorts",
    [("m8_coverage", 10, 10, 4), ("e1_e5_all_edits", 4, 6, 0), ("j6_share_suggestions", 3, 3, 2), ("w2_patch_sessions", 5, 5, 0)],
)
def test_plans_stay_small(spark, name, scans, exchanges, sorts):
    """Scans, hash exchanges and sort aggregates before adaptive execution."""
    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    assert plan.count("Scan parquet") <= scans and plan.count("Exchange hashpartitioning") <= exchanges and plan.count("SortAggregate") <= sorts


def test_bulk_lookups_join_on_keys(spark):
    for name in ("a12_bulk_search", "l4_known_users_bulk", "m2_spelling_and_order"):
        plan = plan_of(registry.queries()[name](spark, SF_DIR))
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan, name


def test_the_listing_of_all_users_is_in_order(spark):
    rows = [(r["user_id"], r["updated_at"]) for r in registry.queries()["l1_session_list"](spark, SF_DIR).collect()]
    assert all(a[0] < b[0] or (a[0] == b[0] and a[1] >= b[1]) for a, b in zip(rows, rows[1:]))
