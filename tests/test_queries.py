import pytest
from flowmill import queries
from flowmill.plans import report

from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got, want = oracle.both(spark, db, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_whole_table_queries_reach_whole_tables(spark):
    customers = queries.read(spark, SF, "customer")
    assert queries.QUERIES["upsert_update_whole"](spark, SF).count() == customers.count()
    changed = customers.where("c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')").count()
    assert queries.QUERIES["verify_diff_whole"](spark, SF).count() == changed


def test_plan_report_counts_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    plan = queries.planned(spark, queries.document(sf, queries._RATES))
    assert all(r["sampled"] == queries.read(spark, sf, "orders").count() for r in report.build(plan)["pipelines"]["q"]["checks"])
