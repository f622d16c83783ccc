"""Every registered query against its SQL."""

import pytest
from compare import same

from factloom.plans import catalog, evidence

QUERIES, SQL = catalog.QUERIES | evidence.QUERIES, catalog.SQL | evidence.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    same(got, want)
    assert len(want)  # an empty result shows nothing


def test_plans_have_no_product_and_one_scan(spark, sf_dir):
    plan = lambda n: catalog.QUERIES[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for n in ("join_two_hop", "join_value_value", "or_pattern", "not_conjunctive", "tx_metadata_join"):
        assert "Cartesian" not in plan(n), n
    star = plan("star_lineitem")
    assert star.count("FileScan") == 1
    assert "l_comment" not in star and "l_tax" not in star.split("ReadSchema")[1]
    assert "PushedFilters: [IsNotNull" in plan("match_bare")
