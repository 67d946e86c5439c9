import re

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
PAIRS = ("e2_diameter_2d", "e4_diameter_cosine", "e5_near_duplicates", "e6_cannibalization", "e10_knn")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["f15_project_result", "f5_f6_planar_scores", "c1_merge_sitemap_urls", "b9_main_content", "r1_site_brief", "e7_blended_similarity"])
def test_query_matches_sql(spark, name):
    problem, rows = compare(spark, connect(FOLDER), contract.queries()[name], contract.oracle_sql()[name], FOLDER)
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", PAIRS)
def test_no_cartesian_plans(spark, name):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoop", plan)
