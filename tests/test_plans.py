"""Plan shape: scans read only the columns a query needs, and filters reach the scan."""

import re

from tidewatch.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_scan_prunes_columns(spark):
    plan = _plan(QUERIES["n3_create_signature"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    part = [s for s in schemas if "p_partkey" in s]
    assert part and all("p_retailprice" not in s for s in part), schemas


def test_filters_are_pushed_to_the_scan(spark):
    plan = _plan(QUERIES["t4_delete_application"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_returnflag,R\)", plan), plan
