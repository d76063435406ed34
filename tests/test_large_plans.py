"""The plans a large cluster would run: automatic broadcasts off, so every
join is a sort-merge join (bucketed where the marts allow) and every
aggregate shuffles.  Results must still equal the oracle (sf0.001)."""

from __future__ import annotations

from conftest import SF001
from marketlens.plans.registry import ORACLE_SQL, QUERIES
from oracle_compare import compare, duck_connect


def test_all_queries_without_auto_broadcast(spark):
    con = duck_connect(SF001)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        failures = []
        for name in sorted(QUERIES):
            res = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF001)
            if not res["ok"]:
                failures.append(res)
        plan = QUERIES["seller_category_benchmark"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not failures, failures
    assert "SortMergeJoin" in plan
