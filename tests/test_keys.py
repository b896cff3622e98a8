"""Joins beyond the size at which keys are broadcast give the same rows."""

from quire.operators import keys
from quire.plans import document_queries as D
from quire.plans import problem_queries as P


def test_results_do_not_hang_on_the_broadcast_bound(spark, folder, monkeypatch):
    rows = lambda df: sorted(map(str, df.collect()))
    queries = (P.p5_found, D.keyword_search, D.document_sections)
    broadcast = [rows(q(spark, folder)) for q in queries]
    monkeypatch.setattr(keys, "BROADCAST_KEYS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in keys.sized(spark.range(3)).join(spark.range(9), "id")._jdf.queryExecution().executedPlan().toString()
        assert [rows(q(spark, folder)) for q in queries] == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
