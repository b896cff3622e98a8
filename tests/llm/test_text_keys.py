"""Text queries beyond the size at which keys are broadcast give the same rows."""

from quire.llm import queries as Q
from quire.operators import keys


def test_results_do_not_hang_on_the_broadcast_bound(spark, folder, monkeypatch):
    rows = lambda df: sorted(map(str, df.collect()))
    broadcast = [rows(q(spark, folder)) for q in (Q.p1_found, Q.p2_found, Q.p4_found)]
    monkeypatch.setattr(keys, "BROADCAST_KEYS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [rows(q(spark, folder)) for q in (Q.p1_found, Q.p2_found, Q.p4_found)] == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
