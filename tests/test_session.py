"""Broadcasts on estimates, and files of exchanges."""

import os

from pyspark.sql import functions as F

from evigraph.session import ESTIMATED_BROADCAST, cut, tune


def test_a_table_is_not_broadcast_because_its_files_are_small(spark):
    rows = cut(spark.range(100_000).withColumn("name", F.sha2(F.col("id").cast("string"), 256)).select("id", "name", F.lit(0).alias("n")), "rows")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(rows.join(rows.select("id", F.col("name").alias("other")), "id"))
    # what is marked, or small by any measure, still is
    assert "BroadcastHashJoin" in plan(rows.join(F.broadcast(rows.select("id")), "id"))
    assert "BroadcastHashJoin" in plan(rows.join(cut(spark.range(10), "few"), "id"))


def test_limits_of_the_session_are_kept(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tune(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2m")
        tune(tune(spark))
        assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) == ESTIMATED_BROADCAST
        assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")) == 2 << 20
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_files_of_an_exchange_go_with_their_job(spark):
    tune(spark)
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    held = lambda: sum(f.startswith("shuffle_") for d in folders for _, _, names in os.walk(d) for f in names)
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    before = held()
    assert cut(df, "counted").count() == 7
    assert held() <= before
    assert sorted(r["count"] for r in df.collect()) == sorted(r["count"] for r in df.collect())  # a second action makes them anew


def test_case_neighbours_counts_every_edge_of_a_person_and_an_event(spark):
    from evigraph.operators.graph import EvidenceGraph
    from evigraph.operators.metrics import case_neighbours

    nodes = spark.createDataFrame([("person_a", "person"), ("person_b", "person"), ("case_1", "event"), ("case_2", "event"), ("beat_1", "location"), (None, "event")], "id string, type string")
    edges = spark.createDataFrame([("case_1", "person_a"), ("person_a", "case_1"), ("case_2", "person_a"), ("case_2", "person_b"), ("person_a", "person_b"), ("case_1", "beat_1"),
                                   ("case_9", "person_b"), (None, "person_b"), ("person_a", "person_a")], "source string, target string")
    for closed in (False, True):
        got = case_neighbours(EvidenceGraph(nodes, edges, closed))
        assert {tuple(r) for r in got.collect()} == {("person_a", 3), ("person_b", 1)} and got.columns == ["id", "case_neighbours"]
    widest = max((len(x.split(",")) for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x), default=0)
    assert widest  # ids meet the counts last, edges are joined by key
    assert "source" not in got._jdf.queryExecution().optimizedPlan().toString()
