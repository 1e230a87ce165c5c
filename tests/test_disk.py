"""What exports and snapshots leave on disk and exchange."""

from pyspark.sql import functions as F

from evigraph.operators.graph import EDGE_COLUMNS, EvidenceGraph
from evigraph.session import cut, drop_staged, staged_tables
from evigraph.sinks import exports as K
from evigraph.sinks import snapshots as N


def _graph(spark, nodes, closed):
    kinds = spark.createDataFrame(nodes, "id string, type string")
    ends = [("event_1", "person_1"), ("event_1", "account_1"), ("event_2", "person_1"), (None, "person_1")]
    edges = spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(ends)], "id string, source string, target string")
    rest = {"label": F.lit("MENTIONS"), "confidence": F.lit(90), "anomalous": F.lit(False), "observed_at": F.lit("t"), "epistemic_status": F.lit("observed"),
            **{c: F.array(F.lit("x")) for c in ("evidence_record_ids", "evidence_hashes", "source_types")}}
    return EvidenceGraph(kinds, edges.withColumns(rest).select(*EDGE_COLUMNS), closed)


def test_references_are_read_off_ids_only_where_these_tell_the_kind(spark):
    plain = [("event_1", "event"), ("event_2", "event"), ("person_1", "person"), ("account_1", "account"), (None, "person")]
    rows = lambda g: sorted(tuple(r) for r in K.stix_relations(g, "i", "t").collect())
    joins = lambda g: "Join" in K.stix_relations(g, "i", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert not joins(_graph(spark, plain, True)) and joins(_graph(spark, plain, False))
    assert len(rows(_graph(spark, plain, True))) == 3 and rows(_graph(spark, plain, True)) == rows(_graph(spark, plain, False))
    # one word with two kinds, or an id that stands twice: ends meet the nodes
    for odd in ([*plain, ("event_3", "account")], [*plain, ("person_1", "person")]):
        assert joins(_graph(spark, odd, True)) and rows(_graph(spark, odd, True)) == rows(_graph(spark, odd, False))


def test_a_snapshot_is_written_in_zstd_and_named_staged_tables_stay(spark, tmp_path):
    g = _graph(spark, [("event_1", "event")], True)
    N.save_snapshot(g, spark.range(3), str(tmp_path), "a")
    assert list(tmp_path.rglob("*.zstd.parquet")) and not list(tmp_path.rglob("*.snappy.parquet"))
    before = staged_tables()
    kept = cut(spark.range(4), "kept")
    held = staged_tables()
    cut(spark.range(5), "gone")
    assert drop_staged(spark, held) == 1
    assert staged_tables() == held and len(held) == len(before) + 1 and kept.count() == 4
