"""Hypotheses, identity review, briefing, exports and snapshots on small records."""

import json
import math
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from evigraph import session
from evigraph.functions import rules
from evigraph.operators import graph, hypotheses, metrics, products
from evigraph.plans import catalogue, evidence
from evigraph.session import scratch_path
from evigraph.sinks import exports, snapshots
from evigraph.sources import readers

FIELDS = ("primary_type", "beat", "block", "vehicle_plate")


def incidents(n=60, seed=3):
    rng = random.Random(seed)
    return [{"case_number": f"AA{i:06d}", "suspect_name": rng.choice(["", "Ana Lee", "Bo Lee", "Cy Roe", "Di Roe"]), "primary_type": rng.choice(["THEFT", "ROBBERY", "ARSON"]), "beat": rng.choice(["0101", "0102", "0103"]),
             "block": f"{rng.randrange(8)} <MAIN> & \"ST\"", "vehicle_plate": rng.choice(["", "P1", "P2", "P3"]), "description": "d", "district": "1", "date": f"2025-01-{1 + i % 28:02d} 10:00:00", "arrest": "false", "domestic": "true",
             "location_description": "STREET", "year": "2025", "ward": "1", "community_area": "2", "iucr": "0110", "fbi_code": "01"} for i in range(n)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(list(enumerate(incidents())), "seq bigint, fields map<string,string>").cache()


def brute_leads(rows):
    out = []
    for r in rows:
        for s in {x["suspect_name"] for x in rows} - {"", r["suspect_name"]}:
            own = [x for x in rows if x["suspect_name"] == s]
            m = {f: sum(x[f] == r[f] for x in own) if r[f] else 0 for f in FIELDS}
            m["vehicle_plate"] = min(1, m["vehicle_plate"])
            if sum(v > 0 for v in m.values()) < 2:
                continue
            strength = sum(min(rules.FEATURE_WEIGHTS[f][2], rules.FEATURE_WEIGHTS[f][0] + v * rules.FEATURE_WEIGHTS[f][1]) for f, v in m.items() if v)
            score = min(rules.SCORE_CAP, 1 - math.exp(-rules.SCORE_RATE * strength))
            out.append((round(score, 9), r["case_number"], s, tuple((rules.SIGNAL_NAMES[f], r[f], m[f]) for f in FIELDS if m[f])))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


@pytest.mark.parametrize("k", [5, 1000])
def test_leads_with_their_signals(records, k):
    got = [(round(r["score"], 9), r["case"], r["subject"], tuple((s["feature"], s["value"], s["prior_matches"]) for s in r["said"])) for r in hypotheses.top_hypotheses(records, k).collect()]
    want = brute_leads(incidents())
    assert sorted(got, key=lambda x: (-x[0], x[1], x[2])) == want[:k]
    classes = hypotheses.link_hypotheses(records).agg(F.sum("cases")).first()[0]
    assert classes == len(want)


def test_class_rows_are_neither_staged_nor_exchanged(records, monkeypatch):
    staged, cut = [], hypotheses.cut
    monkeypatch.setattr(hypotheses, "cut", lambda df, tag: staged.append(tag) or cut(df, tag))
    rows = lambda: sorted(hypotheses.link_hypotheses(records).drop("score").collect(), key=str)
    want = rows()
    assert "near" not in staged
    monkeypatch.setattr(hypotheses, "PROFILE", 2)  # most subjects are joined value by value then
    assert rows() == want
    counts = dict.fromkeys(("near", "area"), 0)
    for r in want:
        counts[r["kind"]] += r["cases"]
    leads = brute_leads(incidents())
    near = sum(any(s[0] in (rules.SIGNAL_NAMES["block"], rules.SIGNAL_NAMES["vehicle_plate"]) for s in lead[3]) for lead in leads)
    assert counts == {"near": near, "area": len(leads) - near}


def test_leads_that_share_block_and_plate_are_enough_if_they_beat_all_others(spark, records, monkeypatch):
    near, met = hypotheses._near, []
    monkeypatch.setattr(hypotheses, "_near", lambda rows, counts, pairs: met.append(tuple(pairs)) or near(rows, counts, pairs))
    got = [(round(r["score"], 9), r["case"], r["subject"]) for r in hypotheses.top_hypotheses(records, 5).collect()]
    assert got == [row[:3] for row in brute_leads(incidents())[:5]]
    assert met == [(("block", "vehicle_plate"),)]


def test_identity_review_names_the_other(spark):
    seen = spark.createDataFrame([("Ana Lee", "P1", "x", "here", None), ("Al Lee", "P1", "y", "there", None), ("Abe Lee", "P9", "z", "there", None), ("Zed Roe", "P1", "x", "here", None)],
                                 "name string, identifier string, organization string, place string, ts timestamp")
    got = {r["key"]: (r["identifier_with"], r["recommendation"]) for r in hypotheses.identity_review(seen).collect()}
    assert got == {"ana lee": ("al lee", "escalate"), "al lee": ("ana lee", "escalate"), "abe lee": (None, "keep-separate")}


def test_briefing_says_how_to_read_findings(spark, records):
    g = graph.build_crime_graph(records)
    manifest = spark.createDataFrame([("a", "0" * 64), ("b", None)], "name string, sha256 string")
    rows = {(r["section"], r["item"]): r["value"] for r in products.briefing(g, records, manifest, "2026-01-01").collect()}
    assert rows["graph", "nodes"] == str(g.nodes.count()) and rows["provenance", "verified"] == "1"
    assert rows["quality", "crime-record:records"] == "60" and ("guardrail", "4") in rows
    for finding in ("repeat-subject-network", "beat-concentration", "high-severity-cluster"):
        assert rows["reading", f"{finding}:next-action"] and rows["finding", f"{finding}:1"]
    assert not any("graph-" in item for _, item in rows)


def test_crime_records_have_no_graph_findings_and_read_no_edges(spark, records):
    found = products.graph_findings(graph.build_crime_graph(records), records)
    assert found.count() == 0 and found.dtypes == products.repeat_findings(records).select(found.columns).dtypes
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_graphml_is_xml(spark, records):
    g = graph.build_crime_graph(records).staged()
    path = scratch_path(spark, "graphml-test")
    exports.write_lines(exports.graphml_lines(g), path)
    import glob

    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(path.removeprefix("file:") + "/part-*")))
    root = ET.fromstring(text)
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f".//{space}node")) == g.nodes.count() and len(root.findall(f".//{space}edge")) == g.edges.count()


def test_stix_bundle_and_reports(spark, records, monkeypatch):
    monkeypatch.setattr(exports, "REPORT_REFS", 20)
    g = graph.build_crime_graph(records).staged()
    path = scratch_path(spark, "bundle-test")
    exports.write_lines(exports.stix_bundle_lines(exports.stix_objects(g, "inv", "2026-01-01T00:00:00.000Z"), "00000000-0000-4000-8000-000000000000"), path)
    import glob

    bundle = json.loads("".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(path.removeprefix("file:") + "/part-*"))))
    objects = {o["id"]: o for o in bundle["objects"]}
    reports = {i: o for i, o in objects.items() if o["type"] == "report"}
    named = {i for o in reports.values() for i in o["object_refs"]}
    assert bundle["type"] == "bundle" and named <= objects.keys() and all(o["object_refs"] for o in reports.values())
    top = reports.keys() - named
    assert len(top) == 1 and {i for i, o in objects.items() if o["type"] not in ("report",)} - named == {i for i, o in objects.items() if o.get("identity_class") == "system"}


def test_snapshots_replace_and_drop(spark, records):
    base = scratch_path(spark, "snapshot-test")
    g = graph.build_crime_graph(records)
    snapshots.save_snapshot(g, records, base, "one")
    snapshots.save_snapshot(graph.build_crime_graph(records.filter("seq < 10")), records.filter("seq < 10"), base, "two")
    assert snapshots.load_snapshot(spark, base, "one").nodes.count() == g.nodes.count()
    before = snapshots.load_snapshot(spark, base, "two").nodes.count()
    snapshots.save_snapshot(g, records, base, "two")
    assert before < snapshots.load_snapshot(spark, base, "two").nodes.count() == g.nodes.count()
    snapshots.drop_snapshot(spark, base, "one")
    assert [r[0] for r in snapshots.all_snapshots(spark, base, "nodes").select("investigation_id").distinct().collect()] == ["two"]


def test_a_save_is_one_commit(spark, records, monkeypatch):
    """A writer that fails at any table, or before its commit, changes nothing that a reader sees."""
    base, name = scratch_path(spark, "snapshot-test"), "case 007/äö=1"
    few = records.filter("seq < 10")
    small, large = graph.build_crime_graph(few).staged(), graph.build_crime_graph(records).staged()
    seen = lambda: [snapshots.load_snapshot(spark, base, name).nodes.count(), snapshots.load_snapshot(spark, base, name).edges.count(), snapshots.load_records(spark, base, name).count()]
    assert snapshots.save_snapshot(small, few, base, name) == 1
    before = seen()
    for broken in (graph.EvidenceGraph(large.nodes, large.edges.withColumn("id", F.raise_error(F.lit("lost")).cast("string"))), large):
        rows = records if broken is large else few
        with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
            m.setattr(snapshots, "put_marker", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            snapshots.save_snapshot(broken, rows, base, name)
        assert seen() == before and snapshots.snapshot_versions(spark, base, name) == [1]
    held = snapshots.load_snapshot(spark, base, name)
    assert snapshots.save_snapshot(large, records, base, name) == 2
    assert held.nodes.count() == before[0] and seen()[2] == records.count() and seen()[0] == large.nodes.count()
    assert snapshots.load_snapshot(spark, base, name, number=1).edges.count() == before[1]
    assert snapshots.snapshot_ids(spark, base) == [name] and snapshots.load_snapshot(spark, base, "other", default_id=name).nodes.count() == large.nodes.count()
    assert snapshots.expire_versions(spark, base, name) == 1 and snapshots.snapshot_versions(spark, base, name) == [2]
    folders = [len(session.children(spark, f"{base}/{t}/{snapshots._folder(name)}")) for t in snapshots.TABLES]
    assert folders == [1, 1, 1] and seen()[0] == large.nodes.count()
    snapshots.drop_snapshot(spark, base, name)
    assert not snapshots.snapshot_exists(spark, base, name) and snapshots.all_snapshots(spark, base, "nodes") is None
    with pytest.raises(LookupError):
        snapshots.load_snapshot(spark, base, name)


def test_node_link_documents_by_line(spark):
    path = scratch_path(spark, "node-link-test")
    docs = [json.dumps({"nodes": [{"id": f"n{i}", "label": "x", "type": "t"}], "edges": [{"source": f"n{i}", "target": "n0", "relationship": "R"}]}) for i in range(5)]
    spark.createDataFrame([(d,) for d in docs], "v string").write.text(path)
    g = readers.read_node_link(spark, path, lines=True)
    assert g.nodes.count() == 5 and {r["source"] for r in g.edges.collect()} == {f"n{i}" for i in range(5)}


def test_reports_hold_no_more_references_than_they_may(spark, records, monkeypatch):
    monkeypatch.setattr(exports, "REPORT_REFS", 20)
    g = graph.build_crime_graph(records).staged()
    objects = [json.loads(r["json"]) for r in exports.stix_objects(g, "inv", "2026-01-01T00:00:00.000Z").collect()]
    sizes = [len(o["object_refs"]) for o in objects if o["type"] == "report"]
    body = sum(o["type"] != "report" for o in objects) - 1  # but the system
    leaves = -(-body // 20)
    assert max(sizes) <= 20 and sorted(sizes, reverse=True)[: body // 20] == [20] * (body // 20)
    assert len(sizes) == leaves + -(-leaves // 20) + (leaves > 20)


def test_documents_may_be_packed(spark, records):
    import gzip
    from glob import glob

    path = scratch_path(spark, "graphml-test")
    g = graph.build_crime_graph(records)
    exports.write_lines(exports.graphml_lines(g), path, "gzip")
    files = sorted(glob(path.removeprefix("file:") + "/part-*.gz"))
    root = ET.fromstring("".join(gzip.open(p, "rt", encoding="utf-8").read() for p in files))
    assert len(root.findall(".//{http://graphml.graphdrawing.org/xmlns}edge")) == g.edges.count()


def test_triples_are_a_set_and_only_repeated_cases_are_compared(spark, records, monkeypatch):
    plain = lambda df: [tuple(r) for r in df.collect()]
    once = plain(exports.to_triples(records))
    seen, kept = {}, exports.cut

    def spy(df, tag):
        seen[tag] = kept(df, tag)
        return seen[tag]

    monkeypatch.setattr(exports, "cut", spy)
    few = records.filter("seq < 7")
    arrest = few.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, v: k != "arrest"), F.create_map(F.lit("arrest"), F.lit("maybe"))))
    more = plain(exports.to_triples(records.unionByName(few).unionByName(arrest)))
    assert len(set(once)) == len(once) and len(more) == len(set(more)) and set(once) == set(more)
    assert seen["triple-cases"].count() == few.select(F.col("fields")["case_number"]).distinct().count()


@pytest.mark.parametrize("name", ["k09_replaced_snapshot", "k09_earlier_version"])
def test_a_saved_graph_is_read_back_and_not_built_again(spark, monkeypatch, name):
    built, build = [], graph.build_multisource_graph
    monkeypatch.setattr(graph, "build_multisource_graph", lambda records: built.append(1) or build(records))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() and len(built) == 1


@pytest.mark.parametrize("read", [evidence.event_rows, evidence.incident_rows])
def test_rows_of_a_file_of_one_row_group_are_dealt_out_first(spark, read):
    assert "RepartitionByExpression" in read(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("words", [64, 1])
def test_traces_leave_other_kinds_out_before_the_exchange(spark, monkeypatch, words):
    monkeypatch.setattr(metrics, "ID_WORDS", words)  # with more words than that every end is kept until the join
    names = ["a_1", "a_2", "a:3", "b_1", "b_2", "c", "c_9"]
    ends = [(0, 3), (1, 3), (3, 4), (2, 5), (5, 6), (0, 0), (0, 3)]
    nodes = spark.createDataFrame([(n, n.upper(), "x") for n in names], "id string, name string, type string")
    edges = spark.createDataFrame([(f"e{i}", names[s], names[t], "L", 90, [f"r{i}"], [f"h{i}"], ["S"]) for i, (s, t) in enumerate(ends)],
                                  "id string, source string, target string, label string, confidence int, evidence_record_ids array<string>, evidence_hashes array<string>, source_types array<string>")
    asked = {"a_1", "a:3", "c"}
    ids = nodes.filter(F.col("id").isin(*asked))
    g = graph.EvidenceGraph(nodes, edges, True)
    trace = hypotheses.entity_trace(g, ids)
    want = sorted((names[x], f"e{i}", names[y]) for i, (s, t) in enumerate(ends) for x, y in ((s, t), (t, s)) if names[x] in asked)
    assert sorted((r["id"], r["edge_id"], r["nbr"]) for r in trace.collect()) == want
    assert ("StartsWith(" in trace._jdf.queryExecution().optimizedPlan().toString()) == (words == 64)
    for multi in (True, False):
        every = [tuple(r) for r in metrics.adjacency(g, multi).collect() if r["node"] in asked]
        assert sorted(tuple(r) for r in metrics.adjacency(g, multi, ids).collect()) == sorted(every)


def test_crime_edges_without_repeats(records):
    rows = lambda **extra: sorted((str(r) for r in graph.build_crime_graph(records, **extra).edges.drop("anomalous").collect()))
    assert rows(repeats=False) == rows()
    assert not graph.build_crime_graph(records, repeats=False).edges.filter("anomalous IS NOT NULL").count()
