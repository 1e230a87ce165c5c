"""Own multi-channel fixture, window counting against brute force, integrity, guards and masking."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions import scalars as S
from evigraph.operators import features, graph, integrity, patterns
from evigraph.operators.ranking import numbered
from evigraph.sources import readers


def at(day, hour, minute):
    return f"2025-03-{day:02d}T{hour:02d}:{minute:02d}:00"


RECORDS = [
    {"call_id": "CALL-1", "timestamp": at(1, 9, 0), "record_type": "call", "caller_name": "Mira Sol", "caller_number": "700", "callee_number": "701", "tower_location": "Dock 4"},
    {"call_id": "CALL-2", "timestamp": at(1, 9, 20), "record_type": "call", "caller_name": "Omar Quist", "caller_number": "701", "callee_number": "700", "tower_location": "Hill"},
    {"call_id": "CALL-3", "timestamp": at(2, 9, 20), "record_type": "call", "caller_name": "M. Sol", "caller_number": "702", "callee_number": "702", "tower_location": "Hill"},
    {"transaction_id": "TX-1", "timestamp": at(2, 10, 0), "record_type": "transfer", "sender_name": "Mira Sol", "source_account": "A", "destination_account": "B", "amount": "INR 150,000"},
    {"transaction_id": "TX-2", "timestamp": at(2, 10, 30), "record_type": "transfer", "sender_name": "Mira Sol", "source_account": "A", "destination_account": "B", "amount": "90,000"},
    {"transaction_id": "TX-3", "timestamp": at(2, 10, 45), "record_type": "transfer", "sender_name": "Mira Sol", "source_account": "A", "destination_account": "B", "amount": "2,000,000"},
    {"transaction_id": "TX-4", "timestamp": at(3, 8, 0), "record_type": "transfer", "sender_name": "Omar Quist", "source_account": "B", "destination_account": "C", "amount": "10"},
    {"transaction_id": "TX-5", "timestamp": at(3, 9, 0), "record_type": "transfer", "source_account": "C", "destination_account": "A", "amount": "oops"},
    {"record_id": "ANPR-1", "timestamp": at(4, 12, 0), "record_type": "plate read", "vehicle_plate": "KX 1", "location": "Dock gate", "person_name": "mira sol"},
    {"record_id": "SURV-1", "timestamp": at(4, 12, 10), "record_type": "note", "subject": "Mira Sol", "location": "dock yard", "organization": "Gull Freight"},
    {"post_id": "OSINT-1", "timestamp": at(4, 12, 25), "record_type": "post", "subject": "Unknown", "location": "Dock", "signal": "suspicious fraud weapon threat"},
    {"record_id": "FIR-1", "timestamp": at(5, 7, 0), "record_type": "report", "protected_person_id": "PP-9", "location": "Hill", "organization": "Gull Freight"},
    {"record_id": "FIR-2", "timestamp": "not a time", "record_type": "report", "suspect_name": " Mira   Sol ", "location": "Hill"},
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(list(enumerate(RECORDS)), "seq bigint, fields map<string,string>").cache()


def test_graph_counts_and_provenance(records):
    g = graph.build_multisource_graph(records)
    nodes = {r.name: r for r in g.nodes.collect()}
    edges = g.edges.collect()
    by_label = {}
    for e in edges:
        by_label[e.label] = by_label.get(e.label, 0) + 1
    assert by_label["CALLED"] == 2 and by_label["TRANSFERRED_TO"] == 5  # the self call has no actor edge
    assert sum(1 for n in nodes.values() if n.type == "event") == len(RECORDS)
    assert all(e.evidence_record_ids and len(e.evidence_hashes[0]) == 64 and e.source_types for e in edges)
    digest = hashlib.sha256(json.dumps(RECORDS[0], ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert {e.evidence_hashes[0] for e in edges if e.evidence_record_ids == ["CALL-1"]} == {digest}
    protected = nodes["Protected Person"]
    assert (protected.type, protected.risk) == ("protected_person", 0)
    assert not any(e.anomalous for e in edges if e.target == protected.id)
    assert nodes["Mira Sol"].id != nodes["M. Sol"].id
    assert sum(1 for n in nodes.values() if n.type == "person" and n.name.lower() == "mira sol") == 1
    assert nodes["Post OSINT-1"].risk == 45 + 30


def test_last_record_describes_a_repeated_event(spark):
    rows = [(0, {"id": "X", "record_type": "first", "timestamp": at(1, 1, 1)}), (1, {"id": "X", "record_type": "second", "timestamp": at(1, 1, 2)})]
    g = graph.build_multisource_graph(spark.createDataFrame(rows, "seq bigint, fields map<string,string>"))
    assert [r.name for r in g.nodes.collect()] == ["Second X"]


def test_patterns(records):
    rows = patterns.staged_rows(records)
    found = {}
    for r in patterns.pattern_evidence(rows).collect():
        found.setdefault(r.pattern_id, set()).add(r.rid)
    assert found["communication-burst"] == {"CALL-1", "CALL-2"}
    assert found["rapid-split-transfer"] == {"TX-1", "TX-2", "TX-3"}
    assert found["circular-fund-flow"] == {"TX-1", "TX-2", "TX-3", "TX-4", "TX-5"}
    assert found["cross-source-convergence"] == {"ANPR-1", "SURV-1", "OSINT-1"}
    assert found["cross-channel-bridge"] == {"CALL-1", "TX-1", "TX-2", "TX-3", "ANPR-1", "SURV-1"}  # FIR-2 spells the name with other spacing
    envelope = patterns.detect_patterns(rows).collect()
    assert [r.id for r in envelope] == ["circular-fund-flow", "cross-source-convergence", "communication-burst", "cross-channel-bridge", "rapid-split-transfer"]
    assert all(len(r.receipt) == 64 for r in envelope)


def test_emergence_days(records):
    days = {str(r.day): r for r in patterns.emergence(records).collect()}
    assert days["2025-03-01"].new_patterns == ["communication-burst"]
    assert days["2025-03-02"].new_patterns == ["rapid-split-transfer"]
    assert days["2025-03-03"].new_patterns == ["circular-fund-flow"]
    assert "cross-source-convergence" in days["2025-03-04"].new_patterns
    assert days["2025-03-05"].cumulative_records == len(RECORDS) - 1  # one record has no time


def test_a_late_transfer_ends_a_cycle(spark, records):
    late = spark.createDataFrame([(99, {"transaction_id": "TX-9", "timestamp": at(9, 1, 0), "source_account": "A", "destination_account": "B", "amount": "1"})], records.schema)
    days = {str(r.day): r.patterns for r in patterns.emergence(records.unionByName(late)).collect()}
    assert "circular-fund-flow" in days["2025-03-05"] and "circular-fund-flow" not in days["2025-03-09"]


def test_windows_on_a_hot_key(spark):
    rng = random.Random(5)
    start = datetime(2025, 1, 1)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        rows.append((i, key, start + timedelta(seconds=rng.choice([0, 1800, 3600, rng.randint(0, 40_000)])), rng.choice(rules.CHANNELS)))
    df = spark.createDataFrame(rows, "seq bigint, k string, ts timestamp, channel string")
    got = {(r.k, r.window_start): (r.n, r.n_distinct, r.window_end) for r in patterns.densest_window(
        df, ["k"], "ts", 1800, 1, "channel", rules.CHANNELS, 1, all_windows=True).collect()}
    want = {}
    for _, k, t, _ in rows:
        inside = [(x[2], x[3]) for x in rows if x[1] == k and t <= x[2] <= t + timedelta(seconds=1800)]
        want[(k, t)] = (len(inside), len({c for _, c in inside}), max(x for x, _ in inside))
    assert got == want


def test_triangles_through_a_hub(spark):
    rng = random.Random(2)
    names = ["hub"] + [f"a{i:02d}" for i in range(25)]
    pairs = {(a, b) for a in names for b in names if a != b and (a == "hub" or b == "hub" or rng.random() < 0.15)}
    route = spark.createDataFrame([(a, b, 1, datetime(2025, 1, 1), datetime(2025, 1, 2)) for a, b in pairs], "source string, target string, n bigint, lo timestamp, hi timestamp")
    want = {(a, b, c) for a, b in pairs for c in names if a < b and a < c and (b, c) in pairs and (c, a) in pairs}
    got = [(r.a, r.b, r.c) for r in patterns.directed_triangles(route).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_numbering_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 37) % 1000, i) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "g string, v int, id int"), ["g"], ["v", "id"]).collect()
    want = {}
    for g, v, i in sorted(rows):
        want[(g, v, i)] = 1 + sum(1 for x in want if x[0] == g)
    assert {(r.g, r.v, r.id): r.n for r in got} == want


# -- integrity, guards, masking --------------------------------------------------------

def test_chain_seal_and_tamper(spark):
    events = spark.createDataFrame([("c1", f"2025-01-01T00:00:{i:02d}", "ana", "export", f"t{i}", {"n": str(i), "q": 'a"b'}, i) for i in range(25)],
                                   "chain string, timestamp string, actor string, action string, target string, details map<string,string>, id int")
    sealed = integrity.seal_chain(events, "chain", ["timestamp", "id"], block=10).cache()
    rows = sorted(sealed.collect(), key=lambda r: r.sequence)
    assert [r.sequence for r in rows] == list(range(1, 26))
    previous = rules.GENESIS_HASH
    for r in rows:
        if (r.sequence - 1) % 10 == 0:
            previous = rules.GENESIS_HASH
        body = {"sequence": r.sequence, "timestamp": r.timestamp, "actor": r.actor, "action": r.action, "target": r.target, "details": r.details, "previous_hash": previous}
        assert r.previous_hash == previous
        assert r.hash == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        previous = r.hash
    roots = integrity.chain_roots(sealed, "chain", block=10)
    verify = lambda entries: {(r.sequence, r.reason) for r in integrity.verify_chain(entries, "chain", roots, block=10).collect()}
    assert verify(sealed) == set()
    changed = sealed.withColumn("target", F.when(F.col("sequence") == 4, "other").otherwise(F.col("target")))
    assert verify(changed) == {(4, "content hash mismatch")}
    assert verify(sealed.filter("sequence <> 7")) == {(8, "sequence mismatch"), (8, "previous hash mismatch"), (None, "root mismatch")}
    # whole blocks, at the front, in the middle and at the end
    assert verify(sealed.filter("sequence > 10")) == {(11, "sequence mismatch"), (None, "root mismatch")}
    assert verify(sealed.filter("sequence <= 10 or sequence > 20")) == {(21, "sequence mismatch"), (None, "root mismatch")}
    assert verify(sealed.filter("sequence <= 20")) == verify(sealed.filter("false")) == {(None, "root mismatch")}
    assert verify(sealed.unionByName(sealed.filter("sequence = 5"))) == {(5, "sequence mismatch")}
    assert [df.count() for df in integrity.chain_levels(sealed, "chain", block=2)] == [3, 2, 1]


def test_appending_to_a_chain_is_sealing_once(spark):
    """Batches that end inside a block, at its end and with a chain that begins late; blocks of 3 make the levels grow."""
    events = spark.createDataFrame([(c, f"2025-01-01T00:00:{i:02d}", "ana", "export", f"t{i}", {"n": str(i)}, i) for c, low in (("c1", 0), ("c2", 11), (None, 5)) for i in range(low, 40)],
                                   "chain string, timestamp string, actor string, action string, target string, details map<string,string>, id int")
    once = integrity.seal_chain(events, "chain", ["timestamp", "id"], block=3)
    entries, levels = None, None
    for low, high in ((0, 2), (2, 9), (9, 10), (10, 40)):
        part = events.filter(f"id >= {low} and id < {high}")
        fresh = integrity.seal_chain(part, "chain", ["timestamp", "id"], 3, None if entries is None else integrity.chain_tails(entries, "chain")).cache()
        levels = integrity.chain_levels(fresh, "chain", 3) if levels is None else integrity.append_levels(levels, fresh, "chain", 3)
        entries = fresh if entries is None else entries.unionByName(fresh)
    plain = lambda df: sorted((str(r.chain), r.sequence, r.block, r.target, r.previous_hash, r.hash) for r in df.collect())
    assert plain(entries) == plain(once)
    want = integrity.chain_levels(once, "chain", 3)
    rows = lambda dfs: [sorted((str(r.chain), r.number, r.entries, r["head"]) for r in df.collect()) for df in dfs]
    assert rows(levels) == rows(want) and len(want) == 4
    assert integrity.verify_chain(entries.filter("chain is not null"), "chain", integrity.chain_roots(once, "chain", 3).filter("chain is not null"), 3).isEmpty()


def test_hostile_files_and_rows(spark):
    files = spark.createDataFrame([("/x/a.csv", bytearray(b"MZ\x90")), ("/x/b.csv", bytearray(b"a\x00b")), ("/x/c.xml", bytearray(b"<!DOCTYPE x><a/>")),
                                   ("/x/d.exe", bytearray(b"hi")), ("/x/e.csv", bytearray(b"a,b\n1,2\n"))], "path string, content binary")
    accepted, rejected = readers.guard_files(files)
    assert [r.path for r in accepted.collect()] == ["/x/e.csv"]
    assert {r.path[-5:]: r.reason for r in rejected.collect()} == {
        "a.csv": "executable or archive content", "b.csv": "binary content", "c.xml": "document type or entity declaration", "d.exe": "unsupported format"}
    wide = {f"c{i}": "1" for i in range(201)}
    rows = spark.createDataFrame([(0, {"a": "x" * 20_001}), (1, wide), (2, {"a": "ok"})], "seq bigint, fields map<string,string>")
    ok, bad = readers.guard_records(rows)
    assert [r.seq for r in ok.collect()] == [2]
    assert {r.seq: r.reason for r in bad.collect()} == {0: "oversized field", 1: "too many columns"}


def test_masking_and_spreadsheet_cells(spark):
    df = spark.createDataFrame([("Ada  Lo", "+44 20 7946 0958", " =1+1"), ("X", "12", "plain")], "n string, p string, c string")
    got = df.select(S.mask_name(F.col("n")), S.mask_phone(F.col("p")), S.csv_safe(F.col("c"))).collect()
    assert tuple(got[0]) == ("A•• L••", "+44-•••••••958", "' =1+1")
    assert tuple(got[1]) == ("X••", "WITHHELD", "plain")


def test_name_based_uuid(spark):
    import uuid

    names = ["a", "evigraph:x:identity:1", "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(S.uuid5_url(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_forward_pass(spark):
    x = {"a": [1.0, 2.0], "b": [0.5, -1.0], "c": [3.0, 0.0]}
    edges = [("a", "b"), ("a", "b")]
    w = {"layer1": {"neighbour": [[0.2, -0.1], [0.4, 0.3]], "self": [[0.5, 0.5], [-0.3, 0.1]], "bias": [0.1, -0.2]},
         "layer2": {"neighbour": [[0.6, 0.1], [0.2, -0.4]], "self": [[0.1, 0.9], [0.3, 0.2]], "bias": [0.0, 0.1]},
         "classifier": {"weight": [[0.7, -0.2], [0.1, 0.8]], "bias": [0.05, -0.05]}}
    near = {n: [] for n in x}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)

    import math

    def dot(m, v):
        return [sum(p * q for p, q in zip(row, v)) for row in m]

    def layer(h, p):
        out = {}
        for n in h:
            mean = [sum(h[m][i] for m in near[n]) / len(near[n]) if near[n] else 0.0 for i in range(2)]
            out[n] = [max(0.0, l + b + r) for l, b, r in zip(dot(p["neighbour"], mean), p["bias"], dot(p["self"], h[n]))]
        return out

    h = layer(layer(x, w["layer1"]), w["layer2"])
    want = {}
    for n in h:
        z = [a + b for a, b in zip(dot(w["classifier"]["weight"], h[n]), w["classifier"]["bias"])]
        want[n] = math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1]))
    f = spark.createDataFrame(list(x.items()), "id string, features array<double>")
    adj = spark.createDataFrame([p for a, b in edges for p in ((a, b), (b, a))], "node string, nbr string")
    got = {r.id: r.probability for r in features.mean_aggregator_scores(f, adj, w).collect()}
    assert got == pytest.approx(want)


def test_equal_windows_go_to_the_first_row_of_a_key(spark):
    """Two equal bursts: the key whose first row comes first wins, even if that row has no time."""
    rows = [(1, "p", None), (2, "q", "2025-01-01 00:00:00"), (3, "q", "2025-01-01 00:10:00"), (4, "p", "2025-01-02 00:00:00"), (5, "p", "2025-01-02 00:10:00")]
    df = spark.createDataFrame(rows, "seq long, k string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r["k"]: (r["n"], r["first_seq"]) for r in patterns.densest_window(df, ["k"], "ts", 1800, 2).collect()}
    assert got == {"p": (2, 1), "q": (2, 2)}


def test_repeated_ids_leave_the_receipt_stable(spark):
    rows = RECORDS + [dict(RECORDS[3], amount="1"), dict(RECORDS[8], signal="other")]
    receipts = []
    for parts in (1, 7):
        df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, fields map<string,string>").repartition(parts)
        receipts.append({r["id"]: (r["receipt"], r["explanation"], r["n_evidence"]) for r in patterns.detect_patterns(patterns.staged_rows(df)).collect()})
    assert receipts[0] == receipts[1] and receipts[0]
    assert "amounts 1 to" in receipts[0]["rapid-split-transfer"][1]


def test_scores_by_short_keys_count_parallel_edges_and_loops(spark):
    from evigraph.operators import metrics
    from evigraph.operators.graph import EvidenceGraph

    kinds = {"a": "event", "b": "person", "c": "vehicle", "d": "location", "e": "crime"}
    nodes = spark.createDataFrame([(i, i, t, []) for i, t in kinds.items()], "id string, name string, type string, tags array<string>")
    ends = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "c"), ("c", "c"), ("d", "a")]
    g = EvidenceGraph(nodes, spark.createDataFrame([(f"e{i}", s, t, "L") for i, (s, t) in enumerate(ends)], "id string, source string, target string, label string"), True)
    w = {"layer1": {"neighbour": [[0.3, -0.2, 0.1, 0.4, 0.2, 0.1, 0.9]], "self": [[0.1] * 7], "bias": [0.05]}, "layer2": {"neighbour": [[0.7]], "self": [[0.2]], "bias": [0.1]}, "classifier": {"weight": [[0.4], [-0.6]], "bias": [0.0, 0.1]}}
    want = {r.id: r.probability for r in features.mean_aggregator_scores(features.node_features(g), metrics.adjacency(g, multi=True), w).collect()}
    keyed, pairs = metrics.keyed(g)
    scores = features.mean_aggregator_scores(features.keyed_features(keyed, pairs), features.weighted(pairs), w).withColumnRenamed("id", "key")
    got = {r.id: r.probability for r in keyed.select("id", "key").join(scores, "key").collect()}
    assert got == pytest.approx(want) and len(got) == 5
