"""Readers on hand-made files: order, headers, quotes, broken input."""

import os

from pyspark.sql import functions as F

from evigraph.operators import graph, products
from evigraph.session import scratch_path
from evigraph.sources import readers, scans


def folder(spark, files):
    path = scratch_path(spark, "reader-test").removeprefix("file:")
    os.makedirs(path)
    for name, text in files.items():
        with open(os.path.join(path, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return path


def rows_of(df):
    return [(r["seq"], r["fields"]) for r in df.orderBy("seq").collect()]


def test_csv_headers_per_file_and_quoted_line_breaks(spark):
    path = folder(spark, {"b.csv": "note,id\nlate,3\n", "a.csv": '﻿id,note\n1,"two\nlines, quoted ""x"""\n2,\n', "c.csv": "id,extra\n4,more\n"})
    got = rows_of(readers.read_csv_records(spark, path))
    assert got == [(0, {"id": "1", "note": 'two\nlines, quoted "x"'}), (1, {"id": "2", "note": ""}), (2, {"id": "3", "note": "late"}), (3, {"id": "4", "extra": "more"})]
    assert [r["seq"] for r in readers.read_csv_records(spark, path, key="id", limit=2).collect()] == [1, 2]


def test_order_follows_files_not_splits(spark):
    big = "".join(f'{{"n": "{i}"}}\n' for i in range(3000))
    path = folder(spark, {"a.json": '{"n": "first"}\n', "b.json": big, "c.json": '{"n": "last"}\n'})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [f["n"] for _, f in rows_of(readers.read_json_lines(spark, path))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == ["first", *map(str, range(3000)), "last"]


def test_broken_json_is_kept_apart(spark):
    path = folder(spark, {"a.json": '{"id": "1"}\n{"id": \n[1, 2]\n{"id": "2"}\n\n'})
    good, bad = readers.split_json_lines(spark, path)
    assert [f for _, f in rows_of(good)] == [{"id": "1"}, {"id": "2"}]
    assert sorted((r["text"], r["reason"]) for r in bad.collect()) == [("[1, 2]", "malformed JSON"), ('{"id": ', "malformed JSON")]
    path = folder(spark, {"a.json": '{"records": [{"id": "1"}, {"id": "2"}]}', "b.json": '[{"id": "3"}]', "c.json": '{"records": [{"id"'})
    good, bad = readers.split_json_records(spark, path)
    assert [f["id"] for _, f in rows_of(good)] == ["1", "2", "3"]
    assert [r["text"] for r in bad.collect()] == ['{"records": [{"id"']


def test_narratives_decide_per_file(spark):
    path = folder(spark, {"a.txt": "Case Number: X1 happened\n---\nno number here", "b.txt": "first plain block\n\nsecond plain block"})
    got = {(r["doc_id"], r["block_idx"], r["text"]) for r in readers.read_narratives(spark, path).collect()}
    assert got == {("a.txt", 0, "Case Number: X1 happened"), ("b.txt", 0, "first plain block"), ("b.txt", 1, "second plain block")}


def test_guards_read_whole_files(spark):
    pad = b"x" * 2_000_000
    files = spark.createDataFrame([("/x/a.csv", bytearray(pad + b"\0")), ("/x/b.xml", bytearray(b"<a>" + pad + b"<!ENTITY y 'z'></a>")), ("/x/c.csv", bytearray(pad))], "path string, content binary")
    accepted, rejected = readers.guard_files(files)
    assert [r["path"] for r in accepted.collect()] == ["/x/c.csv"]
    assert {r["path"]: r["reason"] for r in rejected.collect()} == {"/x/a.csv": "binary content", "/x/b.xml": "document type or entity declaration"}


def test_scans_share_files_out_and_equal_plain_digests(spark):
    """Files cut into ranges of 8 KB against hashes of their whole contents; odd endings, marks, empty and forbidden files."""
    import hashlib

    block, sha = 4, lambda b: hashlib.sha256(b).hexdigest()
    long = b"".join(b"line %d \xff\xfe\r\n" % i for i in range(3000))
    pad = b"x" * 30_000 + b"\n"
    contents = {"a.csv": long, "b.csv": long[:-1], "c.txt": "\ufeffMZ one".encode(), "d.txt": b"", "e.txt": b"\n\n", "f.json": b"MZ" + pad, "g.txt": pad * 3 + b"\0", "h.xml": pad + b"<!Entity y>", "i.exe": b"x", "j.txt": b"<!doctype html>\n"}
    path = folder(spark, {})
    for name, data in contents.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        assert scans.read_lines(spark, path).rdd.getNumPartitions() > 20
        got = {r["source"].rsplit("/", 1)[1]: r for r in scans.source_digests(spark, path, block=block).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    def digest(data):
        lines = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        level = [sha(x) for x in lines]
        while len(level) > 1:
            level = [sha("".join(level[i : i + block]).encode()) for i in range(0, len(level), block)]
        return len(lines), sha(f"{len(data)}:{len(lines)}:{level[0] if level else sha(b'')}".encode())

    assert contents.pop("d.txt") == b""
    assert {n: (r["lines"], r["digest"]) for n, r in got.items()} == {n: digest(d) for n, d in contents.items()}
    assert {n: r["bytes"] for n, r in got.items()} == {n: len(d) for n, d in contents.items()}
    assert {n: r["reason"] for n, r in got.items() if r["reason"]} == {
        "f.json": "executable or archive content", "g.txt": "binary content", "h.xml": "document type or entity declaration", "i.exe": "unsupported format"}


def test_mixed_records_go_to_their_own_builder(spark):
    rows = [(0, {"call_id": "CALL-1", "caller_name": "Ana Lee", "caller_number": "1", "callee_number": "2"}),
            (1, {"case_number": "AA000001", "primary_type": "THEFT", "suspect_name": "Ana Lee", "beat": "0101", "block": "X", "district": "1", "description": "d"})]
    records = spark.createDataFrame(rows, "seq bigint, fields map<string,string>")
    g = graph.build_graph(records)
    kinds = {r["type"] for r in g.nodes.collect()}
    assert {"event", "person", "crime"} <= kinds and g.nodes.count() == g.nodes.select("id").distinct().count()
    labels = {r["label"] for r in g.edges.collect()}
    assert "CALLED" in labels and "HAS_CRIME_TYPE" in labels
    assert {r["schema"]: r["records"] for r in products.data_quality(records).collect()} == {"multi-source": 2} or products.data_quality(records).agg(F.sum("records")).first()[0] == 2
