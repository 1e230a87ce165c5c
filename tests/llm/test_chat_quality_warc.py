import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

from conftest import ODD
from pyspark.sql import functions as F

from evigraph.llm import chat, quality, warc
from evigraph.session import scratch_path

TALK = "conv_id long, turn long, role string, text string"


def talks():
    rnd = random.Random(7)
    rows = [(c, t, ("system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"), " ".join(rnd.choice(["a", "<|end|>", "[INST]", "\\", "<\\", "</s>", "wörd", "\n"]) for _ in range(rnd.choice([0, 3, 60, 500]))) ) for c in range(12) for t in range(rnd.randint(1, 30))]
    return rows + [(50, 0, None, None), (50, None, "assistant", "first"), (51, 3, "assistant", "twice"), (51, 3, "assistant", "twice"), (None, 1, "user", "no id"), (52, 5000, "user", "late"), (52, 1, "assistant", "<|turn|>user<|text|>x<|end|>")]


def test_chat_round_trip_and_budget(spark):
    rows = talks()
    got = chat.formatted(spark.createDataFrame(rows, TALK), budget=200)
    read = got.select("conv_id", "window", "formatted", "loss", "repeats", chat.read_turns(F.col("formatted"), F.col("repeats")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    by = defaultdict(list)
    for r in read:
        by[r["conv_id"]].append(r)
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert by.keys() == want.keys()
    for c, windows in by.items():
        windows.sort(key=lambda r: r["window"])
        assert [(t["role"], t["text"]) for w in windows for t in w["turns"]] == want[c]
        assert "".join(w["learned"] for w in windows) == "".join(t for r, t in want[c] if r == "assistant")
        for k, w in enumerate(windows):
            assert not re.search(r"</s>|\[INST\]|\[/INST\]", w["formatted"])
            tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", t["text"])) + 4 for t in w["turns"]]
            whole = [len(re.findall(r"[^\x20\x09-\x0D]+", chat_text(t))) + 4 for t in w["formatted"].split("<|end|>")[:-1]]
            head = len(re.findall(r"[^\x20\x09-\x0D]+", want[c][0][1])) + 4 if want[c][0][0] == "system" else 0
            assert sum(whole) <= 200 or (len(tokens) == 1 and w["repeats"] <= 1 and tokens[0] + head > 200)
            assert k == 0 or (w["formatted"].startswith("<|turn|>system<|text|>")) == (0 < head <= 100)
            assert k > 0 or w["repeats"] == 0


def chat_text(turn):
    """A turn's text as it was: escapes taken away."""
    return re.sub(r"([<\[\\])\\", r"\1", turn.split("<|text|>")[1])


def test_windows_with_a_long_system_turn_keep_their_budget(spark):
    for system in (20, 150, 190, 300):
        rows = [(1, 0, "system", "s " * system)] + [(1, t, "user" if t % 2 else "assistant", "w " * (5 + t % 40)) for t in range(1, 60)]
        windows = chat.formatted(spark.createDataFrame(rows, TALK), budget=400).collect()
        for w in windows:
            turns = w["formatted"].split("<|end|>")[:-1]
            words = sum(len(chat_text(t).split()) + 4 for t in turns)
            assert words <= 400
            assert w["window"] == min(x["window"] for x in windows) or turns[0].startswith("<|turn|>system<|text|>") == (system + 4 <= 200)


def test_chat_without_rows(spark):
    assert chat.formatted(spark.createDataFrame([], TALK)).count() == 0


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(lines)


def brute_kept(m):
    words, chars, symbols, dup, repeat, lines = m
    return not (words < 50 or 100 * repeat > 50 * words or symbols > words or 10 * dup > 5 * lines or chars < 2 * words or chars > 15 * words)


def test_quality(spark, clash):
    rnd = random.Random(9)
    rows = ODD + [(100 + i, "".join(rnd.choice(["the ", "cat ", "é\n", "## ", "a\n", f"w{rnd.randrange(500)} "]) for _ in range(rnd.choice([0, 30, 90, 200])))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = quality.estimated_order(df)
    assert sorted(n for n, _ in order) == sorted(n for n, _ in quality.RULES)
    for rules in (order, order[::-1]):
        for r in quality.judged(quality.measured(df), rules).collect():
            m = brute_measures(r["text"])
            assert tuple(r[c] for c in quality.MEASURED) == m[:5]
            assert r["kept"] == brute_kept(m) == (r["failed_rule"] is None)
    assert quality.judged(quality.measured(clash), order).columns.count("kept") == 1
    none = df.limit(0)
    assert quality.estimated_order(none) == list(quality.RULES) and quality.judged(quality.measured(none), order).count() == 0


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\n" + "é" * (i % 7)) for i in range(60)] + [(100, None, None), (101, "u\r\nX: y", ""), (102, "", "long " * 30000), (None, "http://n", "<p>only</p>"), (None, "http://m", "<p>0</p>\r\n\r\nWARC/1.1\r\n")] + [(7, "http://h/7", "twice"), (7, "http://h/7", "twice")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    for least in (0, 30):
        path = scratch_path(spark, "warc-test")
        warc.write(df, path, least_bytes=least, records_per_file=25)
        records = warc.read(spark, path)
        assert records.where("type = 'malformed'").isEmpty() and records.count() == 3 * len(rows)
        got = warc.assembled(records).collect()
        assert sum(r["rows"] for r in got) == len(rows) and len(got) == len(rows) - 1
        best = defaultdict(lambda: None)
        for p, _, h in rows:
            if p is not None:
                best[h or ""] = max(p, best[h or ""] if best[h or ""] is not None else p)
        ids = {r["record_id"]: r for r in got}
        for r in got:
            assert len(r["requests"]) == 1 and r["note"]["via"] == "crawl"
            if r["type"] == "response":
                data = bytes(r["payload"])
                assert r["payload_bytes"] == len(data) and r["payload_digest"] == r["stated_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
                page = r["note"].get("page-id")
                b = best[data.decode()]
                assert b is None or len(data) < least or int(page or -1) == b
            else:
                kept = ids[r["refers_to"]]
                assert kept["type"] == "response" and kept["payload_digest"] == r["stated_digest"] and kept["payload_bytes"] >= least


def test_warc_from_elsewhere(spark):
    """Archives by another writer: one gzip member per record, a lone request, a broken end."""
    def record(kind, rid, extra, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode()
        return gzip.compress(head + block + b"\r\n\r\n")

    data = record("warcinfo", "<i>", "Content-Type: application/warc-fields\r\n", b"software: x\r\n") + record("metadata", "<m>", "WARC-Concurrent-To: <r>\r\nContent-Type: application/warc-fields\r\n", b"fetchTimeMs: 12\r\n")
    data += record("response", "<r>", "Content-Type: application/http\r\n", b"HTTP/1.1 200 OK\r\n\r\nhello") + record("request", "<q>", "WARC-Concurrent-To: <gone>\r\nContent-Type: application/http\r\n", b"GET / HTTP/1.1\r\n\r\n") + gzip.compress(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    path = scratch_path(spark, "warc-test")
    spark.createDataFrame([("x",)], "v string").write.text(path)  # makes the folder
    import os

    with open(os.path.join(path.removeprefix("file:"), "foreign.warc.gz"), "wb") as f:
        f.write(data)
    records = warc.read(spark, path + "/*.warc.gz")
    assert [r["type"] for r in records.orderBy("number").collect()] == ["warcinfo", "metadata", "response", "request", "malformed"]
    got = {r["record_id"]: r for r in warc.assembled(records).collect()}
    assert got.keys() == {"<i>", "<r>", "<gone>"} and bytes(got["<r>"]["payload"]) == b"hello" and got["<r>"]["note"] == {"fetchTimeMs": "12"}
    assert got["<gone>"]["type"] is None and len(got["<gone>"]["requests"]) == 1
