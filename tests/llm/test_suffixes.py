import random

import numpy as np
import pytest

from evigraph.llm import suffixes


def brute(rows, length=100):
    """(key, n_bytes, n_removed, n_spans, kept) of rows (key, text), equal rows as one document."""
    order = sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is None, r[0], r[1]))
    seen, out = set(), {}
    for key, text in order:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(data[i : i + length])
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key, text] = len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return sorted(((k, *out[k, t or ""]) for k, t in rows), key=repr)


def result(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "mine") for k, t in rows], "doc_id long, text string, kept string")
    return sorted(((r[0], *r[1:4], bytes(r[4])) for r in suffixes.deduplicated(df, **options).collect()), key=repr)


def corpus(n, seed):
    """Texts of shared passages, near copies, exact copies, runs of one character and own words; keys differ."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijé", k=rnd.randrange(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(k) for k in (12, 20, 40, 60)] + ["-" * 150, "ab" * 120]
    rows = []
    for i in range(n):
        kind = rnd.randrange(6)
        if kind == 0 and rows:
            text = rnd.choice(rows)[1]
        elif kind == 1 and rows:
            text = list(rnd.choice(rows)[1])
            for _ in range(3):
                text.insert(rnd.randrange(len(text) + 1), rnd.choice("xyz"))
            text = "".join(text)
        else:
            text = " ".join(rnd.choice([prose(rnd.randrange(1, 30)), rnd.choice(passages)]) for _ in range(rnd.randrange(0, 5)))
        rows.append((i, text))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("slice_bytes", "hot"), [(1 << 20, 2048), (3000, 2048), (3000, 3), (500, 0)])
def test_against_plain_code(spark, slice_bytes, hot):
    rows = corpus(160, 1)
    assert result(spark, rows, slice_bytes=slice_bytes, hot=hot) == brute(rows)


def test_other_lengths(spark):
    rows = corpus(60, 2)
    for length in (40, 57):
        assert result(spark, rows, length=length, slice_bytes=2000, hot=5) == brute(rows, length)
    with pytest.raises(ValueError):
        suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), length=20)


def test_copies_nulls_and_repeated_rows(spark):
    text = "A passage of more than one hundred bytes that stands in several of the documents of this small test, word by word."
    rows = [(5, text), (3, text), (3, text), (None, text), (None, text), (4, None), (4, ""), (6, text[:99]), (7, text + text), (8, "x" * 1000), (9, "é" * 300), (2, "x" * 99)] + [(100 + i, text) for i in range(300)]
    got = result(spark, rows, slice_bytes=2000, hot=4)
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] == 3] == [0, 0]


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdefgh ", k=700_000))
    rows = [(1, text + text[:400_000]), (2, text[5:300_000])]
    got = {r[0]: r[2] for r in result(spark, rows)}
    assert got == {1: 400_000, 2: 300_000 - 5}


def test_empty_table(spark):
    assert result(spark, []) == []


def test_pointers_of_equal_beginnings():
    rnd = random.Random(4)
    parts = ["".join(rnd.choices("ab", k=k)) for k in (30, 40, 80)]
    text = ("".join(rnd.choice(parts) + rnd.choice(["", "a", "b"]) for _ in range(60))).encode()
    buf = np.frombuffer(text + b"\0" * 16, np.uint8)
    for length in (40, 64, 100):
        pointers = np.sort(np.array(rnd.sample(range(len(text) - length), 900)))
        seen, want = set(), []
        for p in pointers:
            want.append(text[p : p + length] in seen)
            seen.add(text[p : p + length])
        assert suffixes.repeats(buf, pointers, length).tolist() == want


def test_every_string_has_one_anchor_that_its_bytes_decide():
    rnd = random.Random(5)
    part = "".join(rnd.choices("abc", k=260))
    texts = [part, "zz" + part, "", "short", "a" * 300, part * 3]
    buf = np.frombuffer("".join(texts).encode() + b"\0" * 64, np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    by = {}
    for first, n, h in suffixes.anchors(buf, offsets, 100):
        for f, k, x in zip(first.tolist(), n.tolist(), h.tolist(), strict=True):
            for s in range(f, f + k):
                assert s not in by
                by[s] = x
    assert sorted(by) == [int(o) + i for o, t in zip(offsets, texts, strict=False) for i in range(len(t) - 99)]
    of = {}
    for s, x in by.items():
        assert of.setdefault(bytes(buf[s : s + 100]), x) == x


def test_repeats_of_one_slice_meet_across_pieces(monkeypatch):
    """A slice is sorted in pieces: a repeat far behind its first string, in no other slice, is found as well."""
    import pyarrow as pa

    rnd = random.Random(5)
    passage = [("".join(rnd.choices("abcdefgh", k=160))) for _ in range(40)]
    texts = [" ".join(passage), "x" * 130 + " " + " ".join(reversed(passage))]
    table = pa.table({"slice": pa.array([0, 0], pa.int64()), "key": pa.array([1, 2], pa.int64()), "tie": pa.array([1, 2], pa.int64()), "text": texts})
    want = [r[2] for r in brute([(1, texts[0]), (2, texts[1])])]
    monkeypatch.setattr(suffixes, "BLOCK", 2000)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    for hot in (2048, 3, 0):
        known = suffixes.known_anchors(suffixes.sent_anchors(table, 100, 1), hot)
        parts = list(suffixes.settled_slice(table, known, 100, 1))
        for final in (False, True):
            whole = pa.concat_tables([p.cast(parts[0].schema) for p in parts])
            parts = list(suffixes.settled_bin(whole, 100, 1, final))
        whole = pa.concat_tables([p.cast(parts[0].schema) for p in parts])
        marks = whole.filter(pa.compute.equal(whole["kind"], suffixes.MARKS))
        assert suffixes.kept_bytes(table, marks, 100)["n_removed"].to_pylist() == want
