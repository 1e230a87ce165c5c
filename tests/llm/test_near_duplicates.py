import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from evigraph.llm import ngram_join
from evigraph.llm.components import connected


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Class and links of every row by comparing all texts that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j > i}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return {(k, min(least[root(i)]), links[i]) for i, (k, _) in enumerate(rows)}


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(df, **options).collect()}


def test_documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [512, 16])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    want, got = brute(rows), result(spark, rows)
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert got == want


def test_odd_texts(spark, odd, clash):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "a b c"), (6, "a b c d e"), (7, "a  b c\nd e"), (8, "b a c"), (9, "w " * 30000), (10, "w " * 20000)]
    assert result(spark, rows) == brute(rows)
    got = ngram_join.near_duplicates(odd)
    assert got.count() == odd.count() and ngram_join.near_duplicates(odd.limit(0)).count() == 0
    kept = ngram_join.one_of_each(clash)
    assert kept.columns == clash.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("é") == 1 and texts.count(None) == 1 and texts.count("no id here at all") == 1


def recall(depths):
    return 1 - np.prod([1 - 0.8**d for d in depths])


def test_prefixes_are_shortened_to_the_target():
    for trees, target in ((24, 0.999), (8, 0.9)):
        depth = ngram_join.prefix_depth(0.8, trees, target)
        assert recall([depth] * trees) >= target > recall([depth + 1] * trees)
    crowded = {(t, d): (1000 if t < 12 else 1) * 10 ** (8 - d) for t in range(24) for d in range(4, 9)}
    depths = ngram_join.tree_depths(crowded, 0.8, 24, 0.999, 5)
    assert recall(depths) >= 0.999 and max(depths[12:]) < min(depths[:12])
    assert recall(ngram_join.tree_depths({}, 0.8, 24, 0.999, 5)) >= 0.999
    assert ngram_join.tree_depths({}, 0.8, 2, 0.999, 1) == [1, 1]


def test_matches_of_sorted_paths_in_any_batches():
    rnd = random.Random(8)
    paths = sorted((rnd.randrange(3), int.from_bytes(bytes(rnd.choice(b"ab") for _ in range(8)), "big"), i) for i in range(200))
    want = {}
    for t, p, i in paths:
        same = [8 - ((p ^ q).bit_length() + 7) // 8 for u, q, j in paths if u == t and j != i]
        want[i] = max(same)
    for size in (1, 7, 200):
        parts = [paths[a : a + size] for a in range(0, len(paths), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[2] for r in x], pa.int64()), pa.array([r[0] for r in x], pa.int32()), pa.array([r[1] for r in x], pa.int64())], ["cid", "tree", "path"]) for x in parts]
        got = {c: m for b in ngram_join.matches(iter(batches), 5) for c, m in zip(b["cid"].to_pylist(), b["matched"].to_pylist(), strict=True)}
        edges = {paths[0][2], paths[-1][2]}
        assert got == {i: (8 if i in edges else m) for i, m in want.items() if m >= 5 or i in edges}
    assert [b.num_rows for b in ngram_join.matches(iter([]), 5)] == [0]


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(4)
    names = list(range(400))
    rnd.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 260)] + [(names[300 + i], names[300 + (i + 1) % 50]) for i in range(50)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    for low, high in ((0, 151), (200, 260), (300, 350)):
        assert {got[x] for x in names[low:high]} == {min(names[low:high])}
    assert connected(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_signatures_do_not_depend_on_batches():
    texts = [f"one two three four five six seven {i}" for i in range(50)] + ["", "a"]
    whole = ngram_join.signatures(pa.array(texts), 5, 4, 3)[0]
    assert np.array_equal(whole, np.concatenate([ngram_join.signatures(pa.array([t]), 5, 4, 3)[0] for t in texts]))


def test_kept_texts_are_exchanged_once(spark):
    """Rows that their key and text tell apart need no second exchange; rows that they do not tell apart are still told from others."""
    rows = [(i, f"one two three four five six seven {i * 977}", "x") for i in range(60)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    alone = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert "Aggregate" not in plan(alone) and alone.count() == 60
    more = [*rows, rows[5], (5, rows[5][1], "y"), (100, rows[6][1], "x"), (None, "a b c", "x"), (None, "a b c", "z"), (200, " ", "x"), (200, " ", "y"), (200, " ", "x")]
    got = ngram_join.one_of_each(spark.createDataFrame(more, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in got) == sorted([(False, i, t) for i, t, _ in rows] + [(True, None, "a b c"), (False, 200, " "), (False, 200, " ")])


def test_candidates_are_not_sent_to_every_text(spark, monkeypatch):
    """The join of texts to their candidate groups is an exchange at any size, so that small runs tell what large ones need."""
    seen = []
    own = ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, tag: seen.append((tag, df._jdf.queryExecution().executedPlan().toString())) or own(df, tag))
    rows = [(i, "one two three four five six seven eight nine ten eleven twelve " * 3 + str(i % 4)) for i in range(40)]
    ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert "SortMergeJoin" in dict(seen)["ngram-verified"]
