import hashlib
import random
import re
from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from evigraph.llm import mixing


def brute_targets(sizes, repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate >= repeats * sizes[s]}
        if not over:
            target |= {s: weight[s] * rate for s in open_}
            break
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, F.lit(None)).otherwise(F.col("source")))
    rows = mixing.mix(docs, shards=5).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * len(r["copies"])
        assert len(r["copies"]) <= 3 and len({c["pass"] for c in r["copies"]}) == len(r["copies"])
    want = brute_targets(sizes)
    longest = max(r["size"] for r in rows)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert want[s] - longest <= taken[s] <= want[s] + 1e-6
    again = {(r["doc_id"], tuple(map(tuple, r["copies"]))) for r in mixing.mix(docs.repartition(7), shards=5).collect()}
    assert again == {(r["doc_id"], tuple(map(tuple, r["copies"]))) for r in rows}


def test_full_sources_leave_their_excess(spark):
    rows = [(i, "a b c d", "a") for i in range(100)] + [(200, "w " * 10, "b"), (201, "w", "c"), (202, None, "d")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.size("copies")).alias("n")).collect()
    want = brute_targets({"a": 400, "b": 10, "c": 1, "d": 0})
    assert {r["source"]: r["t"] for r in got} == pytest.approx(want)
    assert {r["source"]: r["n"] for r in got if r["source"] != "a"} == {"b": 30, "c": 3, "d": 0}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_tree_keeps_every_quota(spark, shards):
    quotas = {1: 1000, 2: 1, 3: 57, 4: 300}
    got = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "rank int, quota long"), shards, 4).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in got:
        by_source[r["rank"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert dict(by_source) == quotas
    assert max(by_shard.values()) - min(by_shard.values()) <= shards.bit_length() and len(by_shard) == shards


def test_draws_follow_the_hypergeometric_law(spark):
    from math import comb

    n = 50_000
    got = spark.range(n).select(mixing.hypergeometric(*(F.lit(x).cast("long") for x in (30, 12, 10)), mixing.unit_hash(F.col("id"))).alias("k")).groupBy("k").count().collect()
    for r in got:
        p = comb(12, r["k"]) * comb(18, 10 - r["k"]) / comb(30, 10)
        assert abs(r["count"] - n * p) < 6 * (n * p) ** 0.5 + 3
    sure = spark.range(1).select(*[mixing.hypergeometric(*(F.lit(x).cast("long") for x in a), F.lit(0.7)).alias(f"k{i}") for i, a in enumerate([(5, 5, 3), (5, 0, 3), (5, 2, 5), (0, 0, 0), (7, 3, 0)])]).first()
    assert list(sure) == [3, 0, 2, 0, 0]


def test_odd_rows(spark, clash):
    got = mixing.mix(clash).collect()
    assert len(got) == clash.count()
    assert all(not r["copies"] for r in got if not (r["text"] or "").strip())
    alike = [r["copies"] for r in got if r["doc_id"] == 4]
    assert alike[0] == alike[1]
    assert mixing.mix(clash.limit(0)).count() == 0
    assert mixing.rows_of(mixing.mix(clash)).columns.count("value") == 1


def test_a_long_document_blocks_nothing(spark):
    """Each source has one document as long as all others together; the last pass takes rows in hash order up to the first that does not fit, then the smallest behind it."""
    rng = random.Random(3)
    one = [*(rng.randint(1, 40) for _ in range(700)), 14_000]
    sizes = {(s, i): n for s in range(6) for i, n in enumerate(one)}
    rows = [(1000 * s + i, "w " * n, f"s{s}") for (s, i), n in sizes.items()]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=3).collect()
    number = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)
    for s in range(6):
        own = [r for r in got if r["source"] == f"s{s}"]
        total, target = sum(r["size"] for r in own), own[0]["target"]
        full, want = int(target // total), {}
        rest, blocks, rank = int(target - full * total), -(-len(own) // mixing.BLOCK_ROWS), s + 1

        def turn(r):
            spot = number(11, r["doc_id"], r["text"])
            block = spot % mixing.BLOCKS * blocks // mixing.BLOCKS
            return number(11, "block", rank, block), block, number(11, "row", spot), spot

        could, behind = [r for r in sorted(own, key=turn) if r["size"] <= rest], []
        for r in own:
            want[r["doc_id"]] = full
        while could and could[0]["size"] <= rest:
            rest -= could[0]["size"]
            want[could.pop(0)["doc_id"]] += 1
        behind = sorted((r for r in could if r["size"] <= rest), key=lambda r: (r["size"], turn(r)))
        while behind and behind[0]["size"] <= rest:
            rest -= behind[0]["size"]
            want[behind.pop(0)["doc_id"]] += 1
        assert {r["doc_id"]: len(r["copies"]) for r in own} == want
        short = target - sum(r["size"] * len(r["copies"]) for r in own)
        assert 0 <= short <= 0.005 * target and short < 1 + min(r["size"] for r in own if len(r["copies"]) == full)


def test_the_mix_lies_by_shard_and_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, shards=4)
    rows = mixing.rows_of(mixed).select("doc_id", "shard", "place", F.spark_partition_id().alias("part")).collect()
    want = sorted((c["shard"], c["place"], r["doc_id"]) for r in mixed.collect() for c in r["copies"])
    assert sorted((r["shard"], r["place"], r["doc_id"]) for r in rows) == want
    for part in {r["part"] for r in rows}:
        own = [(r["shard"], r["place"]) for r in rows if r["part"] == part]
        assert own == sorted(own)
    assert len({(r["shard"], r["part"]) for r in rows}) == len({r["shard"] for r in rows}) == 4


def test_a_large_shard_is_dealt_out_in_runs_of_places(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 16)
    mixed = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source"), shards=2)
    rows = mixing.rows_of(mixed).select("doc_id", "shard", "place", F.spark_partition_id().alias("part")).collect()
    assert sorted((r["shard"], r["place"], r["doc_id"]) for r in rows) == sorted((c["shard"], c["place"], r["doc_id"]) for r in mixed.collect() for c in r["copies"])
    runs = {(r["shard"], r["place"] // 16) for r in rows}
    assert len({(r["shard"], r["place"] // 16, r["part"]) for r in rows}) == len(runs) > 4
    for part in {r["part"] for r in rows}:
        own = [(r["shard"], r["place"]) for r in rows if r["part"] == part]
        assert own == sorted(own)


def test_one_size_fills_from_the_front(spark):
    """Rows of one size behind the first that does not fit are taken in hash order, as many as fit."""
    rows = [(i, "w " * (7 if i % 2 else 11), "a") for i in range(900)] + [(2000 + i, "w " * 50, "b") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        short = own[0]["target"] - sum(r["size"] * len(r["copies"]) for r in own)
        full = min(len(r["copies"]) for r in own)
        assert 0 <= short < 1 + min((r["size"] for r in own if len(r["copies"]) == full), default=10**9)


def test_texts_meet_sources_and_plan_in_one_join_each(spark):
    docs = spark.createDataFrame([(i, "a b " * (1 + i % 5), f"s{i % 3}") for i in range(40)], "doc_id bigint, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Join ") for line in plan.splitlines()) == 2


def test_texts_meet_one_row_per_source(spark):
    """What the texts meet does not grow with them, so they need no exchange; rows that are equal are still taken alike."""
    rows = [(i, "a b " * (1 + i % 7), f"s{i % 3}") for i in range(2000)] + [(5000 + i % 40, "c " * (1 + i % 40), "s1") for i in range(160)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=4)
    staged = {f.rsplit("/", 1)[0] for f in mixed.inputFiles()}
    assert staged and sum(spark.read.parquet(f).count() for f in staged) <= 3 + 40
    got = mixed.collect()
    by_row = defaultdict(set)
    for r in got:
        by_row[r["doc_id"], r["text"]].add(tuple(map(tuple, r["copies"])))
    assert len(got) == len(rows) and all(len(c) == 1 for c in by_row.values())
    longest = max(r["size"] for r in got)
    for s in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == s]
        short = own[0]["target"] - sum(r["size"] * len(r["copies"]) for r in own)
        assert -1e-6 <= short <= 4 * longest


def test_equal_rows_that_only_fit_apart(spark):
    """Equal rows are one of their words together: too long for what is left, none is taken, though one alone would fit."""
    rows = [(1, "w " * 60, "a")] * 3 + [(i, "w", "a") for i in range(2, 120)] + [(1000 + i, "w " * 5, "b") for i in range(12)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=2).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        full = int(own[0]["target"] // own[0]["source_size"])
        rest = own[0]["target"] - full * own[0]["source_size"]
        assert own[0]["target"] + 1e-6 >= sum(r["size"] * len(r["copies"]) for r in own)
        assert s == "b" or rest < 180 and {len(r["copies"]) for r in own if r["doc_id"] == 1} == {full}
