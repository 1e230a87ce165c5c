"""Stream jobs against plain loops in event time, whatever the order of files, and the driver entry."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evigraph.operators import graph
from evigraph.session import remove, scratch_path
from evigraph.streaming import jobs, store

START = datetime(2025, 1, 1)


def stream_of(spark, rows, columns, max_files=None):
    """Rows in several files, in an order that has nothing to do with time."""
    path = scratch_path(spark, "stream-test")
    rows = list(rows)
    random.Random(8).shuffle(rows)
    spark.createDataFrame(rows, columns).repartition(5).write.parquet(path)
    return jobs.read_table_stream(spark, path, max_files)


def events():
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "cold"]), START + timedelta(seconds=rng.randint(0, 900), microseconds=i)) for i in range(300)]
    return [*rows, ("end", START + timedelta(hours=5))]  # moves the watermark past all others


def test_rate_limit(spark):
    rows = events()
    got = {(r.k, r.ts): r.admitted for r in jobs.run_rate_limit(stream_of(spark, rows, "k string, ts timestamp"), "k", "ts", 4, 60).collect()}
    held, want = {}, {}
    for k, t in sorted(rows[:-1], key=lambda r: r[1]):
        recent = [h for h in held.get(k, []) if h >= t - timedelta(seconds=60)]
        want[(k, t)] = len(recent) < 4
        held[k] = recent + [t] if len(recent) < 4 else recent
    assert got == want and not all(want.values())


def test_bursts_hold_both_ends(spark):
    rows = events() + [("pair", START), ("pair", START + timedelta(minutes=30)), ("pair", START + timedelta(minutes=60, microseconds=1)), ("twice", START), ("twice", START)]
    got = {tuple(r) for r in jobs.run_to_table(jobs.stream_bursts(stream_of(spark, rows, "k string, ts timestamp"), ["k"], "ts", 1800, 2), "bursts").collect()}
    want = set()
    for k in {k for k, _ in rows} - {"end"}:
        times = sorted(t for x, t in rows if x == k)
        for t in set(times):
            inside = [u for u in times if t <= u <= t + timedelta(minutes=30)]
            if len(inside) >= 2:
                want.add((k, t, max(inside), len(inside)))
    assert got == want and ("pair", START, START + timedelta(minutes=30), 2) in want


def test_batches_in_order_of_time_decide_the_same(spark):
    """A stream in seven batches, each later than the one before, with a watermark that closes cells in between."""
    rows, path = sorted(events()[:-1], key=lambda r: r[1]), scratch_path(spark, "stream-test")
    for i in range(7):
        spark.createDataFrame(rows[43 * i : 43 * (i + 1)], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    read = lambda: jobs.read_table_stream(spark, path, 1)
    limited = jobs.run_rate_limit(read(), "k", "ts", 4, 60, "5 seconds", "20 seconds", finite=True).collect()
    held, want = {}, {}
    for k, t in rows:
        recent = [h for h in held.get(k, []) if h >= t - timedelta(seconds=60)]
        want[(k, t)] = len(recent) < 4
        held[k] = recent + [t] if len(recent) < 4 else recent
    assert {(r.k, r.ts): r.admitted for r in limited} == want and len(limited) == len(rows)
    bursts = jobs.run_finite(read(), ["k"], "ts", lambda s: jobs.stream_bursts(s, ["k"], "ts", 40, 3, "5 seconds"), "bursts-batches").collect()
    wide = {(k, t): [u for x, u in rows if x == k and t <= u <= t + timedelta(seconds=40)] for k, t in rows}
    assert sorted((r.k, r.window_start, r.window_end, r.n) for r in bursts) == sorted((k, t, max(u), len(u)) for (k, t), u in wide.items() if len(u) >= 3)


def test_a_finite_stream_is_decided_to_its_end(spark):
    rows = [*events()[:-1], (None, START + timedelta(minutes=15)), (None, START + timedelta(minutes=15))]
    limited = jobs.run_rate_limit(stream_of(spark, rows, "k string, ts timestamp"), "k", "ts", 4, 60, finite=True).collect()
    assert sorted((str(r.k), r.ts) for r in limited) == sorted((str(k), t) for k, t in rows)
    bursts = jobs.run_finite(stream_of(spark, rows, "k string, ts timestamp"), ["k"], "ts", lambda s: jobs.stream_bursts(s, ["k"], "ts", 1800, 2), "bursts-end").collect()
    last = {k: sorted(t for x, t in rows if x == k)[-2:] for k in ("hot", "cold", None)}
    assert {(r.k, r.window_start, r.window_end, r.n) for r in bursts} >= {(k, *t, 2) for k, t in last.items()}


def test_first_seen_does_not_depend_on_arrival(spark):
    rows = events()
    got = {r.k: r.first for r in jobs.stream_emergence(stream_of(spark, rows, "k string, ts timestamp", 1), "k", "ts", scratch_path(spark, "first-test")).collect()}
    assert got == {k: min(t for x, t in rows if x == k) for k, _ in rows}


def first_times(parts):
    return parts.groupBy("k").agg(F.min("t").alias("t"))


def test_run_store_merges_by_levels_and_survives_a_crash(spark):
    """Twenty batches: a logarithm of runs, each batch once; an incomplete run and inputs of a finished one are left out."""
    path, schema = scratch_path(spark, "store-test"), "k int, t int"
    for b in range(20):
        store.add_batch(spark.createDataFrame([(b % 3, 100 - b), (7, b)], schema), path, b, first_times)
    assert store.live_runs(spark, path) == [(0, 15), (16, 16), (17, 17), (18, 18), (19, 19)]
    want = {7: 0, **{k: 100 - max(b for b in range(20) if b % 3 == k) for k in range(3)}}
    read = lambda: {r.k: r.t for r in store.stored(spark, path, first_times, schema).collect()}
    assert read() == want
    store.add_batch(spark.createDataFrame([(1 % 3, 81), (7, 19)], schema), path, 19, first_times)  # repeated
    spark.createDataFrame([(7, -5)], schema).write.parquet(f"{path}/r16-19")  # merged, but its marker was not written
    remove(spark, f"{path}/r16-19/_SUCCESS")
    assert read() == {**want, 1: 81}
    store.add_batch(spark.createDataFrame([(9, 9)], schema), path, 20, first_times)
    assert read() == {**want, 1: 81, 9: 9} and store.live_runs(spark, path) == [(0, 15), (16, 19), (20, 20)]
    spark.createDataFrame([(7, -5)], schema).write.parquet(f"{path}/r17-17")  # an input that was not deleted yet
    assert read() == {**want, 1: 81, 9: 9}
    assert store.stored(spark, scratch_path(spark, "no-store"), first_times, schema).count() == 0


def test_ingested_graph_is_that_of_one_batch(spark):
    """Entities and events whose first and last records arrive in other batches than their source order says."""
    rng = random.Random(6)
    rows = [(i, {"call_id": f"CALL-{i // 2}", "caller_name": rng.choice(["Ana  Lee", "ana lee", "Bo"]), "caller_number": str(rng.randrange(6)),
                 "callee_number": str(rng.randrange(6)), "timestamp": f"2025-01-01 10:{i % 60:02d}:00"}) for i in range(80)]
    records = spark.createDataFrame(rows, "seq bigint, fields map<string,string>")
    sink = scratch_path(spark, "ingest-test")
    jobs.stream_ingest(stream_of(spark, rows, "seq bigint, fields map<string,string>", 1), sink)
    got, want = jobs.ingested_graph(spark, sink), graph.build_multisource_graph(records)
    rows_of = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert rows_of(got.nodes.select(*want.nodes.columns)) == rows_of(want.nodes)
    assert rows_of(got.edges.select(*want.edges.columns)) == rows_of(want.edges)


def test_entry(spark):
    import __spark_entry__ as driver

    rows = driver.entry(spark).collect()
    assert [r.rank for r in rows] == list(range(1, 11))
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_a_file_of_one_row_group_is_worked_on_by_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/in")
    parts, rows = [], []

    def see(batch, batch_id):
        parts.append(batch.rdd.getNumPartitions())
        rows.extend(r["id"] for r in batch.collect())

    stream = jobs.read_table_stream(spark, f"{tmp_path}/in", 1, spread=True)
    stream.writeStream.foreachBatch(see).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert parts == [spark.sparkContext.defaultParallelism] and sorted(rows) == list(range(1000))
