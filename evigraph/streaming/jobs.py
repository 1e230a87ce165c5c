"""Structured Streaming forms of ingest, limiting, burst detection, emergence and deduplication.

Every job takes a streaming DataFrame and returns a started-and-finished or
running query through the caller's writer; state is bounded by watermarks, and first-seen
times are a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evigraph.operators import graph as G
from evigraph.session import scratch_path, share_package
from evigraph.sources.readers import guard_records
from evigraph.streaming.store import add_batch, stored

#: The time of the closing row, in the last year that fits the nanoseconds Python workers get.
END = "2262-01-01 00:00:00"


def read_table_stream(spark: SparkSession, path: str, max_files: int | None = None, spread: bool = False) -> DataFrame:
    """The parquet table ``path``, a folder or one file, as a stream of new files.

    A file of one row group is read by one task; ``spread`` deals its rows out to all cores before anything is worked out from them.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a glob may name a folder as well as a file
    return rows.repartition(spark.sparkContext.defaultParallelism) if spread else rows


def run_to_table(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Process what is available into a parquet table and return that table."""
    path = scratch_path(stream.sparkSession, tag)
    _run(stream, path, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def _run(stream: DataFrame, path: str, mode: str = "append") -> None:
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data")
             .option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start())
    query.awaitTermination()


def run_finite(rows: DataFrame, keys: list[str], ts: str, job: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """``job`` over a stream that ends: what it writes once every row is closed.

    After all rows a second run of the same query reads one closing row without a key, which moves the
    watermark past all of them; it stays in the state itself, so nothing is written for it.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, tag)
    own = rows.select(*keys, F.col(ts).cast("timestamp").alias(ts))
    spark.createDataFrame([], own.schema).write.parquet(f"{path}/end")
    stream = job(own.unionByName(spark.readStream.schema(own.schema).parquet(f"{path}/end")))
    _run(stream, path)
    last = spark.range(1).select(*[F.lit(None).cast(own.schema[k].dataType).alias(k) for k in keys], F.lit(END).cast("timestamp").alias(ts))
    last.write.mode("append").parquet(f"{path}/end")
    _run(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def stream_ingest(records: DataFrame, sink: str) -> None:
    """Micro-batches of records to accepted, rejected, mention and edge tables.

    A batch writes its own ``batch`` folder, so a repeated batch replaces
    itself and the tables hold each record once.  It also adds what it knows of events and entities to
    two run stores, from which ``ingested_graph`` reads nodes over all batches.
    """
    spark = records.sparkSession

    def put(df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """The rows of a batch as written; what is derived from them reads the table and not the batch again."""
        path = f"{sink}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = guard_records(batch)
        put(rejected, "rejected", batch_id)
        observed = put(G.observations(put(accepted, "accepted", batch_id)), "observed", batch_id)
        mentioned = put(G.mentions(observed), "mentions", batch_id)
        put(G.actor_edges(observed), "actor_edges", batch_id)
        add_batch(G.event_parts(observed), f"{sink}/events", batch_id, G.merged_events)
        add_batch(G.entity_parts(mentioned), f"{sink}/entities", batch_id, G.merged_entities)

    query = records.writeStream.foreachBatch(write).option("checkpointLocation", f"{sink}/log").trigger(availableNow=True).start()
    query.awaitTermination()


def ingested_graph(spark: SparkSession, sink: str) -> G.EvidenceGraph:
    """The graph of all records ingested into ``sink``, equal to that of one batch over them.

    Nodes come from the merged parts: the first record names an entity and the last one describes an event, in source
    order and not in order of arrival.  Use counts go over all batches, and so do the edges that depend on them.
    """
    nodes = G.event_nodes_of(stored(spark, f"{sink}/events", G.merged_events, G.EVENT_PARTS)).unionByName(
        G.entity_nodes_of(stored(spark, f"{sink}/entities", G.merged_entities, G.ENTITY_PARTS)))
    read = lambda name: spark.read.parquet(f"{sink}/{name}").drop("batch")
    return G.EvidenceGraph(nodes, G.mention_edges(read("mentions")).unionByName(read("actor_edges")), True)


def stream_time_cells(events: DataFrame, key: str, ts: str, watermark: str = "10 minutes", cell: str = "10 minutes") -> DataFrame:
    """(key, at, times): the sorted times of each key and time cell, once the watermark has passed the cell; built-in functions only."""
    rows = events.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, watermark)
    cells = rows.groupBy(key, F.window(ts, cell).alias("cell")).agg(F.sort_array(F.collect_list(F.unix_micros(ts))).alias("times"))
    return cells.select(key, F.window_time("cell").alias("at"), "times")


def stream_limited(cells: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Flag each time of a stream of closed cells, which come in order; the state of a key is its last ``limit`` admitted times at most."""
    span = seconds * 1_000_000

    def decide(name: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        times, flags = [t for part in sorted([int(t) for t in part] for chunk in chunks for part in chunk["times"]) for t in part], []
        for t in times:
            held = [h for h in held if h >= t - span]
            flags.append(limit <= 0 or len(held) < limit)
            if flags[-1] and limit > 0:
                held.append(t)
        state.update((held,))
        yield pd.DataFrame({key: [name[0]] * len(times), ts: pd.Series(times, dtype="int64").astype("datetime64[us]"), "admitted": flags})

    share_package(cells.sparkSession)
    out = f"{key} {cells.schema[key].dataType.simpleString()}, {ts} timestamp, admitted boolean"
    return cells.select(key, "times").groupBy(key).applyInPandasWithState(decide, out, "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def run_rate_limit(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60, watermark: str = "10 minutes", cell: str = "10 minutes", finite: bool = False) -> DataFrame:
    """Flag each event as admitted or not: at most ``limit`` admitted per key and sliding window.

    Only admitted events count, so events are taken in event-time order once the watermark
    has passed them.  One query gathers them in time cells, one state value per key and cell, and appends closed cells to a
    table; a second one reads that table in the order in which cells closed and decides.  So no state value grows with
    the rows of a key, and neither the order of arrival nor the cut into batches matters.  ``finite``
    closes every cell at the end of the stream.
    """
    cells = lambda rows: stream_time_cells(rows, key, ts, watermark, cell)
    closed = run_finite(events, [key], ts, cells, "cells") if finite else run_to_table(cells(events), "cells")
    folder = closed.inputFiles()[0].rsplit("/", 1)[0] if not closed.isEmpty() else None
    if folder is None:
        return closed.select(key, F.col("at").alias(ts), F.lit(True).alias("admitted")).where("false")
    stream = events.sparkSession.readStream.schema(closed.schema).parquet(folder)
    return run_to_table(stream_limited(stream, key, ts, limit, seconds), "limited")


def stream_rate_windows(events: DataFrame, key: str, ts: str, limit: int, watermark: str = "1 minute") -> DataFrame:
    """The declarative form: keys whose count in any 60-second window exceeds the limit."""
    rows = events.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, watermark)
    counts = rows.groupBy(key, F.window(ts, "60 seconds", "10 seconds")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return counts.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def _last_at_most(times: Column, value: Column) -> Column:
    """Place of the last entry of a sorted array that is not above ``value``, by halving."""
    bits = F.ceil(F.log2(F.size(times) + 1)).cast("int")

    def halve(acc: Column, step: Column) -> Column:
        probe = acc + F.pow(F.lit(2), bits - 1 - step).cast("int")
        return F.when((probe <= F.size(times)) & (F.get(times, probe - 1) <= value), probe).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(bits - 1, F.lit(0))), F.lit(0), halve)


def stream_bursts(rows: DataFrame, keys: list[str], ts: str, seconds: int = 1800, minimum: int = 2, watermark: str = "10 minutes") -> DataFrame:
    """Every window that starts at a row and holds at least ``minimum`` rows of its key, both ends included.

    Time is cut into cells as wide as the window.  Two neighbouring cells hold all windows that start in the first, so
    one sliding aggregate over pairs of cells keeps a key's times, one state value per key and pair of cells, and
    emits its windows once the watermark has passed both.  Built-in functions only.
    """
    width = seconds * 1_000_000
    timed = rows.select(*keys, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, watermark)
    pairs = timed.groupBy(*keys, F.window(ts, f"{2 * seconds} seconds", f"{seconds} seconds").alias("cells")).agg(F.sort_array(F.collect_list(F.unix_micros(ts))).alias("times"))
    middle = F.unix_micros(F.col("cells.start")) + width
    places = F.filter(F.sequence(F.lit(1), F.size("times")), lambda i: (F.get("times", i - 1) < middle) & ((i == 1) | (F.get("times", F.greatest(i - 2, F.lit(0))) < F.get("times", i - 1))))
    found = F.transform(places, lambda i: F.struct(i.alias("first"), _last_at_most(F.col("times"), F.get("times", i - 1) + width).alias("last")))
    many = F.filter(found, lambda w: w["last"] - w["first"] + 1 >= minimum)
    windows = pairs.select(*keys, "times", F.explode(many).alias("w"))
    at = lambda c: F.timestamp_micros(F.get("times", F.col(f"w.{c}") - 1))
    return windows.select(*keys, at("first").alias("window_start"), at("last").alias("window_end"), (F.col("w.last") - F.col("w.first") + 1).cast("bigint").alias("n"))


def stream_emergence(rows: DataFrame, key: str, ts: str, store: str) -> DataFrame:
    """First-seen table (key, first) of all entities, by event time; late rows move a first time back.

    Each batch adds its own earliest times to a run store, so no state grows in memory, arrival order
    does not matter, a repeated batch replaces itself and no batch rewrites the table.
    """
    spark = rows.sparkSession
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, first timestamp"

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(key).agg(F.min("first").alias("first"))

    def add(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch.select(key, F.col(ts).cast("timestamp").alias("first")), f"{store}/runs", batch_id, merge)

    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{store}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stored(spark, f"{store}/runs", merge, schema)


def stream_dedupe(rows: DataFrame, key: str, ts: str, watermark: str = "1 day") -> DataFrame:
    """One row per record id within the late-data bound; later repeats are dropped."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
