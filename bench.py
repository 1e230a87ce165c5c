"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from evigraph.operators import explore, graph, iterate  # noqa: E402
from evigraph.plans import catalogue  # noqa: E402
from evigraph.plans import evidence as E  # noqa: E402
from evigraph.session import cut, drop_staged, scratch_path, tune  # noqa: E402
from evigraph.sources import readers  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMED = ("n05_degree_top10", "w01_densest_window", "w02_communication_burst", "w04_circular_funds", "w05_convergence",
         "n02_components", "h02_sealed_chain", "p01_extract_strict", "g01_crime_edges", "n06_betweenness", "n08_influence",
         "j04_hypotheses", "m05_masking", "w08_emergence")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("evigraph-bench").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        return out

    def medians(name, fn, runs):
        taken = []
        for _ in range(runs):
            timed(name, fn)
            taken.append(times[name])
        times[name] = statistics.median(taken)

    # the driver writes each table as one file of one row group, which one task would read: lay them out in as many files as there are cores, once
    laid = f"{scratch_path(spark, 'bench')}"

    def layout():
        for name in TABLES:
            spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS)).write.parquet(f"{laid}/{name}.parquet")

    start = time.perf_counter()
    layout()
    layout_seconds = round(time.perf_counter() - start, 3)

    # the published scale job: call records to graph, then name search and path search on it
    calls = readers.call_records(E.table(spark, laid, "events").select(F.col("event_id").alias("i")))
    g = timed("build_call_graph", lambda: graph.build_multisource_graph(calls).staged())
    index = scratch_path(spark, "search-index")
    timed("write_search_index", lambda: explore.write_search_index(g, index))
    # the published search times are medians
    medians("name_search_index", lambda: explore.search_index(spark, index, "bench-01234", limit=20).collect(), 7)
    medians("name_search", lambda: explore.search(g, "bench-01234", limit=20).collect(), 7)
    pair = cut(g.edges.filter("label = 'CALLED'").orderBy("id").limit(1).select(F.lit("p").alias("pair_id"), "source", "target"), "pair")
    medians("path_search", lambda: iterate.connection_paths(g, pair, 4)[0].collect(), 3)
    nodes, edges = g.nodes.count(), g.edges.count()
    drop_staged(spark)
    for name in NAMED:
        timed(name, lambda n=name: catalogue.QUERIES[n](spark, laid).write.format("noop").mode("overwrite").save())
        drop_staged(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR,
                      "cpus": int(CPUS), "layout_seconds": layout_seconds, "graph": {"nodes": nodes, "edges": edges}}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
