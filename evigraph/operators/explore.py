"""Filters, search, paging, top lists and ego networks."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.graph import EvidenceGraph
from evigraph.operators.metrics import adjacency, simple_degrees
from evigraph.operators.ranking import rank_by
from evigraph.session import cut


def node_filter(types=(), min_risk: int = 0, query: str = "") -> Column:
    keep = F.col("risk") >= min_risk
    if types:
        keep = keep & F.col("type").isin(*types)
    if query:
        keep = keep & F.lower("name").contains(query.lower())
    return keep


def _page(df: DataFrame, after: str | None, limit: int) -> DataFrame:
    return (df.filter(F.col("id") > after) if after is not None else df).orderBy("id").limit(limit)


def page_nodes(g: EvidenceGraph, entity_type: str | None = None, min_risk: int = 0, after: str | None = None, limit: int = 250):
    """The page that follows the id ``after`` in id order, and the total as a one-row frame.

    A page is found by key, so it costs the same wherever it lies.
    """
    kept = g.nodes.filter(node_filter([entity_type] if entity_type else (), min_risk))
    return _page(kept, after, limit), kept.agg(F.count(F.lit(1)).alias("total"))


def page_edges(g: EvidenceGraph, after: str | None = None, limit: int = 500):
    return _page(g.edges, after, limit), g.edges.agg(F.count(F.lit(1)).alias("total"))


def node_detail(g: EvidenceGraph, node_ids: DataFrame) -> DataFrame:
    """Incident edges of the given ids (column ``id``), one row per (node, edge)."""
    e = g.edges.select(F.col("id").alias("edge_id"), "source", "target", "label", "confidence")
    out = e.join(node_ids.select(F.col("id").alias("source")), "source").select(F.col("source").alias("id"), F.col("target").alias("other"), "edge_id", "label", "confidence")
    into = e.filter("source <> target").join(node_ids.select(F.col("id").alias("target")), "target").select(
        F.col("target").alias("id"), F.col("source").alias("other"), "edge_id", "label", "confidence")
    return out.unionByName(into)


def induced_subgraph(g: EvidenceGraph, types=(), min_risk: int = 0, query: str = "", limit: int | None = None) -> EvidenceGraph:
    kept = g.nodes.filter(node_filter(types, min_risk, query))
    return g.restrict(kept.orderBy("id").limit(limit) if limit else kept)


def search(g: EvidenceGraph, query: str = "", types=(), min_risk: int = 0, limit: int = 50) -> DataFrame:
    return rank_by(g.nodes.filter(node_filter(types, min_risk, query)).select("id", "name", "type", "risk"),
                   [F.desc("risk"), F.asc("name"), F.asc("id")], limit)


def _grams(name: Column) -> Column:
    text = F.lower(name)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substr(text, i, F.lit(3))))


def write_search_index(g: EvidenceGraph, path: str, buckets: int = 64) -> None:
    """Names by their runs of three characters: postings in ``buckets`` folders, each sorted by run, and a count per run.

    A search then reads one folder's row groups of one run, however many nodes there are.
    """
    rows = g.nodes.select("id", "name", "type", "risk", F.explode(_grams(F.col("name"))).alias("gram"))
    rows = rows.withColumn("bucket", F.pmod(F.crc32(F.encode("gram", "utf-8")), F.lit(buckets)))
    rows.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def search_index(spark: SparkSession, path: str, query: str, types=(), min_risk: int = 0, limit: int = 50, buckets: int = 64) -> DataFrame:
    """The rows of ``search`` for a query of three characters or more, from an index.

    The rarest run of the query picks the postings; the name itself decides.
    """
    text = query.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    if not grams:
        raise ValueError("an indexed search needs three characters or more")
    held = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(grams)).collect()}  # at most the query's runs
    gram = min(grams, key=lambda x: (held.get(x, 0), x))
    schema = "id string, name string, type string, risk int, gram string"
    if held.get(gram):
        rows = spark.read.schema(schema).parquet(f"{path}/postings/bucket={zlib.crc32(gram.encode()) % buckets}").filter(F.col("gram") == gram)
    else:  # a run that no name has
        rows = spark.createDataFrame([], schema)
    return rank_by(rows.filter(node_filter(types, min_risk, query)).select("id", "name", "type", "risk"), [F.desc("risk"), F.asc("name"), F.asc("id")], limit)


def filter_alerts(alerts: DataFrame, acknowledged: bool | None = None, severities=(), query: str = "") -> DataFrame:
    out = alerts
    if acknowledged is not None:
        out = out.filter(F.col("acknowledged") == acknowledged)
    if severities:
        out = out.filter(F.col("severity").isin(*severities))
    if query:
        out = out.filter(F.lower(F.concat_ws(" ", "title", "detail")).contains(query.lower()))
    return out


def top_by_risk(g: EvidenceGraph, k: int = 25) -> DataFrame:
    return rank_by(g.nodes.select("id", "name", "type", "risk"), [F.desc("risk"), F.asc("id")], k)


def default_focus(g: EvidenceGraph) -> DataFrame:
    """One row: the unprotected node highest by risk, degree and name."""
    open_nodes = g.nodes.filter(F.col("type") != "protected_person").select("id", "risk", "name")
    return open_nodes.join(simple_degrees(g), "id").orderBy(F.desc("risk"), F.desc("degree"), "name", "id").limit(1)


def ego_network(g: EvidenceGraph, seeds: DataFrame, hops: int = 2, cap: int | None = None) -> DataFrame:
    """(id, hop) of all nodes within ``hops`` of the seeds.

    ``cap`` keeps a display-sized top list by hop, risk and id.
    """
    adj = adjacency(g)
    found = cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "ego")
    for hop in range(1, hops + 1):
        frontier = found.filter(F.col("hop") == hop - 1).select(F.col("id").alias("node"))
        reached = adj.join(frontier, "node", "left_semi").select(F.col("nbr").alias("id")).distinct()
        fresh = reached.join(found.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        found = cut(found.unionByName(fresh), "ego")
    if cap is None:
        return found
    risk = g.nodes.select("id", "risk")
    return found.join(risk, "id").orderBy("hop", F.desc("risk"), "id").limit(cap).select("id", "hop")
