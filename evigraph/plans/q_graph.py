"""Graph construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import graph as G
from evigraph.operators import metrics as M
from evigraph.plans import evidence as E
from evigraph.plans.oracle_base import CRIME, EVENTS, INCIDENTS, MULTI, OBSERVED, RISKS, STAR, TRADE, with_
from evigraph.plans.registry import query


def flat_nodes(df):
    return df.select("id", "name", "type", "risk", "confidence", "community", "last_seen",
                     F.concat_ws("|", "tags").alias("tags"))


def flat_edges(df):
    return df.select("id", "source", "target", "label", "confidence", "anomalous",
                     F.col("evidence_record_ids")[0].alias("record_id"), F.col("evidence_hashes")[0].alias("digest"), "observed_at")


@query("g01_crime_nodes", with_(CRIME, "SELECT id, name, type, risk, confidence, community, last_seen, tags, description, location FROM cnodes"))
def g01_crime_nodes(spark, sf_dir):
    return E.crime_graph(spark, sf_dir).nodes.select(
        "id", "name", "type", "risk", "confidence", "community", "last_seen", F.concat_ws("|", "tags").alias("tags"), "description", "location")


@query("g01_crime_edges", with_(CRIME, "SELECT * FROM cedges"))
def g01_crime_edges(spark, sf_dir):
    return flat_edges(E.crime_graph(spark, sf_dir).edges)


@query("g02_multisource_nodes", with_(MULTI, "SELECT * FROM mnodes"))
def g02_multisource_nodes(spark, sf_dir):
    return flat_nodes(E.event_graph(spark, sf_dir).nodes)


@query("g02_multisource_edges", with_(MULTI, "SELECT * FROM medges"))
def g02_multisource_edges(spark, sf_dir):
    return flat_edges(E.event_graph(spark, sf_dir).edges).withColumn(
        "channel", F.when(F.col("record_id").startswith("CALL"), "CDR").when(F.col("record_id").startswith("TX"), "BANK")
        .when(F.col("record_id").startswith("ANPR"), "ANPR").when(F.col("record_id").startswith("SURV"), "SURVEILLANCE").otherwise("OSINT"))


@query("g03_schema_dispatch", with_(CRIME, MULTI, """
SELECT 'nodes' AS part, type, count(*) AS n FROM (SELECT id, type FROM cnodes UNION SELECT id, type FROM mnodes) GROUP BY type
UNION ALL SELECT 'edges', label, count(*) FROM (SELECT label FROM cedges UNION ALL SELECT label FROM medges) GROUP BY label"""))
def g03_schema_dispatch(spark, sf_dir):
    """Incidents and events in one table: every record by its own schema."""
    g = G.build_graph(mixed_records(spark, sf_dir))
    count = F.count(F.lit(1)).alias("n")
    nodes = g.nodes.groupBy("type").agg(count).select(F.lit("nodes").alias("part"), "type", "n")
    return nodes.unionByName(g.edges.groupBy("label").agg(count).select(F.lit("edges").alias("part"), F.col("label").alias("type"), "n"))


def mixed_records(spark, sf_dir):
    """An event comes first, then incidents and events as their keys fall."""
    return E.event_records(spark, sf_dir).unionByName(E.incident_records(spark, sf_dir))


@query("g04_first_writer", with_(EVENTS, OBSERVED, "SELECT type, key, name, risk, observed_at, uses FROM ent"))
def g04_first_writer(spark, sf_dir):
    m = G.mentions(G.observations(E.event_records(spark, sf_dir)))
    return G.first_writer(m, ["type", "key"], F.col("seq") * 16 + F.col("role"), ["name", "risk", "observed_at"],
                          uses=F.count(F.lit(1)))


@query("g05_repeat_counts", with_(EVENTS, OBSERVED, "SELECT type, key, uses FROM ent"))
def g05_repeat_counts(spark, sf_dir):
    return G.repeat_counts(G.mentions(G.observations(E.event_records(spark, sf_dir))), ["type", "key"])


@query("g06_mean_risk_per_beat", with_(INCIDENTS, RISKS, "SELECT beat, CAST(round_even(avg(risk), 0) AS INT) AS mean_risk FROM rec GROUP BY 1"))
def g06_mean_risk_per_beat(spark, sf_dir):
    return G.mean_risk(G.crime_rows(E.incident_records(spark, sf_dir)), "beat")


@query("g07_actor_edges", with_(MULTI, "SELECT id, source, target, label, anomalous, observed_at FROM medges WHERE label IN ('CALLED', 'TRANSFERRED_TO')"))
def g07_actor_edges(spark, sf_dir):
    edges = G.actor_edges(G.observations(E.event_records(spark, sf_dir)))
    return edges.select("id", "source", "target", "label", "anomalous", "observed_at")


@query("g08_edge_provenance", with_(MULTI, """
SELECT label, channel, count(*) AS edges, count(DISTINCT record_id) AS records, count(DISTINCT digest) AS digests,
  count_if(anomalous) AS anomalous, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM medges GROUP BY 1, 2"""))
def g08_edge_provenance(spark, sf_dir):
    edges = E.event_graph(spark, sf_dir).edges
    return edges.groupBy("label", F.col("source_types")[0].alias("channel")).agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct(F.col("evidence_record_ids")[0]).alias("records"),
        F.countDistinct(F.col("evidence_hashes")[0]).alias("digests"), F.count_if("anomalous").alias("anomalous"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


@query("g09_protection", with_(MULTI, """
SELECT n.type, count(DISTINCT n.id) AS nodes, CAST(max(n.risk) AS INT) AS max_risk, count(e.id) AS edges, count_if(coalesce(e.anomalous, false)) AS anomalous
FROM mnodes n LEFT JOIN medges e ON e.target = n.id WHERE n.type <> 'event' GROUP BY 1"""))
def g09_protection(spark, sf_dir):
    g = E.event_graph(spark, sf_dir)
    joined = g.nodes.filter("type <> 'event'").select("id", "type", "risk").join(
        g.edges.select(F.col("id").alias("edge_id"), F.col("target").alias("id"), "anomalous"), "id", "left")
    return joined.groupBy("type").agg(
        F.countDistinct("id").alias("nodes"), F.max("risk").alias("max_risk"), F.count("edge_id").alias("edges"),
        F.count_if(F.coalesce("anomalous", F.lit(False))).alias("anomalous"))


@query("g09_unprotected_view", with_(MULTI, """
SELECT n.type, count(DISTINCT n.id) AS nodes, count(e.id) AS edges FROM mnodes n LEFT JOIN medges e ON e.target = n.id
WHERE n.type <> 'protected_person' GROUP BY 1"""))
def g09_unprotected_view(spark, sf_dir):
    g = G.apply_protection(E.event_graph(spark, sf_dir))
    return g.nodes.select("id", "type").join(g.edges.select(F.col("id").alias("edge_id"), F.col("target").alias("id")), "id", "left").groupBy("type").agg(
        F.countDistinct("id").alias("nodes"), F.count("edge_id").alias("edges"))


_SIMPLE = with_(INCIDENTS, """links AS (
  SELECT case_number AS a, suspect_name AS b, 'PERPETRATED_BY' AS relationship FROM inc WHERE suspect_name <> ''
  UNION ALL SELECT suspect_name, vehicle_plate, 'DRIVES_VEHICLE' FROM inc WHERE suspect_name <> '' AND vehicle_plate <> ''
  UNION ALL SELECT case_number, primary_type, 'OFFENSE_TYPE' FROM inc
  UNION ALL SELECT case_number, block, 'OCCURRED_AT' FROM inc
  UNION ALL SELECT case_number, 'Beat ' || beat, 'OCCURRED_IN_BEAT' FROM inc)""",
  "SELECT least(a, b) AS source, greatest(a, b) AS target, min(relationship) AS relationship FROM links GROUP BY 1, 2")


@query("g10_simple_graph", _SIMPLE)
def g10_simple_graph(spark, sf_dir):
    return G.simple_typed_graph(E.incident_records(spark, sf_dir)).edges


@query("g11_star_edges", with_(STAR, "SELECT id, source, target, label FROM sedges"))
def g11_star_edges(spark, sf_dir):
    return E.star_graph(spark, sf_dir).edges.select("id", "source", "target", "label")


@query("g11_star_nodes", with_(STAR, "SELECT id, name, type, risk FROM snodes"))
def g11_star_nodes(spark, sf_dir):
    return E.star_graph(spark, sf_dir).nodes.select("id", "name", "type", "risk")


@query("g11_trade_nodes", with_(TRADE, "SELECT id, name, type, risk FROM tnodes"))
def g11_trade_nodes(spark, sf_dir):
    return E.trade_graph(spark, sf_dir).nodes.select("id", "name", "type", "risk")


@query("g11_trade_edges", with_(TRADE, "SELECT id, source, target, label FROM tedges"))
def g11_trade_edges(spark, sf_dir):
    return E.trade_graph(spark, sf_dir).edges.select("id", "source", "target", "label")


@query("g11_trade_degrees", with_(TRADE, """adj AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT source AS node, target AS nbr FROM tedges UNION ALL SELECT target, source FROM tedges))""", """SELECT id, type, count(nbr) AS degree FROM tnodes LEFT JOIN adj ON node = id WHERE type IN ('item', 'organization') GROUP BY ALL"""))
def g11_trade_degrees(spark, sf_dir):
    """Order lines per part, and order lines and nations per supplier: graph operators work on any such mapping."""
    g = E.trade_graph(spark, sf_dir, closed=True)
    kept = g.nodes.filter(F.col("type").isin("item", "organization")).select("id", "type")
    degrees = M.adjacency(g, ids=kept).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return kept.join(degrees.withColumnRenamed("node", "id"), "id", "left").select("id", "type", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
