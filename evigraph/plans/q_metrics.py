"""Counts, distributions, topology, filters and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import explore as X
from evigraph.operators import metrics as M
from evigraph.operators.graph import star_graph
from evigraph.operators.ranking import top_k_per_group
from evigraph.plans import evidence as E
from evigraph.plans.oracle_base import CRIME, CRIME_ADJ, EVENTS, MULTI, with_
from evigraph.plans.registry import query
from evigraph.session import scratch_path, tune

MADJ = """madj AS (SELECT DISTINCT * FROM (SELECT source AS node, target AS nbr FROM medges UNION ALL SELECT target, source FROM medges))"""


@query("n05_degree_top10", with_(MULTI, MADJ, """
SELECT row_number() OVER (ORDER BY degree DESC, risk DESC, name, id) AS rank, id, name, type, risk, degree, degree / (SELECT count(*) - 1 FROM mnodes) AS score
FROM (SELECT n.id, n.name, n.type, n.risk, count(a.nbr) AS degree FROM mnodes n LEFT JOIN madj a ON a.node = n.id GROUP BY ALL)
ORDER BY degree DESC, risk DESC, name, id LIMIT 10"""))
def n05_degree_top10(spark, sf_dir):
    g = E.event_graph(spark, sf_dir, provenance=False).staged(("id", "name", "type", "risk"), ("source", "target"))
    return M.rank_entities(g, M.degree_centrality(g), 10).select("rank", "id", "name", "type", "risk", "degree", "score")


@query("n01_adjacency", with_(CRIME_ADJ, "SELECT node, nbr FROM adj"))
def n01_adjacency(spark, sf_dir):
    return M.adjacency(E.crime_graph(spark, sf_dir))


@query("n03_modularity", with_(CRIME_ADJ, """
SELECT (SELECT count_if(a.community = b.community) / count(*) FROM cedges e JOIN cnodes a ON a.id = e.source JOIN cnodes b ON b.id = e.target)
  - (SELECT sum(d * d) FROM (SELECT sum(degree) AS d FROM deg JOIN cnodes USING (id) GROUP BY community))
    / (4.0 * (SELECT count(*) FROM cedges) * (SELECT count(*) FROM cedges)) AS modularity"""))
def n03_modularity(spark, sf_dir):
    return M.modularity(E.crime_shape(spark, sf_dir))


_DENSITY = """SELECT (SELECT count(*) FROM cnodes) AS nodes, (SELECT count(*) FROM cedges) AS edges,
  2 * (SELECT count(*) FROM cedges) / (SELECT count(*) FROM cnodes) AS average_degree,
  (SELECT count(*) FROM cedges) / ((SELECT count(*) FROM cnodes) * ((SELECT count(*) FROM cnodes) - 1) / 2) AS density,
  (SELECT max(degree) FROM deg) AS max_degree, (SELECT avg(risk) FROM cnodes) AS average_risk"""


@query("n04_density", with_(CRIME_ADJ, _DENSITY))
def n04_density(spark, sf_dir):
    return M.density(E.crime_shape(spark, sf_dir))


_REACH = """SELECT d.id, least(1.0, (d.degree + 0.35 * coalesce(s.around, 0)) / (2.0 * (SELECT max(degree) FROM deg))) AS reach
FROM deg d LEFT JOIN (SELECT node, sum(degree) AS around FROM adj JOIN deg ON deg.id = adj.nbr GROUP BY 1) s ON s.node = d.id"""


@query("n07_reach", with_(CRIME_ADJ, _REACH))
def n07_reach(spark, sf_dir):
    return M.local_topology(E.crime_shape(spark, sf_dir)).select("id", "reach")


@query("n09_key_individuals", with_(CRIME_ADJ, f"reach AS ({_REACH})", """
SELECT row_number() OVER (ORDER BY reach DESC, risk DESC, name, id) AS rank, id, name, type, risk, reach AS score FROM reach JOIN cnodes USING (id)
WHERE type = 'person' ORDER BY reach DESC, risk DESC, name, id LIMIT 20"""))
def n09_key_individuals(spark, sf_dir):
    return M.key_individuals(E.crime_shape(spark, sf_dir), metric="reach").select("rank", "id", "name", "type", "risk", "score")


@query("n13_case_neighbours", with_(CRIME, "SELECT target AS id, count(*) AS case_neighbours FROM cedges WHERE label = 'HAS_SUSPECT' GROUP BY 1"))
def n13_case_neighbours(spark, sf_dir):
    return M.case_neighbours(E.crime_graph(spark, sf_dir, repeats=False))


@query("a01_type_counts", with_(CRIME, "SELECT 'entity' AS kind, type AS name, count(*) AS n FROM cnodes GROUP BY 2 UNION ALL SELECT 'relationship', label, count(*) FROM cedges GROUP BY 2"))
def a01_type_counts(spark, sf_dir):
    return M.type_counts(E.crime_graph(spark, sf_dir))


@query("a02_risk_bands", with_(CRIME, """SELECT count_if(risk >= 85) AS critical, count_if(risk >= 70 AND risk < 85) AS high,
  count_if(risk >= 45 AND risk < 70) AS medium, count_if(risk < 45) AS low FROM cnodes"""))
def a02_risk_bands(spark, sf_dir):
    return M.risk_bands(E.crime_graph(spark, sf_dir))


@query("a03_degree_distribution", with_(CRIME_ADJ, "SELECT degree, count(*) AS nodes FROM deg GROUP BY 1"))
def a03_degree_distribution(spark, sf_dir):
    return M.degree_distribution(E.crime_graph(spark, sf_dir))


@query("a05_communities", with_(CRIME, """
SELECT community, count(*) AS size, avg(risk) AS average_risk, list(id ORDER BY rn) FILTER (rn <= 5) AS top_entities
FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY risk DESC, id) AS rn FROM cnodes) GROUP BY 1"""))
def a05_communities(spark, sf_dir):
    return M.community_rollup(E.crime_shape(spark, sf_dir))


@query("a06_risk_trend", with_(CRIME, """
SELECT strftime(CAST(last_seen AS TIMESTAMP), '%b') AS period, month(CAST(last_seen AS TIMESTAMP)) AS position, avg(risk) AS average_risk,
  count_if(risk >= 85) AS review_signals, count(*) AS incidents FROM cnodes WHERE type = 'event' GROUP BY 1, 2"""))
def a06_risk_trend(spark, sf_dir):
    return M.risk_trend(E.crime_graph(spark, sf_dir))


@query("a07_channel_counts", with_(EVENTS, "SELECT channel, count(*) AS n FROM ev GROUP BY 1"))
def a07_channel_counts(spark, sf_dir):
    return M.channel_counts(E.event_records(spark, sf_dir))


@query("a11_ingest_summary", with_(CRIME, """
SELECT 'entity:' || type AS measure, count(*) AS n FROM cnodes GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM cnodes
UNION ALL SELECT 'edges', count(*) FROM cedges UNION ALL SELECT 'risk_signals', count_if(risk >= 85) FROM cnodes"""))
def a11_ingest_summary(spark, sf_dir):
    return M.summarise_ingest(E.crime_graph(spark, sf_dir))


@query("a12_telemetry", """
SELECT 'total' AS section, 'all' AS name, count(*) AS n, avg(value) AS mean FROM events
UNION ALL SELECT 'status', event_type, count(*), avg(value) FROM events GROUP BY 2
UNION ALL (SELECT 'path', CAST(user_id AS VARCHAR) AS name, count(*) AS n, avg(value) FROM events GROUP BY 2 ORDER BY n DESC, name LIMIT 12)""")
def a12_telemetry(spark, sf_dir):
    return M.telemetry(E.table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query("a16_location_concentration", with_(CRIME_ADJ, """
SELECT row_number() OVER (ORDER BY degree DESC, risk DESC, name, id) AS rank, id, name, degree AS count, risk, 28 + a / 255.0 * 44 AS x, 14 + b / 255.0 * 70 AS y,
  42.02 - (b / 255.0 * 70) / 70 * 0.38 AS lat, -87.94 + (a / 255.0 * 44) / 44 * 0.42 AS lng, 'place in a grid, drawn from the id; no measured position' AS coordinate_basis
FROM (SELECT n.*, d.degree, CAST(('0x' || substr(sha256(n.id), 1, 2)) AS INT) AS a, CAST(('0x' || substr(sha256(n.id), 3, 2)) AS INT) AS b
  FROM cnodes n JOIN deg d USING (id) WHERE tags = 'police-beat') ORDER BY degree DESC, risk DESC, name, id LIMIT 30"""))
def a16_location_concentration(spark, sf_dir):
    return M.location_concentration(E.crime_shape(spark, sf_dir))


@query("a17_provenance_coverage", with_(MULTI, "SELECT count(*) AS edges, count_if(record_id <> '' AND digest <> '' AND channel <> '') AS covered, 100.0 * count_if(record_id <> '' AND digest <> '' AND channel <> '') / count(*) AS coverage FROM medges"))
def a17_provenance_coverage(spark, sf_dir):
    return M.provenance_coverage(E.event_graph(spark, sf_dir))


@query("w11_timeline", with_(CRIME, """
SELECT id, CAST(last_seen AS TIMESTAMP) AS occurred_at, split_part(description, ' — ', 1) AS title, description,
  CASE WHEN risk >= 85 THEN 'critical' WHEN risk >= 70 THEN 'high' WHEN risk >= 45 THEN 'medium' ELSE 'low' END AS severity, risk
FROM cnodes WHERE type = 'event'"""))
def w11_timeline(spark, sf_dir):
    return M.timeline(E.crime_graph(spark, sf_dir))[0]


@query("w11_timeline_entities", with_(CRIME_ADJ, """
SELECT a.node AS id, row_number() OVER (PARTITION BY a.node ORDER BY n.risk DESC, n.name, a.nbr) AS place, a.nbr, n.name, n.risk
FROM adj a JOIN cnodes n ON n.id = a.nbr WHERE a.node IN (SELECT id FROM cnodes WHERE type = 'event')"""))
def w11_timeline_entities(spark, sf_dir):
    return M.timeline(E.crime_shape(spark, sf_dir))[1]


@query("w12_rank", with_(CRIME_ADJ, """
SELECT row_number() OVER (ORDER BY degree DESC, risk DESC, name, id) AS rank, id, name, degree FROM deg JOIN cnodes USING (id)
ORDER BY degree DESC, risk DESC, name, id LIMIT 50"""))
def w12_rank(spark, sf_dir):
    g = E.crime_shape(spark, sf_dir)
    return M.rank_entities(g, M.simple_degrees(g), 50, score="degree").select("rank", "id", "name", "degree")


@query("t01_top_risk", with_(CRIME, "SELECT row_number() OVER (ORDER BY risk DESC, id) AS rank, id, name, type, risk FROM cnodes ORDER BY risk DESC, id LIMIT 25"))
def t01_top_risk(spark, sf_dir):
    return X.top_by_risk(E.crime_graph(spark, sf_dir))


@query("t03_top_per_group", """
SELECT c_mktsegment, rank, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5""")
def t03_top_per_group(spark, sf_dir):
    c = E.table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return top_k_per_group(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@query("f01_node_page", with_(CRIME, """
SELECT id, name, type, risk, (SELECT count(*) FROM cnodes WHERE type = 'person' AND risk >= 90) AS total FROM cnodes
WHERE type = 'person' AND risk >= 90 AND id > 'person_2' ORDER BY id LIMIT 250"""))
def f01_node_page(spark, sf_dir):
    page, total = X.page_nodes(E.crime_graph(spark, sf_dir), "person", 90, "person_2", 250)
    return page.select("id", "name", "type", "risk").join(F.broadcast(total))


@query("f02_edge_page", with_(CRIME, "SELECT id, source, target, label, (SELECT count(*) FROM cedges) AS total FROM cedges WHERE id > 'e2' ORDER BY id LIMIT 500"))
def f02_edge_page(spark, sf_dir):
    page, total = X.page_edges(E.crime_graph(spark, sf_dir), "e2", 500)
    return page.select("id", "source", "target", "label").join(F.broadcast(total))


@query("f03_node_detail", with_(CRIME, """
SELECT n.id, e.target AS other, e.id AS edge_id, e.label, e.confidence FROM cnodes n JOIN cedges e ON e.source = n.id WHERE n.type = 'vehicle'
UNION ALL SELECT n.id, e.source, e.id, e.label, e.confidence FROM cnodes n JOIN cedges e ON e.target = n.id WHERE n.type = 'vehicle' AND e.source <> e.target"""))
def f03_node_detail(spark, sf_dir):
    g = E.crime_graph(spark, sf_dir)
    return X.node_detail(g, g.nodes.filter("type = 'vehicle'").select("id"))


@query("f04_induced_subgraph", with_(CRIME, """, keep AS (SELECT id FROM cnodes WHERE type IN ('person', 'event') AND risk >= 80 AND lower(name) LIKE '%a%')
SELECT e.id, e.source, e.target, e.label FROM cedges e WHERE e.source IN (SELECT id FROM keep) AND e.target IN (SELECT id FROM keep)"""))
def f04_induced_subgraph(spark, sf_dir):
    sub = X.induced_subgraph(E.crime_graph(spark, sf_dir), ("person", "event"), 80, "A")
    return sub.edges.select("id", "source", "target", "label")


@query("f05_search", with_(CRIME, """
SELECT row_number() OVER (ORDER BY risk DESC, name, id) AS rank, id, name, type, risk FROM cnodes
WHERE lower(name) LIKE '%b ba%' AND risk >= 50 AND type IN ('person', 'vehicle') ORDER BY risk DESC, name, id LIMIT 50"""))
def f05_search(spark, sf_dir):
    return X.search(E.crime_graph(spark, sf_dir), "b Ba", ("person", "vehicle"), 50)


@query("f05_indexed_search", with_(CRIME, """
SELECT row_number() OVER (ORDER BY risk DESC, name, id) AS rank, id, name, type, risk FROM cnodes
WHERE lower(name) LIKE '%b ba%' AND risk >= 50 AND type IN ('person', 'vehicle') ORDER BY risk DESC, name, id LIMIT 50"""))
def f05_indexed_search(spark, sf_dir):
    """The same search from an index of the names' runs of three characters."""
    path = scratch_path(spark, "search-index")
    X.write_search_index(E.crime_graph(spark, sf_dir), path)
    return X.search_index(spark, path, "b Ba", ("person", "vehicle"), 50)


_EGO = """, focus AS (SELECT id FROM cnodes JOIN deg USING (id) WHERE type <> 'protected_person' ORDER BY risk DESC, degree DESC, name, id LIMIT 1),
h1 AS (SELECT nbr AS id FROM adj WHERE node IN (SELECT id FROM focus) EXCEPT SELECT id FROM focus),
h2 AS (SELECT nbr AS id FROM adj WHERE node IN (SELECT id FROM h1) EXCEPT (SELECT id FROM focus UNION ALL SELECT id FROM h1))
SELECT id, 0 AS hop FROM focus UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2"""


@query("f07_ego_network", with_(CRIME_ADJ, _EGO))
def f07_ego_network(spark, sf_dir):
    g = E.crime_shape(spark, sf_dir)
    return X.ego_network(g, X.default_focus(g))


@query("j01_valid_edges", """
SELECT CASE WHEN l.doc_id IS NULL THEN 'dangling' ELSE 'valid' END AS status, d.lang, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def j01_valid_edges(spark, sf_dir):
    tune(spark)
    # documents point to their label row; labels cover only some of them
    tables = {"documents": E.table(spark, sf_dir, "documents").select("doc_id", "lang"), "labels": E.table(spark, sf_dir, "labels")}
    g = star_graph(tables, (("documents", "doc_id", "lang", "event", "0"), ("labels", "doc_id", "quality", "crime", "0")),
                   (("documents", "doc_id", "doc_id", "labels", "HAS_LABEL", None),))
    valid, dangling = M.validate_endpoints(g)
    edges = valid.select(F.lit("valid").alias("status"), "source").unionByName(dangling.select(F.lit("dangling").alias("status"), "source"))
    return edges.join(g.nodes.select(F.col("id").alias("source"), F.col("name").alias("lang")), "source").groupBy("status", "lang").agg(
        F.count(F.lit(1)).alias("n"))
