"""Iterative, hypothesis, integrity, feature and product queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions import scalars as S
from evigraph.operators import explore as X
from evigraph.operators import features as L
from evigraph.operators import hypotheses as Y
from evigraph.operators import integrity as H
from evigraph.operators import iterate as I
from evigraph.operators import metrics as M
from evigraph.operators import products as B
from evigraph.operators.graph import EvidenceGraph
from evigraph.plans import evidence as E
from evigraph.plans.oracle_base import CRIME, CRIME_ADJ, EVENTS, INCIDENTS, MULTI, OBSERVED, RISKS, STAR, with_
from evigraph.plans.registry import query
from evigraph.session import cut, tune

COMPONENTS = """where_ AS (SELECT 'region:' || r_regionkey AS id, r_regionkey AS r FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'orders:' || o_orderkey, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


@query("n02_components", with_(COMPONENTS, "SELECT id AS node, min(id) OVER (PARTITION BY r) AS component FROM where_"))
def n02_components(spark, sf_dir):
    return I.connected_components(E.star_graph(spark, sf_dir))


@query("a04_structure", with_(STAR, COMPONENTS, """
SELECT (SELECT count(*) FROM snodes) AS nodes, (SELECT count(*) FROM sedges) AS edges, 2 * (SELECT count(*) FROM sedges) / (SELECT count(*) FROM snodes) AS average_degree,
  (SELECT count(*) FROM sedges) / ((SELECT count(*) FROM snodes) * ((SELECT count(*) FROM snodes) - 1) / 2) AS density,
  (SELECT max(degree) FROM sdeg) AS max_degree, (SELECT avg(risk) FROM snodes) AS average_risk,
  (SELECT count_if(a.tag = b.tag) / count(*) FROM sedges e JOIN snodes a ON a.id = e.source JOIN snodes b ON b.id = e.target)
  - (SELECT sum(d * d) FROM (SELECT sum(degree) AS d FROM sdeg JOIN snodes USING (id) GROUP BY tag)) / (4.0 * (SELECT count(*) FROM sedges) * (SELECT count(*) FROM sedges)) AS modularity,
  (SELECT count(DISTINCT r) FROM where_) AS components"""))
def a04_structure(spark, sf_dir):
    g = E.star_graph(spark, sf_dir).staged()
    g = EvidenceGraph(g.nodes.withColumn("community", F.element_at("tags", 1)), g.edges, True)
    return M.structure_metrics(g, I.connected_components(g))


def brandes_sql(nodes: str, adj: str, sources: int = 32, depth: int = 12) -> str:
    """CTEs that end in ``between`` (node, score): level by level from the sources, then back."""
    parts = [f"bn AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS total FROM {nodes})",
             f"l0 AS MATERIALIZED (SELECT DISTINCT id AS src, id AS node, 1.0::DOUBLE AS sigma FROM bn, range({sources}) t(i) WHERE rn = least(total - 1, CAST(floor(i * (total / {sources})) AS BIGINT)) + 1)",
             f"a0 AS MATERIALIZED (SELECT node, nbr FROM {adj} WHERE node <> nbr)"]
    for d in range(1, depth + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{o} o WHERE o.src = x.src AND o.node = x.node)" for o in range(max(0, d - 2), d))
        parts.append(f"l{d} AS MATERIALIZED (SELECT * FROM (SELECT src, nbr AS node, sum(sigma) AS sigma FROM l{d - 1} JOIN a0 USING (node) GROUP BY 1, 2) x WHERE {seen})")
    parts.append(f"d{depth} AS MATERIALIZED (SELECT src, node, sigma, 0.0::DOUBLE AS delta FROM l{depth})")
    for d in range(depth - 1, 0, -1):
        parts.append(f"d{d} AS MATERIALIZED (SELECT l.src, l.node, l.sigma, l.sigma * coalesce(sum((1 + w.delta) / w.sigma), 0) AS delta FROM l{d} l JOIN a0 ON a0.node = l.node LEFT JOIN d{d + 1} w ON w.src = l.src AND w.node = a0.nbr GROUP BY 1, 2, 3)")
    union = " UNION ALL ".join(f"SELECT node, delta FROM d{d}" for d in range(1, depth + 1))
    parts.append(f"sums AS (SELECT node, sum(delta) AS s FROM ({union}) GROUP BY 1)")
    parts.append("between_ AS MATERIALIZED (SELECT id AS node, CASE WHEN (SELECT max(s) FROM sums) > 0 THEN coalesce(s, 0) / (SELECT max(s) FROM sums) ELSE 0 END AS score FROM bn LEFT JOIN sums ON sums.node = bn.id)")
    return ",\n".join(parts)


@query("n06_betweenness", with_(CRIME_ADJ, brandes_sql("cnodes", "adj"), "SELECT node, round(score, 9) AS score FROM between_"))
def n06_betweenness(spark, sf_dir):
    return I.sampled_betweenness(E.crime_shape(spark, sf_dir)).select("node", F.round("score", 9).alias("score"))


@query("n08_influence", with_(STAR, brandes_sql("snodes", "sadj"), """top_ AS (SELECT max(degree) AS peak, count(*) AS n FROM sdeg),
around AS (SELECT a.node, sum(d.degree) AS around FROM sadj a JOIN sdeg d ON d.id = a.nbr GROUP BY 1),
t AS (SELECT n.id, n.name, n.type, n.risk, d.degree, d.degree / greatest(1, top_.n - 1) AS degree_centrality, least(1.0, (d.degree + coalesce(around, 0) * 0.35) / greatest(1, peak * 2)) AS reach,
  d.degree / peak AS scaled, score AS betweenness FROM snodes n JOIN sdeg d USING (id) JOIN between_ b ON b.node = n.id LEFT JOIN around ON around.node = n.id, top_)""", """
SELECT row_number() OVER (ORDER BY score DESC, risk DESC, name, id) AS rank, * FROM (SELECT id, name, type, risk, round(0.45 * scaled + 0.40 * betweenness + 0.15 * reach, 9) AS score, degree, round(degree_centrality, 9) AS degree_centrality,
  round(betweenness, 9) AS betweenness, round(reach, 9) AS reach FROM t) ORDER BY rank LIMIT 20"""))
def n08_influence(spark, sf_dir):
    g = E.star_graph(spark, sf_dir).staged()
    top = M.centrality(g, I.sampled_betweenness(g), "influence", 20)
    return top.select("rank", "id", "name", "type", "risk", "degree", *[F.round(c, 9).alias(c) for c in ("score", "degree_centrality", "betweenness", "reach")])


def beat_pairs(g):
    """Each beat and the next one in number, the last with the first."""
    beats = g.nodes.filter(F.array_contains("tags", "police-beat")).select("id", F.regexp_extract("name", "([0-9]+)$", 1).cast("int").alias("beat"))
    ranked = beats.withColumns({"n": F.row_number().over(Window.orderBy("beat")), "size": F.count(F.lit(1)).over(Window.partitionBy())})  # one row per police beat
    return ranked.join(ranked.select(F.col("id").alias("target"), (F.when(F.col("n") == 1, F.col("size")).otherwise(F.col("n") - 1)).alias("n")), "n").select(F.col("beat").cast("string").alias("pair_id"), F.col("id").alias("source"), "target")


def paths_sql(hops: int) -> str:
    """CTEs that end in ``goal`` (pair_id, cost, hop) and ``steps`` (pair_id, step, from_id, to_id, edge_id, confidence, forward): cheapest labels hop by hop with the choice rule of the contract.

    Nodes and edges are numbered in the order of their ids, so that labels are numbers.
    """
    label = "struct_pack(cost := l.cost + h.w, prev := l.node, edge := h.edge, confidence := h.confidence, forward := h.forward)"
    parts = ["nn_ AS MATERIALIZED (SELECT id, name, tags, row_number() OVER (ORDER BY id) AS i FROM cnodes)",
             """beat_ AS MATERIALIZED (SELECT i, CAST(regexp_extract(name, '([0-9]+)$', 1) AS INT) AS beat, row_number() OVER (ORDER BY CAST(regexp_extract(name, '([0-9]+)$', 1) AS INT)) AS n, count(*) OVER () AS size FROM nn_ WHERE tags = 'police-beat'),
asked AS MATERIALIZED (SELECT CAST(a.beat AS VARCHAR) AS pair_id, a.i AS source, b.i AS target FROM beat_ a JOIN beat_ b ON b.n = CASE WHEN a.n = a.size THEN 1 ELSE a.n + 1 END)""",
             """ee_ AS MATERIALIZED (SELECT e.id, row_number() OVER (ORDER BY e.id) AS edge, confidence, a.i AS source, b.i AS target FROM cedges e JOIN nn_ a ON a.id = e.source JOIN nn_ b ON b.id = e.target WHERE e.source <> e.target),
hops_ AS MATERIALIZED (SELECT edge, confidence, 200 - confidence AS w, source AS node, target AS nbr, true AS forward FROM ee_ UNION ALL SELECT edge, confidence, 200 - confidence, target, source, false FROM ee_)""",
             "p0 AS MATERIALIZED (SELECT pair_id, source AS node, 0::BIGINT AS cost, NULL::BIGINT AS prev, NULL::BIGINT AS edge, NULL::INT AS confidence, NULL::BOOLEAN AS forward, target FROM asked)"]
    for h in range(1, hops + 1):
        known = " UNION ALL ".join(f"SELECT pair_id, node, cost FROM p{i}" for i in range(h))
        parts.append(f"""s{h} AS MATERIALIZED (SELECT l.pair_id, h.nbr AS node, min({label}) AS s, any_value(l.target) AS target FROM p{h - 1} l JOIN hops_ h ON h.node = l.node WHERE l.node <> l.target GROUP BY 1, 2),
k{h} AS MATERIALIZED (SELECT pair_id, node, min(cost) AS cost FROM ({known}) GROUP BY 1, 2),
p{h} AS MATERIALIZED (SELECT x.pair_id, x.node, x.s.cost AS cost, x.s.prev AS prev, x.s.edge AS edge, x.s.confidence AS confidence, x.s.forward AS forward, x.target FROM s{h} x LEFT JOIN k{h} k ON k.pair_id = x.pair_id AND k.node = x.node
  LEFT JOIN k{h} b ON b.pair_id = x.pair_id AND b.node = x.target WHERE (k.cost IS NULL OR x.s.cost < k.cost) AND (b.cost IS NULL OR x.s.cost < b.cost))""")
    hits = " UNION ALL ".join(f"SELECT pair_id, cost, {i} AS hop, target FROM p{i} WHERE node = target" for i in range(hops + 1))
    parts.append(f"goal AS MATERIALIZED (SELECT pair_id, min(struct_pack(cost := cost, hop := hop)) AS g, any_value(target) AS target FROM ({hits}) GROUP BY 1)")
    # back from the goal: a label of one hop names the node of the hop before
    for h in range(hops, 0, -1):
        after = f" UNION ALL SELECT pair_id, prev FROM w{h + 1}" if h < hops else ""
        parts.append(f"w{h} AS MATERIALIZED (SELECT p.* FROM (SELECT pair_id, target AS node FROM goal WHERE g.hop = {h}{after}) c JOIN p{h} p ON p.pair_id = c.pair_id AND p.node = c.node)")
    steps = " UNION ALL ".join(f"SELECT {h} AS step, * FROM w{h}" for h in range(1, hops + 1))
    parts.append(f"""steps AS MATERIALIZED (SELECT pair_id, step, a.id AS from_id, b.id AS to_id, e.id AS edge_id, s.confidence, forward FROM ({steps}) s JOIN nn_ a ON a.i = s.prev JOIN nn_ b ON b.i = s.node JOIN ee_ e ON e.edge = s.edge)""")
    return ",\n".join(parts)


_PATHS = (CRIME, paths_sql(4))


@query("n10_paths", with_(*_PATHS, """SELECT a.pair_id, x.id AS source, y.id AS target, g IS NOT NULL AS found, g.hop AS hops, g.cost / 100.0 AS cost, CASE WHEN g IS NOT NULL THEN round(100.0 * coalesce(p, 1), 6) END AS path_confidence,
  CASE WHEN g IS NULL THEN 'no-observed-path' ELSE 'observed-path' END AS epistemic_status FROM asked a JOIN nn_ x ON x.i = a.source JOIN nn_ y ON y.i = a.target LEFT JOIN goal USING (pair_id)
LEFT JOIN (SELECT pair_id, product(confidence / 100.0) AS p FROM steps GROUP BY 1) USING (pair_id)"""))
def n10_paths(spark, sf_dir):
    g = E.crime_paths(spark, sf_dir)
    return I.connection_paths(g, beat_pairs(g), 4)[0].drop("receipt").withColumn("path_confidence", F.round("path_confidence", 6))


@query("n10_path_steps", with_(*_PATHS, """SELECT pair_id, step, from_id, to_id, edge_id, CASE WHEN forward THEN 'forward' ELSE 'reverse traversal' END AS direction, e.label AS relationship, e.record_id FROM steps JOIN cedges e ON e.id = edge_id"""))
def n10_path_steps(spark, sf_dir):
    g = E.crime_paths(spark, sf_dir)
    steps = I.connection_paths(g, beat_pairs(g), 4)[1]
    return steps.select("pair_id", "step", "from_id", "to_id", "edge_id", "direction", "relationship", F.col("evidence_record_ids")[0].alias("record_id"))


@query("n11_traces", with_(CRIME, """
SELECT v.id, e.id AS edge_id, o.id AS nbr, o.name AS nbr_name, o.type AS nbr_type, label, e.confidence, record_id, digest
FROM cnodes v JOIN cedges e ON v.id IN (e.source, e.target) JOIN cnodes o ON o.id = CASE WHEN e.source = v.id THEN e.target ELSE e.source END WHERE v.type = 'person'"""))
def n11_traces(spark, sf_dir):
    g = E.crime_graph(spark, sf_dir, repeats=False)
    t = Y.entity_trace(g, g.nodes.filter("type = 'person'").select("id"))
    return t.select("id", "edge_id", "nbr", "nbr_name", "nbr_type", "label", "confidence", F.col("evidence_record_ids")[0].alias("record_id"),
                    F.col("evidence_hashes")[0].alias("digest"))


@query("n12_counterfactuals", with_(CRIME, """k AS (
  SELECT n.id, n.type, n.risk, n.tags, n.description, count(e.id) AS cases FROM cnodes n LEFT JOIN (SELECT e.target AS t, e.id FROM cedges e WHERE e.source LIKE 'case_%') e ON e.t = n.id GROUP BY ALL),
o AS (SELECT id, risk, 'the name turns out to be shared by several people' AS change, least(12, 4 * (cases - 1)) AS pts FROM k WHERE type = 'person' AND cases > 1
  UNION ALL SELECT id, risk, 'no weapon was involved', 7 FROM k WHERE type = 'event' AND upper(description) LIKE '%HANDGUN%'
  UNION ALL SELECT id, risk, 'an arrest was made', 4 FROM k WHERE type = 'event' AND tags LIKE '%open%'
  UNION ALL SELECT id, risk, 'the case is not domestic', 5 FROM k WHERE type = 'event' AND tags LIKE '%domestic%'
  UNION ALL SELECT id, risk, 'cases were put at this place twice', least(10, 3 * (cases - 1)) FROM k WHERE type = 'location' AND cases > 1)""", """
SELECT id, change, -pts AS delta, greatest(0, risk - pts) AS risk_after, CASE WHEN change LIKE 'the name%' THEN 'identifiers that only one person can have, in the original reports' WHEN change LIKE 'cases were%' THEN 'addresses, area borders and repeated case numbers' ELSE 'the source report has the corrected field' END AS required_verification FROM o
UNION ALL SELECT id, 'no rule changes this score', 0, risk, 'the connected source records' FROM k WHERE id NOT IN (SELECT id FROM o)"""))
def n12_counterfactuals(spark, sf_dir):
    return Y.counterfactuals(E.crime_shape(spark, sf_dir))


@query("j02_predictions", with_(CRIME, """nm AS MATERIALIZED (SELECT id, name, type FROM cnodes),
pred AS MATERIALIZED (SELECT o_orderkey, case_number AS node1, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE suspect_name END AS node2, o_totalprice / 500000 AS p
  FROM inc JOIN orders ON o_orderkey = seq JOIN customer ON c_custkey = o_custkey WHERE suspect_name <> '')""", """
SELECT node1, node2, a.id AS source_id, a.type AS source_type, coalesce(b.id, node2) AS target_id, coalesce(b.type, 'person') AS target_type, p AS link_probability, p >= 0.5 AS predicted_link
FROM pred JOIN nm a ON a.name = 'Case ' || node1 LEFT JOIN nm b ON b.name = node2"""))
def j02_predictions(spark, sf_dir):
    rows = E.incident_rows(spark, sf_dir).select("seq", "case_number", "suspect_name").filter("suspect_name <> ''")
    orders = E.table(spark, sf_dir, "orders").join(E.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pred = rows.join(orders, F.col("seq") == F.col("o_orderkey")).select(
        F.col("case_number").alias("node1"), F.when(F.col("seq") % 2 == 0, F.col("c_name")).otherwise(F.col("suspect_name")).alias("node2"),
        F.lit("PREDICTED").alias("relationship"), (F.col("o_totalprice") / 500000).alias("link_probability"), (F.col("o_totalprice") / 500000 >= 0.5).alias("predicted_link"))
    out = Y.resolve_predictions(E.crime_graph(spark, sf_dir), pred)
    return out.select("node1", "node2", F.col("source.id").alias("source_id"), F.col("source.type").alias("source_type"), F.col("target.id").alias("target_id"),
                      F.col("target.type").alias("target_type"), "link_probability", "predicted_link")


_LEADS = with_(INCIDENTS, """r AS (SELECT case_number AS c, nullif(suspect_name, '') AS s, primary_type AS t, beat AS b, block AS k, nullif(vehicle_plate, '') AS v FROM inc),
mt AS (SELECT s, t, count(*) AS m FROM r WHERE s IS NOT NULL GROUP BY 1, 2), mb AS (SELECT s, b, count(*) AS m FROM r WHERE s IS NOT NULL GROUP BY 1, 2),
mk AS (SELECT s, k, count(*) AS m FROM r WHERE s IS NOT NULL GROUP BY 1, 2), mv AS (SELECT DISTINCT s, v FROM r WHERE s IS NOT NULL AND v IS NOT NULL),
cand AS (SELECT r.c, mt.s FROM r JOIN mt USING (t) UNION ALL SELECT r.c, mb.s FROM r JOIN mb USING (b) UNION ALL SELECT r.c, mk.s FROM r JOIN mk USING (k) UNION ALL SELECT r.c, mv.s FROM r JOIN mv USING (v)),
two AS (SELECT c, s, count(*) AS signals FROM cand GROUP BY 1, 2 HAVING count(*) >= 2)""", """
SELECT two.c AS "case", two.s AS subject, signals, least(0.99, 1 - exp(-2.2 * (CASE WHEN mt.m > 0 THEN least(0.24, 0.12 + 0.04 * mt.m) ELSE 0 END + CASE WHEN mb.m > 0 THEN least(0.28, 0.14 + 0.05 * mb.m) ELSE 0 END
  + CASE WHEN mk.m > 0 THEN least(0.38, 0.25 + 0.06 * mk.m) ELSE 0 END + CASE WHEN mv.v IS NOT NULL THEN 0.5 ELSE 0 END))) AS score, 'hypothesis-only' AS status,
  concat_ws('; ', 'crime_type=' || r.t || ':' || mt.m, 'police_beat=' || r.b || ':' || mb.m, 'location_block=' || r.k || ':' || mk.m, 'vehicle_plate=' || mv.v || ':1') AS said
FROM two JOIN r ON r.c = two.c LEFT JOIN mt ON mt.s = two.s AND mt.t = r.t LEFT JOIN mb ON mb.s = two.s AND mb.b = r.b LEFT JOIN mk ON mk.s = two.s AND mk.k = r.k
  LEFT JOIN mv ON mv.s = two.s AND mv.v = r.v WHERE r.s IS DISTINCT FROM two.s ORDER BY round(score, 9) DESC, 1, 2 LIMIT 250""")


@query("j04_hypotheses", _LEADS)
def j04_hypotheses(spark, sf_dir):
    said = F.array_join(F.transform("said", lambda s: F.concat(s["feature"], F.lit("="), s["value"], F.lit(":"), s["prior_matches"])), "; ")
    return Y.top_hypotheses(E.incident_records(spark, sf_dir)).withColumn("said", said)


@query("j04_hypothesis_classes", _LEADS.split("SELECT two.c AS")[0].rstrip() + """,
lead AS (SELECT two.c, two.s, signals, r.t, r.b, r.k, r.v, coalesce(mt.m, 0) AS m1, coalesce(mb.m, 0) AS m2, coalesce(mk.m, 0) AS m3, CASE WHEN mv.v IS NOT NULL THEN 1 ELSE 0 END AS m4
  FROM two JOIN r ON r.c = two.c LEFT JOIN mt ON mt.s = two.s AND mt.t = r.t LEFT JOIN mb ON mb.s = two.s AND mb.b = r.b LEFT JOIN mk ON mk.s = two.s AND mk.k = r.k
  LEFT JOIN mv ON mv.s = two.s AND mv.v = r.v WHERE r.s IS DISTINCT FROM two.s)
SELECT s AS suspect, t AS primary_type, b AS beat, CASE WHEN m3 + m4 > 0 THEN k END AS block, CASE WHEN m3 + m4 > 0 THEN v END AS vehicle_plate, m1 AS m_primary_type, m2 AS m_beat, m3 AS m_block, m4 AS m_vehicle_plate,
  signals, CASE WHEN m3 + m4 > 0 THEN 'near' ELSE 'area' END AS kind, count(*) AS cases FROM lead GROUP BY ALL""")
def j04_hypothesis_classes(spark, sf_dir):
    return Y.link_hypotheses(E.incident_records(spark, sf_dir)).drop("score")


_ALERTS = CRIME_ADJ + """,
rk AS (SELECT 'derived-high-severity' AS alert_id, id, name, confidence, row_number() OVER (ORDER BY risk DESC, name, id) AS rn FROM cnodes WHERE type = 'event'
  UNION ALL SELECT 'derived-repeat-subject', id, name, confidence, row_number() OVER (ORDER BY degree DESC, risk DESC, name, id) FROM cnodes JOIN deg USING (id) WHERE tags = 'repeat-subject'
  UNION ALL SELECT 'derived-beat-concentration', id, name, confidence, row_number() OVER (ORDER BY degree DESC, risk DESC, name, id) FROM cnodes JOIN deg USING (id) WHERE tags = 'police-beat'
  UNION ALL SELECT 'derived-repeat-location', id, name, confidence, row_number() OVER (ORDER BY degree DESC, risk DESC, name, id) FROM cnodes JOIN deg USING (id) WHERE tags = 'repeat-location'
  UNION ALL SELECT 'derived-vehicle-link', id, name, confidence, row_number() OVER (ORDER BY degree DESC, risk DESC, name, id) FROM cnodes JOIN deg USING (id) WHERE type = 'vehicle'),
alerts AS (SELECT alert_id, id AS entity_id, confidence, CASE alert_id WHEN 'derived-high-severity' THEN 'critical' WHEN 'derived-repeat-location' THEN 'medium' WHEN 'derived-vehicle-link' THEN 'low' ELSE 'high' END AS severity FROM rk WHERE rn = 1)"""


@query("t02_alerts", with_(_ALERTS, "SELECT alert_id, entity_id, confidence, severity FROM alerts"))
def t02_alerts(spark, sf_dir):
    return B.generate_alerts(E.crime_shape(spark, sf_dir)).select("alert_id", "entity_id", "confidence", "severity")


def _acknowledged(spark, sf_dir):
    # an alert counts as acknowledged once any conversation turn of a user mentions its kind of review
    turns = E.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return turns.select(F.when(F.col("role") == "user", "derived-vehicle-link").when(F.col("role") == "assistant", "derived-repeat-subject").otherwise("none").alias("alert_id"))


@query("j05_acknowledged", with_(_ALERTS, """
SELECT alert_id, entity_id, severity, (alert_id = 'derived-vehicle-link' AND EXISTS (SELECT 1 FROM conversations WHERE role = 'user'))
  OR (alert_id = 'derived-repeat-subject' AND EXISTS (SELECT 1 FROM conversations WHERE role = 'assistant')) AS acknowledged FROM alerts"""))
def j05_acknowledged(spark, sf_dir):
    alerts = B.with_acknowledgement(B.generate_alerts(E.crime_shape(spark, sf_dir)), _acknowledged(spark, sf_dir))
    return alerts.select("alert_id", "entity_id", "severity", "acknowledged")


@query("f06_filtered_alerts", with_(_ALERTS, """
SELECT alert_id, severity, entity_id FROM alerts WHERE severity IN ('critical', 'high') AND NOT (alert_id = 'derived-repeat-subject' AND EXISTS (SELECT 1 FROM conversations WHERE role = 'assistant'))"""))
def f06_filtered_alerts(spark, sf_dir):
    alerts = B.with_acknowledgement(B.generate_alerts(E.crime_shape(spark, sf_dir)), _acknowledged(spark, sf_dir))
    return X.filter_alerts(alerts, False, ("critical", "high"), "C").select("alert_id", "severity", "entity_id")


@query("j06_recovery", with_(MULTI, """
SELECT 'entities' AS measure, (SELECT count(DISTINCT 'Subject ' || user_id) FROM events WHERE 'Subject ' || user_id IN (SELECT name FROM mnodes)) AS got, (SELECT count(DISTINCT user_id) FROM events) AS wanted
UNION ALL SELECT 'relationships', count(DISTINCT label), 10 FROM medges WHERE label <> 'TRANSFERRED_TO'
UNION ALL SELECT 'kept-apart', (SELECT count(*) - 1 FROM mnodes WHERE type = 'person'), (SELECT count(*) - 1 FROM mnodes WHERE type = 'person')"""))
def j06_recovery(spark, sf_dir):
    g = E.event_graph(spark, sf_dir).staged()
    users = E.table(spark, sf_dir, "events").select(F.concat(F.lit("Subject "), "user_id").alias("name")).distinct()
    labels = spark.createDataFrame([(x,) for x in (
        "HAS_PROTECTED_PERSON", "MENTIONS_PERSON", "MENTIONS_ORGANIZATION", "HAS_SOURCE_PHONE", "HAS_DESTINATION_PHONE", "HAS_SOURCE_ACCOUNT",
        "HAS_DESTINATION_ACCOUNT", "INVOLVES_VEHICLE", "OCCURRED_AT", "CALLED")], "label string")
    people = g.nodes.filter("type = 'person'").select("name")
    first = people.agg(F.min("name").alias("left"))
    apart = people.join(F.broadcast(first)).filter("name <> left").select("left", F.col("name").alias("right"))
    return Y.evaluate_scenario(g, users, labels, apart)


@query("m07_scenario", with_(*_PATHS, """e AS (SELECT DISTINCT suspect_name AS name FROM inc WHERE suspect_name <> ''), people AS (SELECT id, name FROM cnodes WHERE type = 'person')
""", """SELECT 'entities' AS measure, count_if(name IN (SELECT name FROM cnodes)) AS got, count(*) AS wanted FROM e
UNION ALL SELECT 'relationships', count(DISTINCT label), count(DISTINCT label) FROM cedges
UNION ALL SELECT 'kept-apart', count_if(p.id <> (SELECT min_by(id, name) FROM people)), count(*) FROM people p WHERE name <> (SELECT min(name) FROM people)
UNION ALL SELECT 'paths', count_if(pair_id IN (SELECT pair_id FROM goal)), count(*) FROM asked"""))
def m07_scenario(spark, sf_dir):
    """Truth recovery plus whether declared paths exist."""
    g = E.crime_paths(spark, sf_dir)
    pairs = beat_pairs(g)
    paths = I.connection_paths(g, pairs, 4)[0].agg(F.count_if("found").alias("got"), F.count(F.lit(1)).alias("wanted")).select(F.lit("paths").alias("measure"), "got", "wanted")
    rows = E.incident_rows(spark, sf_dir)
    entities = rows.filter("suspect_name <> ''").select(F.col("suspect_name").alias("name")).distinct()
    labels = g.edges.select("label").distinct()
    people = g.nodes.filter("type = 'person'").select("name")
    apart = people.join(F.broadcast(people.agg(F.min("name").alias("left")))).filter("name <> left").select("left", F.col("name").alias("right"))
    return Y.evaluate_scenario(g, entities, labels, apart).unionByName(paths)


_IDENTITY = """o AS (SELECT split_part(lower(suspect_name), ' ', 2) AS surname, substr(lower(suspect_name), 1, 1) AS initial, lower(suspect_name) AS key, nullif(vehicle_plate, '') AS identifier,
  beat AS organization, block AS place, CAST(floor(epoch(CAST(date AS TIMESTAMP)) / 3600) AS BIGINT) AS cell FROM inc WHERE suspect_name <> ''),
sz AS (SELECT surname, initial, count(DISTINCT key) AS names FROM o GROUP BY 1, 2 HAVING names >= 2),
si AS (SELECT surname, initial, key, count(*) AS n, min(CASE WHEN key = lo THEN hi ELSE lo END) AS w FROM (SELECT DISTINCT surname, initial, key, identifier FROM o) JOIN (SELECT surname, initial, identifier, min(key) AS lo, max(key) AS hi FROM o WHERE identifier IS NOT NULL GROUP BY ALL HAVING count(DISTINCT key) > 1) USING (surname, initial, identifier) GROUP BY 1, 2, 3),
so AS (SELECT surname, initial, key, count(*) AS n, min(CASE WHEN key = lo THEN hi ELSE lo END) AS w FROM (SELECT DISTINCT surname, initial, key, organization FROM o) JOIN (SELECT surname, initial, organization, min(key) AS lo, max(key) AS hi FROM o GROUP BY ALL HAVING count(DISTINCT key) > 1) USING (surname, initial, organization) GROUP BY 1, 2, 3),
ap AS (SELECT surname, initial, key, count(DISTINCT cell) AS n, min(CASE WHEN key = lo THEN hi ELSE lo END) AS w FROM o JOIN (SELECT surname, initial, cell, min(key) AS lo, max(key) AS hi FROM o GROUP BY ALL HAVING count(DISTINCT key) > 1 AND count(DISTINCT place) > 1) USING (surname, initial, cell) GROUP BY 1, 2, 3),
cand AS (SELECT surname, initial, key, count(*) AS records, count(DISTINCT identifier) AS identifiers, any_value(names) AS names FROM o JOIN sz USING (surname, initial) GROUP BY 1, 2, 3)"""


def _seen(spark, sf_dir):
    tune(spark)
    rows = E.incident_rows(spark, sf_dir).filter("suspect_name <> ''")
    return rows.select(F.col("suspect_name").alias("name"), S.blank_to_null(F.col("vehicle_plate")).alias("identifier"), F.col("beat").alias("organization"),
                       F.col("block").alias("place"), F.col("date").cast("timestamp").alias("ts"))


@query("h07_identity_review", with_(INCIDENTS, _IDENTITY, """
SELECT surname, initial, key, records, identifiers, names, coalesce(si.n, 0) AS shared_identifiers, coalesce(so.n, 0) AS shared_organizations, coalesce(ap.n, 0) AS apart_cells, si.w AS identifier_with, so.w AS organization_with, ap.w AS apart_from,
  CASE WHEN coalesce(si.n, 0) > 0 THEN 'escalate' ELSE 'keep-separate' END AS recommendation FROM cand LEFT JOIN si USING (surname, initial, key) LEFT JOIN so USING (surname, initial, key) LEFT JOIN ap USING (surname, initial, key)"""))
def h07_identity_review(spark, sf_dir):
    return Y.identity_review(_seen(spark, sf_dir))


@query("h08_latest_decision", """WITH d AS (SELECT 'user-' || user_id AS candidate_id, event_type AS decision, CAST(event_id AS VARCHAR) AS rationale, ts FROM events),
c AS (SELECT DISTINCT 'user-' || user_id AS candidate_id FROM events UNION SELECT 'customer-' || c_custkey FROM customer)
SELECT candidate_id, coalesce(arg_max(decision, ts), 'pending-review') AS status, arg_max(rationale, ts) AS rationale, max(ts) AS decided_at FROM c LEFT JOIN d USING (candidate_id) GROUP BY 1""")
def h08_latest_decision(spark, sf_dir):
    tune(spark)
    events = E.table(spark, sf_dir, "events")
    decisions = events.select(F.concat(F.lit("user-"), "user_id").alias("candidate_id"), F.col("event_type").alias("decision"),
                              F.col("event_id").cast("string").alias("rationale"), F.col("ts").alias("decided_at"))
    candidates = decisions.select("candidate_id").distinct().unionByName(
        E.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("candidate_id")))
    return Y.with_latest_decision(candidates, decisions)


@query("h09_explanations", with_(_ALERTS, """
SELECT alert_id AS id, confidence, 'fixed risk rules and counts of linked nodes' AS methodology FROM alerts WHERE alert_id = 'derived-repeat-subject'
UNION ALL SELECT * FROM (SELECT 'beat-concentration', 100, 'counts over the records themselves' FROM inc GROUP BY beat ORDER BY count(*) DESC, beat LIMIT 5)"""))
def h09_explanations(spark, sf_dir):
    out = B.explain(B.generate_alerts(E.crime_shape(spark, sf_dir)), B.repeat_findings(E.incident_records(spark, sf_dir)), ["derived-repeat-subject", "beat-concentration"])
    return out.select("id", "confidence", "methodology")


# -- integrity --------------------------------------------------------------------------

@query("h01_receipts", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS receipt FROM orders""")
def h01_receipts(spark, sf_dir):
    o = E.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.receipt(F.struct("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")).alias("receipt"))


def audit_events(spark, sf_dir):
    tune(spark)
    return E.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chain"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.concat(F.lit("user-"), "user_id").alias("actor"),
        F.col("event_type").alias("action"), F.concat(F.lit("event-"), "event_id").alias("target"), F.create_map(F.lit("props"), "props").alias("details"), "event_id")


BLOCK = 20  # chains of the test tables hold several blocks


def sealed(spark, sf_dir):
    return cut(H.seal_chain(audit_events(spark, sf_dir), "chain", ["timestamp", "event_id"], BLOCK), "sealed")


_CHAIN = """e AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
  'user-' || user_id AS actor, event_type AS action, 'event-' || event_id AS target,
  '{"action":"' || event_type || '","actor":"user-' || user_id || '","details":{"props":"' || replace(props, '"', '\\"') || '"},"previous_hash":"' AS head FROM events),
b AS (SELECT *, '","sequence":' || sequence || ',"target":"' || target || '","timestamp":"' || timestamp || '"}' AS tail FROM e),
c AS (SELECT chain, sequence, action, target, repeat('0', 64) AS previous_hash, sha256(head || repeat('0', 64) || tail) AS hash FROM b WHERE (sequence - 1) % 20 = 0
  UNION ALL SELECT b.chain, b.sequence, b.action, b.target, c.hash, sha256(b.head || c.hash || b.tail) FROM c JOIN b ON b.chain = c.chain AND b.sequence = c.sequence + 1 AND (b.sequence - 1) % 20 <> 0)"""
# levels above the entries: heads of blocks, then heads of groups of 20 heads, as often as a chain needs
_LEVELS = """h0 AS (SELECT chain, (sequence - 1) // 20 AS number, count(*) AS entries, max_by(hash, sequence) AS head FROM c GROUP BY ALL),
up AS (SELECT 0 AS level, chain, number, entries, head, entries AS total, sha256(repeat('0', 64) || ':' || number || ':' || entries || ':' || head) AS acc FROM h0 WHERE number % 20 = 0
  UNION ALL SELECT 0, h0.chain, h0.number, h0.entries, h0.head, up.total + h0.entries, sha256(up.acc || ':' || h0.number || ':' || h0.entries || ':' || h0.head)
  FROM up JOIN h0 ON h0.chain = up.chain AND h0.number = up.number + 1 AND h0.number % 20 <> 0),
h1 AS (SELECT chain, number // 20 AS number, max(total) AS entries, max_by(acc, number) AS head FROM up GROUP BY ALL),
top AS (SELECT chain, number, entries, total, acc FROM (SELECT chain, number, entries, entries AS total, sha256(repeat('0', 64) || ':' || number || ':' || entries || ':' || head) AS acc FROM h1 WHERE number % 20 = 0)
  UNION ALL SELECT h1.chain, h1.number, h1.entries, top.total + h1.entries, sha256(top.acc || ':' || h1.number || ':' || h1.entries || ':' || h1.head)
  FROM top JOIN h1 ON h1.chain = top.chain AND h1.number = top.number + 1 AND h1.number % 20 <> 0),
h2 AS (SELECT chain, max(total) AS entries, max_by(acc, number) AS head FROM top GROUP BY ALL)"""


@query("h02_sealed_chain", with_(_CHAIN, "SELECT chain, sequence, target, previous_hash, hash FROM c"))
def h02_sealed_chain(spark, sf_dir):
    return H.seal_chain(audit_events(spark, sf_dir), "chain", ["timestamp", "event_id"], BLOCK).select("chain", "sequence", "target", "previous_hash", "hash")


@query("h02_chain_heads", with_(_CHAIN, _LEVELS, """SELECT 0 AS level, chain, number, entries, head FROM h0
  UNION ALL SELECT 1, chain, number, entries, head FROM h1
  UNION ALL SELECT 2, chain, 0, entries, head FROM h2 WHERE (SELECT max(number) FROM h1) > 0"""))
def h02_chain_heads(spark, sf_dir):
    """Heads of every level up to the roots (the SQL follows three levels, 8,000 entries a chain)."""
    levels = [df.select(F.lit(i).alias("level"), "chain", "number", "entries", "head") for i, df in enumerate(H.chain_levels(sealed(spark, sf_dir), "chain", BLOCK))]
    out = levels[0]
    for df in levels[1:]:
        out = out.unionByName(df)
    return out


def _in_batches(spark, sf_dir):
    """The audit events in three batches, each later than the one before."""
    events = audit_events(spark, sf_dir)
    at = F.unix_micros(F.to_timestamp("timestamp"))
    ends = events.agg(F.min(at).alias("low"), F.max(at).alias("high"))
    part = F.least(F.floor(3 * (at - F.col("low")) / (F.col("high") - F.col("low") + 1)), F.lit(2))
    parted = cut(events.join(F.broadcast(ends)).withColumn("part", part).drop("low", "high"), "audit-parts")
    return [parted.where(F.col("part") == i).drop("part") for i in range(3)]


def _appended(spark, sf_dir):
    """Entries and levels of the chains, sealed in three batches."""
    first, *later = _in_batches(spark, sf_dir)
    entries = cut(H.seal_chain(first, "chain", ["timestamp", "event_id"], BLOCK), "sealed")
    levels = H.chain_levels(entries, "chain", BLOCK)
    for events in later:
        fresh = cut(H.seal_chain(events, "chain", ["timestamp", "event_id"], BLOCK, H.chain_tails(entries, "chain")), "sealed")
        levels = H.append_levels(levels, fresh, "chain", BLOCK)
        entries = entries.unionByName(fresh)
    return entries, levels


@query("h02_appended_chain", with_(_CHAIN, "SELECT chain, sequence, target, previous_hash, hash FROM c"))
def h02_appended_chain(spark, sf_dir):
    """Sealed in three batches, the chains are those of sealing once."""
    return _appended(spark, sf_dir)[0].select("chain", "sequence", "target", "previous_hash", "hash")


@query("h02_appended_heads", with_(_CHAIN, _LEVELS, """SELECT 0 AS level, chain, number, entries, head FROM h0
  UNION ALL SELECT 1, chain, number, entries, head FROM h1
  UNION ALL SELECT 2, chain, 0, entries, head FROM h2 WHERE (SELECT max(number) FROM h1) > 0"""))
def h02_appended_heads(spark, sf_dir):
    """Heads of every level after three batches."""
    levels = [df.select(F.lit(i).alias("level"), "chain", "number", "entries", "head") for i, df in enumerate(_appended(spark, sf_dir)[1])]
    return reduce(DataFrame.unionByName, levels)


@query("h03_verify", with_(_CHAIN, """a AS (SELECT chain, CASE WHEN chain % 5 = 2 AND sequence = 3 THEN 4 WHEN chain % 5 = 2 AND sequence = 4 THEN 3 ELSE sequence END AS sequence, sequence AS was,
    (sequence - 1) // 20 AS block, previous_hash, hash, action = 'error' AS changed FROM c WHERE NOT (chain % 5 = 0 AND sequence BETWEEN 21 AND 40) AND NOT (chain % 5 = 3 AND sequence = 9)),
t AS (SELECT * FROM a WHERE NOT (chain % 5 = 4 AND sequence > 50) UNION ALL SELECT * FROM a WHERE chain % 5 = 1 AND sequence = 7),
n AS (SELECT chain, sequence, count(*) AS copies, min(hash) AS hash FROM t GROUP BY ALL),
v AS (SELECT t.*, n.copies, p.hash AS before FROM t JOIN n USING (chain, sequence) LEFT JOIN n p ON p.chain = t.chain AND p.sequence = t.sequence - 1),
touched AS (SELECT chain FROM c GROUP BY chain HAVING (chain % 5 = 0 AND max(sequence) > 20) OR (chain % 5 = 3 AND max(sequence) >= 9) OR (chain % 5 = 4 AND max(sequence) > 50) OR (chain % 5 = 2 AND max(sequence) = 4))""", """
SELECT chain, sequence, 'sequence mismatch' AS reason, count(*) AS n FROM v WHERE copies > 1 OR (sequence > 1 AND before IS NULL) GROUP BY ALL
UNION ALL SELECT chain, sequence, 'previous hash mismatch', count(*) FROM v WHERE previous_hash IS DISTINCT FROM CASE WHEN (sequence - 1) % 20 = 0 THEN repeat('0', 64) ELSE before END GROUP BY ALL
UNION ALL SELECT chain, sequence, 'content hash mismatch', count(*) FROM v WHERE changed OR sequence <> was GROUP BY ALL
UNION ALL SELECT chain, NULL, 'root mismatch', 1 FROM touched"""))
def h03_verify(spark, sf_dir):
    """After sealing, entries are altered, a whole block, one entry and the tail of a chain removed, one repeated and two swapped."""
    entries = sealed(spark, sf_dir)
    roots = H.chain_roots(entries, "chain", BLOCK)
    kind, n = F.col("chain") % 5, F.col("sequence")
    altered = entries.withColumn("target", F.when(F.col("action") == "error", F.concat("target", F.lit("x"))).otherwise(F.col("target")))
    altered = altered.filter(~((kind == 0) & n.between(21, 40)) & ~((kind == 3) & (n == 9)))
    altered = altered.withColumn("sequence", F.when((kind == 2) & (n == 3), 4).when((kind == 2) & (n == 4), 3).otherwise(n).cast("bigint"))
    altered = altered.filter(~((kind == 4) & (n > 50))).unionByName(altered.filter((kind == 1) & (n == 7)))
    return H.verify_chain(altered, "chain", roots, BLOCK).groupBy("chain", "sequence", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("h04_recent", """SELECT row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank, event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def h04_recent(spark, sf_dir):
    return H.recent(E.table(spark, sf_dir, "events"), 100, ("ts", "event_id")).select("rank", "event_id", "user_id", "event_type")


@query("h06_disclosure_log", """SELECT 'PP-' || conv_id AS profile_id, role || '-' || turn AS authorization_reference, sha256(trim(text, ' ')) AS reason_sha256,
  ['legal_name', 'phone', 'address'] AS fields_revealed, role AS actor FROM conversations""")
def h06_disclosure_log(spark, sf_dir):
    turns = E.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("PP-"), "conv_id").alias("profile_id"), F.concat(F.lit(" "), "role", F.lit("-"), "turn").alias("authorization_reference"),
        F.col("text").alias("reason"), F.col("role").alias("actor"))
    return H.disclosure_log(turns)


@query("k11_verified_objects", "SELECT 'item-' || item_id AS key, sha256(text) AS sha256, item_id % 2 = 0 AS ok FROM benchmark")
def k11_verified_objects(spark, sf_dir):
    tune(spark)
    stored = cut(H.seal_objects(E.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("key"), F.col("text").alias("content"))), "objects")
    # half of the stored objects lose their last character
    even = F.regexp_extract("key", "([0-9]+)$", 1).cast("bigint") % 2 == 0
    damaged = stored.withColumn("content", F.when(even, F.col("content")).otherwise(F.expr("substring(content, 1, length(content) - 1)")))
    return H.verify_objects(damaged).join(stored.select("key", "sha256"), "key")


# -- features and evaluation ---------------------------------------------------------------

@query("m01_features", with_(CRIME, """d AS (SELECT id, count(*) AS k FROM (SELECT source AS id FROM cedges UNION ALL SELECT target FROM cedges) GROUP BY 1)""", """
SELECT n.id, [CAST(type = 'event' AS DOUBLE), CAST(type = 'person' AS DOUBLE), CAST(type = 'crime' AS DOUBLE), CAST(type = 'vehicle' AS DOUBLE),
  CAST(type = 'location' AND tags <> 'police-beat' AS DOUBLE), CAST(tags = 'police-beat' AS DOUBLE), coalesce(k, 0) / (SELECT max(k) FROM d)] AS features FROM cnodes n LEFT JOIN d USING (id)"""))
def m01_features(spark, sf_dir):
    return L.node_features(E.crime_graph(spark, sf_dir))


@query("m02_preview", with_(MULTI, """cn AS (SELECT target AS id, count(*) AS k FROM medges WHERE label IN ('MENTIONS_PERSON', 'MENTIONS_ASSOCIATE') GROUP BY 1)""", """
SELECT row_number() OVER (ORDER BY coalesce(k, 0) DESC, risk DESC, name, id) AS rank, id, name, coalesce(k, 0) AS case_neighbours, coalesce(k, 0) AS graph_degree, risk,
  CASE WHEN k >= 2 THEN 'suspicious' ELSE 'normal' END AS derived_label, 'schema-incompatible-preview' AS mode FROM mnodes LEFT JOIN cn USING (id) WHERE type = 'person'
ORDER BY coalesce(k, 0) DESC, risk DESC, name, id LIMIT 25"""))
def m02_preview(spark, sf_dir):
    return L.structural_preview(E.event_graph(spark, sf_dir).staged())


def demo_weights():
    """A small fixed weight table; trained weights are an input of the operator."""
    def matrix(rows, columns, salt):
        return [[((i * 7 + j * 3 + salt) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]

    return {"layer1": {"neighbour": matrix(4, 7, 1), "self": matrix(4, 7, 2), "bias": [0.1, -0.1, 0.05, 0.0]},
            "layer2": {"neighbour": matrix(4, 4, 3), "self": matrix(4, 4, 4), "bias": [0.0, 0.1, -0.05, 0.2]},
            "classifier": {"weight": matrix(2, 4, 5), "bias": [0.0, 0.1]}}


def _linear(rows, columns, bias=None):
    """One SQL expression per output row."""
    return [" + ".join([*(f"({w}) * {c}" for w, c in zip(row, columns, strict=True)), *([str(bias[i])] if bias else [])]) for i, row in enumerate(rows)]


def _layer(name, source, width, weights):
    means, own = [f"coalesce(m{i}, 0)" for i in range(width)], [f"f.f{i}" for i in range(width)]
    out = [f"greatest({a} + {b}, 0) AS f{i}" for i, (a, b) in enumerate(zip(_linear(weights["neighbour"], means, weights["bias"]), _linear(weights["self"], own), strict=True))]
    average = ", ".join(f"avg(s.f{i}) AS m{i}" for i in range(width))
    return f"{name} AS MATERIALIZED (SELECT f.id, {', '.join(out)} FROM {source} f LEFT JOIN (SELECT b.node, {average} FROM both_ b JOIN {source} s ON s.id = b.nbr GROUP BY 1) m ON m.node = f.id)"


def model_sql() -> str:
    w = demo_weights()
    hot = ["type = 'event'", "type = 'person'", "type = 'crime'", "type = 'vehicle'", "type = 'location' AND NOT (tags = 'police-beat' OR name LIKE 'Police Beat %')", "type = 'location' AND (tags = 'police-beat' OR name LIKE 'Police Beat %')"]
    kinds = dict(zip(("CASE", "SUSPECT", "CRIME_TYPE", "VEHICLE", "LOCATION", "POLICE_BEAT"), hot, strict=True))
    ones = [f"CASE WHEN {kinds[k]} THEN 1.0::DOUBLE ELSE 0.0 END AS f{i}" for i, k in enumerate(rules.MODEL_TYPES)]
    z = _linear(w["classifier"]["weight"], [f"f{i}" for i in range(4)], w["classifier"]["bias"])
    return ",\n".join(("both_ AS MATERIALIZED (SELECT source AS node, target AS nbr FROM cedges UNION ALL SELECT target, source FROM cedges)", "md AS (SELECT node, count(*) AS d FROM both_ GROUP BY 1)",
                       f"f0 AS MATERIALIZED (SELECT id, {', '.join(ones)}, coalesce(d, 0)::DOUBLE / (SELECT max(d) FROM md) AS f6 FROM cnodes LEFT JOIN md ON md.node = id)",
                       _layer("f1", "f0", 7, w["layer1"]), _layer("f2", "f1", 4, w["layer2"]), f"z_ AS (SELECT id, 1 / (1 + exp(({z[0]}) - ({z[1]}))) AS p FROM f2)"))


@query("m03_scores", with_(CRIME_ADJ, model_sql(), "SELECT id, round(p, 9) AS probability, CASE WHEN p >= 0.5 THEN 'suspicious' ELSE 'normal' END AS derived_label FROM z_"))
def m03_scores(spark, sf_dir):
    g = E.crime_shape(spark, sf_dir)
    nodes, pairs = M.keyed(g)
    features = cut(L.keyed_features(nodes, pairs), "features")
    scores = L.mean_aggregator_scores(features, L.weighted(pairs), demo_weights()).withColumnRenamed("id", "key")
    return nodes.select("id", "key").join(scores, "key").select("id", F.round("probability", 9).alias("probability"), "derived_label")


@query("m03_layer_mean", with_(CRIME_ADJ, """both_ AS (SELECT source AS node, target AS nbr FROM cedges UNION ALL SELECT target, source FROM cedges)""", """
SELECT n.id, greatest(0.0, 0.5 * coalesce(avg(m.risk), 0) - 0.25 * n.risk + 1) AS value FROM cnodes n LEFT JOIN both_ b ON b.node = n.id LEFT JOIN cnodes m ON m.id = b.nbr GROUP BY n.id, n.risk"""))
def m03_layer_mean(spark, sf_dir):
    g = E.crime_shape(spark, sf_dir)
    values = g.nodes.select("id", F.array(F.col("risk").cast("double")).alias("features"))
    layer = L.mean_layer(values, M.adjacency(g, multi=True), 1, {"neighbour": [[0.5]], "self": [[-0.25]], "bias": [1.0]})
    return layer.select("id", F.col("features")[0].alias("value"))


@query("m04_split", with_(CRIME, """l AS (SELECT n.id, CASE WHEN count(e.id) >= 2 THEN 1 ELSE 0 END AS label FROM cnodes n LEFT JOIN cedges e ON e.target = n.id AND e.label = 'HAS_SUSPECT' WHERE type = 'person' GROUP BY 1)""", """
SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) <= round(0.2 * count(*) OVER (PARTITION BY label)) THEN 'validation' ELSE 'train' END AS split FROM l"""))
def m04_split(spark, sf_dir):
    labels = L.proxy_labels(E.crime_graph(spark, sf_dir).staged(("id", "type"), ("source", "target")))
    return L.stratified_split(labels, "label").select("id", "label", "split")


@query("m05_masking", with_(CRIME, """lk AS (SELECT e.id AS edge_id, e.target AS id FROM cedges e JOIN cnodes n ON n.id = e.target AND n.type = 'person' JOIN cnodes c ON c.id = e.source AND c.type = 'event'),
tr AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || edge_id), edge_id) AS n, CAST(round_even(0.2 * count(*) OVER (PARTITION BY seed), 0) AS BIGINT) AS dropped FROM lk, range(1000, 1010) t(seed)),
af AS (SELECT seed, id, CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END AS pred FROM tr WHERE n > dropped GROUP BY 1, 2),
lb AS (SELECT n.id, CASE WHEN count(e.id) >= 2 THEN 1 ELSE 0 END AS label FROM cnodes n LEFT JOIN lk e ON e.id = n.id WHERE n.type = 'person' GROUP BY 1),
bo AS (SELECT seed, label, coalesce(pred, 0) AS pred FROM lb CROSS JOIN range(1000, 1010) t(seed) LEFT JOIN af USING (seed, id)),
co AS (SELECT seed, count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 0) AS tn, count_if(label = 0 AND pred = 1) AS fp, count_if(label = 1 AND pred = 0) AS fn FROM bo GROUP BY 1)""", """
SELECT CAST(seed AS INT) AS seed, tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (SELECT any_value(dropped) FROM tr) AS masked_edges FROM co"""))
def m05_masking(spark, sf_dir):
    return L.masking_stress(E.crime_shape(spark, sf_dir))


@query("m06_baselines", """WITH r AS (SELECT quality AS label, d.n_chars >= 2000 AS a, l.toxic = 0 AS b FROM labels l JOIN documents d USING (doc_id)), f AS (
  SELECT 'long' AS baseline, count_if(label = 1 AND a) AS tp, count_if(label = 0 AND NOT a) AS tn, count_if(label = 0 AND a) AS fp, count_if(label = 1 AND NOT a) AS fn FROM r
  UNION ALL SELECT 'clean', count_if(label = 1 AND b), count_if(label = 0 AND NOT b), count_if(label = 0 AND b), count_if(label = 1 AND NOT b) FROM r)
SELECT baseline, tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM f""")
def m06_baselines(spark, sf_dir):
    rows = E.table(spark, sf_dir, "labels").join(E.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return L.fixed_baselines(rows, "quality", {"long": F.col("n_chars") >= 2000, "clean": F.col("toxic") == 0})


@query("a10_prediction_summary", "SELECT count(*) AS \"rows\", CAST(sum(quality) AS BIGINT) AS predicted_links, avg(quality * 0.5 + toxic * 0.25) AS mean_probability, count(DISTINCT quality * 0.5 + toxic * 0.25) <= 1 AS uniform_probability FROM labels")
def a10_prediction_summary(spark, sf_dir):
    rows = E.table(spark, sf_dir, "labels").withColumn("link_probability", F.col("quality") * 0.5 + F.col("toxic") * 0.25)
    return L.prediction_summary(rows, predicted="quality")


@query("a13_confusion", """WITH c AS (SELECT count_if(quality = 1 AND toxic = 0) AS tp, count_if(quality = 0 AND toxic = 1) AS tn, count_if(quality = 0 AND toxic = 0) AS fp, count_if(quality = 1 AND toxic = 1) AS fn FROM labels)
SELECT tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM c""")
def a13_confusion(spark, sf_dir):
    return L.confusion(E.table(spark, sf_dir, "labels").withColumn("clean", 1 - F.col("toxic")), "quality", "clean")


@query("a14_brier", "SELECT avg(pow(least(1.0, n_chars / 5000) - quality, 2)) AS brier FROM labels JOIN documents USING (doc_id)")
def a14_brier(spark, sf_dir):
    rows = E.table(spark, sf_dir, "labels").join(E.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return L.brier(rows.withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 5000)), "quality", "p")


@query("a15_percentiles", """SELECT median(value) AS median, max(value) FILTER (rn - 1 = round_even(0.95 * (n - 1), 0)) AS p95
FROM (SELECT value, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events)""")
def a15_percentiles(spark, sf_dir):
    tune(spark)
    return L.median_p95(E.table(spark, sf_dir, "events"), "value", "event_id")


# -- products ------------------------------------------------------------------------------

@query("a08_quality", with_(EVENTS, INCIDENTS, """
SELECT count(*) AS records, 100.0 AS completeness, count(DISTINCT case_number) AS unique_ids, count(*) - count(DISTINCT case_number) AS duplicate_ids, 100.0 * count_if(suspect_name <> '') / count(*) AS subject_coverage,
  100.0 * count_if(vehicle_plate <> '') / count(*) AS plate_coverage, 100.0 AS type_coverage, 'pass' AS quality_gate, 'crime-record' AS schema FROM inc
UNION ALL SELECT count(*), 100.0, count(DISTINCT identifier), count(*) - count(DISTINCT identifier), 100.0 * count_if(coalesce(person_name, subject, caller_name, sender_name) IS NOT NULL) / count(*),
  100.0 * count_if(vehicle_plate IS NOT NULL) / count(*), 100.0, 'pass', 'multi-source' FROM ev"""))
def a08_quality(spark, sf_dir):
    return B.data_quality(E.event_records(spark, sf_dir).unionByName(E.incident_records(spark, sf_dir)))


@query("a09_repeat_findings", with_(INCIDENTS, """u AS (SELECT 'repeat-subject-network' AS finding, suspect_name AS name, count(*) AS n FROM inc WHERE suspect_name <> '' GROUP BY 2 HAVING n >= 2
  UNION ALL SELECT 'beat-concentration', beat, count(*) FROM inc GROUP BY 2 UNION ALL SELECT 'high-severity-cluster', primary_type, count(*) FROM inc GROUP BY 2)""", """
SELECT finding, rank, name, n, total FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY n DESC, name) AS rank, count(*) OVER (PARTITION BY finding) AS total FROM u) WHERE rank <= 5"""))
def a09_repeat_findings(spark, sf_dir):
    return B.repeat_findings(E.incident_records(spark, sf_dir))
