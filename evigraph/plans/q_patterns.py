"""Window, temporal and cross-source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.operators import patterns as P
from evigraph.plans import evidence as E
from evigraph.plans.oracle_base import CRIME, CRIME_ADJ, EVENTS, MULTI, OBSERVED, with_
from evigraph.plans.registry import query


def densest(source: str, keys: str, minutes: int, minimum: int) -> str:
    return f"""SELECT {keys}, -min(struct_pack(a := -n, b := window_start, c := window_end)).a AS n, min(struct_pack(a := -n, b := window_start, c := window_end)).b AS window_start,
  min(struct_pack(a := -n, b := window_start, c := window_end)).c AS window_end, any_value(first_seq) AS first_seq FROM (
  SELECT {keys}, tt AS window_start, count(*) OVER w AS n, max(tt) OVER w AS window_end, min(seq) OVER (PARTITION BY {keys}) AS first_seq
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY tt RANGE BETWEEN CURRENT ROW AND INTERVAL {minutes} MINUTE FOLLOWING))
WHERE n >= {minimum} GROUP BY ALL"""


PAIRS = """pairs AS (SELECT seq, identifier, least(caller_number, callee_number) AS low, greatest(caller_number, callee_number) AS high,
  CAST(timestamp AS TIMESTAMP) AS tt FROM ev WHERE caller_number IS NOT NULL AND callee_number IS NOT NULL)"""
MOVES = """moves AS (SELECT seq, identifier, source_account AS source, destination_account AS target, CAST(timestamp AS TIMESTAMP) AS tt FROM ev
  WHERE source_account IS NOT NULL AND destination_account IS NOT NULL)"""
PLACES = """places AS (SELECT seq, identifier, channel, regexp_extract(lower(coalesce(location, tower_location)), '[a-z0-9]+') AS anchor,
  CAST(timestamp AS TIMESTAMP) AS tt FROM ev)"""
CONVERGE = """conv AS (SELECT anchor, seq, tt AS window_start, count(*) OVER w AS n, max(tt) OVER w AS window_end, len(list_distinct(list(channel) OVER w)) AS n_distinct,
  min(seq) OVER (PARTITION BY anchor) AS first_seq FROM places
  WINDOW w AS (PARTITION BY anchor ORDER BY tt RANGE BETWEEN CURRENT ROW AND INTERVAL 30 MINUTE FOLLOWING))"""
NAMES = """names AS (SELECT seq, identifier, channel, tt, name, lower(name) AS key FROM (
  SELECT seq, identifier, channel, CAST(timestamp AS TIMESTAMP) AS tt, unnest([person_name, subject, caller_name, sender_name]) AS name FROM ev) WHERE name IS NOT NULL)"""
ROUTES = """routes AS (SELECT source, target, count(*) AS n, min(tt) AS lo, max(tt) AS hi FROM moves WHERE source <> target GROUP BY 1, 2),
tri AS (SELECT x.source AS a, y.source AS b, z.source AS c, x.n + y.n + z.n AS n, least(x.lo, y.lo, z.lo) AS lo, greatest(x.hi, y.hi, z.hi) AS hi,
    greatest(x.lo, y.lo, z.lo) AS ready FROM routes x JOIN routes y ON x.target = y.source JOIN routes z ON y.target = z.source AND z.target = x.source
  WHERE x.source < y.source AND x.source < z.source)"""


def _rows(spark, sf_dir):
    return P.staged_rows(E.event_records(spark, sf_dir))


@query("w01_densest_window", densest("(SELECT event_id AS seq, user_id, ts AS tt FROM events)", "user_id", 30, 2))
def w01_densest_window(spark, sf_dir):
    events = E.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "ts")
    return P.densest_window(events, ["user_id"], "ts", 1800, 2).drop("n_distinct")


@query("w02_communication_burst", with_(EVENTS, PAIRS, densest("pairs", "low, high", 30, 2)))
def w02_communication_burst(spark, sf_dir):
    return P.communication_burst(_rows(spark, sf_dir)).drop("n_distinct")


@query("w03_rapid_transfers", with_(EVENTS, MOVES, densest("moves", "source, target", 45, 2)))
def w03_rapid_transfers(spark, sf_dir):
    return P.rapid_transfers(_rows(spark, sf_dir)).drop("n_distinct")


@query("w03_transfer_amounts", with_(EVENTS, MOVES, f"best AS ({densest('moves', 'source, target', 45, 2)})", """
SELECT m.source, m.target, count(*) AS n, min(amt) AS smallest, max(amt) AS largest FROM
(SELECT source_account AS source, destination_account AS target, CAST(timestamp AS TIMESTAMP) AS tt, CAST(substr(amount, 5) AS DOUBLE) AS amt FROM ev WHERE amount IS NOT NULL) m
JOIN best b ON b.source = m.source AND b.target = m.target AND m.tt BETWEEN b.window_start AND b.window_end GROUP BY 1, 2"""))
def w03_transfer_amounts(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    keys = ["source", "target"]
    return P.window_members(P.transfers(rows), P.rapid_transfers(rows), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("amount").alias("smallest"), F.max("amount").alias("largest"))


@query("w04_circular_funds", with_(EVENTS, MOVES, ROUTES, """
SELECT a, b, c, n, lo, hi, epoch_us(hi) / 1000000.0 - epoch_us(lo) / 1000000.0 AS span_seconds FROM tri WHERE hi - lo <= INTERVAL 48 HOUR"""))
def w04_circular_funds(spark, sf_dir):
    return P.circular_funds(_rows(spark, sf_dir))


@query("j03_directed_triangles", with_(EVENTS, MOVES, ROUTES, "SELECT a, b, c, n, lo, hi, ready FROM tri"))
def j03_directed_triangles(spark, sf_dir):
    return P.directed_triangles(P.routes(_rows(spark, sf_dir)))


@query("j03_nation_routes", """WITH routes AS (SELECT c_nationkey AS source, s_nationkey AS target, count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)
SELECT x.source AS a, y.source AS b, z.source AS c, x.n + y.n + z.n AS n, least(x.lo, y.lo, z.lo) AS lo, greatest(x.hi, y.hi, z.hi) AS hi,
    greatest(x.lo, y.lo, z.lo) AS ready FROM routes x JOIN routes y ON x.target = y.source JOIN routes z ON y.target = z.source AND z.target = x.source
  WHERE x.source < y.source AND x.source < z.source""")
def j03_nation_routes(spark, sf_dir):
    t = {n: E.table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")}
    moved = (t["lineitem"].select("l_orderkey", "l_suppkey")
             .join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").alias("ts")), "l_orderkey")
             .join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source")), "o_custkey")
             .join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target")), "l_suppkey"))
    return P.directed_triangles(P.routes(moved))


@query("w05_convergence", with_(EVENTS, PLACES, CONVERGE, """
SELECT anchor, -min(struct_pack(a := -n, b := window_start, c := window_end, d := n_distinct)).a AS n, min(struct_pack(a := -n, b := window_start, c := window_end, d := n_distinct)).b AS window_start,
  min(struct_pack(a := -n, b := window_start, c := window_end, d := n_distinct)).c AS window_end, min(struct_pack(a := -n, b := window_start, c := window_end, d := n_distinct)).d AS n_distinct,
  min(first_seq) AS first_seq FROM conv WHERE n_distinct >= 3 GROUP BY 1"""))
def w05_convergence(spark, sf_dir):
    return P.cross_source_convergence(_rows(spark, sf_dir))


@query("w06_bridge", with_(EVENTS, NAMES, """
SELECT key, count(DISTINCT channel) AS channels, count(DISTINCT identifier) AS records, arg_max(name, seq) AS display FROM names GROUP BY 1 HAVING channels >= 4"""))
def w06_bridge(spark, sf_dir):
    return P.cross_channel_bridge(_rows(spark, sf_dir))


_EVIDENCE = f"""burst AS (SELECT * FROM ({densest('pairs', 'low, high', 30, 2)}) ORDER BY n DESC, first_seq LIMIT 1),
split AS (SELECT * FROM ({densest('moves', 'source, target', 45, 2)}) ORDER BY n DESC, first_seq LIMIT 1),
cbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, window_start) AS rn, min(first_seq) OVER (PARTITION BY anchor) AS fs
  FROM conv WHERE n_distinct >= 3) WHERE rn = 1 ORDER BY n DESC, fs LIMIT 1),
cyc AS (SELECT * FROM tri WHERE hi - lo <= INTERVAL 48 HOUR ORDER BY a, b, c LIMIT 1),
bridge AS (SELECT key FROM names GROUP BY 1 HAVING count(DISTINCT channel) >= 4 ORDER BY count(DISTINCT channel) DESC, count(DISTINCT identifier) DESC, key DESC LIMIT 1),
evidence AS (
  SELECT 'communication-burst' AS pattern_id, seq FROM pairs p JOIN burst b ON p.low = b.low AND p.high = b.high AND p.tt BETWEEN b.window_start AND b.window_end
  UNION SELECT 'rapid-split-transfer', seq FROM moves m JOIN split s ON m.source = s.source AND m.target = s.target AND m.tt BETWEEN s.window_start AND s.window_end
  UNION SELECT 'cross-source-convergence', p.seq FROM places p JOIN cbest c ON p.anchor = c.anchor AND p.tt BETWEEN c.window_start AND c.window_end
  UNION SELECT 'circular-fund-flow', seq FROM moves m JOIN cyc ON (m.source = a AND m.target = b) OR (m.source = b AND m.target = c) OR (m.source = c AND m.target = a)
  UNION SELECT 'cross-channel-bridge', seq FROM names JOIN bridge USING (key))"""
_ALL = (EVENTS, PAIRS, MOVES, PLACES, CONVERGE, NAMES, ROUTES, _EVIDENCE)


@query("w07_patterns", with_(*_ALL, """
SELECT pattern_id AS id, CASE pattern_id WHEN 'communication-burst' THEN count(*) || ' calls between one pair of numbers within half an hour'
    WHEN 'rapid-split-transfer' THEN count(*) || ' transfers on one route within 45 minutes, amounts ' || format('{:,}', CAST(min(CAST(substr(amount, 5) AS DOUBLE)) AS BIGINT)) || ' to ' || format('{:,}', CAST(max(CAST(substr(amount, 5) AS DOUBLE)) AS BIGINT))
    WHEN 'circular-fund-flow' THEN 'transfers lead back to their origin: ' || (SELECT a || ' > ' || b || ' > ' || c || ' > ' || a FROM cyc)
    WHEN 'cross-source-convergence' THEN count(*) || ' observations of ' || count(DISTINCT channel) || ' kinds at one place within half an hour'
    ELSE (SELECT arg_max(name, seq) FROM names WHERE key = (SELECT key FROM bridge)) || ' is named in ' || count(DISTINCT channel) || ' kinds of records' END AS explanation, CASE WHEN pattern_id IN ('circular-fund-flow', 'cross-source-convergence') THEN 'critical' ELSE 'high' END AS severity,
  CASE pattern_id WHEN 'communication-burst' THEN 91 WHEN 'rapid-split-transfer' THEN 88 WHEN 'circular-fund-flow' THEN 94 WHEN 'cross-source-convergence' THEN 93 ELSE 90 END AS confidence,
  count(*) AS n_evidence, list_sort(list(DISTINCT channel)) AS source_types, min(CAST(timestamp AS TIMESTAMP)) AS time_start, max(CAST(timestamp AS TIMESTAMP)) AS time_end
FROM evidence JOIN ev USING (seq) GROUP BY 1"""))
def w07_patterns(spark, sf_dir):
    return P.detect_patterns(_rows(spark, sf_dir)).select("id", "explanation", "severity", "confidence", "n_evidence", "source_types", "time_start", "time_end")


@query("w07_evidence", with_(*_ALL[:3], PLACES, CONVERGE, NAMES, ROUTES, OBSERVED, _EVIDENCE, """
SELECT pattern_id, identifier AS rid, channel, digest, CAST(timestamp AS TIMESTAMP) AS ts FROM evidence JOIN obs USING (seq)"""))
def w07_evidence(spark, sf_dir):
    return P.pattern_evidence(_rows(spark, sf_dir)).drop("amount", "note")


_DAYS = """days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS new_records, list(DISTINCT channel) AS ch FROM ev GROUP BY 1),
nodes0 AS (SELECT CAST(min(timestamp) AS DATE) AS day FROM ev GROUP BY identifier UNION ALL SELECT CAST(min(observed_at) AS DATE) FROM men GROUP BY type, key),
nd AS (SELECT day, count(*) AS k FROM nodes0 GROUP BY 1),
ed AS (SELECT CAST(observed_at AS DATE) AS day, count(*) AS k FROM medges GROUP BY 1),
firsts AS (
  SELECT 'communication-burst' AS p, min(CAST(tt AS DATE)) AS day FROM (SELECT tt, tt - lag(tt) OVER (PARTITION BY low, high ORDER BY tt) AS gap FROM pairs) WHERE gap <= INTERVAL 30 MINUTE
  UNION ALL SELECT 'rapid-split-transfer', min(CAST(tt AS DATE)) FROM (SELECT tt, tt - lag(tt) OVER (PARTITION BY source, target ORDER BY tt) AS gap FROM moves) WHERE gap <= INTERVAL 45 MINUTE
  UNION ALL SELECT 'cross-source-convergence', min(CAST(tt AS DATE)) FROM (SELECT tt, len(list_distinct(list(channel) OVER (PARTITION BY anchor ORDER BY tt RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW))) AS k FROM places) WHERE k >= 3
  UNION ALL SELECT 'cross-channel-bridge', CAST(min(t) AS DATE) FROM (SELECT key, list_sort(list(t))[4] AS t FROM (SELECT key, channel, min(tt) AS t FROM names GROUP BY 1, 2) GROUP BY 1)),
hist AS (SELECT d.day, r.source, r.target, min(m.tt) AS lo, max(m.tt) AS hi FROM days d JOIN moves m ON CAST(m.tt AS DATE) <= d.day JOIN routes r ON r.source = m.source AND r.target = m.target
  WHERE EXISTS (SELECT 1 FROM tri WHERE ready - lo <= INTERVAL 48 HOUR AND ((a = r.source AND b = r.target) OR (b = r.source AND c = r.target) OR (c = r.source AND a = r.target))) GROUP BY ALL),
cyc AS (SELECT DISTINCT x.day FROM (SELECT * FROM tri WHERE ready - lo <= INTERVAL 48 HOUR) t JOIN hist x ON x.source = a AND x.target = b JOIN hist y ON y.day = x.day AND y.source = b AND y.target = c JOIN hist z ON z.day = x.day AND z.source = c AND z.target = a
  WHERE greatest(x.hi, y.hi, z.hi) - least(x.lo, y.lo, z.lo) <= INTERVAL 48 HOUR),
pat AS (SELECT day, list_sort(list(p)) AS patterns FROM (SELECT d.day, f.p FROM days d JOIN firsts f ON f.day <= d.day UNION ALL SELECT day, 'circular-fund-flow' FROM cyc) GROUP BY 1),
res AS (SELECT d.day, new_records, sum(new_records) OVER o AS cumulative_records, sum(coalesce(nd.k, 0)) OVER o AS cumulative_nodes, sum(coalesce(ed.k, 0)) OVER o AS cumulative_edges,
  list_sort(list_distinct(flatten(list(ch) OVER o))) AS source_types_seen, coalesce(patterns, []) AS patterns FROM days d LEFT JOIN nd USING (day) LEFT JOIN ed USING (day) LEFT JOIN pat USING (day)
  WINDOW o AS (ORDER BY d.day))"""
_EMERGE = (MULTI, PAIRS, MOVES, PLACES, NAMES, ROUTES, _DAYS)


@query("w08_emergence", with_(*_EMERGE, """
SELECT day, new_records, CAST(cumulative_records AS BIGINT) AS cumulative_records, CAST(cumulative_nodes AS BIGINT) AS cumulative_nodes,
  CAST(cumulative_edges AS BIGINT) AS cumulative_edges, source_types_seen, len(patterns) AS patterns_detected FROM res"""))
def w08_emergence(spark, sf_dir):
    return P.emergence(E.event_records(spark, sf_dir)).drop("patterns", "new_patterns")


@query("u01_new_patterns", with_(*_EMERGE, """
SELECT day, patterns, list_sort(list_filter(patterns, lambda x: NOT list_contains(before, x))) AS new_patterns
FROM (SELECT day, patterns, coalesce(lag(patterns) OVER (ORDER BY day), []) AS before FROM res)"""))
def u01_new_patterns(spark, sf_dir):
    return P.emergence(E.event_records(spark, sf_dir)).select("day", "patterns", F.array_sort("new_patterns").alias("new_patterns"))


_MOTIFS = """nm AS MATERIALIZED (SELECT id, name, type, community, confidence, CAST(last_seen AS TIMESTAMP) AS ts FROM cnodes WHERE type IN ('event', 'person')),
le AS MATERIALIZED (SELECT source, target, label FROM cedges WHERE label IN ('HAS_SUSPECT', 'OCCURRED_AT')),
l AS MATERIALIZED (SELECT e.target AS person, e.source AS c, n.ts, n.community, n.confidence FROM le e JOIN nm n ON n.id = e.source WHERE label = 'HAS_SUSPECT'),
g AS MATERIALIZED (SELECT person, min((epoch_us(ts) - epoch_us(prev)) // 86400000000) AS gap FROM (SELECT person, ts, lag(ts) OVER (PARTITION BY person ORDER BY ts) AS prev FROM l) WHERE prev IS NOT NULL GROUP BY 1),
sp AS MATERIALIZED (SELECT person, count(DISTINCT o.target) AS locations FROM l JOIN le o ON o.source = l.c AND o.label = 'OCCURRED_AT' GROUP BY 1),
m AS MATERIALIZED (SELECT person, count(*) AS cases, count(DISTINCT community) AS communities, min(confidence) AS cc, min(ts) AS time_start, max(ts) AS time_end FROM l GROUP BY 1 HAVING cases >= 2)"""


@query("w09_motifs", with_(CRIME, _MOTIFS, """
SELECT 'motif-' || m.person AS id, CASE WHEN gap <= 90 THEN 'rapid-repeat' ELSE 'repeat-subject' END AS type,
  CASE WHEN cases >= 3 AND coalesce(gap, 999) <= 30 THEN 'critical' WHEN cases >= 3 THEN 'high' ELSE 'medium' END AS severity,
  name || ': ' || cases || ' linked incidents' AS title, m.person, cases, communities, coalesce(locations, 0) AS locations, gap AS minimum_gap_days,
  time_start, time_end, least(p.confidence, cc) AS confidence FROM m JOIN nm p ON p.id = m.person LEFT JOIN g USING (person) LEFT JOIN sp USING (person)"""))
def w09_motifs(spark, sf_dir):
    return P.person_motifs(E.crime_shape(spark, sf_dir))


@query("w10_area", with_(CRIME, """nm AS MATERIALIZED (SELECT id, name, confidence FROM cnodes WHERE type IN ('location', 'crime')),
le AS MATERIALIZED (SELECT source, target, label FROM cedges WHERE label IN ('OCCURRED_IN_BEAT', 'HAS_CRIME_TYPE')),
top AS MATERIALIZED (SELECT target, count(*) AS cases FROM le WHERE label = 'OCCURRED_IN_BEAT' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
dom AS MATERIALIZED (SELECT n.name AS dominant, count(*) AS k FROM top JOIN le b ON b.target = top.target JOIN le x ON x.source = b.source AND x.label = 'HAS_CRIME_TYPE' JOIN nm n ON n.id = x.target GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""", """
SELECT 'motif-concentration-' || top.target AS id, 'area-concentration' AS type, 'high' AS severity, name || ': ' || cases || ' incident concentration' AS title, cases,
  dominant, k AS dominant_cases, confidence FROM top JOIN nm ON id = top.target, dom"""))
def w10_area(spark, sf_dir):
    return P.area_motif(E.crime_shape(spark, sf_dir))


@query("w13_validation", with_(MULTI, PAIRS, MOVES, PLACES, CONVERGE, NAMES, ROUTES, _EVIDENCE, """
SELECT 'source-classification' AS "check", got = wanted AS passed, got, wanted FROM (SELECT count_if(channel IN ('CDR', 'BANK', 'ANPR', 'SURVEILLANCE', 'OSINT')) AS got, (SELECT count(*) FROM events) AS wanted FROM ev)
UNION ALL SELECT 'source-counts', got = wanted, got, wanted FROM (SELECT count_if(a.n = b.n) AS got, count(*) AS wanted FROM (SELECT channel, count(*) AS n FROM ev GROUP BY 1) a
  FULL JOIN (SELECT CASE event_type WHEN 'click' THEN 'CDR' WHEN 'purchase' THEN 'BANK' WHEN 'view' THEN 'ANPR' WHEN 'error' THEN 'SURVEILLANCE' WHEN 'signup' THEN 'OSINT' END AS channel, count(*) AS n FROM events GROUP BY 1) b USING (channel))
UNION ALL SELECT 'edge-provenance', got = wanted, got, wanted FROM (SELECT count_if(record_id <> '' AND digest <> '' AND channel <> '') AS got, count(*) AS wanted FROM medges)
UNION ALL SELECT 'pattern-acceptance', count(DISTINCT pattern_id) = 5, count(DISTINCT pattern_id), 5 FROM evidence
UNION ALL SELECT 'identity-abstention', got = wanted, got, wanted FROM (SELECT (SELECT count(DISTINCT id) FROM mnodes WHERE type = 'person') AS got, count(DISTINCT key) AS wanted FROM men WHERE type = 'person')"""))
def w13_validation(spark, sf_dir):
    expected = spark.createDataFrame([(p,) for p in rules.PATTERNS], "id string")
    channel = F.create_map(*[F.lit(x) for x in ("click", "CDR", "purchase", "BANK", "view", "ANPR", "error", "SURVEILLANCE", "signup", "OSINT")])
    channels = E.table(spark, sf_dir, "events").groupBy(channel[F.col("event_type")].alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    return P.validate_fusion(E.event_records(spark, sf_dir), expected, channels)


@query("u02_recovered", with_(CRIME, """
SELECT DISTINCT upper(primary_type) AS name, true AS recovered FROM inc UNION SELECT n_name, false FROM nation"""))
def u02_recovered(spark, sf_dir):
    g = E.crime_graph(spark, sf_dir)
    expected = E.incident_rows(spark, sf_dir).select(F.col("primary_type").alias("name")).distinct().unionByName(
        E.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    return P.recovered(expected, g.nodes.select(F.upper("name").alias("name")), "name")


@query("u03_unsupported_types", with_(MULTI, "SELECT DISTINCT type FROM mnodes EXCEPT SELECT unnest(['event', 'person', 'crime', 'vehicle', 'location'])"))
def u03_unsupported_types(spark, sf_dir):
    return P.unsupported_types(E.event_graph(spark, sf_dir))


@query("u04_union_findings", with_(CRIME, MULTI, """
SELECT 'incident' AS origin, label, count(*) AS n, count_if(anomalous) AS flagged, NULL AS channel FROM cedges GROUP BY 2
UNION ALL SELECT 'observation', label, count(*), count_if(anomalous), channel FROM medges GROUP BY label, channel"""))
def u04_union_findings(spark, sf_dir):
    agg = (F.count(F.lit(1)).alias("n"), F.count_if("anomalous").alias("flagged"))
    a = E.crime_graph(spark, sf_dir).edges.groupBy("label").agg(*agg).withColumn("origin", F.lit("incident"))
    b = E.event_graph(spark, sf_dir).edges.groupBy("label", F.col("source_types")[0].alias("channel")).agg(*agg).withColumn("origin", F.lit("observation"))
    return P.union_findings(a, b)
