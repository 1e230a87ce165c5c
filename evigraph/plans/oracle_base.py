"""Shared common table expressions of the checking SQL (DuckDB dialect).

Each constant ends with a comma-free CTE list; ``with_(A, B, sql)`` joins them.
"""

from __future__ import annotations


def with_(*parts: str) -> str:
    """A statement from CTE lists and a final select; a select may open with further CTEs after a comma."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def stable_id(prefix: str, expr: str, digits: int = 32) -> str:
    return f"('{prefix}_' || substr(sha1({expr}), 1, {digits}))"


# -- incident records from orders -------------------------------------------

INCIDENTS = """inc AS MATERIALIZED (
  SELECT o_orderkey AS seq,
    chr(CAST(65 + (o_orderkey // 26000000) % 26 AS INT)) || chr(CAST(65 + (o_orderkey // 1000000) % 26 AS INT))
      || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS case_number,
    CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'A' || translate(CAST(o_custkey // 50 AS VARCHAR), '0123456789', 'abcdefghij')
      || ' B' || translate(CAST(o_custkey % 50 AS VARCHAR), '0123456789', 'abcdefghij') END AS suspect_name,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'KA-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '-MH' END AS vehicle_plate,
    strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey * 7 % 60 AS INT)), '%Y-%m-%d %H:%M:%S') AS date,
    CAST(year(o_orderdate) AS VARCHAR) AS year,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'HOMICIDE' WHEN '2-HIGH' THEN 'ROBBERY' WHEN '3-MEDIUM' THEN 'BURGLARY'
      WHEN '5-LOW' THEN 'THEFT' ELSE 'ASSAULT' END AS primary_type,
    CASE WHEN o_totalprice > 400000 THEN 'ARMED HANDGUN' WHEN o_totalprice > 200000 THEN 'OVER $500' ELSE 'SIMPLE' END AS description,
    lpad(CAST(o_orderkey % 977 AS VARCHAR), 4, '0') || 'XX N MAIN ST' AS block,
    CASE o_orderkey % 4 WHEN 0 THEN 'STREET' WHEN 1 THEN 'APARTMENT' WHEN 2 THEN 'PARKING LOT' ELSE 'RESIDENCE' END AS location_description,
    lpad(CAST(o_custkey % 25 + 1 AS VARCHAR), 3, '0') AS district,
    lpad(CAST(o_custkey % 25 * 10 + o_orderkey % 4 + 100 AS VARCHAR), 4, '0') AS beat,
    CAST(o_custkey % 25 + 1 AS VARCHAR) AS ward, CAST(o_custkey % 25 + 31 AS VARCHAR) AS community_area,
    lpad(CAST(o_orderkey % 900 + 100 AS VARCHAR), 4, '0') AS iucr, lpad(CAST(o_orderkey % 26 AS VARCHAR), 2, '0') AS fbi_code,
    CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS arrest,
    CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END AS domestic
  FROM orders)"""

_INC_KEYS = ("arrest", "beat", "block", "case_number", "community_area", "date", "description", "district", "domestic",
             "fbi_code", "iucr", "location_description", "primary_type", "suspect_name", "vehicle_plate", "ward", "year")
INC_JSON = "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":"' || {k} || '"'""" for k in _INC_KEYS) + ") || '}'"

RISKS = f"""rec AS MATERIALIZED (
  SELECT *, CASE primary_type WHEN 'HOMICIDE' THEN 95 WHEN 'ROBBERY' THEN 84 WHEN 'BURGLARY' THEN 66 WHEN 'ASSAULT' THEN 64
      WHEN 'THEFT' THEN 46 ELSE 45 END AS base_risk,
    least(99, CASE primary_type WHEN 'HOMICIDE' THEN 95 WHEN 'ROBBERY' THEN 84 WHEN 'BURGLARY' THEN 66 WHEN 'ASSAULT' THEN 64
      WHEN 'THEFT' THEN 46 ELSE 45 END + CASE WHEN description LIKE '%HANDGUN%' OR description LIKE '%WEAPON%' THEN 7 ELSE 0 END
      + CASE WHEN arrest = 'true' THEN 0 ELSE 4 END + CASE WHEN domestic = 'true' THEN 5 ELSE 0 END) AS risk,
    CAST(district AS INT) % 8 + 1 AS community, sha256({INC_JSON}) AS digest
  FROM inc),
subj AS MATERIALIZED (SELECT suspect_name, count(*) AS uses, arg_min(risk, seq) AS risk, arg_min(community, seq) AS community,
    arg_min(date, seq) AS date FROM rec WHERE suspect_name <> '' GROUP BY 1),
blk AS MATERIALIZED (SELECT block, count(*) AS uses, arg_min(risk, seq) AS risk, arg_min(community, seq) AS community,
    arg_min(location_description, seq) AS premise, arg_min(district, seq) AS district FROM rec GROUP BY 1)"""

CNODES = f"""cnodes AS MATERIALIZED (
  SELECT {stable_id('case', 'case_number')} AS id, 'Case ' || case_number AS name, 'event' AS type, risk, 96 AS confidence, community,
    upper(primary_type[1]) || lower(primary_type[2:]) || ' — ' || description AS description, block AS location, date AS last_seen,
    concat_ws('|', CASE WHEN arrest = 'true' THEN 'arrest-made' ELSE 'open' END, CASE WHEN domestic = 'true' THEN 'domestic' END) AS tags
  FROM rec
  UNION ALL SELECT {stable_id('suspect', 'suspect_name')}, suspect_name, 'person', CAST(least(99, risk + least(12, 4 * (uses - 1))) AS INT), 96,
    community, 'Named in ' || uses || ' reports.', NULL, date, CASE WHEN uses > 1 THEN 'repeat-subject' ELSE '' END FROM subj
  UNION ALL SELECT {stable_id('vehicle', 'vehicle_plate')}, vehicle_plate, 'vehicle',
    CAST(least(95, least(99, v.risk + least(12, 4 * (s.uses - 1))) + 2) AS INT), 96, v.community,
    'Vehicle named with ' || suspect_name || '.', NULL, NULL, 'registered-vehicle'
  FROM (SELECT vehicle_plate, arg_min(suspect_name, seq) AS suspect_name, arg_min(risk, seq) AS risk, arg_min(community, seq) AS community
        FROM rec WHERE suspect_name <> '' AND vehicle_plate <> '' GROUP BY 1) v JOIN subj s USING (suspect_name)
  UNION ALL SELECT {stable_id('crime', 'primary_type')}, upper(primary_type[1]) || lower(primary_type[2:]), 'crime', min(base_risk), 96,
    arg_min(community, seq), 'Offence of ' || count(*) || ' incidents.', NULL, NULL, '' FROM rec GROUP BY primary_type
  UNION ALL SELECT {stable_id('location', 'block')}, block, 'location', CAST(least(96, risk + least(10, 3 * (uses - 1))) AS INT), 96, community,
    CASE premise WHEN 'PARKING LOT' THEN 'Parking Lot' ELSE upper(premise[1]) || lower(premise[2:]) END || ' in District ' || district || '.',
    block, NULL, CASE WHEN uses > 1 THEN 'repeat-location' ELSE '' END FROM blk
  UNION ALL SELECT {stable_id('beat', 'beat')}, 'Police Beat ' || beat, 'location', CAST(round_even(avg(risk), 0) AS INT), 99,
    arg_max(community, seq), 'Police area with ' || count(*) || ' incidents.',
    'District ' || arg_max(district, seq), NULL, 'police-beat' FROM rec GROUP BY beat)"""

CEDGES = f"""cedges AS MATERIALIZED (
  SELECT 'e' || seq || '-1' AS id, {stable_id('case', 'case_number')} AS source, {stable_id('suspect', 'suspect_name')} AS target,
    'HAS_SUSPECT' AS label, 97 AS confidence, uses > 1 OR r.risk >= 88 AS anomalous, case_number AS record_id, digest, r.date AS observed_at
  FROM rec r JOIN subj USING (suspect_name)
  UNION ALL SELECT 'e' || seq || '-2', {stable_id('suspect', 'suspect_name')}, {stable_id('vehicle', 'vehicle_plate')}, 'DRIVES_VEHICLE', 94,
    uses > 1, case_number, digest, r.date FROM rec r JOIN subj USING (suspect_name) WHERE vehicle_plate <> ''
  UNION ALL SELECT 'e' || seq || '-3', {stable_id('case', 'case_number')}, {stable_id('crime', 'primary_type')}, 'HAS_CRIME_TYPE', 99,
    risk >= 88, case_number, digest, date FROM rec
  UNION ALL SELECT 'e' || seq || '-4', {stable_id('case', 'case_number')}, {stable_id('location', 'block')}, 'OCCURRED_AT', 98,
    uses > 1 AND r.risk >= 75, case_number, digest, date FROM rec r JOIN blk USING (block)
  UNION ALL SELECT 'e' || seq || '-5', {stable_id('case', 'case_number')}, {stable_id('beat', 'beat')}, 'OCCURRED_IN_BEAT', 99,
    false, case_number, digest, date FROM rec)"""

CRIME = ",\n".join((INCIDENTS, RISKS, CNODES, CEDGES))

ADJ = """adj AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT source AS node, target AS nbr FROM cedges UNION ALL SELECT target, source FROM cedges)),
deg AS MATERIALIZED (SELECT n.id, count(a.nbr) AS degree FROM cnodes n LEFT JOIN adj a ON a.node = n.id GROUP BY 1)"""
CRIME_ADJ = CRIME + ",\n" + ADJ

# -- multi-channel records from events ---------------------------------------

EVENTS = """ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS MATERIALIZED (
  SELECT event_id AS seq, ts,
    CASE WHEN event_type = 'view' THEN 'ANPR-' || event_id WHEN event_type = 'error' THEN 'SURV-' || event_id END AS record_id,
    CASE WHEN event_type = 'click' THEN 'CALL-' || event_id END AS call_id,
    CASE WHEN event_type = 'purchase' THEN 'TX-' || event_id END AS transaction_id,
    CASE WHEN event_type = 'signup' THEN 'OSINT-' || event_id END AS post_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
    CASE event_type WHEN 'click' THEN 'voice call' WHEN 'purchase' THEN 'transfer' WHEN 'view' THEN 'plate read'
      WHEN 'error' THEN 'field note' ELSE 'public post' END AS record_type,
    CASE WHEN event_type = 'click' THEN 'Subject ' || user_id END AS caller_name,
    CASE WHEN event_type = 'click' THEN 'PH-' || user_id END AS caller_number,
    CASE WHEN event_type = 'click' THEN 'PH-' || (k % 10) END AS callee_number,
    CASE WHEN event_type = 'click' THEN 'S' || (k % 20) || ' Gate ' || (k % 3) END AS tower_location,
    CASE WHEN event_type = 'purchase' THEN 'Subject ' || user_id END AS sender_name,
    CASE WHEN event_type = 'purchase' THEN 'AC-' || user_id END AS source_account,
    CASE WHEN event_type = 'purchase' THEN 'AC-' || (user_id - user_id % 150 + (user_id % 150 + 15 * (k % 10)) % 150) END AS destination_account,
    CASE WHEN event_type = 'purchase' THEN 'INR ' || CAST(floor(value * 10000) AS BIGINT) END AS amount,
    CASE WHEN event_type = 'view' THEN 'VP-' || k END AS vehicle_plate,
    CASE WHEN event_type = 'view' THEN 'Subject ' || user_id END AS person_name,
    CASE WHEN event_type = 'error' AND user_id % 40 = 7 THEN 'PP-' || user_id END AS protected_person_id,
    CASE WHEN event_type = 'signup' OR (event_type = 'error' AND user_id % 40 <> 7) THEN 'Subject ' || user_id END AS subject,
    CASE WHEN event_type IN ('error', 'signup') THEN 'Org ' || (k % 10) END AS organization,
    CASE WHEN event_type IN ('view', 'error', 'signup') THEN 'S' || (k % 20) || ' Gate ' || (k % 3) END AS location,
    CASE k % 10 WHEN 0 THEN 'suspicious fraud' WHEN 1 THEN 'threat and weapon' ELSE 'routine' END AS signal,
    CASE event_type WHEN 'click' THEN 'CDR' WHEN 'purchase' THEN 'BANK' WHEN 'view' THEN 'ANPR' WHEN 'error' THEN 'SURVEILLANCE' ELSE 'OSINT' END AS channel,
    CASE event_type WHEN 'click' THEN 'CALL-' WHEN 'purchase' THEN 'TX-' WHEN 'view' THEN 'ANPR-' WHEN 'error' THEN 'SURV-' ELSE 'OSINT-' END || event_id AS identifier
  FROM ev0)"""

_EV_KEYS = ("amount", "call_id", "callee_number", "caller_name", "caller_number", "destination_account", "location", "organization",
            "person_name", "post_id", "protected_person_id", "record_id", "record_type", "sender_name", "signal", "source_account",
            "subject", "timestamp", "tower_location", "transaction_id", "vehicle_plate")
EV_JSON = "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":"' || {k} || '"'""" for k in _EV_KEYS) + ") || '}'"

OBSERVED = f"""obs AS MATERIALIZED (
  SELECT *, sha256({EV_JSON}) AS digest,
    CAST(('0x' || substr(sha1(identifier), 1, 4)) AS INT) % 8 + 1 AS community,
    least(95, 45 + CASE k10 WHEN 0 THEN 20 WHEN 1 THEN 20 ELSE 0 END
      + CASE WHEN amt >= 1000000 THEN 20 WHEN amt >= 100000 THEN 10 ELSE 0 END) AS risk
  FROM (SELECT *, CASE signal WHEN 'suspicious fraud' THEN 0 WHEN 'threat and weapon' THEN 1 ELSE 2 END AS k10,
          TRY_CAST(regexp_replace(amount, '[^0-9.-]', '', 'g') AS DOUBLE) AS amt FROM ev)),
men AS MATERIALIZED (
  SELECT seq, identifier, timestamp AS observed_at, risk, digest, channel, community, role, type, relation, alias, name, lower(name) AS key FROM (
    SELECT *, 0 AS role, 'protected_person' AS type, 'HAS_PROTECTED_PERSON' AS relation, 'protected_person_id' AS alias, protected_person_id AS name FROM obs
    UNION ALL SELECT *, 1, 'person', 'MENTIONS_PERSON', CASE WHEN person_name IS NOT NULL THEN 'person_name' WHEN subject IS NOT NULL THEN 'subject'
      WHEN caller_name IS NOT NULL THEN 'caller_name' ELSE 'sender_name' END, coalesce(person_name, subject, caller_name, sender_name) FROM obs
    UNION ALL SELECT *, 3, 'organization', 'MENTIONS_ORGANIZATION', 'organization', organization FROM obs
    UNION ALL SELECT *, 4, 'phone', 'HAS_SOURCE_PHONE', 'caller_number', caller_number FROM obs
    UNION ALL SELECT *, 5, 'phone', 'HAS_DESTINATION_PHONE', 'callee_number', callee_number FROM obs
    UNION ALL SELECT *, 6, 'account', 'HAS_SOURCE_ACCOUNT', 'source_account', source_account FROM obs
    UNION ALL SELECT *, 7, 'account', 'HAS_DESTINATION_ACCOUNT', 'destination_account', destination_account FROM obs
    UNION ALL SELECT *, 8, 'vehicle', 'INVOLVES_VEHICLE', 'vehicle_plate', vehicle_plate FROM obs
    UNION ALL SELECT *, 9, 'location', 'OCCURRED_AT', CASE WHEN location IS NOT NULL THEN 'location' ELSE 'tower_location' END, coalesce(location, tower_location) FROM obs
  ) WHERE name IS NOT NULL),
ent AS MATERIALIZED (SELECT type, key, count(*) AS uses, arg_min(name, seq * 16 + role) AS name, arg_min(risk, seq * 16 + role) AS risk,
    arg_min(community, seq * 16 + role) AS community, arg_min(observed_at, seq * 16 + role) AS observed_at,
    arg_min(alias, seq * 16 + role) AS alias FROM men GROUP BY 1, 2)"""

MNODES = f"""mnodes AS MATERIALIZED (
  SELECT {stable_id('record', 'identifier')} AS id, CASE record_type WHEN 'voice call' THEN 'Voice Call ' WHEN 'transfer' THEN 'Transfer '
      WHEN 'plate read' THEN 'Plate Read ' WHEN 'field note' THEN 'Field Note ' ELSE 'Public Post ' END || identifier AS name, 'event' AS type, risk,
    90 AS confidence, community, timestamp AS last_seen, 'source-observation|generic-schema|source:' || lower(channel) AS tags FROM obs
  UNION ALL SELECT type || '_' || substr(sha1(key), 1, 32), CASE type WHEN 'protected_person' THEN 'Protected Person' ELSE name END, type,
    CAST(CASE type WHEN 'protected_person' THEN 0 ELSE least(95, risk + least(15, 3 * (uses - 1))) END AS INT), 90, community, observed_at,
    CASE WHEN type = 'protected_person' THEN 'privacy-protected|risk-scoring-prohibited' WHEN uses > 1 THEN 'repeat-entity' ELSE 'source-observation' END FROM ent)"""

MEDGES = f"""medges AS MATERIALIZED (
  SELECT 'e' || seq || '-' || role AS id, {stable_id('record', 'identifier')} AS source, type || '_' || substr(sha1(key), 1, 32) AS target,
    relation AS label, 90 AS confidence, type <> 'protected_person' AND (uses > 2 OR m.risk >= 80) AS anomalous, identifier AS record_id, digest,
    channel, m.observed_at FROM men m JOIN ent USING (type, key)
  UNION ALL SELECT 'e' || seq || '-a0', {stable_id('phone', 'lower(caller_number)')}, {stable_id('phone', 'lower(callee_number)')}, 'CALLED', 96,
    risk >= 80, identifier, digest, channel, timestamp FROM obs WHERE caller_number <> callee_number
  UNION ALL SELECT 'e' || seq || '-a1', {stable_id('account', 'lower(source_account)')}, {stable_id('account', 'lower(destination_account)')},
    'TRANSFERRED_TO', 96, risk >= 80, identifier, digest, channel, timestamp FROM obs WHERE source_account <> destination_account)"""

MULTI = ",\n".join((EVENTS, OBSERVED, MNODES, MEDGES))

# -- star graph ----------------------------------------------------------------

STAR = """snodes AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'location' AS type, 0 AS risk, 'region' AS tag FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'location', 0, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'person', CAST(greatest(0, least(99, floor(c_acctbal / 100))) AS INT), 'customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'organization', CAST(greatest(0, least(99, floor(s_acctbal / 100))) AS INT), 'supplier' FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, CAST(o_orderkey AS VARCHAR), 'event', CAST(greatest(0, least(99, floor(o_totalprice / 5000))) AS INT), 'orders' FROM orders),
sedges AS MATERIALIZED (
  SELECT 'nation:' || n_nationkey || ':n_regionkey' AS id, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'IN_REGION' AS label FROM nation
  UNION ALL SELECT 'customer:' || c_custkey || ':c_nationkey', 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey || ':s_nationkey', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey || ':o_custkey', 'orders:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY' FROM orders),
sadj AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT source AS node, target AS nbr FROM sedges UNION ALL SELECT target, source FROM sedges)),
sdeg AS MATERIALIZED (SELECT n.id, count(a.nbr) AS degree FROM snodes n LEFT JOIN sadj a ON a.node = n.id GROUP BY 1)"""

TRADE = STAR + """,
lines AS MATERIALIZED (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_orderkey AS o, l_partkey AS p, l_suppkey AS s,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, min(l_shipdate) AS shipped FROM lineitem GROUP BY ALL),
tnodes AS MATERIALIZED (SELECT id, name, type, risk FROM snodes
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'item', CAST(greatest(0, least(99, floor(p_retailprice / 100))) AS INT) FROM part
  UNION ALL SELECT 'lineitem:' || k, k, 'event', CAST(greatest(0, least(99, floor(cents / 10000000))) AS INT) FROM lines),
tedges AS MATERIALIZED (SELECT id, source, target, label FROM sedges
  UNION ALL SELECT 'lineitem:' || k || ':l_orderkey', 'lineitem:' || k, 'orders:' || o, 'LINE_OF' FROM lines
  UNION ALL SELECT 'lineitem:' || k || ':l_partkey', 'lineitem:' || k, 'part:' || p, 'DELIVERS' FROM lines
  UNION ALL SELECT 'lineitem:' || k || ':l_suppkey', 'lineitem:' || k, 'supplier:' || s, 'SUPPLIED_BY' FROM lines)"""
