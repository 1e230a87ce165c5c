"""The driver tables read as evidence.

``events`` are ragged multi-channel records (calls, transfers, plate reads,
surveillance notes, posts); ``orders`` are incident records of the 17-column
crime schema; the star tables are a property graph through their foreign keys.
``seq`` is the source order key: the table's own key, so it is stable across
re-reads and needs no global numbering.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import graph
from evigraph.session import cut, tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out before anything is worked out from them, as a file of one row group is read by one task."""
    return rows.repartition(*keys)


_CALL, _TRANSFER, _PLATE, _WATCH, _POST = (f"event_type = '{t}'" for t in ("click", "purchase", "view", "error", "signup"))
_PROTECTED = f"{_WATCH} AND user_id % 40 = 7"
_SUBJECT = "concat('Subject ', user_id)"
_PLACE = "concat('S', k % 20, ' Gate ', k % 3)"

EVENT_FIELDS = {
    "record_id": f"CASE WHEN {_PLATE} THEN concat('ANPR-', event_id) WHEN {_WATCH} THEN concat('SURV-', event_id) END",
    "call_id": f"CASE WHEN {_CALL} THEN concat('CALL-', event_id) END",
    "transaction_id": f"CASE WHEN {_TRANSFER} THEN concat('TX-', event_id) END",
    "post_id": f"CASE WHEN {_POST} THEN concat('OSINT-', event_id) END",
    "timestamp": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "record_type": f"CASE WHEN {_CALL} THEN 'voice call' WHEN {_TRANSFER} THEN 'transfer' WHEN {_PLATE} THEN 'plate read'"
                   f" WHEN {_WATCH} THEN 'field note' ELSE 'public post' END",
    "caller_name": f"CASE WHEN {_CALL} THEN {_SUBJECT} END",
    "caller_number": f"CASE WHEN {_CALL} THEN concat('PH-', user_id) END",
    "callee_number": f"CASE WHEN {_CALL} THEN concat('PH-', k % 10) END",
    "tower_location": f"CASE WHEN {_CALL} THEN {_PLACE} END",
    "sender_name": f"CASE WHEN {_TRANSFER} THEN {_SUBJECT} END",
    "source_account": f"CASE WHEN {_TRANSFER} THEN concat('AC-', user_id) END",
    "destination_account": f"CASE WHEN {_TRANSFER} THEN concat('AC-', user_id - user_id % 150 + (user_id % 150 + 15 * (k % 10)) % 150) END",
    "amount": f"CASE WHEN {_TRANSFER} THEN concat('INR ', CAST(floor(value * 10000) AS BIGINT)) END",
    "vehicle_plate": f"CASE WHEN {_PLATE} THEN concat('VP-', k) END",
    "person_name": f"CASE WHEN {_PLATE} THEN {_SUBJECT} END",
    "protected_person_id": f"CASE WHEN {_PROTECTED} THEN concat('PP-', user_id) END",
    "subject": f"CASE WHEN {_POST} OR ({_WATCH} AND user_id % 40 <> 7) THEN {_SUBJECT} END",
    "organization": f"CASE WHEN {_WATCH} OR {_POST} THEN concat('Org ', k % 10) END",
    "location": f"CASE WHEN {_PLATE} OR {_WATCH} OR {_POST} THEN {_PLACE} END",
    "signal": "CASE k % 10 WHEN 0 THEN 'suspicious fraud' WHEN 1 THEN 'threat and weapon' ELSE 'routine' END",
}


def to_map(columns) -> Column:
    """A string map holding only the fields a record has."""
    pairs = [x for name in columns for x in (F.lit(name), F.col(name).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def records_of(df: DataFrame, seq: str, columns) -> DataFrame:
    return df.select(F.col(seq).cast("bigint").alias("seq"), to_map(columns).alias("fields"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"), "event_id").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return event_rows_of(events)


def event_rows_of(events: DataFrame) -> DataFrame:
    return events.selectExpr("event_id AS seq", *[f"{sql} AS `{name}`" for name, sql in EVENT_FIELDS.items()])


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return records_of(event_rows(spark, sf_dir), "seq", EVENT_FIELDS)


_DIGIT_WORDS = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"
_NATION = "o_custkey % 25"
INCIDENT_FIELDS = {
    "case_number": "concat(char(65 + CAST(o_orderkey div 26000000 % 26 AS INT)),"
                   " char(65 + CAST(o_orderkey div 1000000 % 26 AS INT)), lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'))",
    "suspect_name": "CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('A', " + _DIGIT_WORDS.format("o_custkey div 50")
                    + ", ' B', " + _DIGIT_WORDS.format("o_custkey % 50") + ") END",
    "vehicle_plate": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('KA-', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'), '-MH') END",
    "date": "date_format(o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), CAST(o_orderkey * 7 % 60 AS INT)), 'yyyy-MM-dd HH:mm:ss')",
    "year": "CAST(year(o_orderdate) AS STRING)",
    "primary_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'HOMICIDE' WHEN '2-HIGH' THEN 'ROBBERY'"
                    " WHEN '3-MEDIUM' THEN 'BURGLARY' WHEN '5-LOW' THEN 'THEFT' ELSE 'ASSAULT' END",
    "description": "CASE WHEN o_totalprice > 400000 THEN 'ARMED HANDGUN' WHEN o_totalprice > 200000 THEN 'OVER $500' ELSE 'SIMPLE' END",
    "block": "concat(lpad(CAST(o_orderkey % 977 AS STRING), 4, '0'), 'XX N MAIN ST')",
    "location_description": "CASE o_orderkey % 4 WHEN 0 THEN 'STREET' WHEN 1 THEN 'APARTMENT' WHEN 2 THEN 'PARKING LOT' ELSE 'RESIDENCE' END",
    "district": f"lpad(CAST({_NATION} + 1 AS STRING), 3, '0')",
    "beat": f"lpad(CAST({_NATION} * 10 + o_orderkey % 4 + 100 AS STRING), 4, '0')",
    "ward": f"CAST({_NATION} + 1 AS STRING)",
    "community_area": f"CAST({_NATION} + 31 AS STRING)",
    "iucr": "lpad(CAST(o_orderkey % 900 + 100 AS STRING), 4, '0')",
    "fbi_code": "lpad(CAST(o_orderkey % 26 AS STRING), 2, '0')",
    "arrest": "CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END",
    "domestic": "CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END",
}


def incident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.selectExpr("o_orderkey AS seq", *[f"{sql} AS `{name}`" for name, sql in INCIDENT_FIELDS.items()])


def incident_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return records_of(incident_rows(spark, sf_dir), "seq", INCIDENT_FIELDS)


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report text per order, written from the incident columns."""
    tune(spark)
    text = F.concat(
        F.lit("On "), F.date_format(F.col("date").cast("timestamp"), "MM/dd/yyyy"), F.lit(" at approximately "),
        F.substring("date", 12, 5), F.lit(" a report with Case Number "), F.col("case_number"),
        F.lit(" was filed. An incident of "), F.col("primary_type"), F.lit(" involving "), F.col("description"),
        F.lit(" was reported at "), F.col("block"), F.lit(", situated in District "), F.col("district"),
        F.lit(", Beat "), F.col("beat"), F.lit(" (Ward "), F.col("ward"), F.lit(", Community Area "),
        F.col("community_area"), F.lit("). It occurred on/at a "), F.col("location_description"),
        F.lit(". The suspect "),
        F.when(F.col("suspect_name") != "", F.concat(F.lit("was identified as "), F.col("suspect_name"))).otherwise(F.lit("is not known")),
        F.when(F.col("vehicle_plate") != "", F.concat(F.lit(" in a car bearing license plate "), F.col("vehicle_plate"))).otherwise(F.lit("")),
        F.lit(". "), F.when(F.col("arrest") == "true", F.lit("ARREST MADE. ")).otherwise(F.lit("No detention. ")),
        F.lit("Domestic dispute: "), F.when(F.col("domestic") == "true", F.lit("YES")).otherwise(F.lit("NO")),
        F.lit(". IUCR code "), F.col("iucr"), F.lit(", FBI Code "), F.col("fbi_code"), F.lit("."),
    )
    return incident_rows(spark, sf_dir).select(F.col("seq").alias("doc_id"), text.alias("text"))


# Foreign keys of the star schema: (table, id column, name column, node type, risk expression)
STAR_NODES = (
    ("region", "r_regionkey", "r_name", "location", "0"),
    ("nation", "n_nationkey", "n_name", "location", "0"),
    ("customer", "c_custkey", "c_name", "person", "CAST(greatest(0, least(99, floor(c_acctbal / 100))) AS INT)"),
    ("supplier", "s_suppkey", "s_name", "organization", "CAST(greatest(0, least(99, floor(s_acctbal / 100))) AS INT)"),
    ("orders", "o_orderkey", "o_orderkey", "event", "CAST(greatest(0, least(99, floor(o_totalprice / 5000))) AS INT)"),
)
# (table, id column, foreign key column, referenced table, label, observation time or None)
STAR_EDGES = (
    ("nation", "n_nationkey", "n_regionkey", "region", "IN_REGION", None),
    ("customer", "c_custkey", "c_nationkey", "nation", "IN_NATION", None),
    ("supplier", "s_suppkey", "s_nationkey", "nation", "BASED_IN", None),
    ("orders", "o_orderkey", "o_custkey", "customer", "PLACED_BY", "o_orderdate"),
)
# Parts and order lines, behind the five tables above
LINE_NODES = (
    ("part", "p_partkey", "p_name", "item", "CAST(greatest(0, least(99, floor(p_retailprice / 100))) AS INT)"),
    ("lineitem", "line_key", "line_key", "event", "CAST(greatest(0, least(99, floor(cents / 10000000))) AS INT)"),
)
LINE_EDGES = (
    ("lineitem", "line_key", "l_orderkey", "orders", "LINE_OF", "shipped"),
    ("lineitem", "line_key", "l_partkey", "part", "DELIVERS", "shipped"),
    ("lineitem", "line_key", "l_suppkey", "supplier", "SUPPLIED_BY", "shipped"),
)


def crime_graph(spark: SparkSession, sf_dir: str, repeats: bool = True) -> graph.EvidenceGraph:
    return graph.build_crime_graph(incident_records(spark, sf_dir), repeats=repeats)


SHAPE = ("id", "source", "target", "label")


def crime_shape(spark: SparkSession, sf_dir: str) -> graph.EvidenceGraph:
    """The incident graph staged without provenance, for questions about its shape."""
    return graph.build_crime_graph(incident_records(spark, sf_dir), provenance=False).staged(edges=SHAPE)


def crime_paths(spark: SparkSession, sf_dir: str) -> graph.EvidenceGraph:
    """The incident graph staged for path search, without digests."""
    return graph.build_crime_graph(incident_records(spark, sf_dir), provenance=False).staged(nodes=("id", "name", "type", "tags"))


def event_graph(spark: SparkSession, sf_dir: str, provenance: bool = True) -> graph.EvidenceGraph:
    return graph.build_multisource_graph(event_records(spark, sf_dir), provenance=provenance)


def star_graph(spark: SparkSession, sf_dir: str) -> graph.EvidenceGraph:
    tune(spark)
    names = {t for t, *_ in STAR_NODES} | {t for t, *_ in STAR_EDGES}
    return graph.star_graph({n: table(spark, sf_dir, n) for n in names}, STAR_NODES, STAR_EDGES)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, line number, part and supplier; the line number alone does not tell lines apart.

    Rows of the same line add up, in whole cents, and the first shipment dates it.
    """
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = spread(table(spark, sf_dir, "lineitem"), *keys).groupBy(*keys).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"), F.min("l_shipdate").alias("shipped"))
    return rows.withColumn("line_key", F.concat_ws("-", *keys))


def trade_graph(spark: SparkSession, sf_dir: str, closed: bool = False) -> graph.EvidenceGraph:
    """All seven tables: the star of ``star_graph`` with parts and order lines.

    With ``closed``, for questions about its shape, lines are added up once and staged, and every edge joins two nodes.
    """
    tune(spark)
    nodes, edges = STAR_NODES + LINE_NODES, STAR_EDGES + LINE_EDGES
    tables = {n: order_lines(spark, sf_dir) if n == "lineitem" else table(spark, sf_dir, n) for n in {t for t, *_ in nodes}}
    if closed:
        tables["lineitem"] = cut(tables["lineitem"], "order-lines")
    return graph.star_graph(tables, nodes, edges, closed)
