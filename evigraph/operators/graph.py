"""Records to a typed property graph whose edges carry their provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions import scalars as S
from evigraph.session import cut

NODE_COLUMNS = (
    "id", "name", "type", "risk", "confidence", "community", "description", "location", "last_seen", "aliases", "tags",
)
EDGE_COLUMNS = (
    "id", "source", "target", "label", "confidence", "anomalous", "evidence_record_ids", "evidence_hashes",
    "source_types", "observed_at", "epistemic_status",
)


@dataclass(frozen=True)
class EvidenceGraph:
    """Two DataFrames.  Edges are directed, several may join the same pair.

    ``closed`` says that every edge endpoint is known to be a node, so that the
    endpoint check (two semi joins) can be left out.
    """

    nodes: DataFrame
    edges: DataFrame
    closed: bool = False

    def staged(self, nodes: tuple[str, ...] = (), edges: tuple[str, ...] = ()) -> EvidenceGraph:
        """Both tables written once, for operators that read the graph several times.

        Given names keep only those columns, so that others are never computed.
        """
        return EvidenceGraph(cut(self.nodes.select(*(nodes or self.nodes.columns)), "nodes"), cut(self.edges.select(*(edges or self.edges.columns)), "edges"), self.closed)

    def restrict(self, nodes: DataFrame) -> EvidenceGraph:
        """The subgraph induced by ``nodes``."""
        ids = nodes.select("id")
        edges = self.edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(
            ids.select(F.col("id").alias("target")), "target", "left_semi"
        )
        return EvidenceGraph(nodes, edges.select(*self.edges.columns), True)


def _strings() -> Column:
    return F.array().cast("array<string>")


def unfold(df: DataFrame, structs: Column) -> DataFrame:
    """One row per non-null struct of an array.

    The outer generator keeps the optimizer from deriving an "array is not
    empty" filter, which would evaluate the whole array a second time per row.
    """
    return df.select(F.explode_outer(structs).alias("item")).filter("item IS NOT NULL").select("item.*")


def _tags(*pairs) -> Column:
    """Array of the tags whose condition holds."""
    return F.filter(F.array(*[F.when(cond, F.lit(tag)) for cond, tag in pairs]), lambda t: t.isNotNull())


def first_writer(df: DataFrame, keys, order: Column, attrs, **extra: Column) -> DataFrame:
    """One row per key; ``attrs`` come from the row with the smallest ``order``."""
    aggs = [F.min_by(F.struct(*attrs), order).alias("first")] + [c.alias(n) for n, c in extra.items()]
    return df.groupBy(*keys).agg(*aggs).select(*keys, *extra, "first.*")


def repeat_counts(df: DataFrame, keys, name: str = "uses") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# -- crime records ----------------------------------------------------------

def crime_rows(records: DataFrame, provenance: bool = True) -> DataFrame:
    """Typed view of crime-schema records, with risk, bucket and (with ``provenance``) digest."""
    f = F.col("fields")

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(S.blank_to_null(f[name]), F.lit(default))

    typed = records.select(
        "seq",
        text("case_number").alias("case_number"), text("suspect_name").alias("suspect"),
        text("vehicle_plate").alias("plate"), text("primary_type", "Unknown").alias("primary_type"),
        F.coalesce(f["description"], F.lit("No description")).alias("description"),
        text("block").alias("block"),
        F.coalesce(f["location_description"], F.lit("Unknown premise")).alias("premise"),
        text("district", "0").alias("district"), text("beat").alias("beat"),
        S.blank_to_null(f["date"]).alias("date"), f["arrest"].alias("arrest"), f["domestic"].alias("domestic"),
        (S.record_digest(f) if provenance else F.lit(None).cast("string")).alias("digest"),
    )
    return typed.withColumns({
        "risk": S.offence_risk(F.col("primary_type"), F.col("description"), F.col("arrest"), F.col("domestic")),
        "community": S.district_bucket(F.col("district")),
    })


def mean_risk(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.bround(F.avg("risk")).cast("int").alias("mean_risk"))


def _capped(base: Column, uses: Column, step: int, bonus: int, cap: int) -> Column:
    extra = F.least(F.lit(bonus).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), (uses - 1) * step))
    return F.least(F.lit(cap), base + extra.cast("int"))


def _node(kind: str, key: Column, name: Column, entity_type: str, risk: Column, digits: int, *, confidence: int = 96,
          description: Column, location: Column = None, last_seen: Column = None, tags: Column = None):
    none = F.lit(None).cast("string")
    return [
        S.stable_id(kind, key, digits).alias("id"), name.alias("name"), F.lit(entity_type).alias("type"),
        F.greatest(F.lit(0), F.least(risk, F.lit(99))).cast("int").alias("risk"), F.lit(confidence).alias("confidence"),
        F.col("community").cast("int").alias("community"), description.alias("description"),
        (none if location is None else location).alias("location"),
        (none if last_seen is None else last_seen).alias("last_seen"),
        _strings().alias("aliases"), (_strings() if tags is None else tags).alias("tags"),
    ]


def crime_nodes(rows: DataFrame, digits: int = rules.ID_HEX) -> DataFrame:
    """Nodes from ``crime_rows``."""
    kept = F.col("case_number") != ""
    order = F.when(kept, F.col("seq"))  # null orderings lose, so counted rows without a case never write attributes
    total = F.count(F.lit(1))
    written = F.count(F.when(kept, 1))

    case = first_writer(rows.filter(kept), ["case_number"], F.col("seq"),
                        ["primary_type", "description", "block", "date", "arrest", "domestic", "risk", "community"])
    case = case.select(*_node(
        "case", F.col("case_number"), F.concat(F.lit("Case "), "case_number"), "event", F.col("risk"), digits,
        description=F.concat(F.initcap("primary_type"), F.lit(" — "), "description"),
        location=S.blank_to_null(F.col("block")), last_seen=F.col("date"),
        tags=_tags((S.truthy(F.col("arrest")), "arrest-made"), (~S.truthy(F.col("arrest")), "open"),
                   (S.truthy(F.col("domestic")), "domestic")),
    ))

    people = first_writer(rows.filter(F.col("suspect") != ""), ["suspect"], order, ["risk", "community", "date"],
                          uses=total, written=written).filter("written > 0")
    person = people.select(*_node(
        "suspect", F.col("suspect"), F.col("suspect"), "person", _capped(F.col("risk"), F.col("uses"), 4, 12, 99), digits,
        description=F.concat(F.lit("Named in "), "uses", F.lit(" reports.")), last_seen=F.col("date"),
        tags=_tags((F.col("uses") > 1, "repeat-subject")),
    ))

    plates = first_writer(rows.filter(kept & (F.col("suspect") != "") & (F.col("plate") != "")), ["plate"], F.col("seq"),
                          ["suspect", "risk", "community"])
    vehicle = plates.join(people.select("suspect", "uses"), "suspect").select(*_node(
        "vehicle", F.col("plate"), F.col("plate"), "vehicle",
        F.least(F.lit(95), _capped(F.col("risk"), F.col("uses"), 4, 12, 99) + 2), digits,
        description=F.concat(F.lit("Vehicle named with "), "suspect", F.lit(".")),
        tags=F.array(F.lit("registered-vehicle")),
    ))

    crime = first_writer(rows, ["primary_type"], order, ["community"], uses=total, written=written).filter("written > 0")
    crime = crime.select(*_node(
        "crime", F.col("primary_type"), F.initcap("primary_type"), "crime", S.offence_base(F.col("primary_type")), digits,
        description=F.concat(F.lit("Offence of "), "uses", F.lit(" incidents.")),
    ))

    place = first_writer(rows.filter(F.col("block") != ""), ["block"], order, ["premise", "district", "risk", "community"],
                         uses=total, written=written).filter("written > 0")
    place = place.select(*_node(
        "location", F.col("block"), F.col("block"), "location", _capped(F.col("risk"), F.col("uses"), 3, 10, 96), digits,
        description=F.concat(F.initcap("premise"), F.lit(" in District "), "district", F.lit(".")),
        location=F.col("block"), tags=_tags((F.col("uses") > 1, "repeat-location")),
    ))

    beats = rows.filter(F.col("beat") != "").groupBy("beat").agg(
        total.alias("uses"), written.alias("written"),
        F.bround(F.avg(F.when(kept, F.col("risk")))).cast("int").alias("risk"),
        F.max_by(F.struct("community", "district"), order).alias("last"),
    ).filter("written > 0").select("beat", "uses", "risk", "last.*")
    beat = beats.select(*_node(
        "beat", F.col("beat"), F.concat(F.lit("Police Beat "), "beat"), "location", F.col("risk"), digits, confidence=99,
        description=F.concat(F.lit("Police area with "), "uses", F.lit(" incidents.")),
        location=F.concat(F.lit("District "), "district"), tags=F.array(F.lit("police-beat")),
    ))

    out = case
    for part in (person, vehicle, crime, place, beat):
        out = out.unionByName(part)
    return out


def _edge(edge_id: Column, source: Column, target: Column, label, confidence, anomalous: Column, record: Column,
          digest: Column, channel: Column, observed: Column) -> Column:
    return F.struct(
        edge_id.alias("id"), source.alias("source"), target.alias("target"),
        (F.lit(label) if isinstance(label, str) else label).alias("label"),
        (F.lit(confidence) if isinstance(confidence, int) else confidence).alias("confidence"),
        anomalous.alias("anomalous"), F.array(record).alias("evidence_record_ids"),
        F.array(digest).alias("evidence_hashes"), F.array(channel).alias("source_types"),
        observed.alias("observed_at"), F.lit("observed").alias("epistemic_status"),
    )


def _with_counts(rows: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """Left join; blank values match nothing, so each goes under a key of its own instead of all to one task."""
    key = F.when(F.col(column) != "", F.col(column)).otherwise(F.concat(F.lit("\u0000"), F.col("seq").cast("string")))
    return rows.withColumn("_key", key).join(counts.withColumnRenamed(column, "_key"), "_key", "left").drop("_key")


def crime_edges(rows: DataFrame, digits: int = rules.ID_HEX, repeats: bool = True) -> DataFrame:
    """Edges from ``crime_rows``; without ``repeats`` nothing is counted and ``anomalous`` stays null."""
    kept = rows.filter(F.col("case_number") != "")
    if repeats:
        subjects = repeat_counts(rows.filter(F.col("suspect") != ""), ["suspect"], "subject_uses")
        blocks = repeat_counts(rows.filter(F.col("block") != ""), ["block"], "block_uses")
        kept = _with_counts(_with_counts(kept, subjects, "suspect"), blocks, "block")
    rows = kept if repeats else kept.withColumns({c: F.lit(None).cast("bigint") for c in ("subject_uses", "block_uses")})

    def make(n: int, source: Column, target: Column, label: str, confidence: int, anomalous: Column, applies: Column) -> Column:
        edge = _edge(F.concat(F.lit("e"), "seq", F.lit(f"-{n}")), source, target, label, confidence, anomalous if repeats else F.lit(None).cast("boolean"),
                     F.col("case_number"), F.col("digest"), F.lit("FIR"), F.col("date"))
        return F.when(applies, edge)

    def ref(kind: str, column: str) -> Column:
        return S.stable_id(kind, F.col(column), digits)

    case, subject = ref("case", "case_number"), ref("suspect", "suspect")
    known = F.col("suspect") != ""
    repeat = F.coalesce(F.col("subject_uses") > 1, F.lit(False))
    severe = F.col("risk") >= 88
    edges = F.array(
        make(1, case, subject, "HAS_SUSPECT", 97, repeat | severe, known),
        make(2, subject, ref("vehicle", "plate"), "DRIVES_VEHICLE", 94, repeat, known & (F.col("plate") != "")),
        make(3, case, ref("crime", "primary_type"), "HAS_CRIME_TYPE", 99, severe, F.lit(True)),
        make(4, case, ref("location", "block"), "OCCURRED_AT", 98,
             F.coalesce(F.col("block_uses") > 1, F.lit(False)) & (F.col("risk") >= 75), F.col("block") != ""),
        make(5, case, ref("beat", "beat"), "OCCURRED_IN_BEAT", 99, F.lit(False), F.col("beat") != ""),
    )
    return unfold(rows, edges)


def build_crime_graph(records: DataFrame, digits: int = rules.ID_HEX, provenance: bool = True, repeats: bool = True) -> EvidenceGraph:
    """Graph of crime-schema records.

    The typed rows are written once: six kinds of nodes and two counts read
    them, each its own columns, and none repeats the extraction.  ``repeats`` may be left
    out where nobody asks which edges are anomalous.
    """
    rows = cut(crime_rows(records, provenance), "crime-rows")
    return EvidenceGraph(crime_nodes(rows, digits), crime_edges(rows, digits, repeats), True)


# -- multi-source records ---------------------------------------------------

def observations(records: DataFrame, provenance: bool = True) -> DataFrame:
    """One row per record: identity, kind, time, channel, risk and matched roles.

    Without ``provenance`` digest and description stay null and cost nothing.
    """
    unsaid = F.lit(None).cast("string")
    norm = records.select("seq", "fields", S.normalise_keys(F.col("fields")).alias("norm"))
    n = F.col("norm")
    base = norm.select(
        "seq", "fields", "norm",
        F.coalesce(S.first_alias(n, rules.RECORD_ID_ALIASES)["value"], (F.col("seq") + 1).cast("string")).alias("identifier"),
        F.coalesce(S.first_alias(n, rules.KIND_ALIASES)["value"], F.lit("source record")).alias("kind"),
        S.first_alias(n, rules.GRAPH_TIME_ALIASES)["value"].alias("observed_at"),
        S.event_time(n).alias("event_ts"), S.generic_risk(F.col("fields"), n).alias("risk"),
        (S.record_digest(F.col("fields")) if provenance else unsaid).alias("digest"), (S.describe_fields(F.col("fields")) if provenance else unsaid).alias("description"),
        F.array(*[S.first_alias(n, aliases) for *_, aliases in rules.ROLES]).alias("roles"),
    )
    return base.select(
        "seq", "identifier", "kind", "observed_at", "event_ts", "risk", "digest", "description", "roles",
        S.source_channel(n, F.col("identifier")).alias("channel"), S.bucket(F.col("identifier")).alias("community"),
    )


def _role_value(position: Column, index: int) -> Column:
    return F.element_at(F.array(*[F.lit(role[index]) for role in rules.ROLES]), position + 1)


def mentions(observed: DataFrame) -> DataFrame:
    """One row per (record, role) that names an entity."""
    flat = observed.select(
        "seq", "identifier", "observed_at", "event_ts", "risk", "digest", "channel", "community",
        F.posexplode_outer("roles").alias("role", "match"),
    ).filter(F.col("match").isNotNull())
    return flat.select(
        "seq", "role", "identifier", "observed_at", "event_ts", "risk", "digest", "channel", "community",
        _role_value(F.col("role"), 0).alias("type"), _role_value(F.col("role"), 1).alias("relation"),
        F.col("match.alias").alias("alias"), S.collapse(F.col("match.value")).alias("name"),
        S.entity_key(F.col("match.value")).alias("key"),
    )


def entity_id(entity_type: Column, key: Column, digits: int) -> Column:
    return F.concat(entity_type, F.lit("_"), F.substring(F.sha1(F.encode(key, "utf-8")), 1, digits))


#: Columns of the partial rows below, from which nodes are made once all parts of a key are merged.
ENTITY_PARTS = "type string, key string, uses bigint, place bigint, name string, risk int, community int, observed_at string, alias string"
EVENT_PARTS = "identifier string, seq bigint, kind string, risk int, observed_at string, community int, channel string, description string"
_ENTITY_ATTRS = ("name", "risk", "community", "observed_at", "alias")
_EVENT_ATTRS = ("kind", "risk", "observed_at", "community", "channel", "description")


def _as(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in schema.split(", "))])


def entity_parts(mentioned: DataFrame) -> DataFrame:
    """One row per mention, ready for ``merged_entities``."""
    return _as(mentioned.withColumns({"uses": F.lit(1), "place": F.col("seq") * 16 + F.col("role")}), ENTITY_PARTS)


def merged_entities(parts: DataFrame) -> DataFrame:
    """Parts of the same entity in one row: uses add up, the first mention in source order names it.  Merges of merges are the same."""
    one = first_writer(parts, ["type", "key"], F.col("place"), _ENTITY_ATTRS, uses=F.sum("uses"), place=F.min("place"))
    return _as(one, ENTITY_PARTS)


def entity_nodes_of(merged: DataFrame, digits: int = rules.ID_HEX) -> DataFrame:
    protected = F.col("type") == "protected_person"
    return merged.select(
        entity_id(F.col("type"), F.col("key"), digits).alias("id"),
        F.when(protected, "Protected Person").otherwise(F.col("name")).alias("name"), "type",
        F.when(protected, 0).otherwise(_capped(F.col("risk"), F.col("uses"), 3, 15, 95)).cast("int").alias("risk"),
        F.lit(90).alias("confidence"), F.col("community").cast("int").alias("community"),
        F.when(protected, "Masked person under protection: never scored, never ranked.")
        .otherwise(F.concat(F.lit("Observed in "), "uses", F.lit(" records, read from field '"), "alias", F.lit("'."))).alias("description"),
        F.lit(None).cast("string").alias("location"), F.col("observed_at").alias("last_seen"), _strings().alias("aliases"),
        F.when(protected, F.array(F.lit("privacy-protected"), F.lit("risk-scoring-prohibited")))
        .when(F.col("uses") > 1, F.array(F.lit("repeat-entity"))).otherwise(F.array(F.lit("source-observation"))).alias("tags"),
    )


def entity_nodes(mentioned: DataFrame, digits: int = rules.ID_HEX) -> DataFrame:
    one = first_writer(mentioned, ["type", "key"], F.col("seq") * 16 + F.col("role"), _ENTITY_ATTRS, uses=F.count(F.lit(1)))
    return entity_nodes_of(one, digits)


def event_parts(observed: DataFrame) -> DataFrame:
    return _as(observed, EVENT_PARTS)


def merged_events(parts: DataFrame) -> DataFrame:
    """Parts of the same event in one row: the last record in source order describes it."""
    last = parts.groupBy("identifier").agg(F.max_by(F.struct(*_EVENT_ATTRS), "seq").alias("last"), F.max("seq").alias("seq"))
    return _as(last.select("identifier", "seq", "last.*"), EVENT_PARTS)


def event_nodes_of(merged: DataFrame, digits: int = rules.ID_HEX) -> DataFrame:
    return merged.select(*_node(
        "record", F.col("identifier"), F.concat(F.initcap("kind"), F.lit(" "), "identifier"), "event", F.col("risk"), digits,
        confidence=90, description=F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("Structured source record")),
        last_seen=F.col("observed_at"),
        tags=F.array(F.lit("source-observation"), F.lit("generic-schema"), F.concat(F.lit("source:"), F.lower("channel"))),
    ))


def event_nodes(observed: DataFrame, digits: int = rules.ID_HEX) -> DataFrame:
    """A repeated identifier is one event; the last record in source order describes it."""
    last = observed.groupBy("identifier").agg(F.max_by(F.struct(*_EVENT_ATTRS), "seq").alias("last")).select("identifier", "last.*")
    return event_nodes_of(last, digits)


def mention_edges(mentioned: DataFrame, digits: int = rules.ID_HEX) -> DataFrame:
    uses = repeat_counts(mentioned, ["type", "key"])
    rows = mentioned.join(uses, ["type", "key"])
    anomalous = (F.col("type") != "protected_person") & ((F.col("uses") > 2) | (F.col("risk") >= 80))
    return rows.select(_edge(
        F.concat(F.lit("e"), "seq", F.lit("-"), "role"), S.stable_id("record", F.col("identifier"), digits),
        entity_id(F.col("type"), F.col("key"), digits), F.col("relation"), 90, anomalous, F.col("identifier"),
        F.col("digest"), F.col("channel"), F.col("observed_at"),
    ).alias("edge")).select("edge.*")


def actor_links(digits: int = rules.ID_HEX) -> Column:
    """Array of the direct actor edges of one observation, null where a rule does not apply."""
    position = {role[1]: i for i, role in enumerate(rules.ROLES)}
    links = []
    for n, (label, source_role, source_aliases, target_role, target_aliases) in enumerate(rules.ACTOR_LINKS):
        source, target = (F.element_at("roles", position[r] + 1) for r in (source_role, target_role))
        entity = F.lit(rules.ROLES[position[source_role]][0])
        keys = [S.entity_key(m["value"]) for m in (source, target)]
        a, b = (entity_id(entity, key, digits) for key in keys)
        applies = source["alias"].isin(*source_aliases) & target["alias"].isin(*target_aliases) & (keys[0] != keys[1])
        links.append(F.when(applies, _edge(
            F.concat(F.lit("e"), "seq", F.lit(f"-a{n}")), a, b, label, 96, F.col("risk") >= 80, F.col("identifier"),
            F.col("digest"), F.col("channel"), F.col("observed_at"),
        )))
    return F.array(*links)


def actor_edges(observed: DataFrame, digits: int = rules.ID_HEX) -> DataFrame:
    """Phone to phone and account to account, without self loops."""
    return unfold(observed, actor_links(digits))


def build_multisource_graph(records: DataFrame, digits: int = rules.ID_HEX, provenance: bool = True) -> EvidenceGraph:
    """Graph of multi-channel records.

    Observations are written once; nodes, counts and edges read their columns
    from there instead of matching aliases and hashing again.  ``provenance`` may be
    left out where only the shape of the graph is asked for.
    """
    observed = cut(observations(records, provenance), "observations")
    mentioned = mentions(observed)
    nodes = event_nodes(observed, digits).unionByName(entity_nodes(mentioned, digits))
    edges = mention_edges(mentioned, digits).unionByName(actor_edges(observed, digits))
    return EvidenceGraph(nodes, edges, True)


def record_schema() -> Column:
    """``crime`` or ``multisource``, from the keys of the record itself."""
    crime = F.map_contains_key("fields", "case_number") & F.map_contains_key("fields", "primary_type")
    return F.when(F.coalesce(crime, F.lit(False)), "crime").otherwise("multisource")


def build_graph(records: DataFrame, schema: str = "auto", digits: int = rules.ID_HEX) -> EvidenceGraph:
    """Graph of records of either schema, or of one.

    With ``auto`` every record goes to the builder of its own schema and the two
    graphs are joined; an entity that both name keeps the attributes of the crime records.
    """
    if schema != "auto":
        return (build_crime_graph if schema == "crime" else build_multisource_graph)(records, digits)
    parts = [build(records.filter(record_schema() == name), digits) for name, build in (("crime", build_crime_graph), ("multisource", build_multisource_graph))]
    nodes = parts[0].nodes.withColumn("part", F.lit(0)).unionByName(parts[1].nodes.withColumn("part", F.lit(1)))
    one = nodes.groupBy("id").agg(F.min_by(F.struct(*[c for c in NODE_COLUMNS if c != "id"]), "part").alias("n")).select("id", "n.*")
    return EvidenceGraph(one, parts[0].edges.unionByName(parts[1].edges), True)


# -- other graph shapes -----------------------------------------------------

def simple_typed_graph(records: DataFrame) -> EvidenceGraph:
    """Six node types under their plain names, undirected, one edge per unordered pair."""
    rows = crime_rows(records).filter(F.col("case_number") != "")

    def ref(column: str, node_type: str, label: Column | None = None) -> Column:
        name = F.col(column) if label is None else label
        return F.when(F.col(column) != "", F.struct(name.alias("id"), F.lit(node_type).alias("type")))

    parts = rows.select(
        ref("case_number", "CASE").alias("case"), ref("suspect", "SUSPECT").alias("suspect"),
        F.when(F.col("suspect") != "", ref("plate", "VEHICLE")).alias("vehicle"),
        ref("primary_type", "CRIME_TYPE").alias("crime"), ref("block", "LOCATION").alias("location"),
        ref("beat", "POLICE_BEAT", F.concat(F.lit("Beat "), "beat")).alias("beat"),
    )
    columns = ("case", "suspect", "vehicle", "crime", "location", "beat")
    nodes = unfold(parts, F.array(*columns)).distinct()
    pairs = (("case", "suspect", "PERPETRATED_BY"), ("suspect", "vehicle", "DRIVES_VEHICLE"), ("case", "crime", "OFFENSE_TYPE"),
             ("case", "location", "OCCURRED_AT"), ("case", "beat", "OCCURRED_IN_BEAT"))
    links = F.array(*[F.struct(F.least(f"{a}.id", f"{b}.id").alias("source"), F.greatest(f"{a}.id", f"{b}.id").alias("target"),
                               F.lit(label).alias("relationship"),
                               (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("both")) for a, b, label in pairs])
    edges = unfold(parts, links).filter("both").groupBy("source", "target").agg(F.min("relationship").alias("relationship"))
    return EvidenceGraph(nodes, edges)


def star_graph(tables, nodes, edges, closed: bool = False) -> EvidenceGraph:
    """Tables joined by foreign keys, as nodes and provenance-carrying edges.

    With ``closed`` a foreign key that names no row gives no edge; that is checked on the
    keys themselves, so that later checks need no ids.
    """
    none = F.lit(None).cast("string")
    keys = {name: key for name, key, *_ in nodes}
    if closed and (lost := sorted({t for name, _, _, target, *_ in edges for t in (name, target)} - keys.keys())):
        raise ValueError(f"no nodes of {', '.join(lost)}")
    node_parts, edge_parts = [], []
    for name, key, label, entity_type, risk in nodes:
        node_parts.append(tables[name].select(
            F.concat_ws(":", F.lit(name), key).alias("id"), F.col(label).cast("string").alias("name"),
            F.lit(entity_type).alias("type"), F.expr(risk).alias("risk"), F.lit(95).alias("confidence"),
            S.bucket(F.concat_ws(":", F.lit(name), key)).alias("community"), none.alias("description"),
            none.alias("location"), none.alias("last_seen"), _strings().alias("aliases"), F.array(F.lit(name)).alias("tags"),
        ))
    for name, key, foreign, target, label, observed in edges:
        row = F.concat_ws(":", F.lit(name), key)
        fields = F.create_map(*[x for c in sorted({foreign, key}) for x in (F.lit(c), F.col(c).cast("string"))])
        rows = tables[name].filter(F.col(foreign).isNotNull())
        if closed:
            held = tables[target].select(F.col(keys[target]).cast("string").alias("_held"))
            rows = rows.join(held, F.col(foreign).cast("string") == F.col("_held"), "left_semi")
        edge_parts.append(rows.select(_edge(
            F.concat_ws(":", row, F.lit(foreign)), row, F.concat_ws(":", F.lit(target), foreign), label, 95, F.lit(False),
            row, S.record_digest(fields), F.lit("TABLE"),
            none if observed is None else F.date_format(observed, "yyyy-MM-dd HH:mm:ss"),
        ).alias("edge")).select("edge.*"))
    out = [node_parts[0], edge_parts[0]]
    for part in node_parts[1:]:
        out[0] = out[0].unionByName(part)
    for part in edge_parts[1:]:
        out[1] = out[1].unionByName(part)
    return EvidenceGraph(*out, closed)


def apply_protection(g: EvidenceGraph) -> EvidenceGraph:
    """Drop protected people and every edge that touches them, ahead of ranking or models."""
    hidden = g.nodes.filter(F.col("type") == "protected_person").select("id")
    edges = g.edges.join(hidden, g.edges.source == hidden.id, "left_anti").join(hidden, g.edges.target == hidden.id, "left_anti")
    return EvidenceGraph(g.nodes.filter(F.col("type") != "protected_person"), edges, g.closed)
