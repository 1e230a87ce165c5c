"""Temporal and cross-source patterns over source records.

Windows are counted on a time grid whose cell equals the window width: a window
that starts in one cell ends in the next, so its count is a suffix of one cell
plus a prefix of the other.  Cells split hot keys, rows with the same key and
time are added up before the first exchange, and the work per cell is linear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions import scalars as S
from evigraph.operators import graph as G
from evigraph.operators.metrics import both_ways, keyed
from evigraph.session import cut

MICROS = 1_000_000


def pattern_rows(records: DataFrame) -> DataFrame:
    """The fields the detectors read, one row per record."""
    norm = records.select("seq", "fields", S.normalise_keys(F.col("fields")).alias("n"))
    n = F.col("n")

    def text(*aliases: str) -> Column:
        return S.first_alias(n, aliases)["value"]

    rows = norm.select(
        "seq", "n", S.record_id(n, F.col("seq")).alias("rid"), S.event_time(n).alias("ts"), S.record_digest(F.col("fields")).alias("digest"),
        text("caller_number").alias("caller"), text("callee_number").alias("callee"),
        text("source_account", "sender_account").alias("source"), text("destination_account", "receiver_account").alias("target"),
        S.parse_amount(n["amount"]).alias("amount"), S.place_anchor(text(*rules.PLACE_ALIASES)).alias("anchor"),
        F.array(*[S.blank_to_null(n[f]) for f in rules.BRIDGE_NAME_FIELDS]).alias("names"),
    )
    return rows.withColumn("channel", S.source_channel(n, F.col("rid"))).drop("n")


def staged_rows(records: DataFrame) -> DataFrame:
    """``pattern_rows`` written once; five detectors read it, each its own columns."""
    return cut(pattern_rows(records), "pattern-rows")


def window_counts(df: DataFrame, keys: list[str], at: str, width: int, distinct_col: str | None = None,
                  distinct_values: tuple[str, ...] = ()) -> DataFrame:
    """For every distinct position ``at`` (BIGINT): rows in [at, at + width], their last position and value mask.

    ``distinct_values`` lists the values of ``distinct_col``, at most 63; bit i of
    ``mask`` tells whether value i occurs in the window.
    """
    bit = F.lit(0).cast("bigint")
    if distinct_col:
        table = F.create_map(*[x for i, v in enumerate(distinct_values) for x in (F.lit(v), F.lit(1 << i).cast("bigint"))])
        bit = F.coalesce(table[F.col(distinct_col)], bit)
    ticks = df.filter(F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("mask"), F.min("seq").alias("first_seq"))
    cell = F.floor(F.col("at") / F.lit(width)).cast("bigint")
    none = F.lit(None).cast("bigint")
    tick = F.struct(cell.alias("cell"), F.col("at").alias("pos"), F.lit(0).alias("probe"), F.col("n").alias("n"),
                    F.col("mask").alias("mask"), F.col("at").alias("seen"))
    probe = F.struct((cell + 1).alias("cell"), (F.col("at") + width).alias("pos"), F.lit(1).alias("probe"),
                     F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("mask"), none.alias("seen"))
    rows = ticks.select(*keys, "at", "first_seq", F.explode_outer(F.array(tick, probe)).alias("r")).select(*keys, "at", "first_seq", "r.*")

    cell_rows = Window.partitionBy(*keys, "cell")
    up = cell_rows.orderBy("pos", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = cell_rows.orderBy(F.desc("pos"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_probe = F.col("probe") == 1

    def part(fn, name: str) -> Column:
        return F.when(is_probe, fn(name).over(up)).otherwise(fn(name).over(down)).alias(name)

    parts = rows.select(*keys, "at", "first_seq", part(F.sum, "n"), part(F.bit_or, "mask"), part(F.max, "seen"))
    return parts.groupBy(*keys, "at").agg(
        F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.max("seen").alias("until"), F.min("first_seq").alias("first_seq"))


def densest_window(df: DataFrame, keys: list[str], ts: str, width_seconds: int, minimum: int = 1, distinct_col: str | None = None,
                   distinct_values: tuple[str, ...] = (), min_distinct: int = 0, all_windows: bool = False) -> DataFrame:
    """Per key the window with the most rows, earliest first; every qualifying window if asked.

    ``first_seq`` is the first row of the key at all, also outside its windows and without a
    time: keys whose windows tie are ranked by it.
    """
    micros = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    counts = window_counts(micros, keys, "_at", width_seconds * MICROS, distinct_col, distinct_values)
    ok = (F.col("n") >= minimum) & (F.bit_count("mask") >= min_distinct)
    kept = counts.filter(ok).select(
        *keys, "n", F.bit_count("mask").alias("n_distinct"), F.timestamp_micros("at").alias("window_start"),
        F.timestamp_micros("until").alias("window_end"), "first_seq")
    if all_windows:
        return kept
    best = F.min(F.struct((-F.col("n")).alias("neg"), "window_start", "window_end", "n_distinct"))
    first = df.groupBy(*keys).agg(F.min("seq").alias("first_seq"))
    return kept.groupBy(*keys).agg(best.alias("b")).join(first, keys).select(
        *keys, (-F.col("b.neg")).alias("n"), "b.n_distinct", "b.window_start", "b.window_end", "first_seq")


def call_pairs(rows: DataFrame) -> DataFrame:
    both = rows.filter(F.col("caller").isNotNull() & F.col("callee").isNotNull())
    return both.withColumns({"low": F.least("caller", "callee"), "high": F.greatest("caller", "callee")})


def transfers(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("source").isNotNull() & F.col("target").isNotNull())


def communication_burst(rows: DataFrame) -> DataFrame:
    return densest_window(call_pairs(rows), ["low", "high"], "ts", rules.BURST_SECONDS, rules.BURST_MINIMUM)


def rapid_transfers(rows: DataFrame) -> DataFrame:
    return densest_window(transfers(rows), ["source", "target"], "ts", rules.TRANSFER_SECONDS, rules.TRANSFER_MINIMUM)


def window_members(rows: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows inside the chosen windows.  ``windows`` has one row per key."""
    joined = rows.join(windows.select(*keys, "window_start", "window_end"), keys)
    return joined.filter(F.col("ts").between(F.col("window_start"), F.col("window_end")))


def cross_source_convergence(rows: DataFrame) -> DataFrame:
    return densest_window(rows.filter(F.col("anchor") != ""), ["anchor"], "ts", rules.CONVERGENCE_SECONDS, 1, "channel",
                          rules.CHANNELS, rules.CONVERGENCE_CHANNELS)


def named_rows(rows: DataFrame) -> DataFrame:
    named = rows.select("seq", "rid", "channel", "ts", "digest", F.explode_outer("names").alias("name")).filter("name IS NOT NULL")
    return named.withColumn("key", F.lower("name"))


def cross_channel_bridge(rows: DataFrame, minimum: int = rules.BRIDGE_CHANNELS) -> DataFrame:
    """Names seen in at least ``minimum`` channels."""
    return named_rows(rows).groupBy("key").agg(
        F.count_distinct("channel").alias("channels"), F.count_distinct("rid").alias("records"),
        F.max_by("name", "seq").alias("display")).filter(F.col("channels") >= minimum)


# -- cycles -------------------------------------------------------------------

def routes(rows: DataFrame) -> DataFrame:
    """(source, target) with transfer count and first and last time; self transfers dropped."""
    moved = transfers(rows).filter(F.col("source") != F.col("target"))
    return moved.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


def directed_triangles(route: DataFrame) -> DataFrame:
    """Every directed 3-cycle once, as a -> b -> c -> a with a the smallest.

    Pairs are oriented from the end with fewer partners to the end with more.
    A node then opens at most sqrt(2 x pairs) paths, hubs included.
    """
    ways = ("n", "lo", "hi")
    forward = F.col("source") < F.col("target")
    pairs = route.groupBy(F.least("source", "target").alias("p"), F.greatest("source", "target").alias("q")).agg(
        *[F.max(F.when(forward, F.col(c))).alias(f"f_{c}") for c in ways], *[F.max(F.when(~forward, F.col(c))).alias(f"b_{c}") for c in ways])
    data = F.struct("p", "q", *[f"{d}_{c}" for d in "fb" for c in ways])
    pairs = pairs.select("p", "q", data.alias("d"))
    ends = pairs.select(F.explode(F.array("p", "q")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    ranked = pairs.join(ends.select(F.col("node").alias("p"), F.col("deg").alias("dp")), "p").join(
        ends.select(F.col("node").alias("q"), F.col("deg").alias("dq")), "q")
    p_first = F.struct("dp", "p") < F.struct("dq", "q")
    out = ranked.select(F.when(p_first, F.col("p")).otherwise(F.col("q")).alias("x"),
                        F.when(p_first, F.col("q")).otherwise(F.col("p")).alias("y"), "d")
    wedge = out.select("x", F.col("y").alias("y1"), F.col("d").alias("d1")).join(
        out.select("x", F.col("y").alias("y2"), F.col("d").alias("d2")), "x").filter("y1 < y2")
    closed = wedge.join(pairs.select(F.col("p").alias("y1"), F.col("q").alias("y2"), F.col("d").alias("d3")), ["y1", "y2"])
    tri = closed.select(F.array_sort(F.array("x", "y1", "y2")).alias("v"), F.array("d1", "d2", "d3").alias("ds"))

    def side(i: int, j: int) -> Column:
        return F.filter("ds", lambda d: (d["p"] == F.col("v")[i]) & (d["q"] == F.col("v")[j]))[0]

    tri = tri.select("v", side(0, 1).alias("s01"), side(1, 2).alias("s12"), side(0, 2).alias("s02"))

    def cycle(order, sides) -> Column:
        fields = [F.col("v")[i].alias(name) for name, i in zip("abc", order, strict=True)]
        parts = [(F.col(f"{s}.{d}_n"), F.col(f"{s}.{d}_lo"), F.col(f"{s}.{d}_hi")) for s, d in sides]
        fields += [reduce(lambda x, y: x + y, [p[0] for p in parts]).alias("n"), F.least(*[p[1] for p in parts]).alias("lo"),
                   F.greatest(*[p[2] for p in parts]).alias("hi"), F.greatest(*[p[1] for p in parts]).alias("ready")]
        return F.when(reduce(lambda x, y: x & y, [p[0].isNotNull() for p in parts]), F.struct(*fields))

    both = F.array(cycle((0, 1, 2), (("s01", "f"), ("s12", "f"), ("s02", "b"))),
                   cycle((0, 2, 1), (("s02", "f"), ("s12", "b"), ("s01", "b"))))
    return G.unfold(tri, both)


def circular_funds(rows: DataFrame, max_span: int = rules.CYCLE_SECONDS) -> DataFrame:
    """3-account cycles whose transfers all lie within ``max_span`` seconds."""
    tri = directed_triangles(routes(rows))
    span = (F.unix_micros("hi") - F.unix_micros("lo")) / MICROS
    return tri.withColumn("span_seconds", span).filter(F.col("span_seconds") <= max_span).drop("ready")


# -- pattern set ----------------------------------------------------------------

def _first(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(1)


def pattern_evidence(rows: DataFrame) -> DataFrame:
    """(pattern_id, rid, channel, digest, ts, amount, note): the records behind each detected pattern.

    Long form, so the evidence of a pattern may be of any size.  Every record counts,
    also one that repeats an id; only the bridge keeps one record per id, its last.
    ``note`` names the route of a cycle and the name of a bridge.
    """
    largest = (F.desc("n"), F.asc("first_seq"))
    columns = ("rid", "channel", "digest", "ts", "amount")

    def tagged(df: DataFrame, pattern: str, note: Column | None = None) -> DataFrame:
        said = F.lit(None).cast("string") if note is None else note
        return df.select(F.lit(pattern).alias("pattern_id"), *columns, said.alias("note"))

    parts = []
    for pattern, source, windows, keys in (
        ("communication-burst", call_pairs(rows), communication_burst(rows), ["low", "high"]),
        ("rapid-split-transfer", transfers(rows), rapid_transfers(rows), ["source", "target"]),
        ("cross-source-convergence", rows, cross_source_convergence(rows), ["anchor"]),
    ):
        parts.append(tagged(window_members(source, F.broadcast(_first(windows, *largest)), keys), pattern))
    cycle = _first(circular_funds(rows), F.asc("a"), F.asc("b"), F.asc("c"))
    legs = cycle.select(F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("c").alias("target")),
        F.struct(F.col("c").alias("source"), F.col("a").alias("target")))).alias("leg"), F.concat_ws(" > ", "a", "b", "c", "a").alias("route")).select("leg.*", "route")  # three rows
    parts.append(tagged(transfers(rows).join(F.broadcast(legs), ["source", "target"]), "circular-fund-flow", F.col("route")))
    name = _first(cross_channel_bridge(rows), F.desc("channels"), F.desc("records"), F.desc("key")).select("key", "display")
    bridge = named_rows(rows).join(F.broadcast(name), "key")
    last = F.max(F.struct("seq", "channel", "digest", "ts", "display")).alias("last")
    bridge = bridge.groupBy("rid").agg(last).select("rid", "last.*").withColumn("amount", F.lit(None).cast("double"))
    parts.append(tagged(bridge, "cross-channel-bridge", F.col("display")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def detect_patterns(rows: DataFrame) -> DataFrame:
    """One envelope per detected pattern, in review order.

    The receipt covers every evidence digest through two order-free sums, so it
    is computed by partial aggregation rather than by collecting the evidence.
    """
    def half(start: int) -> Column:
        return F.sum(F.conv(F.substring("digest", start, 15), 16, 10).cast("decimal(20,0)"))

    found = pattern_evidence(rows).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_set("channel")).alias("source_types"),  # at most 7 channels
        F.min("ts").alias("time_start"), F.max("ts").alias("time_end"), half(1).alias("s1"), half(16).alias("s2"),
        F.min("amount").alias("low"), F.max("amount").alias("high"), F.max("note").alias("note"))
    count, kinds = F.col("n_evidence"), F.size("source_types")
    said = F.when(F.col("pattern_id") == "communication-burst", F.concat(count, F.lit(" calls between one pair of numbers within half an hour")))
    said = said.when(F.col("pattern_id") == "rapid-split-transfer", F.concat(
        count, F.lit(" transfers on one route within 45 minutes, amounts "), F.format_number(F.coalesce("low", F.lit(0.0)), 0), F.lit(" to "), F.format_number(F.coalesce("high", F.lit(0.0)), 0)))
    said = said.when(F.col("pattern_id") == "circular-fund-flow", F.concat(F.lit("transfers lead back to their origin: "), F.col("note")))
    said = said.when(F.col("pattern_id") == "cross-source-convergence", F.concat(count, F.lit(" observations of "), kinds, F.lit(" kinds at one place within half an hour")))
    found = found.withColumn("explanation", said.otherwise(F.concat(F.col("note"), F.lit(" is named in "), kinds, F.lit(" kinds of records"))))
    fixed = F.create_map(*[x for pid, (kind, title, severity, confidence, alternative, action) in rules.PATTERNS.items() for x in (
        F.lit(pid), F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit(severity).alias("severity"),
                             F.lit(confidence).alias("confidence"), F.lit(alternative).alias("alternative"), F.lit(action).alias("analyst_action")))])
    out = found.select(F.col("pattern_id").alias("id"), fixed[F.col("pattern_id")].alias("p"), "explanation", "n_evidence", "source_types",
                       "time_start", "time_end", F.concat_ws(":", "n_evidence", "s1", "s2").alias("evidence")).select(
        "id", "p.*", "explanation", "n_evidence", "source_types", "time_start", "time_end", "evidence")
    receipt = S.receipt(F.struct("confidence", "evidence", "id", "severity", "time_end", "time_start", "type"))
    return out.withColumn("receipt", receipt).drop("evidence").orderBy(
        F.desc(S.severity_rank(F.col("severity"))), F.desc("confidence"), "title")


# -- emergence over time ----------------------------------------------------------

def _first_days(rows: DataFrame) -> DataFrame:
    """(pattern, day): the first day on which each monotone pattern exists."""
    back = rows.withColumn("back", -F.unix_micros("ts"))  # a window read backwards ends at its last record

    def first(df, keys, width, least_rows, channels=0):
        counts = window_counts(df, keys, "back", width * MICROS, "channel", rules.CHANNELS)
        hit = counts.filter((F.col("n") >= least_rows) & (F.bit_count("mask") >= channels))
        return hit.agg(F.to_date(F.timestamp_micros(-F.max("at"))).alias("day"))

    parts = [
        first(call_pairs(back), ["low", "high"], rules.BURST_SECONDS, rules.BURST_MINIMUM).withColumn("pattern", F.lit("communication-burst")),
        first(transfers(back), ["source", "target"], rules.TRANSFER_SECONDS, rules.TRANSFER_MINIMUM).withColumn("pattern", F.lit("rapid-split-transfer")),
        first(back.filter(F.col("anchor") != ""), ["anchor"], rules.CONVERGENCE_SECONDS, 1, rules.CONVERGENCE_CHANNELS).withColumn(
            "pattern", F.lit("cross-source-convergence")),
    ]
    seen = named_rows(rows).filter("ts IS NOT NULL").groupBy("key", "channel").agg(F.min("ts").alias("ts"))
    firsts = seen.groupBy("key").agg(F.array_sort(F.collect_list("ts")).alias("t"))  # one entry per channel
    bridge = firsts.filter(F.size("t") >= rules.BRIDGE_CHANNELS).agg(
        F.to_date(F.min(F.element_at("t", rules.BRIDGE_CHANNELS))).alias("day"))
    parts.append(bridge.withColumn("pattern", F.lit("cross-channel-bridge")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("day IS NOT NULL")


def _cycle_changes(rows: DataFrame) -> DataFrame:
    """(day, change): cycles that start (+1) or stop (-1) being within the span that day.

    A later transfer on any of the three routes can stretch a cycle beyond the
    span, so this pattern may disappear again.
    """
    dated = rows.filter("ts IS NOT NULL")
    tri = directed_triangles(routes(dated)).withColumn("limit", F.timestamp_micros(F.unix_micros("lo") + rules.CYCLE_SECONDS * MICROS))
    tri = tri.filter("ready <= limit").withColumn("cycle", F.concat_ws(">", "a", "b", "c"))
    legs = tri.select("cycle", "ready", "limit", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("c").alias("target")),
        F.struct(F.col("c").alias("source"), F.col("a").alias("target")))).alias("leg")).select("cycle", "ready", "limit", "leg.*")
    moves = transfers(dated).select("source", "target", "ts")
    late = legs.join(moves, ["source", "target"]).groupBy("cycle", "ready").agg(F.min(F.when(F.col("ts") > F.col("limit"), F.col("ts"))).alias("late"))
    spans = late.select(F.to_date("ready").alias("start"), F.to_date("late").alias("stop")).filter("stop IS NULL OR stop > start")
    changes = F.array(F.struct(F.col("start").alias("day"), F.lit(1).alias("change")),
                      F.when(F.col("stop").isNotNull(), F.struct(F.col("stop").alias("day"), F.lit(-1).alias("change"))))
    return G.unfold(spans, changes).groupBy("day").agg(F.sum("change").alias("change"))


def emergence(records: DataFrame) -> DataFrame:
    """Per day: new and cumulative records, nodes, edges, channels and patterns.

    One pass over first-seen days and running sums; nothing is rebuilt per day.
    The final window holds one row per calendar day.
    """
    rows = staged_rows(records)
    dated = G.observations(records, provenance=False).filter("event_ts IS NOT NULL").drop("description", "kind")
    observed = cut(dated.withColumn("day", F.to_date("event_ts")), "dated")  # matched once, read by five counts
    mentioned = G.mentions(observed).withColumn("day", F.to_date("event_ts"))
    count = F.count(F.lit(1))

    links = F.aggregate(G.actor_links(), F.lit(0).cast("bigint"), lambda k, e: k + F.when(e.isNull(), 0).otherwise(1))
    per_day = observed.groupBy("day").agg(
        count.alias("new_records"), F.sum(links).alias("links"))
    first_days = observed.groupBy("channel").agg(F.min("day").alias("day"))  # one row per channel, of which there are seven kinds
    channel_days = first_days.agg(F.map_from_entries(F.collect_list(F.struct("channel", "day"))).alias("channel_days"))
    event_days = observed.groupBy("identifier").agg(F.min("day").alias("day")).groupBy("day").agg(count.alias("k"))
    entity_days = mentioned.groupBy("type", "key").agg(F.min("day").alias("day")).groupBy("day").agg(count.alias("k"))
    node_days = event_days.unionByName(entity_days).groupBy("day").agg(F.sum("k").alias("new_nodes"))
    mention_days = mentioned.groupBy("day").agg(count.alias("mentions"))
    per_day = per_day.join(mention_days, "day", "left")
    per_day = per_day.withColumn("new_edges", F.col("links") + F.coalesce("mentions", F.lit(0)))

    days = per_day.join(node_days, "day", "left").join(_cycle_changes(rows), "day", "left")
    started = _first_days(rows).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "day"))).alias("started"))  # four entries
    days = days.join(F.broadcast(started)).join(F.broadcast(channel_days))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def total(name: str) -> Column:
        return F.sum(F.coalesce(name, F.lit(0))).over(run)

    monotone = sorted(set(rules.PATTERNS) - {"circular-fund-flow"})
    here = [F.when(F.col("started")[p] <= F.col("day"), F.lit(p)) for p in monotone]
    here.append(F.when(total("change") > 0, F.lit("circular-fund-flow")))
    out = days.select(
        "day", "new_records", total("new_records").alias("cumulative_records"), total("new_nodes").alias("cumulative_nodes"),
        total("new_edges").alias("cumulative_edges"),
        F.array_sort(F.map_keys(F.map_filter("channel_days", lambda c, first: first <= F.col("day")))).alias("source_types_seen"),
        F.array_sort(F.filter(F.array(*here), lambda p: p.isNotNull())).alias("patterns"),
    )
    previous = F.coalesce(F.lag("patterns").over(Window.orderBy("day")), F.array().cast("array<string>"))
    return out.withColumn("new_patterns", F.array_except("patterns", previous)).withColumn("patterns_detected", F.size("patterns"))


# -- graph motifs -------------------------------------------------------------------

def _person_cases(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(person, case, n) by key: pairs of a person and an event, with their number of edges."""
    person = nodes.filter("type = 'person'").select(F.col("key").alias("node"))
    event = nodes.filter("type = 'event'").select(F.col("key").alias("nbr"))
    return both_ways(pairs).join(person, "node", "left_semi").join(event, "nbr", "left_semi").select(F.col("node").alias("person"), F.col("nbr").alias("case"), "n")


def person_motifs(g: G.EvidenceGraph) -> DataFrame:
    """Persons linked to two or more cases, with gaps, spread and severity.

    Gaps are whole days between consecutive cases.  Cases are summed up per
    person and day first, so a hot person costs one row per calendar day.
    """
    nodes, pairs = keyed(g)
    cases = nodes.filter("type = 'event'").select(
        F.col("key").alias("case"), S.parse_time(F.col("last_seen")).alias("ts"), "community", F.col("confidence").alias("case_confidence"))
    linked = cut(_person_cases(nodes, pairs).join(cases, "case"), "person-cases")
    totals = linked.groupBy("person").agg(
        F.sum("n").alias("cases"), F.count_distinct("community").alias("communities"), F.min("case_confidence").alias("case_confidence"),
        F.min("ts").alias("time_start"), F.max("ts").alias("time_end")).filter("cases >= 2")
    daily = linked.filter("ts IS NOT NULL").groupBy("person", F.to_date("ts").alias("day")).agg(
        F.sum("n").alias("k"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    before = F.lag("hi").over(Window.partitionBy("person").orderBy("day"))
    gap = F.floor((F.unix_micros("lo") - F.unix_micros(before)) / (86_400 * MICROS))
    gaps = daily.withColumn("gap", F.when(F.col("k") > 1, F.lit(0)).otherwise(gap)).groupBy("person").agg(F.min("gap").cast("bigint").alias("minimum_gap_days"))
    places = nodes.filter((F.col("type") == "location") & ~F.array_contains("tags", "police-beat")).select(F.col("key").alias("place"))
    near = both_ways(pairs).select(F.col("node").alias("case"), F.col("nbr").alias("place")).join(places, "place", "left_semi")
    spread = linked.select("person", "case").join(near, "case").groupBy("person").agg(F.count_distinct("place").alias("locations"))
    people = nodes.filter("type = 'person'").select(F.col("key").alias("person"), "id", "name", "confidence")
    out = totals.join(people, "person").join(gaps, "person", "left").join(spread, "person", "left").withColumn("person", F.col("id")).drop("id")
    rapid = F.coalesce("minimum_gap_days", F.lit(999))
    return out.select(
        F.concat(F.lit("motif-"), "person").alias("id"), F.when(F.col("minimum_gap_days") <= 90, "rapid-repeat").otherwise("repeat-subject").alias("type"),
        F.when((F.col("cases") >= 3) & (rapid <= 30), "critical").when(F.col("cases") >= 3, "high").otherwise("medium").alias("severity"),
        F.concat("name", F.lit(": "), "cases", F.lit(" linked incidents")).alias("title"), "person", "cases", "communities",
        F.coalesce("locations", F.lit(0)).alias("locations"), "minimum_gap_days", "time_start", "time_end",
        F.least("confidence", "case_confidence").alias("confidence"))


def area_motif(g: G.EvidenceGraph) -> DataFrame:
    """The beat with the most case links and its most frequent offence."""
    nodes, pairs = keyed(g)
    adj = both_ways(pairs)
    beats = nodes.filter((F.col("type") == "location") & F.array_contains("tags", "police-beat")).select(F.col("key").alias("node"), "id", "name", "confidence")
    events = nodes.filter("type = 'event'").select(F.col("key").alias("nbr"))
    # a loop counts at both of its ends, but no beat is an event
    cases = adj.join(beats.select("node"), "node", "left_semi").join(events, "nbr", "left_semi")
    counts = cases.groupBy("node").agg(F.sum("n").alias("cases")).join(beats, "node")
    top = cut(counts.orderBy(F.desc("cases"), "id").limit(1), "top-beat")
    members = cases.join(F.broadcast(top.select("node")), "node", "left_semi").select(F.col("nbr").alias("case"), F.col("n").alias("times"))
    crimes = nodes.filter("type = 'crime'").select(F.col("key").alias("nbr"), F.col("name").alias("offence"))
    offences = adj.withColumnRenamed("node", "case").join(members, "case").join(crimes, "nbr").groupBy("offence").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    top = top.withColumn("node", F.col("id")).drop("id")
    dominant = offences.orderBy(F.desc("n"), "offence").limit(1)
    return top.join(F.broadcast(dominant), F.lit(True), "left").select(
        F.concat(F.lit("motif-concentration-"), "node").alias("id"), F.lit("area-concentration").alias("type"), F.lit("high").alias("severity"),
        F.concat("name", F.lit(": "), "cases", F.lit(" incident concentration")).alias("title"), "cases",
        F.coalesce("offence", F.lit("unknown")).alias("dominant"), F.coalesce("n", F.lit(0)).alias("dominant_cases"), "confidence")


# -- set operations --------------------------------------------------------------------

def recovered(expected: DataFrame, detected: DataFrame, column: str) -> DataFrame:
    """Expected values with a flag telling whether they were detected."""
    hit = detected.select(column).distinct().withColumn("recovered", F.lit(True))
    return expected.select(column).distinct().join(hit, column, "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))


def unsupported_types(g: G.EvidenceGraph, supported=rules.MODEL_ENTITY_TYPES) -> DataFrame:
    return g.nodes.select("type").distinct().filter(~F.col("type").isin(*supported))


def union_findings(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def validate_fusion(records: DataFrame, expected_patterns: DataFrame, expected_channels: DataFrame) -> DataFrame:
    """Five acceptance checks as (check, passed, got, wanted).

    ``expected_patterns`` has column id, ``expected_channels`` has channel and n.
    """
    rows = staged_rows(records)
    g = G.build_multisource_graph(records)
    channels = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    classified = channels.agg(F.sum(F.when(F.col("channel") != "OTHER", F.col("n")).otherwise(0)).alias("got"), F.sum("n").alias("wanted")).select(
        F.lit("source-classification").alias("check"), "got", "wanted")
    matched = expected_channels.withColumnRenamed("n", "want").join(channels, "channel", "full").agg(
        F.sum(F.when(F.col("n") == F.col("want"), 1).otherwise(0)).alias("got"), F.count(F.lit(1)).alias("wanted")).select(
        F.lit("source-counts").alias("check"), "got", "wanted")
    covered = g.edges.agg(F.count_if((F.size("evidence_record_ids") > 0) & (F.size("evidence_hashes") > 0) & (F.size("source_types") > 0)).alias("got"),
                          F.count(F.lit(1)).alias("wanted")).select(F.lit("edge-provenance").alias("check"), "got", "wanted")
    hits = recovered(expected_patterns, pattern_evidence(rows).select(F.col("pattern_id").alias("id")), "id")
    patterns = hits.agg(F.count_if("recovered").alias("got"), F.count(F.lit(1)).alias("wanted")).select(F.lit("pattern-acceptance").alias("check"), "got", "wanted")
    names = G.mentions(G.observations(records)).filter("type = 'person'").select("key").distinct()
    people = g.nodes.filter("type = 'person'").select("id")
    merged = names.agg(F.count(F.lit(1)).alias("wanted")).join(F.broadcast(people.agg(F.count_distinct("id").alias("got")))).select(
        F.lit("identity-abstention").alias("check"), "got", "wanted")
    out = classified.unionByName(matched).unionByName(covered).unionByName(patterns).unionByName(merged)
    return out.select("check", (F.col("got") == F.col("wanted")).alias("passed"), F.col("got").cast("bigint"), F.col("wanted").cast("bigint"))
