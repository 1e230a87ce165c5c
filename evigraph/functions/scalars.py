"""Column expressions.  All of them stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions import rules


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*rules.TRUE_WORDS), F.lit(False))


def tristate(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*rules.TRUE_WORDS), F.lit(True)).when(word.isin(*rules.FALSE_WORDS), F.lit(False))


def blank_to_null(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text != "", text)


def entity_key(c: Column) -> Column:
    """Spacing collapsed, trimmed, lower case."""
    return F.lower(collapse(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stable_id(prefix: str, c: Column, digits: int = rules.ID_HEX_SHORT) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.encode(c, "utf-8")), 1, digits))


def canonical_json(fields: Column) -> Column:
    """Compact JSON of a string map, keys in ascending order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def record_digest(fields: Column) -> Column:
    return F.sha2(canonical_json(fields), 256)


def receipt(c: Column) -> Column:
    """SHA-256 over the JSON of a struct whose fields are already in key order."""
    return F.sha2(F.to_json(c, {"ignoreNullFields": "false"}), 256)


def offence_base(primary_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.OFFENCE_RISK.items() for x in pair])
    return F.coalesce(F.element_at(table, F.upper(primary_type)), F.lit(rules.OFFENCE_RISK_DEFAULT))


def offence_risk(primary_type: Column, description: Column, arrest: Column, domestic: Column) -> Column:
    text = F.upper(F.coalesce(description, F.lit("")))
    weapon = reduce(lambda a, b: a | b, [text.contains(w) for w in rules.WEAPON_WORDS])
    points = (
        offence_base(primary_type)
        + F.when(weapon, rules.WEAPON_POINTS).otherwise(0)
        + F.when(~truthy(arrest), rules.OPEN_POINTS).otherwise(0)
        + F.when(truthy(domestic), rules.DOMESTIC_POINTS).otherwise(0)
    )
    return F.least(points, F.lit(rules.OFFENCE_RISK_CAP))


def parse_amount(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9.-]", "").try_cast("double")


def keyword_hits(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(low.contains(w), 1).otherwise(0) for w in rules.RISK_KEYWORDS])


def keyword_risk(text: Column, amount: Column) -> Column:
    steps = F.lit(0)
    for floor, points in reversed(rules.AMOUNT_STEPS):
        steps = F.when(amount >= floor, points).otherwise(steps)
    hits = F.least(F.lit(rules.KEYWORD_CAP), rules.KEYWORD_POINTS * keyword_hits(text))
    return F.least(F.lit(rules.GENERIC_RISK_CAP), F.lit(rules.KEYWORD_BASE) + hits + steps)


def generic_risk(fields: Column, norm: Column) -> Column:
    amount = parse_amount(first_alias(norm, rules.AMOUNT_ALIASES)["value"])
    return keyword_risk(F.concat_ws(" ", F.map_values(fields)), amount)


def normalise_keys(fields: Column) -> Column:
    """Header case and padding never decide whether a field is found."""
    return F.transform_keys(fields, lambda k, v: F.lower(F.trim(k)))


def first_alias(norm: Column, aliases) -> Column:
    """First alias with a non-blank value, as struct(alias, value); null when none.

    One small lambda over the alias list: spelling every alias out as its own
    branch makes generated code so large that compiling it outweighs running it.
    """
    tried = F.transform(F.lit(list(aliases)), lambda a: F.struct(a.alias("alias"), F.trim(norm[a]).alias("value")))
    return F.get(F.filter(tried, lambda x: x["value"] != ""), F.lit(0))


def record_id(norm: Column, seq: Column) -> Column:
    found = first_alias(norm, rules.PATTERN_ID_ALIASES)["value"]
    return F.coalesce(found, F.format_string("ROW-%04d", seq + 1))


def source_channel(norm: Column, identifier: Column) -> Column:
    def has(field: str) -> Column:
        return F.coalesce(F.trim(norm[field]), F.lit("")) != ""

    out = F.when(has("call_id"), "CDR").when(has("transaction_id"), "BANK")
    for prefix, channel in rules.CHANNEL_ID_PREFIXES:
        out = out.when(identifier.startswith(prefix), channel)
    return out.when(has("post_id"), "OSINT").otherwise("OTHER")


def parse_time(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def event_time(norm: Column) -> Column:
    return parse_time(first_alias(norm, rules.PATTERN_TIME_ALIASES)["value"])


def bucket(c: Column) -> Column:
    """First sixteen bits of the SHA-1, modulo eight, from one."""
    return (F.conv(F.substring(F.sha1(F.encode(c, "utf-8")), 1, 4), 16, 10).cast("int") % 8) + 1


def district_bucket(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), (c.cast("bigint") % 8 + 1).cast("int")).otherwise(1)


def place_anchor(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), "[a-z0-9]+", 0)


def risk_band(c: Column) -> Column:
    out = F.when(c >= rules.RISK_BANDS[0][0], rules.RISK_BANDS[0][1])
    for floor, name in rules.RISK_BANDS[1:]:
        out = out.when(c >= floor, name)
    return out.otherwise("low")


def severity_rank(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.SEVERITY_ORDER.items() for x in pair])
    return table[c]


def mask_name(c: Column) -> Column:
    dot = "•"

    def hide(part: Column) -> Column:
        return F.concat(F.substring(part, 1, 1), F.repeat(F.lit(dot), F.greatest(F.lit(2), F.length(part) - 1)))

    parts = F.filter(F.split(c, r"(?U)\s+"), lambda p: p != "")
    return F.concat_ws(" ", F.transform(parts, hide))


def mask_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    shown = F.concat(F.lit("+"), F.substring(digits, 1, 2), F.lit("-" + "•" * 7), F.substring(digits, -3, 3))
    return F.when(F.length(digits) >= 5, shown).otherwise(F.lit("WITHHELD"))


def proxy_point(c: Column, box=rules.PROXY_BOX) -> Column:
    """A display position derived from an id.  Never a source coordinate."""
    lng, lat, lng_span, lat_span = box
    digest = F.sha2(c, 256)

    def fraction(start: int) -> Column:
        return F.conv(F.substring(digest, start, 2), 16, 10).cast("double") / F.lit(255.0)

    x, y = 28 + fraction(1) * 44, 14 + fraction(3) * 70
    return F.struct(
        x.alias("x"), y.alias("y"),
        (F.lit(lat) - (y - 14) / 70 * lat_span).alias("lat"),
        (F.lit(lng) + (x - 28) / 44 * lng_span).alias("lng"),
    )


def iri_local(c: Column) -> Column:
    """Spaces to underscores, everything unsafe percent-encoded."""
    text = F.regexp_replace(F.trim(c), " ", "_")
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def relation_slug(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(c), "_", "-"), "[^a-z0-9-]+", "-")
    text = F.regexp_replace(text, "^-+|-+$", "")
    return F.when(text == "", F.lit("related-to")).otherwise(text)


def describe_fields(fields: Column, n: int = 4) -> Column:
    shown = F.filter(F.map_entries(fields), lambda e: F.trim(e["value"]) != "")
    return F.array_join(
        F.transform(F.slice(shown, 1, n), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " · "
    )


def csv_safe(c: Column) -> Column:
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def xml_escape(c: Column) -> Column:
    out = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def uuid5_url(c: Column) -> Column:
    """Name-based UUID in the URL namespace, from SHA-1 alone."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    digest = F.sha1(F.concat(namespace, F.encode(c, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def extract(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
