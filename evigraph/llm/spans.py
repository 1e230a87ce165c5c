"""Spans of regular-expression matches as columns, by built-in functions only.

The text between matches (``split``) and the matches (``regexp_extract_all``) alternate,
so running lengths give the position of every match in code points.  Patterns must not rescan a
long run from each of its characters, hence the possessive quantifiers and look-behinds of the
callers.  Running values are worked out in parts of the square root of the number of matches,
as an array that grows is copied at every step: work is linear in the text, and the matches' number
to the power 1.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: long, end: long, value: string, left: string, right: string>"


def matches(text: Column, pattern: str, passes: Callable[[Column], Column] | None = None, screen: str | None = None, context: int = 0) -> Column:
    """array<struct<start, end, value, left, right>> of leftmost non-overlapping matches that pass.

    ``screen`` is a cheaper pattern that every text with a passing match contains.
    ``left`` and ``right`` are up to ``context`` characters around the match, not
    reaching into the neighbouring matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("value"), F.slice(gaps, F.lit(2), F.size(found)).alias("next"))
    # of the text between matches only what is needed travels on
    def span(x: Column, end: Column) -> Column:
        left, right = (F.right(x["gap"], F.lit(context)), F.left(x["next"], F.lit(context))) if context else (F.lit(""), F.lit(""))
        return F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"), left.alias("left"), right.alias("right"))

    def placed(bound: Column) -> Column:
        lengths = F.transform(bound, lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long"))
        return F.zip_with(bound, running(lengths, lambda a, b: a + b), span)

    spans = bind(pairs, placed)
    spans = spans if passes is None else F.filter(spans, lambda s: passes(s["value"]))
    return F.when(text.rlike(screen or pattern), spans.cast(f"array<{SPAN}>")).otherwise(F.from_json(F.lit("[]"), f"array<{SPAN}>"))


def parts(items: Column) -> Column:
    """An array cut into arrays of about the square root of its size."""
    def cut(bound: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(bound))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(bound) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(bound, i * size + 1, size))

    return bind(items, cut)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``join`` over an array of longs, from 0."""
    zero, none = F.lit(0).cast("long"), F.from_json(F.lit("[]"), "array<long>")

    def inside(at: Column, part: Column) -> Column:
        grown = lambda acc, x: bind(join(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), grown)

    empty = F.from_json(F.lit("[]"), "array<array<long>>")
    grown = lambda acc, part: bind(inside(acc["at"], part), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
    return F.aggregate(parts(values), F.struct(zero.alias("at"), empty.alias("out")), grown, lambda acc: F.flatten(acc["out"]))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """array<struct<start, rank, end, kind>>, ready to be sorted."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then rank of the kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
