"""Secret scans: fixed key patterns, and character runs whose sliding-window entropy is high.

Beside the three base kinds every run of 20 or more key characters that holds a digit and
a letter is a candidate.  A window of 20 characters slides over it; the counts of the
window's characters change by one in and one out per step, and with them the sum of
count * log2(count), so each step costs the same however long the window is.  A candidate's class
(hexadecimal, or any key character) sets the entropy limit; the span runs from the first
to the last window that reaches it.  An allow-list (identifiers, dates, running alphabets, placeholders)
is held against the parts between separators: a candidate counts only if enough is left without the parts it
knows, so a listed word in a path hides no key behind it.  Base spans stay whatever the list says.

Sums are integers (millionths of a bit), so limits are compared exactly.  Built-in
functions only.  Defined results: null counts as empty; empty texts and texts without
spans give zero counts and empty lists; repeated rows get equal answers; other columns
pass through (added names replace equal ones).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.spans import bind, matches, tagged

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"  # 16 or more characters of AKIA[A-Z0-9]+: runs are maximal, so the bound can stand in the pattern
HEX = r"[0-9a-f]{32,}+"  # likewise
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits per character that a window must reach: class pattern, limit.
CLASSES = (("^[0-9A-Fa-f]+$", 3.0), ("", 3.6))
#: Parts of candidates that are known not to be secret: identifiers, dates, and what holds a listed word or run between separators.
KNOWN = "|".join((
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "[A-Za-z0-9]*(?i:abcdefgh|01234567|12345678|qwertyui|example|placeholder|changeme|xxxxxx|dummy|lorem)[A-Za-z0-9]*",
    "(?i:your)_",
))
SCALE = 1_000_000
TERMS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 2)]


def limit_sum(bits: float) -> int:
    """Largest sum of count * log2(count) of a window with at least ``bits`` per character."""
    return math.floor(SCALE * WINDOW * (math.log2(WINDOW) - bits))


def entropy_range(value: Column) -> Column:
    """struct<first, last>: ends of the first and last window that reach the class limit, 0 if none does."""
    places = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c).cast("int"))
    limit = F.lit(limit_sum(CLASSES[1][1])).cast("long")
    for pattern, bits in CLASSES[:1]:
        limit = F.when(value.rlike(pattern), F.lit(limit_sum(bits)).cast("long")).otherwise(limit)
    terms = F.array(*[F.lit(t).cast("long") for t in TERMS])
    one = F.lit(1)

    def slide(acc: Column, i: Column) -> Column:
        come = F.element_at(acc["places"], i)
        gone = F.when(i > WINDOW, F.element_at(acc["places"], F.greatest(i - WINDOW, one))).otherwise(F.lit(0))
        was = F.when(gone > 0, F.element_at(acc["counts"], F.greatest(gone, one))).otherwise(F.lit(0))
        has = F.element_at(acc["counts"], come) - F.when(gone == come, one).otherwise(F.lit(0))
        total = acc["total"] - F.when(gone > 0, F.element_at(terms, was + 1) - F.element_at(terms, was)).otherwise(F.lit(0).cast("long")) + F.element_at(terms, has + 2) - F.element_at(terms, has + 1)
        counts = F.transform(acc["counts"], lambda n, k: n + F.when(k + 1 == come, one).otherwise(F.lit(0)) - F.when(k + 1 == gone, one).otherwise(F.lit(0)))
        return F.struct(acc["places"].alias("places"), counts.alias("counts"), total.alias("total"), acc["limit"].alias("limit"),
                        F.when((i >= WINDOW) & (total <= acc["limit"]) & (acc["first"] == 0), i).otherwise(acc["first"]).alias("first"),
                        F.when((i >= WINDOW) & (total <= acc["limit"]), i).otherwise(acc["last"]).alias("last"))

    start = F.struct(places.alias("places"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"), limit.alias("limit"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(F.sequence(one, F.length(value)), start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy that the allow-list does not know."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    unknown = lambda v: F.regexp_replace(v, KNOWN, "")
    candidates = matches(text, CANDIDATE, lambda v: mixed(v) & bind(unknown(v), lambda rest: mixed(rest) & (F.length(rest) >= WINDOW)))
    ranged = F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), entropy_range(s["value"]).alias("r")))
    return F.transform(F.filter(ranged, lambda s: s["r"]["last"] > 0), lambda s: F.struct((s["start"] + s["r"]["first"] - WINDOW).alias("start"), (s["start"] + s["r"]["last"]).alias("end")))


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: array<struct<start, rank, end, kind>> of all spans in order."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != "secrets"]
    own = F.col("__text")
    long_enough = lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8
    kinds = (tagged(matches(own, ASSIGN, long_enough), "assign", 0), tagged(matches(own, ACCESS), "access", 1), tagged(matches(own, HEX), "hex", 2), tagged(entropy_spans(own), "entropy", 3))
    return df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text")).select(*kept, F.array_sort(F.concat(*kinds)).alias("secrets"))
