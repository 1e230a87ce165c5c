"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds: email, ip, card (Luhn), phone, and beside these four base kinds iban (mod 97) and
national id numbers (``ssn``), which count only when their score reaches ``LEAST_SCORE``.
A span starts from its kind's score; words of the kind within 48 characters before or 24 after
it, not beyond a neighbouring match, raise it.  Base spans stay whatever their score.

Built-in functions only; every pattern reads a run of characters once, so long texts cost
linear time.  Defined results: null counts as empty; empty texts give zero counts and empty
lists; repeated rows get equal answers; other columns pass through (added names replace
equal ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.spans import bind, matches, parts, running

# A match can start only where a run of its first class starts or the last match ended, so the
# start is tied to that; what cannot be given back is possessive.  Same matches as the plain forms.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
#: A country decides how many characters follow, so capitals behind a number are not taken for a part of it.
IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Characters that may not touch a span of these kinds.
TOUCH = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]"}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Score of a confirmed span, and the words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
WORDS = {
    "email": "mail|contact|write|kontakt", "ip": "address|server|host|adresse", "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobil", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "social|security|ssn|insurance|tax",
}
BONUS, LEAST_SCORE, CONTEXT = 0.3, 0.5, 48


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn."""
    number = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(number, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes mod 97: country and check digits moved to the end, letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _checks() -> dict:
    small = lambda v: F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    card = lambda v: F.when(F.length(_digits(v)).between(12, 19), luhn(_digits(v))).otherwise(False)
    phone = lambda v: F.length(_digits(v)).between(9, 15)
    ssn = lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$")
    return {"email": (EMAIL, None, "@"), "ip": (IP, small, r"[0-9]\.[0-9]"), "card": (CARD, card, r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": (PHONE, phone, r"\+[0-9]"), "iban": ("(?=[A-Z]{2}[0-9]{2})" + IBAN, mod97, "[A-Z]{2}[0-9]{2}"), "ssn": (SSN, ssn, None)}


def _scored(spans: Column, kind: str, rank: int) -> Column:
    near = lambda s: F.lower(F.concat_ws(" ", s["left"], F.left(s["right"], F.lit(CONTEXT // 2)))).rlike(WORDS[kind])
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"),
                                                 F.when(near(s), F.lit(min(1.0, SCORES[kind] + BONUS))).otherwise(F.lit(SCORES[kind])).alias("score")))


def found(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: array<struct<start, rank, end, kind, score>> in order."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != "pii"]
    kinds = []
    for rank, kind in enumerate(KINDS):
        pattern, check, screen = _checks()[kind]
        spans = matches(F.col("__text"), pattern, check, screen, CONTEXT)
        if kind in BASE:
            kinds.append(_scored(spans, kind, rank))
            continue
        apart = F.filter(spans, lambda s: ~s["left"].rlike(TOUCH[kind] + "$") & ~s["right"].rlike("^" + TOUCH[kind]))
        kinds.append(F.filter(_scored(apart, kind, rank), lambda s: s["score"] >= LEAST_SCORE))
    return df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text")).select(*kept, F.array_sort(F.concat(*kinds)).alias("pii"))


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced by ``[KIND]``; overlapping spans become one, named by the first."""
    spans = found(df.select(*[F.col(f"`{c}`") for c in df.columns]), text)
    own = F.col(text)
    clean = F.when(F.size("pii") == 0, own).otherwise(bind(F.col("pii"), lambda found_: bind(_merged(found_), lambda merged: _replaced(own, merged))))
    return spans.withColumn("__clean", clean).select(*[F.col("__clean").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def _merged(spans: Column) -> Column:
    """array<struct<start, end, kind>>: spans that overlap as one, named by the first."""
    upto = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    ahead = F.concat(F.array(F.lit(0).cast("long")), F.slice(upto, F.lit(1), F.greatest(F.size(upto) - 1, F.lit(0))))  # ends before each span
    rows = F.arrays_zip(spans.alias("span"), ahead.alias("ahead"), upto.alias("upto"))

    def joined(all_: Column) -> Column:
        first = F.filter(all_, lambda x: x["span"]["start"] >= x["ahead"])
        # a group ends where the next begins
        next_ = F.concat(F.slice(F.transform(first, lambda x: x["ahead"]), F.lit(2), F.size(first)), F.array(F.element_at(all_, -1)["upto"]))
        return F.zip_with(first, next_, lambda x, end: F.struct(x["span"]["start"].alias("start"), end.alias("end"), x["span"]["kind"].alias("kind")))

    return bind(rows, joined)


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with ``[KIND]`` for each span.  Finding a place in a text reads what is before it, so the text is cut into parts first."""
    def part(own: Column, begin: Column) -> Column:
        at = lambda x: (x - begin).cast("int")
        piece = F.substr(text, (begin + 1).cast("int"), at(F.element_at(own, -1)["end"]))

        def pieces(local: Column) -> Column:
            before = F.concat(F.array(begin), F.transform(own, lambda s: s["end"]))
            marked = F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda s, b: F.concat(F.substr(local, at(b) + 1, (s["start"] - b).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.array_join(marked, "")

        return bind(piece, pieces)

    def cut(all_: Column) -> Column:
        begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(all_, lambda p: F.element_at(p, -1)["end"]))
        done = F.zip_with(all_, F.slice(begins, F.lit(1), F.size(all_)), part)
        return F.concat(F.array_join(done, ""), F.substr(text, (F.element_at(begins, -1) + 1).cast("int"), F.length(text)))

    return bind(parts(spans), cut)
