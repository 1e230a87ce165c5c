"""Secrets and personal data against plain regular expressions."""
import math
import random
import re
import time
from collections import Counter

import pytest
from conftest import ODD
from pyspark.sql import functions as F

from evigraph.llm import pii, secrets
from evigraph.llm.spans import listed

PARTS = ["token", "= ", '"', "secret", ":", "AKIA", "ABCDEFGH1234567", "0123456789abcdef" * 3, "a.b@c.de", "@", "x_y@z.com", ".", " ", "1.2.3.4", "255.", "4111 1111 1111 1111", "+49 ", "(30)", "123 456 78", "-", "é",
         "api_key", "apikey=", "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MA", "\n", "DE89 3704 0044 0532 0130 00", "iban ", "123-45-6789", "social security ", "[", "🙂"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    made = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))) for i in range(100, 1100)]
    # runs that would cost quadratic time if every character began a new attempt
    return made + [(9003, "a.b" * 20000), (9004, "1" * 50000), (9005, "aA1+" * 5000), (9006, "a@" + "b." * 8000 + "c"), (9008, "+" + "1 " * 20000)] + [r for r in ODD if r[0]]


def positions(pattern, text, passes=lambda m: True):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text) if passes(m)]


def brute_secrets(text):
    found = [(a, 0, b, "assign") for a, b in positions(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 8)]
    found += [(a, 1, b, "access") for a, b in positions("AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 16)]
    found += [(a, 2, b, "hex") for a, b in positions("[0-9a-f]+", text, lambda m: len(m[0]) >= 32)]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        left = re.sub(secrets.KNOWN, "", m[0])
        if not (re.search("[0-9]", left) and re.search("[A-Za-z]", left)) or len(left) < 20:
            continue
        bits = 3.0 if re.fullmatch("[0-9A-Fa-f]+", m[0]) else 3.6
        hot = []
        for k in range(len(m[0]) - 19):
            entropy = -sum(c / 20 * math.log2(c / 20) for c in Counter(m[0][k : k + 20]).values())
            if entropy >= bits - 1e-7:
                hot.append(k)
        if hot:
            found.append((m.start() + hot[0], 3, m.start() + hot[-1] + 20, "entropy"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def luhn(value):
    digits = [int(c) for c in re.sub("[^0-9]", "", value)]
    return 12 <= len(digits) <= 19 and sum(d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    found = [(a, 0, b, "email") for a, b in positions(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    found += [(a, 1, b, "ip") for a, b in positions(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(x) <= 255 for x in m[0].split(".")))]
    found += [(a, 2, b, "card") for a, b in positions(r"[0-9]([\x20-]?[0-9])+", text, lambda m: luhn(m[0]))]
    found += [(a, 3, b, "phone") for a, b in positions(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {(r[0], r[1]): r[2] for r in secrets.scanned(df).select("doc_id", "text", listed(F.col("secrets"))).collect()}
    for i, t in rows:
        assert got[i, t] == brute_secrets(t or ""), (i, (t or "")[:200])


def test_pii(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {(r[0], r[1]): r[2] for r in pii.found(df).select("doc_id", "text", listed(F.col("pii"))).collect()}
    for i, t in rows:
        base = ",".join(x for x in got[i, t].split(",") if x.split(":")[0] in pii.BASE)
        assert base == brute_pii(t or ""), (i, (t or "")[:200])


def test_allowed_values_and_context(spark):
    texts = ["id 123e4567-e89b-12d3-a456-426614174000", "key ABCDEFGHIJKLMNOPQRSTUVWX12", "q7Kx9Lm2Zp4Rt6Vw8Yb1Nc3", "pay to DE89 3704 0044 0532 0130 00 now", "DE89 3704 0044 0532 0130 01", "social security 123-45-6789", "part 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[0] for r in secrets.scanned(df).orderBy("doc_id").select(listed(F.col("secrets"))).limit(3).collect()] == ["", "", "entropy:0:23"]
    assert [r[0] for r in pii.found(df).orderBy("doc_id").select(listed(F.col("pii"))).collect()][3:] == ["iban:7:34", "", "ssn:16:27", ""]


def test_masking(spark, clash):
    df = spark.createDataFrame([(1, "x a.b@c.de, +378282246310005 y"), (2, None), (3, "é 1.2.3.4")], "doc_id long, text string")
    assert [r["text"] for r in pii.masked(df).orderBy("doc_id").collect()] == ["x [EMAIL], [PHONE] y", None, "é [IP]"]
    assert pii.masked(clash).columns == clash.columns and pii.masked(clash.limit(0)).count() == 0
    assert pii.found(clash).count() == clash.count() == secrets.scanned(clash).count()


def test_listed_parts_hide_no_key(spark):
    key = "q7Kx9Lm2Zp4Rt6Vw8Yb1Nc3"
    texts = [f"{lead}{key}" for lead in ("", "example/prod/", "2024-01-01-", "s3/lorem/")] + ["2024-01-01-12345678-example", "your_example_api_key_12345678", "abcdefgh1234567890abcdefgh"]
    got = [r[0] for r in secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select("secrets").collect()]
    for text, spans in zip(texts[:4], got[:4], strict=True):
        assert [s["kind"] for s in spans] == ["entropy"] and spans[0]["end"] == len(text) and spans[0]["start"] <= len(text) - len(key)
    assert got[4:] == [[], [], []]


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["iban BE68 5390 0754 7034 AND more", "ES91 2100 0418 4502 0005 1332 BIC ABCD", "BE68539007547034", "BE68539007547034X", "BE68 5390 0754 7035 AND", "ZZ68 5390 0754 7034"]
    got = [r[0] for r in pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select(listed(F.filter("pii", lambda s: s["kind"] == "iban"))).collect()]
    assert got == ["iban:5:24", "iban:0:29", "iban:0:16", "", "", ""]


def test_many_spans_in_one_text(spark):
    n = 100_000
    df = spark.range(1).select(F.repeat(F.lit("é 10.1.2.3 "), n).alias("text"), F.repeat(F.lit("token=abcdefgh1 "), n).alias("other"))
    begin = time.monotonic()
    ips = pii.found(df).select("pii").first()[0]
    assert [(s["start"], s["end"]) for s in ips] == [(11 * i + 2, 11 * i + 10) for i in range(n)]
    assert pii.masked(df).first()["text"] == "é [IP] " * n
    found = secrets.scanned(df, "other").select(F.transform("secrets", lambda s: s["start"])).first()[0]
    assert found == [16 * i for i in range(n)]
    assert time.monotonic() - begin < 150


def test_masked_spans_against_plain_code(spark, rows):
    own = [(i, t) for i, t in rows if 100 <= i < 500]
    df = spark.createDataFrame(own, "doc_id long, text string")
    spans = {r["doc_id"]: sorted((s["start"], s["end"], s["kind"]) for s in r["pii"]) for r in pii.found(df).collect()}
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for r in pii.masked(df).collect():
        text, merged = dict(own)[r["doc_id"]], []
        for a, b, kind in sorted(spans[r["doc_id"]], key=lambda s: (s[0], order[s[2]])):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, kind])
        for a, b, kind in reversed(merged):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        assert r["text"] == text
