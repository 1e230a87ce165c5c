import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from evigraph.llm import divergence, flat

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least_docs=10, top=10):
    """Rows (lang, source, text) by plain counting."""
    docs, count, own = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        own[lang].add(source)
        for t in TERM.findall(text or ""):
            t = t.translate(UPPER)
            docs[lang, t].add(i)
            count[lang, source][t] += 1
    out = []
    for lang, sources in own.items():
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least_docs]
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: chance(count[lang, s]) for s in sources}
        q = chance(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, items, k in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:k]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(n, seed):
    rnd = random.Random(seed)
    words = [*"aa ab abc Abc straße été ünder under_score x1y longlonglonglongA longlonglonglongB".split(), "z" * 80, "z" * 80 + "q"]
    return [(rnd.choice(["en", "fr", None, ""]), rnd.choice(["s1", "s2", "s3", "", None, "ü"]), rnd.choice([None, "", "1 2 3", " ".join(rnd.choices(words, k=rnd.randrange(1, 12)))])) for _ in range(n)] + [("de", "only", None), ("xx", "a", "few words"), ("xx", "b", "few words")]


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "lang string, source string, text string, term string, value string")
    return sorted(tuple(r) for r in divergence.audit(df.repartition(3), **options).collect())


def test_against_plain_counting(spark):
    rows = rows_of(400, 1)
    assert result(spark, rows) == brute(rows)


def test_tiles_and_shards(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 20)
    rows = rows_of(300, 2)
    assert result(spark, rows, least_docs=2, top=3) == brute(rows, 2, 3)


def test_hot_source_and_repeated_rows(spark):
    rows = [("en", "hot", f"same words again {i % 3}") for i in range(300)] + [("en", f"s{i}", "other words") for i in range(20)]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_pointer_sort():
    rnd = random.Random(3)
    for _ in range(30):
        words = ["".join(rnd.choices("abé", k=rnd.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 70]))) for _ in range(rnd.randrange(0, 60))]
        words += rnd.choices(words, k=20) if words else []
        buf = np.frombuffer((" ".join(words) + "\0" * 16).encode(), np.uint8)
        starts, ends = flat.runs(divergence.LETTER[buf])
        order, new = divergence.pointer_sort(buf, starts, ends)
        texts = [w.encode() for w in words]
        assert list(order) == sorted(range(len(texts)), key=lambda i: (texts[i], i))
        assert list(new) == [i == 0 or texts[order[i]] != texts[order[i - 1]] for i in range(len(order))]


def test_slices_add_up():
    rows = [r for r in rows_of(200, 4)]
    columns = [pa.array([(r[i] or "") for r in rows], pa.string()) for i in range(3)]
    whole, parts = Counter(), Counter()
    for sizes, total in (([200], whole), ([50, 70, 80], parts)):
        at = 0
        for size in [*sizes, len(rows) - 200]:
            for batch in divergence.counted_slice(*[c.slice(at, size) for c in columns]):
                for r in batch.to_pylist():
                    total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                    total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
            at += size
    assert whole == parts and whole


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 4 * 10**17, 9 * 10**17
    got = spark.range(1).select(divergence.chance(F.lit(n), F.lit(total), F.lit(10)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 20)
