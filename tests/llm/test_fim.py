import hashlib
import random
import re

import pyarrow as pa

from evigraph.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(v % (len(units) + 1) for v in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, rows, **options):
    done = fim.transformed(df, **options)
    got = done.select("doc_id", "text", *fim.ADDED, fim.restored(done["output"], done["form"]).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:7] == brute(r["doc_id"], r["text"], **options)
        assert r["back"] == (r["text"] or "")
    return {r["form"] for r in got}


def test_against_plain_code(spark):
    rnd = random.Random(5)
    alphabet = ["a", "é", "\U0001f642", " ", "\n", "\t", "\x0b", " ", "<", "P", ">", "<P", "S>", "\x00", "<M>"]
    rows = [(i, "".join(rnd.choices(alphabet[: rnd.choice([11, 14, 15])], k=rnd.randrange(0, 40)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(df, rows) == {"plain", "psm", "spm"}
    assert check(df, rows, seed=7, rate=100, spm_rate=0) == {"plain", "psm"}


def test_odd_rows(spark, odd):
    check(odd.repartition(2), odd.collect())


def test_extra_columns(spark, clash):
    from pyspark.sql import functions as F

    df = clash.withColumns({c: F.lit("mine") for c in (*fim.ADDED, "n")})
    done = fim.transformed(df)
    assert sorted(done.columns) == sorted(df.columns) and done.where("form = 'mine'").count() == 0 and done.where("n = 'mine'").count() == df.count()


def test_empty_table(spark, odd):
    assert fim.transformed(odd.where("false")).count() == 0


def test_restored_needs_no_more_than_the_output():
    outputs, forms = pa.array(["<P>a <S> c<M> b", "<S> c<P>a <M> b", "<P>", None]), pa.array(["psm", "spm", "plain", "plain"])
    assert fim.restored_batch(outputs, forms).to_pylist() == ["a  b c", "a  b c", "<P>", None]
