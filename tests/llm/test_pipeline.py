import zlib

import duckdb
import pytest
from conftest import SF
from test_near_duplicates import brute

import __spark_entry__
import corpus_pipeline
from evigraph.llm import langid, mixing, pieces, pii
from evigraph.session import cut


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), "pipeline-test")
        rows, was = docs.collect(), {r["doc_id"]: r for r in before.collect()}
        kept[name] = [r["doc_id"] for r in rows]
        assert name == "pieces" or docs.columns == columns
        if name == "language":
            gone = set(was) - set(kept[name])
            assert all(not any(c.isalpha() for c in was[i]["text"] or "") for i in gone)
        elif name == "near_duplicates":
            assert sorted(kept[name]) == sorted({c for _, c, _ in brute([(i, r["text"]) for i, r in was.items()])})
        elif name == "pii":
            assert sorted(kept[name]) == sorted(was)
            assert pii.found(docs).where("exists(pii, s -> s.kind in ('email', 'card'))").isEmpty()
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "mixing":
            want = {r["doc_id"]: len(r["copies"]) for r in mixing.mix(before).collect()}
            assert {i: kept[name].count(i) for i in was} == want
        else:
            lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model())
            for r in rows:
                assert r["token_ids"] == lib.encode(was[r["doc_id"]]["text"], add_eos=True) and r["round_trip"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(kept["pieces"])


def test_short_clean_texts_stay(spark):
    long = "one text in three languages that no model can tell apart"
    learned = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 != 2][:24]
    rows = [(i, long, lang) for i, lang in zip(learned, ["aa", "bb", "cc"] * 8, strict=True)] + [(100, "OK", "aa"), (101, "Li", None), (102, "12 34", "aa"), (103, "", "bb"), (104, None, "cc")]
    kept = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [100, 101, *learned]


def test_queries_against_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    names = [n for n in queries if n.startswith("op") and n in oracles]
    assert len(names) == 11
    for n in names:
        got = queries[n](spark, SF)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles[n]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want)), n


def test_unknown_is_no_language():
    assert langid.UNKNOWN == "und"
