import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, SF

from evigraph.llm import pieces

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.default_model())


def texts(library):
    rnd = random.Random(2)
    some = "ab é▁ \n中<s>/0x41\t¿🙂thinger"
    names = [library.id_to_piece(rnd.randrange(300, 32000)) for _ in range(5000)]
    yield from ("".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(800))
    yield from ("".join(rnd.choice(names) for _ in range(30)).replace("▁", " ") for _ in range(300))
    yield from ("".join(rnd.choice("abcdeinrstto") for _ in range(300)) for _ in range(60))
    yield from ("", " ", "  x  ", "▁", "\n\n\n", "</s>", "<0x41>", "a" * 5000, "aaab" * 777, "thethe" * 900)


def test_same_ids_and_texts_as_the_library(library, coder):
    rows = list(texts(library))
    ids, at = coder.encode(pa.array(rows))
    want = library.encode(rows, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert coder.vocabulary.decode(ids, at).to_pylist() == [library.decode(x) for x in want]


def test_decodes_any_ids(library, coder):
    rnd = random.Random(3)
    lists = [[rnd.randrange(0, 400 if k % 2 else 32000) for _ in range(rnd.randint(0, 8))] for k in range(1500)]
    ids, at = np.array([i for x in lists for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert coder.vocabulary.decode(ids, at).to_pylist() == [library.decode(x) for x in lists]


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 5)
    monkeypatch.setattr(pieces, "NEW_CHARS", 10)
    coder = pieces.Coder(pieces.default_model())
    for rows in (["the cat sat", "on the mat"], ["another day", "the cat"]):
        ids, at = coder.encode(pa.array(rows), end=False)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(rows)


def test_tables(spark, odd, clash, library):
    got = {(r["doc_id"], r["text"]): r for r in pieces.tokenized(odd).collect()}
    for i, t in ODD:
        want = library.encode(t or "", add_eos=True)
        assert got[i, t]["token_ids"] == want and got[i, t]["decoded"] == library.decode(want)
    assert pieces.tokenized(clash).columns.count("decoded") == 1
    assert pieces.tokenized(odd.limit(0)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert pieces.tokenized(docs).where("decoded <> text").isEmpty()
