import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import encode as E

DIR = E.TOKENIZER_DIR


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return E.Encoder(E.Merges.load(f"{DIR}/byte_bpe_50k.json"))


def same(encoder, library, texts):
    got = [a.tolist() for a in encoder.encode(texts)]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want


def test_hard_texts(encoder, library):
    same(encoder, library, ["", None, " ", "a" * 999, "aaaa aaa aa a", "=-=-=", "<|endoftext|> x", "日本語 é́ 👩‍👩‍👧", "\r\n\n\t ", "1,234.56-", "x " * 5000, "abcabcabc" * 3000])


def test_corpus(encoder, library, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    same(encoder, library, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, library, texts):
    same(encoder, library, texts)


def test_round_trip_without_library(encoder):
    """Bytes of the ids give the text back."""
    m = encoder.merges
    byte = {int(i): bytes([b]) for b, i in enumerate(m.byte_id)}
    for a, b, c in zip(m.left.tolist(), m.right.tolist(), m.made.tolist()):
        byte[c] = byte[a] + byte[b]
    t = "Total for 1010-0000 Operating Cash  (1,234.50)\r\nñandú ☃"
    assert b"".join(byte[i] for i in encoder.encode([t])[0].tolist()).decode() == t


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x" * 50000, 9)], "doc_id long, text string, ids int")
    rows = sorted((r.doc_id or 0, list(r.ids)) for r in E.encode_corpus(df).collect())
    assert rows[1] == (1, [64, 275]) and rows[2] == (2, []) and rows[3] == rows[4] == (3, []) and len(rows[0][1]) > 1
    n = {(r.doc_id or 0): r.n_tokens for r in E.count_tokens(df).collect()}
    assert n[1] == 2 and n[2] == 0 and n[0] == len(rows[0][1])
    assert E.encode_corpus(df.limit(0)).count() == 0


def test_overlapping_pairs_merge_from_the_left():
    m = E.Merges(np.array([97], np.int32), np.array([97], np.int32), np.array([300], np.int32), np.arange(256, dtype=np.int32))
    ids, at = m.encode_pieces([b"aaaaa", b"", b"aba", b"aa"])
    assert ids.tolist() == [300, 300, 97, 97, 98, 97, 300] and at.tolist() == [0, 3, 3, 6, 7]
