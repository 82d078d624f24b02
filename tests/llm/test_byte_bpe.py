import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")

from strataloom.llm import byte_bpe as B


def reference():
    lines = open(f"{B.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODING = reference()
TABLE = B.load_pairs(f"{B.TOKENIZERS}/byte_bpe_50k.json")


def encode(texts):
    encoder, out = B.Encoder(TABLE), []
    for counts, ids in encoder.batches(texts):
        at = 0
        for n in counts:
            out.append(ids[at : at + n].tolist())
            at += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab c\n'ts1_é漢")), max_size=6))
def test_equals_the_public_encoder(texts):
    assert encode(texts) == [ENCODING.encode_ordinary(t) for t in texts]


def test_long_pieces_and_edges():
    texts = [None, "", " ", "a" * 3000, "ab" * 2000 + "c", "\x1c\x85 　x", "naïve 漢字かな" * 50, "don't I'll  we've\n\n x"]
    assert encode(texts) == [ENCODING.encode_ordinary(t or "") for t in texts]


def test_text_beyond_one_span(monkeypatch):
    monkeypatch.setattr(B, "SPAN", 50)
    texts = ["some words here, and 12 more. " * 9, None, "x y z"]
    assert encode(texts) == [ENCODING.encode_ordinary(t or "") for t in texts]


def test_column_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (1, "a b", 9)], "doc_id long, text string, ids int")
    rows = sorted((r.doc_id, r.ids) for r in B.encode_column(df, "doc_id", "text").collect())
    assert rows == [(1, ENCODING.encode_ordinary("a b")), (1, ENCODING.encode_ordinary("a b")), (2, [])]
    assert B.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in B.count_column(df, "doc_id", "text").collect()) == [(1, 2), (1, 2), (2, 0)]
