import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vecstrata.llm import bpe

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_merging_gives_the_librarys_counts(library):
    texts = [None, "", " ", "<|endoftext|> a  b<|endoftext|>  ", "aaaaaaaaaaa   \n\n x", "é ñ 漢字 🙂🙂🙂  \t\n", "don't  we'll 1234 ²½ _x_", "a" * 5000]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert bpe.merger(PATH, P.PATTERN).count(texts) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    want = len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids) if text else 0
    assert bpe.merger(PATH, P.PATTERN).count([text]) == [want]


def test_symbols_are_the_librarys_ids(library):
    words = ["hello", " transformation", "xyzzyx"]
    sym, n = bpe.merger(PATH, P.PATTERN).merge([w.encode() for w in words])
    assert sym.tolist() == [i for w in words for i in library.encode(w, add_special_tokens=False).ids]
    assert n.sum() == len(sym)


def test_long_runs_and_long_texts(library):
    texts = [" " * 1_000_000, "\n" * 500_000 + "x", "word and " * 100_000, "é" * 200_000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert bpe.merger(PATH, P.PATTERN).count(texts) == want


def test_frame(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 1)], "doc_id long, text string, n_tokens int")
    rows = bpe.count_tokens(docs, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == [(0, 0, 0), (1, 3, 2), (1, 3, 2)]
    assert bpe.count_tokens(docs.limit(0), PATH, P.PATTERN).count() == 0
