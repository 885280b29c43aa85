import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vecstrata.llm import packing

PATH = P.path("byte_bpe_50k.json")


def test_ids_are_the_librarys():
    library = Tokenizer.from_file(PATH)
    for text in ("", "Hello  world\n\n x", "a<|endoftext|> b <|endoftext|>", "é 漢字 🙂 ²½"):
        assert packing.token_ids(text, PATH, P.PATTERN).tolist() == library.encode(text, add_special_tokens=False).ids


def valid(p):
    assert (p.bin >= 0).all()
    load = np.bincount(p.bin, p.size, minlength=len(p.load))
    assert (load == p.load).all() and load.max() <= p.room


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 100, 400)
    people = []
    for k in range(2):
        p = packing.Packing(size, 100)
        p.best_fit(rng.permutation(400))
        valid(p)
        people.append(p)
    for _ in range(20):
        child = people[0].child(people[1], rng)
        valid(child)
        people = [people[1], child]


def triplets(n, room=2048):
    """Pieces that fill ``n`` sequences exactly, three each."""
    rng, out = np.random.default_rng(n), []
    for _ in range(n):
        a = int(rng.integers(780, 1000))
        b = int(rng.integers(520, (room - a) // 2 + 1))
        out += [a, b, room - a - b]
    return np.array(out)


@pytest.mark.parametrize("n", [60, 300, 2000])
def test_shipped_evolution_needs_fewer_sequences_than_best_fit(n):
    size = triplets(n)
    first = packing.Packing(size, 2048)
    first.best_fit(np.argsort(-size, kind="stable"))
    best = packing.evolve(size, 2048, 1, [])
    valid(best)
    assert n <= best.rank()[0] < 0.95 * first.rank()[0]
    assert packing.evolve(size, 2048, 2, [best.bin], children=2).rank() <= best.rank()


def test_every_island_makes_children(monkeypatch):
    made = []
    child = packing.Packing.child
    monkeypatch.setattr(packing.Packing, "child", lambda self, other, rng: made.append(1) or child(self, other, rng))
    assert packing.evolve(np.full(64, 512), 2048, 1, []).rank()[0] == 16 and len(made) == packing.LEAST_CHILDREN


def test_blanks_of_any_length(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["a" + " " * 1_000_000 + "b", "\n" * 2_000_000]
    for text in texts:
        assert packing.token_ids(text, PATH, P.PATTERN).tolist() == library.encode(text, add_special_tokens=False).ids
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(rows, PATH, P.PATTERN).collect()
    assert sum(r.length for r in got) == sum(1 + len(library.encode(t, add_special_tokens=False).ids) for t in texts)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_round_trip(spark, docs):
    packed = packing.pack(docs, PATH, P.PATTERN, keep_ids=True, block_items=50).cache()
    library = Tokenizer.from_file(PATH)
    by, seq = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for d in docs.collect():
        ids, rows = library.encode(d.text, add_special_tokens=False).ids + [0], sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [i for r in rows for i in r.token_ids] == ids and [r.piece for r in rows] == list(range(len(rows)))
        assert all(r.length == 2048 for r in rows[1:]) and rows[0].start == 0
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in rows)
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for rows in seq.values() for r in rows)
    assert len(seq) <= -(-total // 2048) + 2
    for r in packing.sequences(packed).collect():
        assert r.token_ids == [i for x in sorted(seq[r.sequence_id], key=lambda x: x.offset) for i in x.token_ids]


def test_edges(spark, docs):
    rows = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 5000)], "doc_id long, text string").selectExpr("*", "9 AS piece", "'u' AS uid")
    got = packing.pack(rows, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got)[:4] == [(0, 0, 3), (1, 0, 1), (2, 0, 1), (2, 0, 1)]
    assert packing.pack(docs.limit(0), PATH, P.PATTERN).count() == 0
