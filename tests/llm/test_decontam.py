import hashlib
import pickle
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vecstrata.llm import decontam


def brute(text, items, n=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        m = min(n, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[j : j + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return len(words), len(hit), found


WORDS = st.lists(st.sampled_from(["a", "B", "c,", "é", "9-d"]), max_size=30).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=3), st.integers(1, 4))
def test_matches_brute_force(text, items, n):
    items = [(str(i), t) for i, t in enumerate(items)]
    words = decontam.words_of(text)
    hit, found = decontam.Matcher(items, n).find(words)
    assert (len(words), 0 if hit is None else int(hit.sum()), found) == brute(text, items, n)


def test_frame_edges_and_blocks(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, f"Intro. {passage}!"), (1, f"Intro. {passage}!"), (2, "clean words " * 40), (3, None), (4, ""), (None, "w1 w2")],
        "doc_id long, text string",
    ).selectExpr("*", "'x' AS items", "1 AS n_hit")
    bench = spark.createDataFrame([(7, passage), (7, passage), (10, "short one"), (11, None), (12, "")], "item_id long, text string")
    want = {(1, 21, 20, ("7",)), (2, 80, 0, ()), (3, 0, 0, ()), (4, 0, 0, ()), (None, 2, 0, ())}
    for block_bytes in (decontam.BLOCK_BYTES, 20):
        found = decontam.scan(docs.select("doc_id", "text"), bench, block_bytes=block_bytes).collect()
        assert {(r.doc_id, r.n_words, sum(r.runs[1::2]) - sum(r.runs[::2]), tuple(r["items"])) for r in found} == want
    rows = decontam.report(docs, bench).withColumn("d", decontam.items_digest()).collect()
    assert len(rows) == 6 and {r.d for r in rows} == {hashlib.sha256(b).hexdigest() for b in (b"7", b"")}
    assert decontam.report(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontam.report(docs.limit(0), bench).count() == 0
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4]
    clashing = docs.selectExpr("*", "1 AS runs", "2 AS uid", "3 AS n_words", "4 AS c0")
    for block_bytes in (decontam.BLOCK_BYTES, 20):
        again = decontam.clean(clashing, bench, block_bytes=block_bytes)
        assert again.columns == clashing.columns and {tuple(r)[4:] for r in again.collect()} == {(1, 2, 3, 4)}


def test_many_blocks_give_the_same(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda **kw: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.hit_runs)) for r in decontam.report(docs, bench, **kw).collect())
    whole = rows()
    assert any(r[2] for r in whole) and rows(block_bytes=20_000) == whole


def test_a_matcher_is_a_few_times_its_text():
    rng = np.random.default_rng(4)
    items = [(str(k), " ".join(f"word{i}" for i in rng.integers(0, 50_000, 400))) for k in range(300)]
    size = sum(len(t) for _, t in items)
    held = decontam.Matcher(items)
    assert held.nbytes() < 8 * size and len(pickle.dumps(held)) < 8 * size
    assert held.find(decontam.words_of(items[7][1]))[1] == {"7"}


def test_spans_are_cut(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "pad " * 400 + passage + " tail", 7)], "doc_id long, text string, n_chars long")
    row = decontam.clean(docs, spark.createDataFrame([(1, passage)], "item_id int, text string")).first()
    assert row.text == "pad " * 400 + " tail" and row.n_chars == len(row.text)


def test_items_without_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "vw")
    bench = spark.createDataFrame([(None, one), (None, one + " more"), (7, two), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{one} and {two}"), (2, one), (3, two), (4, "clean")], "doc_id long, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 20):
        found = decontam.scan(docs, bench, block_bytes=block_bytes).collect()
        assert {r.doc_id: r["items"] for r in found} == {1: ["7", None], 2: [None], 3: ["7"], 4: []}
    rows = {r.doc_id: r for r in decontam.report(docs, bench).withColumn("d", decontam.items_digest()).collect()}
    assert [(rows[i].n_hit, rows[i].n_items) for i in (1, 2, 3, 4)] == [(40, 2), (20, 1), (20, 1), (0, 0)]
    assert [rows[i].d for i in (1, 2)] == [hashlib.sha256(b).hexdigest() for b in (b"7", b"")]
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [4]


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    whole = decontam.word_hashes
    monkeypatch.setattr(decontam, "word_hashes", lambda words, seed=0: whole(words, seed) if seed else np.zeros(len(words), np.uint64))
    held = decontam.Matcher([("1", "a b c"), ("2", "d e f")], 3)
    assert held.seed == 1 and held.find([b"d", b"e", b"f"])[1] == {"2"}
