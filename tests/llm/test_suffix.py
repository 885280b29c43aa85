import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecstrata.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_texts():
    rng = np.random.default_rng(4)
    for text in (b"banana" * 30, b"a" * 300, b"ab" * 100 + b"a", bytes(range(256)) * 2, rng.integers(97, 99, 2000).astype(np.uint8).tobytes()):
        assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_windows():
    bodies, ids = [b"xxabcdefyy", b"zabcdefz", b"abcdef", b"qqabcdeqq"], np.array([5, 3, 3, 9])
    assert sorted(suffix.repeated_windows(bodies, ids, 5)) == [(0, 2), (0, 3), (3, 2)]


def brute(rows):
    """doc_id -> sorted list of (n_bytes, n_removed, n_spans, sha256)."""
    data = [(suffix._LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, b), (doc, _) in zip(data, rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out.append((str(doc), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def mixed_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join("abcdé \n"[c] for c in rng.integers(0, 7, k))
    passages = [text(int(k)) for k in rng.integers(30, 200, 6)] + ["ab" * 70, "c" * 120]
    rows = []
    for i in range(n):
        parts = [text(int(rng.integers(0, 80))) if rng.random() < 0.6 else passages[rng.integers(0, 8)] for _ in range(rng.integers(1, 6))]
        t = "".join(parts)
        if rows and rng.random() < 0.4:  # a near copy: some letters changed
            t = list(rows[rng.integers(0, len(rows))][1] or "x")
            for _ in range(int(rng.integers(0, 4))):
                t[rng.integers(0, len(t))] = "z"
            t = "".join(t)
        rows.append((int(rng.integers(0, n)), t))
    return [*rows, (3, None), (None, passages[0]), (4, ""), (None, rows[0][1])]


def in_process(rows, shards, per_slice, limit=10**6):
    """The operator's steps without Spark: (doc_id, removed bytes) of every document."""
    groups = [sorted(rows[a : a + per_slice], key=lambda r: (r[0] is None, r[0] or 0)) for a in range(0, len(rows), per_slice)]
    parts = [suffix.Slice([d for d, _ in g], [len((t or "").encode()) for _, t in g], b"".join((t or "").encode() for _, t in g), shards) for g in groups]
    dealt = [(shard, k, blob) for k, p in enumerate(parts) for shard, blob in p.deal()]
    replies = {}
    for shard in range(shards):
        own = [(k, b) for s, k, b in dealt if s == shard]
        if own:
            rows_of = pa.table({"shard": pa.array([shard] * len(own), pa.int32()), "slice_id": [k for k, _ in own], "blob": [b for _, b in own]})
            for made in suffix.shard_replies(rows_of.to_batches(), limit):
                for r in made.to_pylist():
                    replies.setdefault(r["slice_id"], []).append(r)
    fetched = pa.Table.from_batches([suffix.fetched_of(p, k, replies.get(k, []), 3) for k, p in enumerate(parts)])
    cold, hot = (fetched.filter(pc.equal(fetched["hot"], x)) for x in (False, True))
    marks = [m for s in range(3) for m in suffix._shard_marks(cold.filter(pc.equal(cold["shard"], s))).to_pylist()]
    least = {}
    for r in hot.to_pylist():
        least[r["body"]] = min(least.get(r["body"], r["id"]), r["id"])
    marks += [{"slice_id": r["slice_id"], "entry": r["entry"], "first": [r["base"]]} for r in hot.to_pylist() if r["id"] > least[r["body"]]]
    out = []
    for k, p in enumerate(parts):
        gone = np.zeros(len(p.data), bool)
        dup = p.answers(replies.get(k, []))[0]
        for r in range(len(p.entry)):
            e = p.entry[r]
            if dup[e] or p.key[r] > p.key[p.head[e]]:
                gone[p.runs["start"][r] : p.runs["stop"][r] + 50] = True
            else:
                for m in marks:
                    if m["slice_id"] == k and m["entry"] == e:
                        for x in m["first"]:
                            gone[p.runs["start"][r] + x : p.runs["start"][r] + x + 50] = True
        at = 0
        for d, n in zip(p.doc_ids, p.lens.tolist()):
            out.append((str(d), n, int(gone[at : at + n].sum())))
            at += n
    return sorted(out), fetched


def test_hot_grams_are_dealt_by_window(monkeypatch):
    rows = mixed_rows(21, 90)
    want = [r[:3] for r in brute(rows)]
    got_, plain = in_process(rows, 4, 9)
    assert got_ == want and not any(plain["hot"].to_pylist())
    monkeypatch.setattr(suffix, "HOT", 2)
    got_, parted = in_process(rows, 4, 9)
    assert got_ == want and any(parted["hot"].to_pylist())


@pytest.mark.parametrize("limit", [1, 20, 200])
def test_a_shard_holds_few_entries(limit):
    rows = mixed_rows(22, 90)
    got_, parted = in_process(rows, 4, 9, limit)
    assert got_ == [r[:3] for r in brute(rows)] and any(parted["hot"].to_pylist())


def test_shared_grams_and_windows_stay_bounded(monkeypatch):
    """A gram that every document has in a run of its own, and a window that every document
    has: the shard never holds more than its limit, and all replies are given."""
    rng, held = np.random.default_rng(2), []
    shed = suffix.ShardReplies.add
    monkeypatch.setattr(suffix.ShardReplies, "add", lambda self, *a: (shed(self, *a), held.append(sum(len(h[2]) for h in self.held))))
    blobs = []
    for k in range(400):
        tag = np.r_[np.full(50, 7), rng.integers(100, 1 << 32, 50), [9]].astype("<u4")  # one gram in runs of its own, others, one whole run
        run = np.r_[rng.integers(0, 1 << 47, 100), [5]].astype(np.uint64)
        parts = [np.array([101, 1], "<i8"), np.array([k], "<i8"), tag, (run & np.uint64(0xFFFFFFFF)).astype("<u4"), (run >> np.uint64(32)).astype("<u2"), np.zeros(101, "<u2")]
        blobs.append(b"".join(p.tobytes() for p in parts))
    table = pa.table({"shard": pa.array([3] * 400, pa.int32()), "slice_id": list(range(400)), "blob": blobs})
    rows = [r for b in suffix.shard_replies(table.to_batches(max_chunksize=20), 1000) for r in b.to_pylist()]
    assert sorted(r["slice_id"] for r in rows) == list(range(400)) and max(held) <= 1000
    hot = [np.unpackbits(np.frombuffer(r["hot"], np.uint8), count=101) for r in rows]
    assert all(h[:50].all() for h in hot)


def test_hot_in_spark(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_ENTRIES", 50)
    rows = mixed_rows(5, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(suffix.dedup(docs)) == brute(rows)


def test_repeated_ids_over_slices(spark):
    rows = mixed_rows(6, 40)
    rows = [(d if d is None else d // 6, t) for d, t in rows]
    assert in_process(rows, 4, 3)[0] == [r[:3] for r in brute(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, monkeypatch, seed):
    rows = mixed_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS slice_id", "'x' AS data")
    assert got(suffix.dedup(docs)) == brute(rows)


def test_many_slices_shards_and_batches(spark, monkeypatch):
    """In this process alone: slices and shards of a few documents, blocks inside documents."""
    rows = mixed_rows(9, 80)
    monkeypatch.setattr(suffix, "BLOCK", 64)
    monkeypatch.setattr(suffix, "BATCH_SYMBOLS", 100)
    groups = [sorted(rows[a : a + 7], key=lambda r: (r[0] is None, r[0] or 0)) for a in range(0, len(rows), 7)]
    shards = 5
    parts = [suffix.Slice([d for d, _ in g], [len((t or "").encode()) for _, t in g], b"".join((t or "").encode() for _, t in g), shards) for g in groups]
    dealt = [(shard, k, blob) for k, p in enumerate(parts) for shard, blob in p.deal()]
    starts = np.concatenate([p.runs["stop"] - p.runs["start"] + 1 for p in parts]).sum()
    assert starts == sum(max(0, len((t or "").encode()) - 49) for _, t in rows)
    for shard in range(shards):
        own = [suffix.unpack(b) for s, _, b in dealt if s == shard]
        if own:
            dup, send, _ = suffix.compare_entries(*(np.concatenate([o[k] for o in own]) for k in range(3)))
            assert not (dup & send).any()


def test_test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    result = suffix.dedup(docs)
    assert got(result) == brute(rows)
    text = dict(rows)
    for r in result.collect():
        edge = [0, *r.removed, r.n_bytes]
        data = (text[r.doc_id] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2])) == r.kept
    assert suffix.dedup(docs.limit(0)).count() == 0
