import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecstrata.llm import cdc, suffix


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = (2 * h + int(cdc.GEAR[b])) % (1 << 32)
        out.append(h)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_gear_hash_is_the_rolling_one(data):
    assert cdc.gear_hash(np.frombuffer(data, np.uint8)).tolist() == slow_gear(data)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def test_cut_points(monkeypatch):
    text = (words(1, 3000) + "é漢🙂" * 900).encode()
    cuts = cdc.cut_points(text)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(text) and (sizes[:-1] >= cdc.LEAST - 3).all() and sizes.max() <= cdc.MOST
    b"".join(text[a:b].decode().encode() for a, b in zip([0, *cuts], cuts))
    moved = cdc.cut_points(b"something inserted" + text)
    assert len(set(moved) & {c + 18 for c in cuts}) > 0.95 * len(cuts)
    monkeypatch.setattr(cdc, "_BLOCK", 256)
    assert cdc.cut_points(text) == cuts
    assert cdc.cut_points(b"") == [] and cdc.cut_points(b"ab") == [2]


def brute(rows, within=True):
    """Chunk by chunk in the order of doc_id; runs of repeated chunks go if long or whole."""
    seen, out = {}, {}
    for d, text in rows:
        data = (text or "").encode()
        cuts = cdc.cut_points(data)
        runs = []
        for a, b in zip([0, *cuts], cuts):
            key = data[a:b]
            if key in seen and (within or seen[key] != d):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.setdefault(key, d)
        runs = [(a, b) for a, b in runs if b - a >= cdc.LEAST_RUN or b - a == len(data)]
        edge = [0, *(x for r in runs for x in r), len(data)]
        out[d] = hashlib.sha256(b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2]))).hexdigest()
    return out


@pytest.fixture(scope="module")
def rows():
    passage = words(5, 80)
    out = [(i, words(100 + i, 60) + " " + passage + " " + words(200 + i, 60)) for i in range(8)]
    out.append((20, words(77, 90) + " " + words(77, 90)))  # repeats inside one document
    return [*out, (8, words(9, 100)), (9, words(9, 100)), (10, None), (11, ""), (12, "short"), (13, "short")]


def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS slice_id", "'x' AS data")
    got = {r.doc_id: r for r in cdc.dedup(docs).collect()}
    assert {k: r.kept_sha256 for k, r in got.items()} == brute(sorted(rows)) and got[20].n_removed > 200
    small = {r.doc_id: r for r in cdc.dedup(docs, merge=40, slice_bytes=1500, shard_bytes=2000).collect()}
    assert {k: r.kept_sha256 for k, r in small.items()} == {k: r.kept_sha256 for k, r in got.items()}
    across = {r.doc_id: r for r in cdc.dedup(docs, within=False).collect()}
    assert {k: r.kept_sha256 for k, r in across.items()} == brute(sorted(rows), False) and across[20].n_removed == 0
    assert got[0].n_removed == got[8].n_removed == got[12].n_removed == 0 and got[9].n_removed == got[9].n_bytes
    assert all(got[i].n_removed > 250 for i in range(1, 8)) and got[13].n_removed == 5
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.values())


def test_a_shard_holds_each_digest_once():
    """A chunk that all slices have; the first places arrive last."""
    held = cdc.ShardTable(30)
    held.start(0)
    blobs = []
    for k in reversed(range(200)):
        s = cdc.Slice([k, None], [5, 0], b"ab%03d" % (k % 3), 1)
        blobs.append((k, next(s.deal())[1]))
    lost, sizes = {}, []
    for k, blob in blobs:
        held.add(k, blob)
        sizes.append(len(held.a) + held.n)
    held.settle()
    for k, _, dup, gone in held.rows:
        lost[k] = lost.get(k, False) or (bool(np.unpackbits(np.frombuffer(dup, np.uint8))[0]) if dup is not None else len(gone) > 0)
    assert max(sizes) <= 33 and {k for k, x in lost.items() if not x} == {0, 1, 2}


def test_recall_of_long_passages(spark):
    """At sf0.01: passages that exact windows remove are found by chunks, what repeats nowhere stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = {r.doc_id: r.removed for r in suffix.dedup(docs, keep_text=False).collect()}
    by_chunk = {r.doc_id: r.removed for r in cdc.dedup(docs, keep_text=False, within=False).collect()}
    long = {k for k, v in exact.items() if any(b - a >= 280 for a, b in zip(v[::2], v[1::2]))}
    clean = {k for k, v in exact.items() if not v}
    assert sum(bool(by_chunk[k]) for k in long) >= 0.9 * len(long) and sum(bool(by_chunk[k]) for k in clean) <= 0.01 * len(clean)


def test_edges(spark):
    text = words(3, 100)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string").coalesce(1)
    assert sorted(r.n_removed > 0 for r in cdc.dedup(docs).collect()) == [False, True, True]
    assert cdc.dedup(docs.limit(0)).count() == 0
