import re

import numpy as np
import xxhash

from vecstrata.llm import graph, simhash


def brute_fingerprint(text, n=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    low = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    return low


def test_fingerprints():
    for text in (None, "", " \n", "One", "one TWO", "É été\x0bà b\tc d e f", "a b c " * 50, "a\x1cb c\x85d e f g"):
        assert int.from_bytes(simhash.fingerprint(text, 3)) == brute_fingerprint(text)


def as_nodes(spark, fps, words=1):
    rows = spark.createDataFrame([(i, f.to_bytes(8 * words)) for i, f in enumerate(fps)], "node long, fp binary")
    return simhash.with_table(rows, words)


def parts_of(links, n):
    got = {r.node: r.component for r in graph.components(links).collect()}
    return [got.get(i, i) for i in range(n)]


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(8)])
    fps = np.unique(fps)[:, None]
    low = list(range(len(fps)))
    for i, j in simhash.forest(fps, 2, simhash.distance_table(fps)):
        a, b = sorted((low[i], low[j]))
        low = [a if x == b else x for x in low]
    assert low == brute_components([int(x) for x in fps[:, 0]], 2)


def test_the_table_discards_pairs_and_no_link():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, (400, 1), dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ np.uint64(5)])
    table = simhash.distance_table(fps)
    bits = np.bitwise_count(fps ^ fps.T)
    passed = (np.abs(table[:, None] - table[None]).max(axis=2) <= 2)
    assert passed[bits <= 2].all() and passed[bits > 2].mean() < 0.001


def test_links_and_components(spark):
    rng = np.random.default_rng(2)
    fps = sorted({int(b) ^ (1 << int(k)) ^ (1 << int(m)) for b in rng.integers(0, 1 << 63, 20) for k, m in rng.integers(0, 64, (6, 2))})
    assert parts_of(simhash.links(as_nodes(spark, fps), 2), len(fps)) == brute_components(fps, 2)


def test_hot_buckets_are_taken_apart(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 63))
    fps = sorted({base ^ (1 << int(k)) ^ (1 << int(m)) for k, m in rng.integers(0, 64, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 50)} | {0, 1 << 63, 3})
    assert parts_of(simhash.links(as_nodes(spark, fps), 2, limit=20), len(fps)) == brute_components(fps, 2)


def test_hot_wide_buckets_lose_no_link(spark):
    rng = np.random.default_rng(8)
    fps = []
    for _ in range(60):  # pairs 31 bits apart, far from the other pairs, all in one bucket
        one = int.from_bytes(rng.bytes(32))
        fps += [one, one ^ sum(1 << (8 * int(k) + 3) for k in range(31))]
    nodes = as_nodes(spark, fps, 4)
    links = simhash.met(nodes, nodes.selectExpr("7L AS bucket", "node"), 4, 40, 10)
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(60)}


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_report_edges(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(5, text), (3, text), (3, text), (8, None), (9, ""), (None, "z"), (10, text + " w")], "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS component_id")
    rows = simhash.report(docs).collect()
    assert len(rows) == 7
    by = {r.doc_id: r.component_id for r in rows}
    assert by[5] == by[3] == 3 and by[8] == by[9] == 8
    assert simhash.report(docs.limit(0)).count() == 0


def test_report_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in texts]
    low = brute_components(fps, 2)
    want = {(d, f"{f:016x}", texts[k][0]) for (d, _), f, k in zip(texts, fps, low)}
    assert {tuple(r) for r in simhash.report(docs).collect()} == want


def test_keep_one(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:100], "changed", *words[101:]]
    other = [f"v{i}" for i in range(300)]
    docs = spark.createDataFrame([(4, " ".join(words), "a"), (2, " ".join(near), "b"), (2, " ".join(near), "b"), (9, " ".join(other), None), (None, " ".join(words), "x")], "doc_id long, text string, node string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def alike(tag, common, n=300):
    """Two texts of ``n`` shingles that share ``common`` of them: the start of the one and of the other."""
    both = [f"{tag}c{i}" for i in range(common + 4)]
    return [" ".join([*both, *(f"{tag}{side}{i}" for i in range(n - common))]) for side in "xy"]


def test_keep_one_decides_at_the_similarity(spark):
    at, below = 267, 266  # 267 / 333 = 0.8018, 266 / 334 = 0.7964
    assert at / (600 - at) >= 0.8 > below / (600 - below)
    rows = [t for k in range(40) for t in alike(f"p{k}", at)] + [t for k in range(40) for t in alike(f"q{k}", below)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert kept == {*range(0, 80, 2), *range(80, 160)}


def test_keep_one_takes_sets(spark):
    block = " ".join(f"b{i}" for i in range(24))
    pages = [" ".join([block] * 20 + [f"{side}{i}" for i in range(200)]) for side in "xy"]  # alike by about 0.1
    same = " ".join(f"s{i}" for i in range(100))
    docs = spark.createDataFrame([(1, pages[0]), (2, pages[1]), (3, same), (4, " ".join([same] * 9)), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2, 3, 5]


def test_set_forest_and_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(60, int(rng.integers(1, 50)), replace=False)).astype(np.uint64) for _ in range(60)]
    sets += [np.delete(s, 0) for s in sets if len(s) > 5] + [np.r_[s, np.uint64(99)] for s in sets]
    low = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])) and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    got = list(range(len(sets)))
    for i, j in simhash.set_forest(sets, 0.8):
        a, b = sorted((got[i], got[j]))
        got = [a if x == b else x for x in got]
    assert got == low
    texts = [" ".join(f"w{(k + i * (i % 17 == k)) % 400}" for i in range(200)) for k in range(12)] * 2 + alike("z", 290)
    texts += [" ".join(f"c{i if i != 5 * k else -k}" for i in range(250)) for k in range(40)]  # near copies: alike to the leader, or to each other only
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert sorted(r.doc_id for r in simhash.keep_one(docs, bucket=5, compare=600).collect()) == whole


def test_groups_by_cells_lose_no_pair(spark):
    """A chain: the leader links its neighbours alone, the others hang on each other."""
    texts = [" ".join(f"w{i}" for i in range(k * 8, k * 8 + 200)) for k in range(30)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    want = [k for k in range(30) if not any(5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in range(k))]
    rows = spark.createDataFrame([(1, k, len(sets[k]), t) for k, t in enumerate(texts)], "bucket long, node long, size long, text string")
    links = simhash.met_by_cells(rows, 500, 5, 0.8)
    assert want == [0] and parts_of(links, 30) == [0] * 30


def test_keys_meet_at_the_similarity():
    rng, missed = np.random.default_rng(12), 0
    for _ in range(400):
        both = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
        missed += not (simhash.band_keys(both[:540]) == simhash.band_keys(np.r_[both[60:540], both[540:]])).any()  # 480 of 600
    assert missed == 0 and not len(simhash.band_keys(np.zeros(0, np.uint64)))


def test_callers_columns_come_back(spark):
    names = ["uid", "set", "size", "keys", "fp", "c0", "c1", "component"]
    docs = spark.createDataFrame([(1, "a b c d e f", *range(8)), (2, "a b c d e f", *range(8)), (3, None, *range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(tuple(r)[2:] for r in got.collect()) == [tuple(range(8))] * 2


def test_a_star_step_reads_its_edges_twice(spark):
    """Its plan is planned and reported anew after each of its stages, on the driver."""
    edges = graph.materialize(spark.createDataFrame([(0, 1), (1, 2), (0, 5)], "a long, b long"), "edges")
    for large, want in ((True, {(0, 1), (0, 2), (0, 5)}), (False, {(0, 1), (1, 2), (0, 5)})):
        out = graph._star(edges, large)
        assert {(r.a, r.b) for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 2 and "Union" not in plan
