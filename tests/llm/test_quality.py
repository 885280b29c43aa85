import re

import numpy as np
import pytest

from vecstrata.llm import quality

GOOD = "the quiet river runs past old stone walls and green hills in the evening light number {}"
BAD = "BUY!! NOW!! $$$ ### cheap offer {} click here %%% win"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, (GOOD if i % 3 else BAD).format(i) + (" nasty" if i % 7 == 0 else ""), "good.org/a" if i % 3 else "bad.org/x/y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS score", "'z' AS kept")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_scores(tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(rows) == 200
    for i, r in rows.items():
        assert r.kept == (i % 3 > 0 and i % 7 > 0)
        assert 0 <= r.score <= 1 and (r.site_score > 0.5) == (i % 3 > 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_sparse_sites_shrink_to_their_host(spark):
    hosts = [("h0/a", 3.0)] * 300 + [("h1/a", -3.0)] * 300 + [("h2/b", -3.0)] + [("h0/rare", -3.0)]
    rows = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(hosts)], "id long, source string, __quality double")
    by = {(r["__host"], r["__path"]): r["__site"] for r in quality.combined(rows).collect()}
    assert by["h0", "a"] > 0.9 and by["h1", "a"] < 0.1
    assert 0.3 < by["h2", "b"] < 0.7  # alone: the global prior, as the row itself is left out
    assert by["h0", "rare"] > 0.6  # its host's posterior


def test_edges(spark, tables):
    _, labels = tables
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "fine words here", None), (3, "same text", "b"), (3, "same text", "b")], "doc_id long, text string, source string")
    rows = quality.score(docs, labels.limit(0)).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in rows) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs.select("doc_id", "text"), labels.limit(0)).count() == 3


def test_fit_on_one_kind():
    assert quality.fit([("a b", 1)]).logit(set(), [0.0] * 7) > 0 > quality.fit([("a b", 0)]).logit(set(), [0.0] * 7)
    assert np.isfinite(quality.fit([]).logit(set(), [0.0] * 7))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.labelled_rows(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), rows=2400)
    head = quality.fit([(r.text, r.quality) for r in rows[:1600]])
    said = [(head.logit(*e) > 0, r.quality) for r in rows[1600:] if (e := quality.evidence(r.text))]
    assert sum(a == bool(b) for a, b in said) >= 0.98 * len(said)


def test_posteriors_match_brute_force(spark):
    """Means, strengths, leave-one-out posteriors and scores, computed again from lists."""
    rng = np.random.default_rng(5)
    rows = [(i, f"h{i % 7}/p{i % 3}/x", float(rng.normal((i % 7) - 3, 1))) for i in range(400)] + [(900, "solo", 0.5), (901, None, -1.0), (902, "h1/only", 2.0)]
    site = lambda s: ((s or "").split("/")[0], (s or "").split("/")[1] if "/" in (s or "") else "")
    p = {i: 1 / (1 + np.exp(-q)) for i, _, q in rows}
    every = np.array(list(p.values()))
    mean, spread = every.mean(), (every**2).mean() - every.mean() ** 2
    hosts, paths = {}, {}
    for i, s, _ in rows:
        hosts.setdefault(site(s)[0], []).append(p[i])
        paths.setdefault(site(s), []).append(p[i])

    def strength(groups):  # (values, prior)
        between = (sum(len(v) * (np.mean(v) - prior) ** 2 for v, prior in groups) - len(groups) * spread) / sum(len(v) for v, _ in groups)
        return min(max(spread / max(between, 1e-9), 1.0), 1e6)

    of_host = strength([(v, mean) for v in hosts.values()])
    rest = {k: (sum(hosts[k[0]]) - sum(v), len(hosts[k[0]]) - len(v)) for k, v in paths.items()}
    prior = {k: (s + of_host * mean) / (n + of_host) for k, (s, n) in rest.items()}
    of_path = strength([(v, prior[k]) for k, v in paths.items()])
    logit = lambda x: np.log(x / (1 - x))
    got = {r.id: r for r in quality.combined(spark.createDataFrame(rows, "id long, source string, __quality double")).collect()}
    for i, s, q in rows:
        own = paths[site(s)]
        post = (sum(own) - p[i] + of_path * prior[site(s)]) / (len(own) - 1 + of_path)
        assert np.isclose(got[i]["__site"], post)
        assert np.isclose(got[i]["__score"], 1 / (1 + np.exp(-(q + logit(np.clip(post, 1e-4, 1 - 1e-4)) - logit(mean)))))


def test_logits_match_the_words(tables):
    docs, labels = tables
    rows = [(r.text, r.quality) for r in quality.labelled_rows(docs, labels)]
    head = quality.fit(rows)
    text = GOOD.format(5) + "\n" + BAD.format(5)
    words, rates = quality.evidence(text)
    folded = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    want = {w.encode() for w in folded} | {w[: quality.STEM].encode() + b"*" for w in folded if len(w) > quality.STEM}
    assert words == want
    by_hand = head.bias + sum(w for k, w in head.words.items() if k in want) + sum(np.clip((r - c) / s, -6, 6) * w for r, c, s, w in zip(rates, head.center, head.scale, head.rates))
    assert np.isclose(head.logit(words, rates), by_hand)


def test_callers_columns_come_back(spark, tables):
    docs, labels = tables
    odd = docs.selectExpr("*", "1 AS __p", "2 AS __host", "3 AS __quality", "4 AS c0")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and {tuple(r)[-4:] for r in kept.collect()} == {(1, 2, 3, 4)}
