from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vecstrata.llm import rules


def brute(text):
    text = text or ""
    words = [w for w in "".join("\0" if c in " \t\n\v\f\r" else c for c in text).split("\0") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", " ", "\n", "é#", " ", "x*"]), max_size=80).map("".join))
def test_base_statistics(text):
    assert rules.statistics(text)[:5] == brute(text)


def test_many_distinct_words_stay_exact():
    words = [f"w{i}" for i in range(7000)] + [f"w{i}" for i in range(10, 16)]
    assert rules.repeated_words(words) == (12, 7000)


def test_anomalies_have_short_paths():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(0, 0.1, (500, 2)), np.zeros((500, 1))]
    forest = rules.grow(x, np.array([-3.0, -3, 0]), np.array([3.0, 3, 1]))
    score = forest.score(np.array([[0, 0, 0.0], [2.5, -2.5, 0], [0, 0, 1]]))
    assert score[1] > score[0] + 0.1 and score[2] > score[0] + 0.05


def test_scores_match_brute_force():
    """Every row walked down every tree by hand; a leaf of n rows adds the mean path among n."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    forest = rules.grow(x, x.min(axis=0), x.max(axis=0), trees=20, rows=64, depth=6)
    expected = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    for row, score in zip(x[:40], forest.score(x[:40])):
        lengths = []
        for feature, value, length in zip(forest.feature, forest.value, forest.length):
            node, level = 0, 0
            while feature[node] >= 0:
                node, level = 2 * node + 1 + int(row[feature[node]] >= value[node]), level + 1
            assert any(np.isclose(length[node], level + expected(n)) for n in range(65))
            lengths.append(length[node])
        assert np.isclose(score, 2 ** (-np.mean(lengths) / expected(64)))


def test_very_long_text():
    words = [f"w{i % 5000}" for i in range(300_000)]
    assert rules.statistics(" ".join(words))[:5] == (300_000, sum(map(len, words)), 0, 0, 300_000)


def test_threshold():
    good, bad = np.array([90, 9, 1, 0]), np.array([0, 1, 5, 5])
    assert rules.threshold(good, bad, 0.02) == 0.5
    assert rules.threshold(good, bad, 0.0) == 0.75
    assert rules.threshold(good, np.zeros(4)) == 2.0


def test_frame_edges(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 3), (1, "one two three four five six seven eight nine ten", 3), (2, None, 3), (None, "a b", 3), (3, "a b c d e " * 9, 3)], "doc_id long, text string, anomaly int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in rules.judge(docs, labels).collect())
    assert rows == [(0, 2, True, False), (1, 10, False, True), (1, 10, False, True), (2, 0, True, False), (3, 45, True, False)]
    assert rules.judge(docs, labels.limit(0)).count() == 5
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_keeps_good_rows(spark):
    from vecstrata.llm.queries import op10_quality_rules

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op10_quality_rules(spark, sf).collect() if not r.base_failed and r.doc_id in labels]
    good, bad = [r.kept for r in rows if labels[r.doc_id]], [r.kept for r in rows if not labels[r.doc_id]]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.6 * len(bad)
