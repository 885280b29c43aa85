"""Quality rules: an isolation forest on each document's rule statistics.

One Arrow pass over whole texts makes a small row of statistics for each document, which
is written once.  Isolation trees are grown on subsamples of a bounded sample of the good
rows in one half of the labelled ones, in the box that all rows of that half span; the mean
path length over the random splits gives the anomaly score of every document.  The score
above which a document goes is calibrated from the other half, which the trees have not
seen, by a histogram: the threshold that parts good from bad best among those that reject at
most ``GOOD_LOSS`` of the good ones.  Nothing is shuffled but the small rows, to meet labels.

Null text has no words.  Fewer than ten words, or more than a fifth of the words in
repeated 5-word windows, fails outright.  Without labels (or without labels of both
kinds) the forest rejects nothing.  Repeated rows get repeated results; a null doc_id has
no label; ties in the choice of labelled rows fall by their statistics, and of equally good
thresholds the highest counts.  Texts are read whole, however long.  Further columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written as materialize
from .common import about, map_texts

#: Labelled rows the forest may see; trees, rows a tree, and bins of the score.
FIT_ROWS, TREES, TREE_ROWS, DEPTH, BINS = 4096, 100, 256, 10, 2000
GOOD_LOSS = 0.005
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
SCHEMA = "doc_id long," + ",".join(f"{c} long" for c in (*BASE, *MORE))
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
_UPPER, _DIGIT, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?\"'()"


def repeated_words(words: list, window: int = 5) -> tuple[int, int]:
    """(words inside a ``window``-word window that occurs twice or more, distinct words)."""
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n, u = len(ids) - window + 1, max(len(seen), 1)
    if n < 2:
        return 0, len(seen)
    if u**window < 1 << 62:
        key = ids[:n].copy()
        for k in range(1, window):
            key = key * u + ids[k : k + n]
    else:  # rename the longer and longer windows, so that keys stay exact
        key = ids[:n]
        for k in range(1, window):
            key = np.unique(key * u + ids[k : k + n], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0, len(seen)
    twice = np.zeros(n + 1, bool)
    twice[order[:-1][same]] = twice[order[1:][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), len(seen)


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of BASE and MORE."""
    if not text:
        return (0,) * (len(BASE) + len(MORE))
    data = text.encode()
    words = data.split()
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    repeat, distinct = repeated_words(words)
    without = lambda chars: len(data) - len(data.translate(None, chars))
    return (len(words), len(text) - without(SPACES.encode()), without(SYMBOLS.encode()), dup, repeat, n_lines, without(_UPPER), without(_DIGIT), without(_MARKS), distinct)


def statistics_table(docs: DataFrame, text: str = "text") -> DataFrame:
    def work(ids, texts):
        return dict(zip((*BASE, *MORE), map(list, zip(*map(statistics, texts))))) | {"doc_id": ids}

    return map_texts(docs, work, SCHEMA, text)


def features(cols: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the statistics, with roots where small values matter, one row a document."""
    c = {k: np.asarray(v, float) for k, v in cols.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.minimum(c["word_chars"] / words, 30), np.sqrt(c["n_symbols"] / words), np.sqrt(c["n_dup_lines"] / lines), c["n_repeat_words"] / words,
        np.sqrt(c["n_upper"] / chars), np.sqrt(c["n_digits"] / chars), c["n_marks"] / words, c["n_distinct"] / np.sqrt(words),
    ], axis=1)


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as complete binary layouts: split feature (-1: leaf), split value, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    depth: int
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1; a short mean path is anomalous."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for f, v, path in zip(self.feature, self.value, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = f[node]
                node = np.where(at < 0, node, 2 * node + 1 + (x[row, np.maximum(at, 0)] >= v[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Isolate the rows of ``x`` by random splits of the box ``low``..``high``, which may
    be wider than the rows: the empty parts of it are cut off early, so a later row that
    falls there has a short path."""
    rng, rows, size = np.random.default_rng(seed), min(rows, len(x)), 2 ** (depth + 1) - 1
    feature, value, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))

    def split(t: int, node: int, part: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> None:
        wide = np.flatnonzero(high > low)
        if level == depth or len(part) <= 1 or not len(wide):
            length[t, node] = level + float(_expected(len(part)))
            return
        f = int(rng.choice(wide))
        v = rng.uniform(low[f], high[f])
        feature[t, node], value[t, node] = f, v
        right, mid_high, mid_low = part[:, f] >= v, high.copy(), low.copy()
        mid_high[f] = mid_low[f] = v
        split(t, 2 * node + 1, part[~right], low, mid_high, level + 1)
        split(t, 2 * node + 2, part[right], mid_low, high, level + 1)

    for t in range(trees):
        split(t, 0, x[rng.choice(len(x), rows, replace=False)], low.astype(float), high.astype(float), 0)
    return Forest(feature, value, length, depth, max(float(_expected(rows)), 1e-9))


def threshold(good: np.ndarray, bad: np.ndarray, loss: float = GOOD_LOSS) -> float:
    """From counts by score bin: the bin edge with the best balance of bad rejected and
    good kept that rejects at most ``loss`` of the good; 2.0 (none) if there is none."""
    if not good.sum() or not bad.sum():
        return 2.0
    lost, caught = np.cumsum(good[::-1])[::-1] / good.sum(), np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(lost <= loss, caught - lost, -1.0)
    k = int(np.flatnonzero(gain == gain.max())[-1])
    return k / len(good) if gain[k] > 0 else 2.0


def with_score(stats: DataFrame, forest: Forest) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(forest)  # TREES x 2047 nodes

    def run(batches):
        for b in batches:
            x = features({c: b.column(c).to_numpy(zero_copy_only=False) for c in (*BASE, *MORE)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(x))], names=[*b.schema.names, "anomaly"])

    return stats.mapInArrow(run, SCHEMA + ",anomaly double")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Each document's statistics, ``anomaly``, ``base_failed`` and ``kept``."""
    stats = materialize(statistics_table(docs, text), "rule-statistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull())
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    key = F.xxhash64("doc_id", F.lit(3))
    near = stats.join(about(marks.where(half == 0), key, fit_rows), "doc_id")
    rows = near.orderBy(key, "quality", *BASE).limit(fit_rows).collect()
    x = features({c: np.array([r[c] for r in rows]) for c in (*BASE, *MORE)}) if rows else np.zeros((1, 8))
    good = np.array([r.quality == 1 for r in rows], bool)
    scored = with_score(stats, grow(x[good] if good.any() else x, x.min(axis=0), x.max(axis=0)))
    bins = scored.join(marks.where(half == 1), "doc_id").groupBy("quality", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros((2, BINS))
    for r in bins.where("quality in (0, 1)").collect():
        counts[r.quality, r.bin] = r.n
    limit = threshold(counts[1], counts[0])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(limit)))
