"""Quality classifier: document evidence combined with host and path posteriors.

A logistic model over the presence of informative words and some rates of the text is fitted
in numpy on at most ``FIT_ROWS`` labelled documents, once for quality and once for toxicity,
and scores every whole text in one Arrow pass.  The probabilities are summed by site (host)
and by path below it, with partial sums on the map side.  Empirical Bayes then gives each
site a posterior mean: a host is shrunk toward the global mean and a path toward its host,
with strengths estimated by moments from the variance between sites, so sparse sites stay
near their prior.  A document's log odds are its own, with the global prior in them replaced
by the posterior of its path, from which the document itself is left out.

Sums by site are a few numbers a site; they meet the documents' small rows in a join that
adaptive execution broadcasts only after measuring it and otherwise splits where it is hot.

Null or empty text, or no word: score 0, rejected.  A null source is a site of its own (the
empty host).  Without labels of both kinds every document with a word is kept.  Repeated
rows and doc_ids are scored each for itself; ties in the choice of labelled rows fall by
their labels.  Texts are scored whole, however long; only the fit leaves out labelled texts
above ``FIT_CHARS``.  Further columns, whatever their names, are carried.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, about, slices
from .common import written as materialize

#: Labelled documents the fit may take, and the longest text among them.
FIT_ROWS, FIT_CHARS = 4000, 30_000
#: Words of the model: so many at most, each in so many documents of the sample at least.
WORDS, LEAST_DOCS, LEAST_Z = 1500, 4, 3.5
#: Log odds of toxicity above which a document is rejected.
TOXIC = 1.0
#: Bytes of a stem.
STEM = 6
RATES = 7
_STRIP = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SYMBOL, _UPPER, _DIGIT, _MARK = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def evidence(text: str | None) -> tuple[set[bytes], list[float]] | None:
    """(words of the text and stems of the long ones, its rates); None without a word."""
    data = text.encode() if text else b""
    tokens = data.split()
    if not tokens:
        return None
    n, size = len(tokens), len(data)
    without = lambda chars: size - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    words = set(data.translate(_FOLD).split())
    words |= {w[:STEM] + b"*" for w in words if len(w) > STEM}
    return words, [
        np.sqrt(without(_SYMBOL) / n), np.sqrt(without(_UPPER) / size), np.sqrt(without(_DIGIT) / size), np.sqrt(without(_MARK) / n),
        min(size / n, 40) / 10, len(set(tokens)) / n, 1 - len(set(lines)) / len(lines),
    ]


@dataclass
class Head:
    """One logistic model: a weight for each known word, and for each rate."""

    words: dict[bytes, float] = field(default_factory=dict)
    rates: np.ndarray = field(default_factory=lambda: np.zeros(RATES))
    center: np.ndarray = field(default_factory=lambda: np.zeros(RATES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(RATES))
    bias: float = 8.0

    def logit(self, words: set[bytes], rates: list[float]) -> float:
        known = self.words
        said = sum(known[w] for w in words & known.keys()) if known else 0.0
        return float(self.bias + said + np.clip((np.asarray(rates) - self.center) / self.scale, -6, 6) @ self.rates)


def copy_signs(words: set[bytes], least: int = 9) -> set[tuple]:
    """What near copies share with high chance: the lowest two hashes of the long words,
    under each of four hash functions; nothing if there are few long words."""
    rare = [w for w in words if len(w) >= least]
    return {(k, *sorted(zlib.crc32(w, k) for w in rare)[:2]) for k in (1, 2, 3, 4)} if len(rare) > 4 else set()


def fit(rows: list[tuple[str, int]], seed: int = 3) -> Head:
    """Fit on (text, 0 or 1); a constant yes if only one of the two is there.

    Near copies count once, or each group's rare words would pass for telling ones.  The
    sample's words are held as hashes, and named again only where they are chosen."""
    seen, known = [], set()
    for at, (text, v) in enumerate(rows):
        if (e := evidence(text)) is not None:
            signs = copy_signs(e[0])
            if not signs & known:
                seen.append((at, np.fromiter(map(zlib.crc32, e[0]), np.uint32, len(e[0])), e[1], v))
            known |= signs
    del known
    y = np.array([v for *_, v in seen], np.float32)
    if not len(y) or y.min() == y.max():
        return Head(bias=-8.0 if len(y) and y.max() == 0 else 8.0)
    share = float(y.mean())
    hashes, n = np.unique(np.concatenate([h for _, h, _, _ in seen]), return_counts=True)
    of_one = np.zeros(len(hashes))
    for _, h, _, v in seen:
        if v:
            of_one[np.searchsorted(hashes, h)] += 1
    z = np.abs(of_one - n * share) / np.sqrt(n * share * (1 - share))
    usable = np.flatnonzero((n >= LEAST_DOCS) & (z >= LEAST_Z))
    chosen = np.sort(hashes[usable[np.lexsort((hashes[usable], -z[usable]))[:WORDS]]])
    rates = np.array([r for _, _, r, _ in seen])
    center, scale = rates.mean(axis=0), np.maximum(rates.std(axis=0), 1e-3)
    x = np.zeros((len(seen), len(chosen) + RATES), np.float32)
    names: dict[int, bytes] = {}
    for k, (at, h, _, _) in enumerate(seen):
        hit = h[np.isin(h, chosen)]
        x[k, np.searchsorted(chosen, hit)] = 1
        if not names.keys() >= set(hit.tolist()):
            names.update((c, w) for w in evidence(rows[at][0])[0] if (c := zlib.crc32(w)) in set(hit.tolist()))
    x[:, len(chosen) :] = np.clip((rates - center) / scale, -6, 6)
    words = [names[c] for c in chosen.tolist()]
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    w, b, m, v = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, 301):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = weight * (p - y) / len(y)
        grad = np.r_[x.T @ g + 2e-4 * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = (w - move[:-1]).astype(np.float32), float(b - move[-1])
    return Head(dict(zip(words, w[: len(words)].tolist())), w[len(words) :].astype(float), center, scale, float(b))


def labelled_rows(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> list:
    """(text, quality, toxic) of a bounded sample of labelled documents, chosen by a hash."""
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    key = F.xxhash64("__id", F.lit(1))
    picked = about(marks.where("__id IS NOT NULL AND quality IN (0, 1)"), key, rows).orderBy(key, "quality", "toxic").limit(rows)
    near = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col(text).cast("string").alias("text")).where(F.length("text").between(1, chars))
    found = near.join(F.broadcast(picked), "__id").orderBy(key, "quality", "toxic").limit(rows)  # ``rows`` rows of three numbers
    return found.select("text", "quality", "toxic").collect()


def with_evidence(docs: DataFrame, quality: Head, toxic: Head, text: str = "text") -> DataFrame:
    """``docs`` with ``__quality`` and ``__toxic``, log odds by the document alone (null without a word)."""
    sent = docs.sparkSession.sparkContext.broadcast((quality, toxic))  # WORDS words each

    def run(batches):
        for part in slices(batches, text):
            said = [evidence(t) for t in part.column(text).to_pylist()]
            made = [pa.array([None if e is None else head.logit(*e) for e in said], pa.float64()) for head in sent.value]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "__quality", "__toxic"])

    return docs.mapInArrow(run, docs.withColumns({"__quality": F.lit(None).cast("double"), "__toxic": F.lit(None).cast("double")}).schema)


def host_of(site: Column) -> Column:
    return F.regexp_extract(F.coalesce(site.cast("string"), F.lit("")), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)


def path_of(site: Column) -> Column:
    """The first part of the path."""
    return F.regexp_extract(F.coalesce(site.cast("string"), F.lit("")), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*/?([^/?#]*)", 1)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def combined(scored: DataFrame, site: str = "source") -> DataFrame:
    """Materialized rows with ``__quality``: adds ``__site`` (the posterior of the row's path,
    without the row) and ``__score`` (the combined probability)."""
    p = F.coalesce(1 / (1 + F.exp(-F.col("__quality"))), F.lit(0.0))
    at = F.col(site) if site in scored.columns else F.lit("")
    rows = scored.withColumns({"__p": p, "__host": host_of(at), "__path": path_of(at)})
    sums = (F.count(F.lit(1)).alias("__n"), F.sum("__p").alias("__s"), F.sum(F.col("__p") ** 2).alias("__q"))
    paths = materialize(rows.groupBy("__host", "__path").agg(*sums), "path-sums")
    hosts = paths.groupBy("__host").agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"))
    total = paths.agg(F.sum("__n").alias("n"), F.sum("__s").alias("s"), F.sum("__q").alias("q")).first()
    n = total.n or 0
    mean = total.s / n if n else 0.5
    spread = max((total.q or 0) / max(n, 1) - mean**2, 1e-6)

    def strength(sites: DataFrame, size: str, got: str, prior: Column) -> float:
        """Within-site variance over between-site variance: rows the prior is worth."""
        seen = sites.agg(F.sum(F.col(size) * (F.col(got) / F.col(size) - prior) ** 2).alias("ss"), F.count(F.lit(1)).alias("k"), F.sum(size).alias("n")).first()
        if not seen.k or seen.k < 2:
            return 1e6
        between = (seen.ss - seen.k * spread) / seen.n
        return float(min(max(spread / max(between, 1e-9), 1.0), 1e6))

    of_host = strength(hosts, "__hn", "__hs", F.lit(mean))
    both = paths.join(hosts, "__host")
    # a path's prior: its host without the path's own rows, which count below
    prior = (F.col("__hs") - F.col("__s") + of_host * mean) / (F.col("__hn") - F.col("__n") + of_host)
    of_path = strength(both, "__n", "__s", prior)
    sites = materialize(both.select("__host", "__path", "__n", "__s", "__hn", "__hs"), "site-sums")
    met = rows.join(sites, ["__host", "__path"])
    posterior = (F.col("__s") - F.col("__p") + of_path * prior) / (F.col("__n") - 1 + of_path)
    score = 1 / (1 + F.exp(-(F.col("__quality") + _logit(F.col("__site")) - _logit(F.lit(float(mean))))))
    return met.withColumn("__site", posterior).withColumn("__score", F.coalesce(score, F.lit(0.0)))


def heads(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[Head, Head]:
    rows = labelled_rows(docs, labels, text)
    toxic = [(r.text, r.toxic) for r in rows if r.toxic in (0, 1)]
    return fit([(r.text, r.quality) for r in rows]), fit(toxic) if any(y for _, y in toxic) else Head(bias=-8.0)


def _kept(threshold: float) -> Column:
    return F.col("__quality").isNotNull() & (F.col("__score") >= threshold) & (F.col("__toxic") <= TOXIC)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", site: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, doc_score, site_score, score, toxic_score and kept of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(site).cast("string").alias("site")] if site in docs.columns else []))
    rows = materialize(with_evidence(slim, *heads(docs, labels, text)).drop("text"), "document-evidence")
    odds = lambda c: F.coalesce(1 / (1 + F.exp(-F.col(c))), F.lit(0.0))
    return combined(rows, "site").select("doc_id", odds("__quality").alias("doc_score"), F.col("__site").alias("site_score"), F.col("__score").alias("score"), odds("__toxic").alias("toxic_score"), _kept(threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", site: str = "source", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    own = Carried(docs)
    rows = materialize(with_evidence(own.frame, *heads(docs, labels, text), own[text]), "document-evidence")
    return own.back(combined(rows, own[site] if site in own else "").where(_kept(threshold)))
