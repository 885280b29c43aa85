"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes of the
ASCII-lower-cased text, with every other ASCII sign a space); a linear layer and a
softmax give the languages.  Both layers are trained together by stochastic gradient
descent in numpy, on segments of a bounded sample of labelled rows.  The part of the
sample held back sets a temperature, and the score below which an answer is rejected.

Prediction is one Arrow pass over whole texts, without a shuffle.  As both layers are
linear, the product of the two tables is gathered when there are few languages.

Null text, or no letter in the text: ``und`` with score 0, rejected.  No labelled row at
all: ``und`` for every text.  Repeated rows give repeated results; of equally likely
languages the first in alphabetical order counts, and of equal training keys the smaller
text.  Texts are predicted whole, however long, in overlapping pieces; of a long training
text a segment is used.  Further columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

#: Rows of each language, and of all, that training may take, and their characters; rows of each language at least.
TRAIN_PER_LANG, TRAIN_ROWS, TRAIN_CHARS, FLOOR = 600, 6000, 20_000, 20
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 15, 16, 4, 32, 2.0
ORDERS = (2, 3, 4)
#: Share of right answers on held-back segments that rejection may cost.
REJECT_SHARE = 0.005
_PIECE = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _b in range(26):
    _FOLD[97 + _b] = _FOLD[65 + _b] = 97 + _b
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def ngram_buckets(data: bytes) -> np.ndarray:
    """Bucket of every n-gram of ``data`` (one space put before and behind)."""
    b = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    out, x = [], b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        x = x[:-1] | (b[n - 1 :] << np.uint32(8 * (n - 1)))
        out.append(((x * np.uint32(2654435761 + 2 * 7919 * n)) >> np.uint32(17)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages, or buckets x DIM
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        data = text.encode()
        total, n = np.zeros(self.table.shape[1]), 0
        for at in range(0, max(len(data), 1), _PIECE):  # a long text in pieces, each overlapping the next
            h = ngram_buckets(data[at : at + _PIECE + 3])
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        mean = total / max(n, 1)
        return (mean if self.head is None else mean @ self.head) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], min(1.0, float(p[k])), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def segments(text: str, rng: np.random.Generator, most: int = 6) -> list[str]:
    """Some runs of 1 to 60 words, so that short texts are known too."""
    words = text.split(" ")
    out = []
    for _ in range(most):
        n = int(2 ** rng.uniform(0, 6))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(" ".join(words[at : at + n]))
    return [s for s in out if has_letter(s)]


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (text, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(1), 1.0, 1.0)
    rng, index = np.random.default_rng(seed), {lang: i for i, lang in enumerate(langs)}
    fit, held = [], []
    for i in rng.permutation(len(rows)):
        text, lang = rows[i]
        for s in segments(text, rng):
            h, n = np.unique(ngram_buckets(s.encode()), return_counts=True)
            (held if i % 6 == 0 and len(rows) > 30 else fit).append((h, (n / n.sum()).astype(np.float32), index[lang]))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    head, bias = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    share = np.bincount([y for *_, y in fit], minlength=len(langs)).astype(float)
    weight = share.sum() / np.maximum(share, 1) / len(langs)
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0

    def means(part):
        h = np.concatenate([p[0] for p in part])
        w = np.concatenate([p[1] for p in part])
        start = np.r_[0, np.cumsum([len(p[0]) for p in part])[:-1]]
        return h, w, start, np.add.reduceat(emb[h] * w[:, None], start)

    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for at in range(0, len(order), BATCH):
            part = [fit[i] for i in order[at : at + BATCH]]
            rate = RATE * (1 - step / steps)
            step += 1
            h, w, start, mean = means(part)
            y = np.array([p[2] for p in part])
            err = softmax(mean @ head + bias)
            err[np.arange(len(y)), y] -= 1
            err *= weight[y][:, None] / len(y)
            back = (err @ head.T).astype(np.float32)
            n = np.diff(np.r_[start, len(h)])
            head -= (rate * 0.2 * (mean.T @ err)).astype(np.float32)
            bias -= (rate * 0.02 * err.sum(axis=0)).astype(np.float32)
            np.add.at(emb, h, -rate * 10 * w[:, None] * np.repeat(back, n, axis=0))
    temperature, threshold = 1.0, 0.0
    if held:
        logit = np.concatenate([means(held[a : a + 256])[3] for a in range(0, len(held), 256)]) @ head + bias
        y = np.array([p[2] for p in held])
        cost = {t: -np.log(np.maximum(softmax(logit / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
        temperature = float(min(cost, key=cost.get))
        p = softmax(logit / temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        threshold = float(right[int(REJECT_SHARE * len(right))]) if len(right) else 1.0
    few = len(langs) <= DIM
    return Model(langs, (emb @ head).astype(np.float32) if few else emb, None if few else head, bias, temperature, threshold)


def training_rows(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows, even over the languages, chosen by a hash of doc_id:
    ``rows`` are divided among the languages first, ``FLOOR`` at least for each, and of a
    longer text a segment of ``chars`` characters from its middle is taken."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    if not counts:
        return []
    share = min(per_lang, max(FLOOR, rows // len(counts)))
    span = 1 << 40
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(span))
    # twice the share and some more by the hash, so that few are ranked; a language falls short of its share only by chance
    bounds = docs.sparkSession.createDataFrame([(lang, int(span * min(1.0, (2 * share + 50) / n))) for lang, n in counts.items()], "lang string, __bound long")
    near = known.join(F.broadcast(bounds), "lang").withColumn("__key", key).where("__key < __bound")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__key", "text"))
    middle = F.when(F.length("text") > chars, F.expr(f"substring(text, CAST((length(text) - {chars}) / 2 AS INT) + 1, {chars})")).otherwise(F.col("text"))
    picked = near.select("lang", "__key", middle.alias("text")).withColumn("__rank", rank).where(F.col("__rank") <= share).orderBy("__key", "lang").select("text", "lang").collect()
    return [(r.text, r.lang) for r in picked]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x 16 floats at most

    def work(ids, texts):
        said = [sent.value.predict(t) for t in texts]
        return {"doc_id": ids, "lang_pred": [s[0] for s in said], "score": [s[1] for s in said], "rejected": [s[2] for s in said]}

    return map_texts(docs, work, "doc_id long, lang_pred string, score double, rejected boolean", text)
