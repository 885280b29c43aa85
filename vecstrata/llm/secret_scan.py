"""Secret scans with a random forest that removes false positives; built-in functions only.

A pattern gives the candidates of a text: runs of key-like characters with a digit, strings
with a known beginning, whole signed tokens, private key blocks, webhook addresses,
credentials in addresses, and any value, quoted or not, that a word like "password"
announces.  Each candidate is described by its length, its changes of character class and
how usual its letter pairs are, how much of it dictionary words cover, the words around it
and the path it was found at.  A random forest trained on labelled findings is written out
as one SQL expression that walks its trees and applied to the candidates inside their row,
so the scan is a single JVM stage: no shuffle of texts, no Python on the executors, and
nothing gathered but the candidates of one text.  Numpy grows the trees, on the driver, from the
bounded sample alone.

The dictionary is the corpus's own: the ``DICTIONARY`` words that most documents have,
counted over all documents by partial sums, besides a short list of words of code and
configuration.  Training takes at most ``FIT_ROWS`` labelled findings (value, before, after,
path, label).  Without any from the user, findings are made by rule: random keys, passwords
and phrases beside words that announce them, against checksums, identifiers, card numbers,
placeholders, references to variables and dictionary words.

Null text has no candidates; a null path counts as empty.  Repeated rows are scanned each
for itself.  Where candidates overlap, the leftmost counts, then the order of the pattern's
parts; dictionary ties fall alphabetically.  Texts are scanned whole, however long, and the
features describe the whole candidate, in a time that grows with its length.  Further columns,
whatever their names, are carried.  An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried

FIT_ROWS, TREES, DEPTH, SEED = 4000, 25, 9, 5
#: Words of the dictionary, documents that have each, letter pairs taken for usual.
DICTIONARY, LEAST_DOCS, PAIRS = 1000, 5, 220
MARK = "[SECRET]"

# Forms of secrets and the words around them.
ANNOUNCED = r"passw(?:or)?d|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|credentials?"
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
SIGNED_TOKEN = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){0,4}"
CLOUD_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
PREFIXED = r"(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|[sr]k_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}+"
WEBHOOK = r"https://(?:hooks\.[a-z0-9.-]{3,60}|[a-z0-9.-]{3,60}/(?:api/)?webhooks)/[A-Za-z0-9/_-]{16,}+"
IN_ADDRESS = r"(?<=:)(?<=://[^\s/@:]{0,64}:)[^\s/@]{3,}+(?=@)"
_SIGN = r"[\x22\x27]?\s{0,2}[=:]>?\s{0,2}"
QUOTED = rf"(?<=[\x22\x27])(?<=[=:>]\s{{0,2}}[\x22\x27])(?<=(?i:{ANNOUNCED}){_SIGN}[\x22\x27])[^\x22\x27\r\n]{{6,200}}(?=[\x22\x27])"
BARE = rf"(?<=[=:>\s])(?<=[=:>]\s{{0,2}})(?<=(?i:{ANNOUNCED}){_SIGN})[^\s\x22\x27<>,;]{{6,}}+"
BEARER = r"(?<=\s)(?<=(?i:bearer)\s)[A-Za-z0-9._~+/-]{8,}+={0,2}"
KEY_LIKE = rf"(?<![A-Za-z0-9+/_@.-])(?=[A-Za-z+/_-]*+[0-9])(?![A-Za-z0-9+/_-]+?{CLOUD_KEY})[A-Za-z0-9+/_-]{{16,}}+={{0,2}}(?![A-Za-z0-9@])"
_AT_A_START = "|".join((SIGNED_TOKEN, CLOUD_KEY, PREFIXED, WEBHOOK, IN_ADDRESS, QUOTED, BARE, BEARER, KEY_LIKE))
CANDIDATE = rf"{PRIVATE_KEY}|(?<![A-Za-z0-9])(?:{_AT_A_START})"  # inside words nothing more is tried
KNOWN = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^(?:gh[pousr]_|github_pat_|glpat-)[A-Za-z0-9_-]{16,}|^xox[abprs]-|^[sr]k_live_|^AIza[A-Za-z0-9_-]{30,}|^eyJ[A-Za-z0-9_-]{15,}|^-----BEGIN |^https://"
KEYWORD = rf"(?i)(?:{ANNOUNCED}|bearer)\W{{0,12}}$"
ADDRESS = r"://[^\s/@:]{0,64}:$"
HARMLESS = r"(?i)(?:sha-?\d*|commit|md5|checksum|digest|hash|uuid|guid|revision|etag|serial|order|invoice|card|version|build|isbn|tracking)\W{0,12}$"
PLACEHOLDER = r"(?i)^(?:your|my|the|some|an?)[_-]|example|sample|dummy|placeholder|change.?me|redacted|x{4,}|\*{3,}|\.{3}|_here|^[<({\[$%]|^(?:none|null|true|false|undefined|required|optional|string)\b"
WORDS = (
    "the and for with this that from your here test example sample dummy placeholder change secret password token key value "
    "name user admin default config build release version final draft report page file path image data server client service "
    "public private string number index table order item list home local host model class method function module insert "
    "replace none null true false required optional"
).split()
FEATURES = (
    "size", "digits", "upper", "signs", "turns", "pairs", "covered", "distinct", "hex", "known", "keyword", "address",
    "harmless", "assigned", "quoted", "placeholder", "prose", "path_test", "path_depth",
)


def corpus_words(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> tuple[str, ...]:
    """WORDS and the ``most`` words (three letters or more) that most documents have, each in
    LEAST_DOCS at least, or a key that was copied a few times would pass for a word."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(r"(?<![\p{L}\d_])\p{Ll}{3,20}(?![\p{L}\d_])"), F.lit(0)))).alias("w"))
    often = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    # few parts, as each sends its ``most`` first words to the driver
    top = often.repartition(16, "w").orderBy(F.desc("n"), "w").limit(most).collect()
    return tuple(dict.fromkeys([*WORDS, *(r.w for r in top)]))


def usual_pairs(words: tuple[str, ...], most: int = PAIRS) -> list[str]:
    """The letter pairs (a to z) that most words have, ties in alphabetical order."""
    n: dict[str, int] = {}
    for w in words:
        for pair in {w[i : i + 2] for i in range(len(w) - 1)}:
            if pair.isascii():
                n[pair] = n.get(pair, 0) + 1
    return sorted(n, key=lambda p: (-n[p], p))[:most]


def no_usual_pair(words: tuple[str, ...]) -> str:
    """A pattern of the letters (a to z) that do not begin a usual pair where they stand."""
    then: dict[str, str] = {}
    for a, b in usual_pairs(words):
        then[a] = then.get(a, "") + b
    never = "".join(c for c in _LOWER if c not in then)
    return "|".join([*(f"{a}(?![{b}])" for a, b in then.items()), *([f"[{never}]"] if never else [])])


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` computed once under ``name``.  A lambda variable is never
    inlined again by the optimizer, as a column of a select below would be."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def features(value: str, before: str, after: str, path: str, words: tuple[str, ...]) -> str:
    """SQL of the struct of FEATURES, all doubles, from SQL of the four strings."""
    book, v = f"split('{' '.join(words)}', ' ')", "fv"  # one folded literal: a list of literals costs the planner much memory
    flag = lambda text, pattern: f"rlike({text}, r'{pattern}')"
    share = lambda kind: f"length(regexp_replace({v}, '[^{kind}]', '')) / length({v})"
    turns = v
    for kind, sign in (("[a-z]+", "a"), ("[A-Z]+", "b"), ("[0-9]+", "c"), ("[^abc]+", "d")):
        turns = f"regexp_replace({turns}, '{kind}', '{sign}')"
    parts = rf"regexp_extract_all({v}, r'\p{{Lu}}?\p{{Ll}}{{2,}}|\p{{Lu}}{{3,}}', 0)"
    covered = f"aggregate({parts}, 0, (a, w) -> a + IF(array_contains(fd, lower(w)), length(w), 0)) / length({v})"
    letters = f"lower(regexp_replace({v}, '[^A-Za-z]', ''))"
    pairs = let("fl", letters, f"IF(length(fl) < 2, 0, length(regexp_replace(fl, '{no_usual_pair(words)}', '')) / (length(fl) - 1))")
    prose = let("fw", rf"regexp_extract_all(lower({before}), r'\p{{Ll}}{{2,}}', 0)", f"IF(size(fw) = 0, 0, size(filter(fw, w -> array_contains(fd, w))) / size(fw))")
    lasts = rf"regexp_replace({v}, r'(?s)(.)(?=.{{0,255}}?\1)', '')"  # each character is there still, a long value's few times
    cols = [
        f"length({v})", share("0-9"), share("A-Z"), f"1 - {share('A-Za-z0-9')}", f"length({turns}) / length({v})", pairs, covered,
        f"size(array_distinct(split({lasts}, ''))) / least(length({v}), 32)",
        flag(v, "^([0-9a-f]+|[0-9A-F]+)$"), flag(v, KNOWN), flag(before, KEYWORD), flag(before, ADDRESS), flag(before, HARMLESS),
        flag(before, r"[=:]>?\s*[\x22\x27]?$"), flag(before, r"[\x22\x27]$") + " AND " + flag(after, r"^[\x22\x27]"), flag(v, PLACEHOLDER), prose,
        flag(path, "(?i)(test|example|sample|fixture|mock|docs?)(/|$|[._-])"), f"size(split({path}, '/'))",
    ]
    made = "named_struct(" + ", ".join(f"'{n}', CAST({c} AS DOUBLE)" for n, c in zip(FEATURES, cols)) + ")"
    return let("fd", book, let("fv", value, made))


KEYS = (
    "password=", "password: ", 'passwd = "', 'token = "', "token=", 'secret: "', "api_key=", "apikey = '", "access_key: ",
    "Authorization: Bearer ", "auth_token=", "private_key=", '"password": "',
)
LINES = ("commit ", "sha256: ", "md5=", "checksum = ", "digest ", "revision ", "uuid: ", "build ", 'etag: "', "hash ")
ADDRESSES = tuple(f"{a}{b}:" for a in ("postgres://", "https://", "redis://", "mysql://", "amqp://") for b in ("admin", "app", "", "root", "user"))
PATHS = ("example.org/a", "app/settings.py", "", "deploy/main.tf", "blog", "site/posts/1")
TEST_PATHS = ("tests/fixtures/a.py", "docs/x.md", "examples/b", "src/mock/c")
STANDINS = ("${PASSWORD}", "<password>", "{{ token }}", "$SECRET_KEY", "%API_KEY%", "********", "changeme", "os.environ[TOKEN]", "None", "null", "required", "[REDACTED]", "xxxxxxxxxxxxxxxx7")
_HEX, _LOWER, _UPPER, _DIGIT, _SIGNS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!#$%&*?^~"


def finding(kind: int, rng: random.Random, words: tuple[str, ...]) -> tuple[str, str, str, str, float]:
    """A made-up (value, before, after, path, label); SECRET_KINDS are secrets."""
    some = lambda signs, low, high=0: "".join(rng.choices(signs, k=rng.randint(low, high or low)))
    alnum, word = _LOWER + _UPPER + _DIGIT, lambda: rng.choice(words)
    key, prose = rng.choice(KEYS), f"{word()} {word()} {word()}" + rng.choice((" ", " ", ' "', ", "))
    path, bare = rng.choice(PATHS), rng.choice((prose, prose, "", f"{word()} ", f"{word()}{rng.choice('/.-:=')}", "\n"))
    match kind:
        # secrets
        case 0: value, before = rng.choice(("AKIA", "ASIA")) + some(_UPPER + _DIGIT, 16), bare  # noqa: E701
        case 1: value, before = some(_HEX, 18, 40), key  # noqa: E701
        case 2: value, before = rng.choice(("ghp_", "gho_", "glpat-")) + some(alnum, 36), bare  # noqa: E701
        case 3: value, before = some(alnum, 24), key  # noqa: E701
        case 4: value, before = some(alnum + "+/", 40), key  # noqa: E701
        case 5: value, before = f"eyJ{some(alnum, 30)}.{some(alnum, 50)}.{some(alnum, 40)}", rng.choice((key, bare))  # noqa: E701
        case 6: value, before = "sk_live_" + some(alnum, 24), bare  # noqa: E701
        case 7: value, before = some(alnum, 7, 14), key  # noqa: E701
        case 8: value, before = some(alnum + _SIGNS, 9, 16), key  # noqa: E701
        case 9: value, before = "".join(word().title() for _ in range(4)), key  # noqa: E701
        case 10: value, before = word() + some(_DIGIT, 3), key  # noqa: E701
        case 11: value, before = word().title() + some(_DIGIT, 4) + some(_SIGNS, 1), key  # noqa: E701
        case 12: value, before = some(alnum, 8, 24), rng.choice(ADDRESSES)  # noqa: E701
        case 13: value, before = word() + some(_DIGIT, 2), rng.choice(ADDRESSES)  # noqa: E701
        case 14: value, before = f"-----BEGIN RSA PRIVATE KEY-----\n{some(alnum, 64)}\n-----END RSA PRIVATE KEY-----", "\n"  # noqa: E701
        case 15: value, before = "https://hooks.example.org/services/" + some(alnum, 24), bare  # noqa: E701
        case 16: value, before = f"{some(alnum, 4)} {word()}{some(_SIGNS, 1)} {some(_DIGIT, 2)}", rng.choice([k for k in KEYS if k.endswith(('"', "'"))])  # noqa: E701
        # no secrets
        case 17: value, before = some(_HEX, 40), rng.choice(LINES)  # noqa: E701
        case 18: value, before = some(_HEX, 64), rng.choice(LINES)  # noqa: E701
        case 19: value, before = some(_HEX, 32), prose  # noqa: E701
        case 20: value, before = some(_DIGIT, 16), prose  # noqa: E701
        case 21: value, before = some(_DIGIT, 17), rng.choice(LINES)  # noqa: E701
        case 22: value, before = "-".join(some(_HEX, n) for n in (8, 4, 4, 4, 12)), rng.choice((prose, "uuid: "))  # noqa: E701
        case 23: value, before = f"{word()}-{word()}-{some(_DIGIT, 4)}-{word()}", prose  # noqa: E701
        case 24: value, before = f"your_{word()}_key_here{rng.choice(('', '_1'))}", key  # noqa: E701
        case 25: value, before = f"{word()}/{word()}/{word()}/{some(_DIGIT, 3)}", prose  # noqa: E701
        case 26: value, before = f"{word()}{word().title()}{word().title()}{some(_DIGIT, 2)}", prose  # noqa: E701
        case 27: value, before, path = some(_HEX, 40), key, rng.choice(TEST_PATHS)  # noqa: E701
        case 28: value, before = f"{word()}_{word()}_{some(_DIGIT, 3)}", prose  # noqa: E701
        case 29 | 30: value, before = word() + rng.choice(("", ".", ";")), key  # noqa: E701
        case 31 | 32: value, before = rng.choice(STANDINS), key  # noqa: E701
        case 33: value, before = f"{word()}_{word()}", key  # noqa: E701
        case 34: value, before, path = some(alnum, 16, 28), prose, rng.choice(TEST_PATHS)  # noqa: E701
        case 35: value, before = f"example_{word()}_{some(_DIGIT, 4)}", key  # noqa: E701
        # secrets that look like checksums but for what announces them
        case _: value, before = some(rng.choice((_HEX, _HEX.upper())), rng.choice((32, 40, 64))), key  # noqa: E701
    if before[-1:] in ('"', "'"):
        after = before[-1]
    else:
        after = "@db.example.org/x" if "://" in before else rng.choice((" the", ".", ", and", "", "\n", "### to"))
    return value, before, after, path, float(kind in SECRET_KINDS)


KINDS, SECRET_KINDS = 39, {*range(17), 36, 37, 38}
_FINDING = "value string, before string, after string, path string, label double"


def made_findings(spark: SparkSession, words: tuple[str, ...] = tuple(WORDS), n: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """``n`` labelled findings by rule, the kinds in turn, their words from the dictionary."""
    rng = random.Random(seed)
    return spark.createDataFrame([finding(k % KINDS, rng, words) for k in range(n)], _FINDING)


def described(findings: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(label, FEATURES) of labelled findings."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = findings.select(F.col("value"), *(text(c).alias(c) for c in ("before", "after", "path")), "label")
    return rows.select("label", F.expr(features("value", "before", "after", "path", words)).alias("x")).select("label", "x.*")


@dataclass(frozen=True)
class Tree:
    """A decision tree: a leaf with its verdict, or a feature, a threshold and two subtrees
    (``low`` where the feature is at most the threshold)."""

    verdict: float
    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x) -> float:
        at = self
        while at.low is not None:
            at = at.low if x[at.feature] <= at.threshold else at.high
        return at.verdict

    def depth(self) -> int:
        return 0 if self.low is None else 1 + max(self.low.depth(), self.high.depth())


def best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    """(impurity, feature, threshold) of the split with the least Gini impurity, halfway
    between neighbouring values; None if no feature differs."""
    best, n = None, len(y)
    for f in features.tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows on the low side
        if not len(at):
            continue
        low, all_ones = ones[at - 1], ones[-1]
        high = all_ones - low
        impurity = 2 * (low * (1 - low / at) + high * (1 - high / (n - at)))
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0]:
            best = float(impurity[k]), f, float((v[at[k] - 1] + v[at[k]]) / 2)
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> Tree:
    """A tree on all rows; each split looks at half of the features, chosen at random."""
    verdict = float(2 * y.sum() > len(y))
    if not depth or y.min() == y.max():
        return Tree(verdict)
    split = best_split(x, y, rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2])
    if split is None:
        return Tree(verdict)
    _, f, threshold = split
    low = x[:, f] <= threshold
    return Tree(verdict, f, threshold, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1))


def fit(findings: DataFrame, words: tuple[str, ...], rows: int = FIT_ROWS) -> list[Tree]:
    """A random forest on at most ``rows`` findings: each tree on a bootstrap sample."""
    used = findings.where("length(value) > 0 AND label IS NOT NULL").orderBy(F.xxhash64("value", "before", "path"), "value").limit(rows)
    held = described(used, words).collect()
    if not held:
        return [Tree(0.0)]
    x, y = np.array([[r[f] for f in FEATURES] for r in held], float), np.array([r.label for r in held], float)
    rng = np.random.default_rng(SEED)
    samples = (rng.integers(0, len(y), len(y)) for _ in range(TREES))
    return [grow(x[i], y[i], rng) for i in samples]


def as_sql(forest: list[Tree]) -> str:
    """The forest as SQL over a struct x of FEATURES: the share of trees that say secret.

    Nodes stand in arrays, one folded literal each, and a tree is walked from its root, where
    a leaf leads to itself; nested conditions would fill the driver's parser and plans."""
    feature, bound, low, high = [], [], [], []  # of a leaf, the bound is its verdict

    def put(t: Tree) -> int:
        at = len(feature)
        for held, x in zip((feature, bound, low, high), (max(t.feature, 0), t.verdict if t.low is None else t.threshold, at, at)):
            held.append(x)
        if t.low is not None:
            low[at], high[at] = put(t.low), put(t.high)
        return at

    roots, steps = [put(t) for t in forest], max(1, *(t.depth() for t in forest))
    listed = lambda kind, xs: f"CAST(split('{' '.join(map(repr, xs))}', ' ') AS ARRAY<{kind}>)"
    nodes = f"""named_struct('x', array({', '.join(f'x.{f}' for f in FEATURES)}), 'feature', {listed('INT', feature)},
        'bound', {listed('DOUBLE', bound)}, 'low', {listed('INT', low)}, 'high', {listed('INT', high)})"""
    leaf = f"aggregate(sequence(1, {steps}), fr, (fn, fi) -> IF(fo.x[fo.feature[fn]] <= fo.bound[fn], fo.low[fn], fo.high[fn]))"
    return let("fo", nodes, f"aggregate({listed('INT', roots)}, 0D, (fs, fr) -> fs + fo.bound[{leaf}]) / {len(forest)}D")


@lru_cache(4)
def _made_forest(app: str, words: tuple[str, ...]) -> str:
    return as_sql(fit(made_findings(SparkSession.active(), words), words))


def forest_for(spark: SparkSession, findings: DataFrame | None, words: tuple[str, ...]) -> str:
    return as_sql(fit(findings, words)) if findings is not None else _made_forest(spark.sparkContext.applicationId, words)


def scanned(forest: str, threshold: float, words: tuple[str, ...], text: str = "text", path: str = "''") -> Column:
    """Of a text: ``found``, an array of (value, start, score) of each candidate, start
    counted in characters from 0, and ``clean``, the text with its secrets replaced.

    Starts are running sums over blocks of 256 candidates, as appending to one array would
    copy it for each of them."""
    before = "right(concat(IF(i > 0, right(s.v[i - 1], 60), ''), s.p[i]), 60)"
    raw = f"""IF(size(s.v) > 0, transform(sequence(0, size(s.v) - 1), i -> named_struct('value', s.v[i],
        'x', {let("fb", before, features("s.v[i]", "fb", "left(s.p[i + 1], 20)", "s.path", words))})), array())"""
    steps = "IF(size(s.v) > 0, transform(sequence(0, size(s.v) - 1), i -> named_struct('gap', length(s.p[i]), 'size', length(s.v[i]))), array())"
    none = "CAST(array() AS ARRAY<INT>)"
    block = f"""aggregate(slice(w, b * 256 + 1, 256), named_struct('at', a.at, 'out', {none}),
        (c, e) -> named_struct('at', c.at + e.gap + e.size, 'out', array_append(c.out, c.at + e.gap)))"""
    starts = f"""aggregate(sequence(0, size(w) div 256), named_struct('at', 0, 'out', {none}),
        (a, b) -> {let("z", block, "named_struct('at', z.at, 'out', concat(a.out, z.out))")}, a -> a.out)"""
    found = f"transform(r, (e, i) -> named_struct('value', e.value, 'start', t[i], 'score', CAST({let('x', 'e.x', forest)} AS DOUBLE)))"
    clean = f"concat(array_join(transform(f, (e, i) -> concat(s.p[i], IF(e.score >= {threshold}D, '{MARK}', e.value))), ''), element_at(s.p, -1))"
    cut = f"named_struct('p', split(coalesce({text}, ''), r'{CANDIDATE}', -1), 'v', regexp_extract_all(coalesce({text}, ''), r'{CANDIDATE}', 0), 'path', coalesce({path}, ''))"
    return F.expr(let("s", cut, let("r", raw, let("w", steps, let("t", starts, let("f", found, f"named_struct('found', f, 'clean', {clean})"))))))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, text: str = "text", path: str = "source") -> DataFrame:
    """One row for each candidate: doc_id, start, length, kind, value, score, is_secret."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(path).cast("string").alias("path")] if path in docs.columns else []))
    words = corpus_words(slim)
    said = scanned(forest_for(docs.sparkSession, findings, words), threshold, words, "text", "path" if path in docs.columns else "''")
    rows = slim.where(F.col("text").rlike(CANDIDATE)).select("doc_id", F.explode(said["found"]).alias("f"))
    value = F.col("f.value")
    kind = (
        F.when(value.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), "cloud_key").when(value.rlike("^(gh[pousr]_|github_pat_|glpat-)"), "repository_token")
        .when(value.rlike("^eyJ"), "signed_token").when(value.rlike("^-----BEGIN"), "private_key").when(value.rlike("^https://"), "webhook")
        .when(value.rlike("^[0-9a-fA-F]+$"), "hex").otherwise("mixed")
    )
    return rows.select("doc_id", F.col("f.start").cast("long").alias("start"), F.length(value).cast("long").alias("length"), kind.alias("kind"), value.alias("value"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, text: str = "text", path: str = "source") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``MARK``; n_chars, if there, counted anew."""
    own = Carried(docs)
    words = corpus_words(docs, text)
    said = scanned(forest_for(docs.sparkSession, findings, words), threshold, words, own[text], f"CAST({own[path]} AS STRING)" if path in own else "''")
    held = F.col(own[text])
    out = own.back(own.frame.withColumn(own[text], F.when(held.rlike(CANDIDATE), said["clean"]).otherwise(held)))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out
