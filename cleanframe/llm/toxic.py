"""Toxicity by a linear-chain conditional random field over the words of each line."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import as_binary, fold, keyed, ship

#: A-Z counts as a-z, bytes from 128 are letters, all else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Words of a training chain.
CHAIN = 60
#: Words whose weights a task keeps.
MEMO = 300_000


def features(word: bytes) -> tuple[tuple[str | int, bytes], ...]:
    """The word itself and its beginnings of 3 to 7 bytes: insults keep their stems under other endings."""
    return (("w", word), *[(n, word[:n]) for n in range(3, min(7, len(word)) + 1)])


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


class Chains:
    """Chains of different lengths side by side, longest first: step t has the first `live[t]` of them."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        size = sizes[self.order]
        self.begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))[self.order]
        self.live = np.searchsorted(-size, -np.arange(size[0]), side="left") if len(size) and size[0] else np.zeros(0, np.int64)

    def at(self, t: int) -> np.ndarray:
        return self.begin[: self.live[t]] + t


class Field:
    """Two labels. `weight`: of a feature for label 1; `move[a, b]`: of label b after a; label 0 weighs 0."""

    def __init__(self) -> None:
        self.weight: dict[tuple[str | int, bytes], float] = {}
        self.bias, self.move = 0.0, np.zeros((2, 2))
        self.top = np.zeros(4)

    def emission(self, word: bytes) -> float:
        return self.bias + sum(self.weight.get(f, 0.0) for f in features(word))

    def passes(self, e: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of label 1 at each word from the left (with its own emission) and from the right."""
        (t00, t01), (t10, t11) = self.move
        left, right = e.copy(), np.zeros(len(e))
        for t in range(1, len(chains.live)):
            at = chains.at(t)
            r = left[at - 1]
            left[at] = e[at] + t01 - t00 + softplus(r + t11 - t01) - softplus(r + t10 - t00)
        for t in range(len(chains.live) - 2, -1, -1):
            at = chains.at(t + 1)
            r = right[at] + e[at]
            right[at - 1] = t10 - t00 + softplus(r + t11 - t10) - softplus(r + t01 - t00)
        return left, right

    def marginals(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of label 1 at each word, by forward-backward over all chains at once."""
        left, right = self.passes(e, Chains(sizes))
        return 1 / (1 + np.exp(-np.clip(left + right, -500, 500)))

    def fit(self, chains: list[tuple[list[bytes], np.ndarray]], epochs: int = 40, rate: float = 0.15, decay: float = 1e-3) -> Field:
        """Adam on the labelled chains' conditional likelihood; gradients are observed less expected counts."""
        names: dict[tuple[str | int, bytes], int] = {}
        rows = [[names.setdefault(f, len(names)) for f in features(w)] for ws, _ in chains for w in ws]
        ids = np.array([i for r in rows for i in r], np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        y = np.concatenate([l for _, l in chains]).astype(float)
        sizes = np.array([len(ws) for ws, _ in chains])
        lay = Chains(sizes)
        inner = np.ones(len(y), bool)
        inner[np.cumsum(sizes)[:-1]] = inner[0] = False
        pair = np.flatnonzero(inner)
        seen = np.array([[np.sum((1 - y[pair - 1]) * (1 - y[pair])), np.sum((1 - y[pair - 1]) * y[pair])], [np.sum(y[pair - 1] * (1 - y[pair])), np.sum(y[pair - 1] * y[pair])]])
        theta = np.zeros(len(names) + 5)
        theta[-5] = -4.0
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, epochs + 1):
            w, self.bias, self.move = theta[: len(names)], float(theta[-5]), theta[-4:].reshape(2, 2)
            e = self.bias + np.bincount(owner, w[ids], minlength=len(y))
            left, right = self.passes(e, lay)
            p = 1 / (1 + np.exp(-np.clip(left + right, -500, 500)))
            a, b = left[pair - 1], e[pair] + right[pair]
            joint = np.stack([np.zeros(len(pair)) + self.move[0, 0], b + self.move[0, 1], a + self.move[1, 0], a + b + self.move[1, 1]])
            joint = np.exp(joint - joint.max(axis=0))
            joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            error = y - p
            g = np.concatenate((np.bincount(ids, error[owner], minlength=len(names)), [error.sum()], (seen - joint).ravel())) / len(chains) - decay * theta
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.bias, self.move = float(theta[-5]), theta[-4:].reshape(2, 2)
        self.weight = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-4}
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> Field:
        """Logistic regression of documents' labels on their marginals' sums, by Newton's method with a ridge."""
        top = np.zeros(x.shape[1])
        ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
        loss = lambda t: float(np.sum(weight * (softplus(x @ t) - y * (x @ t))) + t @ ridge @ t / 2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ top, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
            move = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ top)
            while np.abs(move).max() > 1e-7 and loss(top + move) > loss(top):
                move = move / 2
            top = top + move
            if np.abs(move).max() < 1e-6:
                break
        self.top = top
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.top, -30, 30)))


class Weights(dict):
    def __init__(self, field: Field) -> None:
        super().__init__()
        self.field = field

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        e = self[word] = self.field.emission(word)
        return e


def lines_of(text: bytes) -> list[list[bytes]]:
    return [ws for ws in (line.translate(FOLD).split() for line in text.split(b"\n")) if ws]


def tagged(field: Field, memo: Weights, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document features, marginals of each text's words): bias, largest, log sum and log density of the marginals."""
    lines = [lines_of(t) for t in texts]
    sizes = np.array([len(ws) for ls in lines for ws in ls], np.int64)
    words = np.array([sum(map(len, ls)) for ls in lines], np.int64)
    e = np.fromiter((memo[w] for ls in lines for ws in ls for w in ws), float, int(words.sum()))
    p = field.marginals(e, sizes) if len(e) else e
    parts = np.split(p, np.cumsum(words)[:-1])
    x = np.array([[1.0, m.max(initial=0.0), np.log1p(m.sum()), np.log((m.sum() + 0.02) / (len(m) + 20))] for m in parts])
    return x, parts


def spans(text: bytes, marginals: np.ndarray, least: float) -> list[dict]:
    """Offsets (code points) and marginal of each word of at least that marginal."""
    out, i, at = [], 0, 0
    for line in text.split(b"\n"):
        for m in WORD.finditer(line.translate(FOLD)):
            if marginals[i] >= least:
                start = len(text[: at + m.start()].decode("utf-8", "ignore"))
                out.append({"start": start, "end": start + len(line[m.start() : m.end()].decode("utf-8", "ignore")), "score": float(marginals[i])})
            i += 1
        at += len(line) + 1
    return out


def train(df: DataFrame, labels: DataFrame, per_class: int = 1200, lines: int = 3, modulo: int = 4, left: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 3) -> Field | None:
    """A field from a bounded sample: some `per_class` labelled rows of each class, by a hash of the id, and at
    most `lines` lines of each for the field.

    Only rows whose crc32(id as text) modulo `modulo` is not `left` are learned from. Words are labelled from
    their documents' labels: toxic are those words of toxic documents that have a feature (the word, its
    beginnings) found in a fiftieth of toxic documents (eight at least) and four times as often as in others.
    Equal texts count once. Null labels are left out, of repeated ones the largest counts. Without both classes there is no field (None).
    """
    ship(df.sparkSession)
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & (fold(F.col(f"`{id_col}`"), modulo) != left)).groupBy(F.col(f"`{id_col}`").alias("_l")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("_y") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    picked = known.where(F.pmod(F.xxhash64(F.lit(seed), F.col("_l").cast("string")), F.lit(1 << 20)) < share * (1 << 20))
    got = df.select(F.col(f"`{id_col}`").alias("_l"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_b")).join(F.broadcast(picked), "_l").orderBy("_l").toPandas()
    got = got.drop_duplicates("_b")
    y = got["_y"].to_numpy().astype(int)
    docs = [lines_of(bytes(b)) for b in got["_b"]]
    hits = [Counter(), Counter()]
    for ls, label in zip(docs, y, strict=True):
        hits[label].update({f for ws in ls for w in ws for f in features(w)})
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    marks = {f for f, c in hits[1].items() if c >= max(8, n1 / 50) and (c + 0.5) / n1 >= 4 * (hits[0][f] + 0.5) / n0}
    rng = np.random.default_rng(seed)
    chains = []
    for ls, label in zip(docs, y, strict=True):
        took, some = 0, int(rng.integers(max(1, len(ls))))
        for j in rng.permutation(len(ls)).tolist():
            ws = ls[j]
            hit = np.array([any(f in marks for f in features(w)) for w in ws])
            if took == lines or not hit.any() and (label or j != some):
                continue
            took += 1
            # a chain around the first marked word; in a clean document marked words are labelled clean
            a = max(0, int(np.argmax(hit)) - CHAIN // 2)
            chains.append((ws[a : a + CHAIN], hit[a : a + CHAIN] & bool(label)))
    if not chains:
        return None
    field = Field().fit(chains)
    x, _ = tagged(field, Weights(field), [bytes(b) for b in got["_b"]])
    # the classes weigh what they do in all labelled rows, whatever the sample's shares
    share = counts[1] / (counts[0] + counts[1])
    return field.calibrate(x, y.astype(float), np.where(y == 1, share * len(y) / n1, (1 - share) * len(y) / n0))


def _score(field: Field | None, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    memo = Weights(field) if field else None
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = part.column("_b").to_pylist()
            if field:
                x, marginals = tagged(field, memo, texts)
                s, found = field.scores(x), [spans(t, m, least) if m.max(initial=0.0) >= least else [] for t, m in zip(texts, marginals, strict=True)]
            else:
                s, found = np.zeros(len(texts)), [[] for _ in texts]
            yield pa.RecordBatch.from_arrays([part.column("_k"), pa.array(s), pa.array(found, kind)], ["_k", "score", "spans"])


def score(df: DataFrame, field: Field | None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, score, spans`: toxicity of each whole text (0 to 1) and its offending words' offsets and marginals.

    Every line is a chain; a document's score comes from the largest, the sum and the density of its words'
    marginals. Null and empty texts get the score of no word at all; without a field all scores are 0.
    Repeated ids give a row each.
    """
    rows, plain = keyed(df, id_col, text_col)
    out = as_binary(rows).mapInArrow(partial(_score, field, least), "_k long, score double, spans array<struct<start:int,end:int,score:double>>")
    if plain:
        return out.withColumnRenamed("_k", id_col)
    return out.join(rows.select("_k", F.col("_id").alias(id_col)), "_k").select(id_col, "score", "spans")
