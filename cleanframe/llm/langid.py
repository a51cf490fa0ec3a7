"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import as_binary, fold, keyed, lean, ship

#: Bytes of a window, widths and number of the filters, size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: A byte's class: letters by themselves without case, bytes from 128 by themselves, all other bytes as 0.
CLASSES = 1 + 26 + 128
CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 128 + 27 if b >= 128 else 0 for b in range(256)], np.int16)
#: Windows that a task holds at once, and those of them whose places are all held.
BATCH, PLACES = 512, 64
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


class ByteNet:
    """Embedding, filters of several widths, max pooling over a window, softmax."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (CLASSES, EMBED)).astype(np.float32)
        self.conv = [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.top = np.zeros(len(langs), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 4, size: int = 64, rate: float = 0.005, seed: int = 7) -> ByteNet:
        """Adam on the cross entropy; through the max pooling, only the winning position of a filter learns."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.conv, self.bias, self.out, self.top]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), size):
                part = order[i : i + size]
                grads = self._gradients(CLASS[windows[part]], labels[part])
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        e = self.embed[x]
        pooled, where = [], []
        for w, k in zip(WIDTHS, self.conv, strict=True):
            z = sum(e[:, j : WINDOW - w + 1 + j] @ k[j] for j in range(w))
            at = z.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, axis=1) + self.bias
        a = np.maximum(h, 0)
        z = a @ self.out + self.top
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.out.T) * (h > 0)
        d_embed, d_conv = np.zeros_like(self.embed), []
        for i, (w, k) in enumerate(zip(WIDTHS, self.conv, strict=True)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(k)
            for j in range(w):
                taken = np.take_along_axis(x, where[i] + j, 1)
                g[j] = np.einsum("nfe,nf->ef", self.embed[taken], d)
                np.add.at(d_embed, taken, d[:, :, None] * k[j].T[None])
            d_conv.append(g)
        return [d_embed, *d_conv, dh.sum(axis=0), a.T @ p, p.sum(axis=0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters' answers to byte pairs at offsets 0 and 2: applying them is two look-ups a byte."""
        one = [[self.embed @ k[j] for j in range(w)] for w, k in zip(WIDTHS, self.conv, strict=True)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, FILTERS)
        ahead = np.concatenate([pair(o[0], o[1]) for o in one], axis=1)
        nil = np.zeros((CLASSES, FILTERS), np.float32)
        behind = np.concatenate([pair(one[1][2], nil), pair(one[2][2], one[2][3])], axis=1)
        return np.ascontiguousarray(ahead), np.ascontiguousarray(behind)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and score of each text: its windows' probabilities, averaged by their letters."""
        ahead, behind = self._cached = getattr(self, "_cached", None) or self.tables()
        n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
        padded = b"".join(t.ljust(k * WINDOW, b" ") for t, k in zip(texts, n.tolist(), strict=True))
        owner = np.repeat(np.arange(len(texts)), n)
        total = np.zeros((len(texts), len(self.langs)))
        weight = np.zeros(len(texts))
        for i in range(0, len(owner), BATCH):
            x = CLASS[np.frombuffer(padded, np.uint8, min(BATCH, len(owner) - i) * WINDOW, i * WINDOW)].astype(np.int32).reshape(-1, WINDOW)
            pairs = x[:, :-1] * CLASSES + x[:, 1:]
            # a filter's place needs all the bytes of the widest one: the last three places of a window have none
            most = np.empty((len(x), ahead.shape[1]), np.float32)
            for j in range(0, len(x), PLACES):
                z = ahead[pairs[j : j + PLACES, :-2]]
                z[:, :, FILTERS:] += behind[pairs[j : j + PLACES, 2:]]
                z.max(axis=1, out=most[j : j + PLACES])
            a = np.maximum(most + self.bias, 0) @ self.out + self.top
            p = np.exp(a - a.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            letters = (x > 0).sum(axis=1)
            own = owner[i : i + len(x)]
            np.add.at(total, own, p * letters[:, None])
            np.add.at(weight, own, letters)
        best = total.argmax(axis=1)
        score = total[np.arange(len(texts)), best] / np.maximum(weight, 1)
        found = [has_letter(t) for t in texts]
        return [self.langs[b] if f else "und" for b, f in zip(best.tolist(), found, strict=True)], [float(min(1.0, s)) if f else 0.0 for s, f in zip(score.tolist(), found, strict=True)]


def _cut(per_text: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of labelled texts, evenly spread over each text."""
    for batch in batches:
        langs, windows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_b").to_pylist(), strict=True):
            n = max(1, -(-len(text) // WINDOW))
            for i in sorted({n * j // per_text for j in range(per_text)}):
                part = text[i * WINDOW : (i + 1) * WINDOW]
                if has_letter(part):
                    langs.append(lang)
                    windows.append(part.ljust(WINDOW, b" "))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "w"])


def train(labelled: DataFrame, per_lang: int = 700, windows_per_text: int = 3, max_langs: int = 200, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", epochs: int = 4) -> ByteNet | None:
    """A network from a bounded sample: some `per_lang` rows of each of the `max_langs` most frequent languages,
    `windows_per_text` windows of each. Rows are chosen by a hash of their id, whatever the size of the table.
    Null languages and texts are left out; without a labelled row there is no network (None).
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("_b")).where("lang is not null and _b is not null")
    counts = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, per_lang / n))])
    picked = rows.where(F.pmod(F.xxhash64(F.lit(5), "i"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    got = picked.select("lang", "_b").mapInArrow(partial(_cut, windows_per_text), "lang string, w binary").orderBy("lang", "w").toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return None
    x = np.frombuffer(b"".join(got["w"]), np.uint8).reshape(-1, WINDOW)
    return ByteNet(langs).fit(x, np.searchsorted(langs, got["lang"].to_numpy().astype(str)), epochs=epochs)


def _in_parts(texts: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + WINDOW
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _label(net: ByteNet | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for part in _in_parts(texts):
        a, b = net.predict(part) if net else (["und"] * len(part), [0.0] * len(part))
        langs += a
        scores += b
    return langs, scores


def _predict(net: ByteNet | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = _label(net, batch.column("_b").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_k", "lang_pred", "score"])


@lean
def _keep(net: ByteNet | None, least: float, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        langs, scores = _label(net, pc.fill_null(batch.column(at).cast(pa.binary()), b"").to_pylist())
        yield batch.filter(pa.array([lang != "und" and s >= least for lang, s in zip(langs, scores, strict=True)], pa.bool_()))


def predict(df: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, lang_pred, score` of every whole text: all its windows count. `und` and 0 for null texts and texts
    without a letter, and for all texts where there is no network. Repeated ids give a row each."""
    rows, plain = keyed(df, id_col, text_col)
    out = as_binary(rows).mapInArrow(partial(_predict, net), "_k long, lang_pred string, score double")
    if plain:
        return out.withColumnRenamed("_k", id_col)
    return out.join(rows.select("_k", F.col("_id").alias(id_col)), "_k").select(id_col, "lang_pred", "score")


def learned(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: those whose crc32(id as text) modulo 4 is not 2."""
    return df.where(fold(F.col(f"`{id_col}`"), 4) != 2)


def recognised(df: DataFrame, net: ByteNet | None, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose language is recognised: not `und`, and of a score of at least `least`."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_keep, net, least, text_col), df.schema)
