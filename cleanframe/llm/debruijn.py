"""Substring deduplication over the de Bruijn graph of the corpus' word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import as_binary, dropped, keyed, written

#: Odd multipliers of the two rolling hashes: 64 bits of one and 32 of the other tell windows apart.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words whose hashes a task keeps.
MEMO = 300_000


class Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(x: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of `size` words, by doubling: the hash of 2n words joins those of n and n."""
    n = len(x) - size + 1
    out, have, part, width, power = None, 0, x, 1, base
    while True:
        if size & width:
            out = part[:n] if out is None else out[:n] * power + part[have : have + n]
            have += width
        if width * 2 > size:
            return mixed(out)
        part = part[: len(part) - width] * power + part[width:]
        width *= 2
        power = power * power


def sliding(x: np.ndarray, size: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each `size` neighbours."""
    width = 1
    while width * 2 <= size:
        x = least(x[: len(x) - width], x[width:])
        width *= 2
    rest = size - width
    return least(x[: len(x) - rest], x[rest:]) if rest else x


class Words:
    """A text's words, their hashes, and the minimizers of its windows.

    A window's minimizer is the least hash among the runs of three tenths of its length in it. Equal windows have equal
    minimizers, so a window whose minimizer occurs once in the corpus is not repeated.
    """

    def __init__(self, text: bytes, window: int, memo: Memo) -> None:
        self.words = text.split()
        self.window, self.half = window, max(1, window * 3 // 10)
        self.n = len(self.words)
        if self.n >= window:
            # one power less than the window in each multiplier: the hashes differ by position
            self.x = np.fromiter(map(memo.__getitem__, self.words), np.uint64, self.n)
            with np.errstate(over="ignore"):
                self.runs = rolled(self.x, self.half, BASES[0])
            self.span = window - self.half + 1
            self.least = sliding(self.runs, self.span, np.minimum)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs that are some window's minimizer."""
        if self.n < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pad = np.zeros(self.span - 1, np.uint64)
        most = sliding(np.concatenate((pad, self.least, pad)), self.span, np.maximum)
        at = np.flatnonzero(most == self.runs)
        return at, self.runs[at]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows with a minimizer at one of the `repeated` places."""
        marked = np.full(len(self.runs), MAX)
        marked[repeated] = self.runs[repeated]
        return np.flatnonzero(sliding(marked, self.span, np.minimum) == self.least)

    def edges(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return tuple(rolled(self.x, self.window, b)[starts] for b in BASES)


def _minimizers(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            at, hashes, keys = [], [], []
            for k, b in zip(part.column("_k").to_pylist(), part.column("_b").to_pylist(), strict=True):
                a, h = Words(b, window, memo).minimizers()
                at.append(a)
                hashes.append(h)
                keys.append(np.full(len(a), k, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32))], ["m", "_k", "p"])


def _edges(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo()
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            out = [[], [], [], []]
            for k, b, places in zip(part.column("_k").to_pylist(), part.column("_b").to_pylist(), part.column("_places").to_pylist(), strict=True):
                w = Words(b, window, memo)
                starts = w.candidates(np.array(places, np.int64))
                for column, x in zip(out, (*w.edges(starts), np.full(len(starts), k, np.int64), starts), strict=True):
                    column.append(x)
            cols = [np.concatenate(c) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array((cols[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(cols[2]), pa.array(cols[3].astype(np.int32))], ["h", "g", "_k", "i"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins edges that follow each other at their source, equally often repeated, to paths (start, edges, count)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        firsts = batch.column("_firsts")
        at = firsts.offsets.to_numpy().astype(np.int64)
        edges = firsts.flatten()
        i, n = edges.field("i").to_numpy(), edges.field("n").to_numpy()
        at -= at[0]
        new = np.ones(len(i) + 1, bool)
        new[1:-1] = (np.diff(i) != 1) | (np.diff(n) != 0)
        new[at] = True
        cut = np.flatnonzero(new)
        paths = pa.StructArray.from_arrays([pa.array(i[cut[:-1]], pa.int32()), pa.array(np.diff(cut), pa.int32()), pa.array(n[cut[:-1]], pa.int64())], ["start", "edges", "count"])
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.ListArray.from_arrays(pa.array(np.searchsorted(cut, at), pa.int32()), paths)], ["_k", "_paths"])


def covered(n: int, window: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words are covered by windows at the distinct `starts`."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] = 1
    edge[starts + window] -= 1
    return np.cumsum(edge[:n]) > 0


def _spans(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _kept(window: int, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = []
        for k, b, places, paths in zip(*[batch.column(c).to_pylist() for c in ("_k", "_b", "_places", "_paths")], strict=True):
            gone = None
            if places:
                w = Words(b, window, memo)
                starts = w.candidates(np.array(places, np.int64))
                own = np.zeros(w.n, bool)
                for p in paths or []:
                    own[p["start"] : p["start"] + p["edges"]] = True
                later = starts[~own[starts]]
                words = w.words
                if len(later):
                    gone = covered(w.n, window, later)
                    words = list(compress(words, (~gone).tolist()))
                n = w.n
            else:
                words = b.split()
                n = len(words)
            text = b" ".join(words)
            rows.append((k, n, n - len(words), hashlib.sha256(text).hexdigest() if digest else text.decode(), [] if gone is None or digest else _spans(gone)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["_k", "n_words", "n_removed", "kept", "removed"])


def _deduped(df: DataFrame, window: int, digest: bool, id_col: str, text_col: str) -> DataFrame:
    rows, plain = keyed(df, id_col, text_col)
    texts = as_binary(rows)
    least = written(texts.mapInArrow(partial(_minimizers, window), "m long, _k long, p int"), "minimizers")
    # a table of its own: it is broadcast while small, and beyond that a hot minimizer's rows can be split
    repeated = written(least.groupBy("m").count().where("count > 1").select("m"), "repeated")
    places = written(least.join(repeated, "m", "left_semi").groupBy("_k").agg(F.collect_list("p").alias("_places")), "places")
    dropped(least)
    edges = texts.join(places, "_k").mapInArrow(partial(_edges, window), "h long, g int, _k long, i int")
    firsts = edges.groupBy("h", "g").agg(F.min(F.struct("_k", "i")).alias("at"), F.count("*").alias("n"))
    sources = firsts.groupBy(F.col("at._k").alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col("at.i").alias("i"), "n"))).alias("_firsts"))
    paths = written(sources.mapInArrow(_paths, "_k long, _paths array<struct<start:int,edges:int,count:bigint>>"), "paths")
    told = places.join(paths, "_k", "left")
    out = texts.join(told, "_k", "left").mapInArrow(partial(_kept, window, digest), "_k long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
    if plain:
        return out.withColumnRenamed("_k", id_col)
    return out.join(rows.select("_k", F.col("_id").alias(id_col)), "_k").select(id_col, "n_words", "n_removed", "kept", "removed")


def without_repeats(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_words, n_removed, kept, removed`: texts less the words covered by windows that start earlier elsewhere.

    A window is `window` consecutive words (runs without space or \\x09-\\x0D). Of all equal windows the first, by
    id and start, stays; every word in a later one goes; windows are judged on the input. `kept` joins the
    words left with one space, `removed` lists the spans of words that went.

    Windows are the edges of the corpus' de Bruijn graph. (1) Each text's minimizers are counted; only
    windows whose minimizer repeats go on, so that the words of most texts never leave their task. (2) Those
    are grouped by 96 bits of hash to find each edge's first place and count, with partial sums for hot ones.
    (3) Edges that follow each other at their source and repeat equally often are compacted to paths by
    source, which (4) are joined to the texts: candidates that lie on no own path start earlier elsewhere.
    Null texts have no words. Rows with null or repeated ids are rows of their own, in `keyed`'s order.
    """
    return _deduped(df, window, False, id_col, text_col)


def repeat_digests(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_words, n_removed, kept_sha256` of `without_repeats`."""
    return _deduped(df, window, True, id_col, text_col).withColumnRenamed("kept", "kept_sha256").drop("removed")
