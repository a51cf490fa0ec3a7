"""Language-model scoring by a hidden Markov model over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import as_binary, fold, keyed, written

#: Words that are symbols of their own: the most frequent, so many at most. All others share the classes.
HEAD = 1 << 16
#: Classes of the other words, by ending and length.
CLASSES = 1 << 12
#: Tokens of a training chain; a text's chains but the first start from the states' overall shares.
CHAIN = 64
#: Steps of a forward recursion between two scalings: a step's least factor is some 1e-18, and 1e-308 can be told from 0.
SCALED = 8
#: Longest word, in bytes, that can be in the head: bounds what the tasks get.
HEAD_BYTES = 64
#: Words outside the head whose symbols a task remembers.
MEMO = 200_000


def word_class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-3:] + bytes([min(len(word), 15)]), 42) % CLASSES


@lru_cache(1 << 16)
def _class_of_key(key: int) -> int:
    n = key & 255
    return word_class(bytes(max(0, n - 3)) + bytes(key >> 8 * i & 255 for i in range(min(n, 3), 0, -1)))


def word_classes(words: pa.Array) -> np.ndarray:
    """`word_class` of each word: found once for each ending and length."""
    if not len(words):
        return np.zeros(0, np.int32)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, size, end = np.frombuffer(words.buffers()[2], np.uint8), np.diff(at), at[1:]
    key = np.minimum(size, 15)
    for i in (1, 2, 3):
        some = np.flatnonzero(size >= i)
        key[some] |= data[end[some] - i].astype(np.int64) << 8 * i
    keys, which = np.unique(key, return_inverse=True)
    return np.array([*map(_class_of_key, keys.tolist())], np.int32)[which]


class Symbols(dict):
    """Symbol of each word: head words by rank, others by class; the last symbol is a text's end.

    MEMO words of the classes are remembered."""

    def __init__(self, head: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(head))
        self.words, self.head = head, len(head)
        self.end = self.head + CLASSES

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.head + MEMO:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.words))
        n = self[word] = self.head + word_class(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([*map(self.__getitem__, words), self.end], np.int32)


class Model:
    """start and share (K), move (K x K), emit (symbols x K)."""

    def __init__(self, start: np.ndarray, share: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.share, self.move, self.emit = start, share, move, emit

    @classmethod
    def first(cls, unigram: np.ndarray, states: int, seed: int) -> Model:
        """Unigram emissions, shaken by state, and states that tend to stay."""
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(rng.normal(0, 0.5, (len(unigram), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        share = np.full(states, 1 / states)
        return cls(share, share, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def counts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Expected counts (start, share, move, emit) of the texts' chains, by the scaled forward-backward recursion."""
        k = self.move.shape[0]
        start, share, move, emit = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        chains = [(t[i : i + CHAIN], i == 0) for t in texts for i in range(0, len(t), CHAIN)]
        chains.sort(key=lambda c: -len(c[0]))
        for a in range(0, len(chains), 1024):
            part = chains[a : a + 1024]
            size = np.array([len(c[0]) for c in part])
            opening = np.array([c[1] for c in part])
            steps = int(size[0])
            sym = np.zeros((steps, len(part)), np.int32)
            live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]
            flat = np.concatenate([c[0] for c in part])
            at = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
            sym[at, np.repeat(np.arange(len(part)), size)] = flat
            e = self.emit[sym]
            alpha, scale = np.zeros((steps, len(part), k)), np.ones((steps, len(part)))
            x = np.where(opening[:, None], self.start, self.share) * e[0]
            for t in range(steps):
                n = live[t]
                if t:
                    x = (alpha[t - 1, :n] @ self.move) * e[t, :n]
                s = x.sum(axis=1)
                scale[t, :n] = s
                alpha[t, :n] = x / s[:, None]
            beta = np.ones((len(part), k))
            gamma = np.zeros((steps, len(part), k))
            for t in range(steps - 1, -1, -1):
                n = live[t]
                if t + 1 < steps:
                    m = live[t + 1]
                    ahead = e[t + 1, :m] * beta[:m] / scale[t + 1, :m, None]
                    move += alpha[t, :m].T @ ahead
                    beta[:m] = ahead @ self.move.T
                gamma[t, :n] = alpha[t, :n] * beta[:n]
            start += gamma[0][opening].sum(axis=0)
            share += gamma.sum(axis=(0, 1))
            own = gamma[at, np.repeat(np.arange(len(part)), size)]
            for j in range(k):
                emit[:, j] += np.bincount(flat, own[:, j], minlength=len(emit))
        return start, share, move * self.move, emit

    def refit(self, start: np.ndarray, share: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray, prior: float = 50.0) -> Model:
        """The next model, from expected counts; emissions lean on the unigram shares by `prior` tokens."""
        k = len(share)
        smooth = lambda x: (x + 1) / (x.sum(axis=-1, keepdims=True) + k)
        emit = emit + prior * unigram[:, None]
        return Model(smooth(start), smooth(share), smooth(move), emit / emit.sum(axis=0))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the exact likelihood of each whole text, by the scaled forward recursion."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([texts[i] for i in order])
        at = np.concatenate(([0], np.cumsum(size[order])[:-1]))
        steps = int(size[order[0]])
        live = np.searchsorted(-size[order], -np.arange(steps), side="left").tolist()
        total, x = np.zeros(len(texts)), self.start * self.emit[flat[at]]
        for t in range(1, steps):
            n = live[t]
            if t % SCALED == 0:
                s = x[:n].sum(axis=1)
                total[:n] += np.log10(s)
                x[:n] /= s[:, None]
            at = at[:n] + 1
            np.multiply(x[:n] @ self.move, self.emit[flat[at]], out=x[:n])
        # a text that has ended keeps its last step
        total += np.log10(x.sum(axis=1))
        out = np.zeros(len(texts))
        out[order] = total
        return out


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, all words as bytes): A-Z lower-cased, split at white space."""
    # views, not casts: a cast of a slice to another width of offsets is wrong in this version of Arrow
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, ends = lists.flatten().view(pa.binary()), lists.offsets.to_numpy()
    # white space at a text's ends leaves empty words
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return np.diff(kept[ends - ends[0]]), words.filter(full)


def _parts(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """Keys, words of each text and all words of rows, some `most` bytes at a time."""
    keys, texts = batch.column("_k"), batch.column("_b")
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    row = 0
    while row < len(texts):
        upto = min(len(texts), max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + most, side="left")) + 1))
        yield keys.slice(row, upto - row), *_words(texts.slice(row, upto - row))
        row = upto


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("cls", pa.array(word_classes(batch.column("word"))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with counts, handed on whenever there are more than MEMO: partial sums."""

    def rows(counts: pa.Table) -> list[pa.RecordBatch]:
        return [pa.RecordBatch.from_arrays([b.column("word").view(pa.string()), b.column("c")], ["word", "c"]) for b in counts.to_batches(max_chunksize=MEMO)]

    counts, held = None, 0
    for batch in batches:
        for _, _, words in _parts(batch):
            v = words.value_counts()
            new = pa.table([v.field("values"), v.field("counts")], ["word", "c"])
            counts, held = new if counts is None else pa.concat_tables([counts, new]), held + len(new)
            if held > 2 * MEMO:
                counts = counts.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])
                held = len(counts)
                if held > MEMO:
                    yield from rows(counts)
                    counts, held = None, 0
    if counts is not None:
        yield from rows(counts.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]))


def _encode(head: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's symbols with its end, and its words outside the head with their counts."""
    first, heads = len(head), pa.array(head, pa.binary())
    for batch in batches:
        for keys, size, words in _parts(batch):
            coded = words.dictionary_encode()
            kinds, which = coded.dictionary, coded.indices.to_numpy()
            symbol = pc.fill_null(pc.index_in(kinds, heads), -1).to_numpy().copy()
            other = np.flatnonzero(symbol < 0)
            symbol[other] = first + word_classes(kinds.take(pa.array(other)))
            ends = np.cumsum(size + 1)
            made = np.full(int(ends[-1]), first + CLASSES, np.int32)
            text = np.repeat(np.arange(len(size)), size)
            made[np.arange(len(which)) + text] = symbol[which]
            # rare words by (text, word)
            far = np.flatnonzero((symbol >= first)[which])
            pairs, times = np.unique(text[far] * len(kinds) + which[far], return_counts=True)
            at = pa.array(np.searchsorted(pairs, np.arange(len(size) + 1) * len(kinds)).astype(np.int32))
            rare = kinds.take(pa.array(pairs % max(1, len(kinds))))
            yield pa.RecordBatch.from_arrays([
                keys.cast(pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(made)),
                pa.ListArray.from_arrays(at, rare.view(pa.string())),
                pa.ListArray.from_arrays(at, pa.array(times, pa.int64())),
            ], ["_k", "s", "rare", "times"])


def _texts(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, symbols of each text) of rows, some `most` tokens at a time."""
    s = batch.column("s")
    flat, at = s.flatten().to_numpy(), s.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    row = 0
    while row < len(s):
        upto = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, [flat[a:b] for a, b in zip(at[row:upto].tolist(), at[row + 1 : upto + 1].tolist(), strict=True)]
        row = upto


def _expect(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expected counts of a partition: a row for each symbol it holds, and negative rows for start, share, moves."""
    sums = None
    for batch in batches:
        for _, texts in _texts(batch):
            got = model.counts(texts)
            sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
    if sums is not None:
        start, share, move, emit = sums
        rows = np.flatnonzero(emit.sum(axis=1))
        names = np.concatenate((rows, -1 - np.arange(2 + len(share))))
        values = np.concatenate((emit[rows], start[None], share[None], move))
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *[pa.array(values[:, j]) for j in range(values.shape[1])]], ["s", *[f"v{j}" for j in range(values.shape[1])]])


def _iterate(texts: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One Baum-Welch step: expected counts by partition, summed by symbol. The result has a fixed bound."""
    k = model.move.shape[0]
    cols = [f"v{j}" for j in range(k)]
    each = texts.select("s").mapInArrow(partial(_expect, model), "s int, " + ", ".join(f"{c} double" for c in cols))
    got = each.groupBy("s").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    s, v = got["s"].to_numpy(), got[cols].to_numpy()
    if not len(s):
        return model
    emit = np.zeros_like(model.emit)
    emit[s[s >= 0]] = v[s >= 0]
    rest = dict(zip(s[s < 0].tolist(), v[s < 0], strict=True))
    return model.refit(rest[-1], rest[-2], np.stack([rest[-3 - j] for j in range(k)]), emit, unigram)


def _score(model: Model, first: int, end: int, head_log: np.ndarray, class_log: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in _texts(batch):
            size = np.array([len(t) for t in texts])
            flat = np.concatenate(texts)
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            rare = (flat >= first) & (flat < end)
            yield pa.RecordBatch.from_arrays([
                batch.column("_k").slice(row, len(texts)),
                pa.array(size.astype(np.int64)),
                pa.array(np.add.reduceat(rare.astype(np.int64), begin)),
                pa.array(np.add.reduceat(head_log[flat], begin)),
                pa.array(model.log10(texts) - np.add.reduceat(class_log[flat], begin)),
            ], ["_k", "n", "rare", "head", "path"])


def scores(df: DataFrame, states: int = 8, warm: int = 8, full: int = 2, seed: int = 1, modulo: int = 7, left: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, held_out, n_tokens, n_known, train_tokens, base_score, score` of every whole text.

    Learns from the rows whose crc32(id as text) modulo `modulo` is not `left`. Tokens are words with A-Z
    lower-cased and an end. All words are counted, in all training rows. A hidden Markov model of `states`
    states emits symbols: the HEAD most frequent words by themselves (fewer where counts tie), the end, and classes of the
    others, by ending and length; a class then gives its word by add-one counts, with a share for unknown
    words. Baum-Welch goes once through all training rows in `warm` steps, each on another share of them by a
    hash of the id, and ends with `full` steps over all of them; a step's expected counts are summed across partitions. `score`
    is the log10 likelihood of the whole text by the scaled forward recursion, `base_score` that of add-one
    unigrams. Rare words' counts are joined by word, so only the head, bounded, reaches all tasks. Null texts
    are an end alone; without a training row all counts are 0 and the model is uniform. Repeated ids count.
    """
    rows, plain = keyed(df, id_col, text_col)
    texts = as_binary(rows)
    train = rows.where(fold(F.col("_id"), modulo) != left)
    each = as_binary(train).mapInArrow(_counted, "word string, c long")
    words = written(each.groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = train.count()
    sizes = words.where(F.octet_length("word") <= HEAD_BYTES).groupBy("c").count().orderBy(F.desc("c"))
    total, distinct = (x or 0 for x in words.agg(F.sum("c"), F.count("*")).first())
    tokens, kinds = total + ends, distinct + (ends > 0)
    least, seen = None, 0
    for r in sizes.limit(HEAD).toLocalIterator():
        if seen + r["count"] > HEAD:
            break
        least, seen = r["c"], seen + r["count"]
    in_head = (F.octet_length("word") <= HEAD_BYTES) & (F.col("c") >= F.lit(least)) if least is not None else F.lit(False)
    top = [(r["word"].encode(), r["c"]) for r in words.where(in_head).orderBy(F.desc("c"), "word").collect()]
    head = [w for w, _ in top]
    tail = words.where(~in_head)
    classes = tail.select("word", "c").mapInArrow(_classed, "word string, c long, cls int").groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    mass = np.concatenate(([c for _, c in top], class_n, [ends])).astype(float) + 0.5
    unigram = mass / mass.sum()
    model = Model.first(unigram, states, seed)
    # tokenised once: all that follows reads symbols
    encoded = texts.mapInArrow(partial(_encode, head), "_k long, s array<int>, rare array<string>, times array<bigint>")
    ids = rows.select("_k", "_id", fold(F.col("_id"), modulo).alias("_fold"))
    by_key = fold(F.col("_k"), modulo).alias("_fold")
    encoded = written(encoded.select("*", by_key) if plain else encoded.join(ids.select("_k", "_fold"), "_k"), "symbols")
    learn = encoded.where(F.col("_fold") != left)
    if ends:
        for i in range(warm):
            model = _iterate(learn.where(F.pmod(F.xxhash64(F.lit(11), F.col("_k")), F.lit(warm)) == i), model, unigram)
        for _ in range(full):
            model = _iterate(learn, model, unigram)
    base = float(np.log10(tokens + kinds + 1))
    head_log = np.concatenate((np.log10(np.array([c for _, c in top], float) + 1) - base, np.full(CLASSES, -base), [np.log10(ends + 1) - base]))
    class_log = np.concatenate((np.zeros(len(top)), np.log10(class_n + class_v + 1), [0.0]))
    main = encoded.select("_k", "s").mapInArrow(partial(_score, model, len(head), len(head) + CLASSES, head_log, class_log), "_k long, n long, rare long, head double, path double")
    rare = encoded.select("_k", F.inline(F.arrays_zip("rare", "times"))).toDF("_k", "word", "n").join(tail.select("word", "c"), "word", "left")
    lifted = rare.groupBy("_k").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("up"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    out = main.join(lifted, "_k", "left")
    out = out.select("*", by_key) if plain else out.join(ids, "_k")
    up, known = F.coalesce("up", F.lit(0.0)), F.coalesce("known", F.lit(0))
    end_known = 1 if ends else 0
    return out.select(
        (F.col("_k") if plain else F.col("_id")).alias(id_col),
        (F.col("_fold") == left).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("n") - F.col("rare") - (1 - end_known) + known).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head") + up).alias("base_score"),
        (F.col("path") + up).alias("score"),
    )
