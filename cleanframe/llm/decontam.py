"""Benchmark decontamination: pigeonhole edit matching of test items in documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import as_binary, keyed, lean, ship

#: Test items go to the tasks in blocks of about so many bytes; more items mean more passes, never fewer items.
BLOCK_BYTES = 8 << 20
#: Bytes below 128 that are neither letters nor digits count as spaces; A-Z counts as a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """(distance, end): least edit distance, in words, of the pattern to a part of the text, and that part's end.

    Myers' bit-parallel recurrence over words; one Python integer holds a column of any pattern length.
    """
    m = len(pattern)
    at: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(h | plus) & full)
        down = plus & h
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(x | up) & full), up & x
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The automaton of all pieces of a block of test items, and the items to verify hits against."""

    def __init__(self, items: list[tuple], error_rate: float, min_words: int) -> None:
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = fold_words(text)
            if not words:
                continue
            budget = int(len(words) * error_rate) if len(words) >= min_words else 0
            cuts = [round(len(words) * i / (budget + 1)) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = (b" " + b" ".join(words[a:b]) + b" ").decode("latin-1")
                pieces.setdefault(piece, []).append((len(self.items), a))
            self.items.append((item_id, words, budget))
        self.find = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.find.add_word(piece, (len(piece), where))
        if pieces:
            self.find.make_automaton()

    def hits(self, text: bytes) -> list[tuple]:
        """(item id, distance, first word, word after the last) of each item found, at its best place."""
        if not self.items or not text:
            return []
        words = fold_words(text)
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.find.iter(line))
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        starts: dict[int, set[int]] = {}
        for end, (size, where) in found:
            word = int(np.searchsorted(blanks, end - size + 1))
            for item, offset in where:
                starts.setdefault(item, set()).add(word - offset)
        out = []
        for item, places in starts.items():
            item_id, pattern, budget = self.items[item]
            best, seen = (budget + 1, 0, 0), float("-inf")
            for p in sorted(places):
                if p <= seen:  # inside the part that the last hit has verified
                    continue
                # places within one budget of p share its window
                seen = p + budget
                a, b = max(0, p - budget), max(0, seen + budget + len(pattern))
                d, end = myers(pattern, words[a:b])
                if d < best[0]:
                    _, back = myers(pattern[::-1], words[a : a + end][::-1])
                    best = (d, a + end - back, a + end)
            if best[0] <= budget:
                out.append((item_id, *best))
        return sorted(out, key=lambda x: (x[2], str(x[0])))


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The test items, some BLOCK_BYTES at a time: a stated query set that every document is held against."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("b")).where(F.col("b").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("b") + 16)).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for i in range(n):
        yield [(r["id"], bytes(r["b"])) for r in items.where(F.pmod(F.xxhash64("b"), F.lit(n)) == i).orderBy("id", "b").collect()]


def _find(make: Callable[[], Matcher], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = make()
    for batch in batches:
        rows = [(k, *h) for k, b in zip(batch.column("_k").to_pylist(), batch.column("_b").to_pylist(), strict=True) for h in matcher.hits(b)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_k", "item_id", "distance", "start_word", "end_word"])


@lean
def _clean(make: Callable[[], Matcher], text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = make()
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        texts = pc.fill_null(batch.column(at).cast(pa.binary()), b"").to_pylist()
        yield batch.filter(pa.array([not matcher.hits(b) for b in texts], pa.bool_()))


def leaks(df: DataFrame, benchmark: DataFrame, error_rate: float = 0.2, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`id, item_id, distance, start_word, end_word`: every test item that a document holds, at its best place.

    Words are runs of letters and digits, A-Z lower-cased (bytes from 128 are letters). An item of n words may
    differ by k = floor(n * error_rate) word edits. It is cut into k + 1 pieces, of which at least one is
    unharmed, so all exact piece hits are looked up and verified with Myers' distance: nothing within the
    budget is missed. Items under `min_words` words may not differ at all; null items and those without a word
    are left out; null texts hold nothing; rows with repeated ids each count. Item ids are whole numbers. Items go to tasks in blocks, see `blocks`.
    """
    rows, plain = keyed(df, id_col, text_col)
    out = None
    for items in blocks(benchmark, item_col, item_text):
        found = as_binary(rows).mapInArrow(partial(_find, partial(Matcher, items, error_rate, min_words)), "_k long, item_id long, distance long, start_word long, end_word long")
        out = found if out is None else out.union(found)
    if plain:
        return out.withColumnRenamed("_k", id_col)
    return out.join(rows.select("_k", F.col("_id").alias(id_col)), "_k").select(id_col, "item_id", "distance", "start_word", "end_word")


def decontaminated(df: DataFrame, benchmark: DataFrame, error_rate: float = 0.2, min_words: int = 8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `df`, all columns, that hold no test item by the rule of `leaks`. One pass, no shuffle."""
    ship(df.sparkSession)
    for items in blocks(benchmark, item_col, item_text):
        df = df.mapInArrow(partial(_clean, partial(Matcher, items, error_rate, min_words), text_col), df.schema)
    return df
