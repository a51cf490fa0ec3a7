"""Filter interaction audit: which filters of a chain remove what, in every order of the chain.

Each text goes through a table-driven transducer over its UTF-8 bytes, all texts of some megabytes in step. What comes
out is a mask of failed filters; all figures are sums over counts of masks, so that only a short row a document moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import ship, written

FILTERS = "ABCDE"
#: Failure conditions: fewer words; distinct words below a share; capitals above a share; any of these symbols.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "#$%&*|"
#: Bytes of text that are worked on at once (a longer text alone), and bytes that one lane of the transducer reads.
PART, LANE = 2 << 20, 512

#: States: outside a word, inside one, and inside one with 1, 2 or 3 bytes of a code point to come.
OUT, IN, MORE1, MORE2, MORE3 = range(5)
#: What a step puts out, as bits beside the next state (the low three bits).
START, END, CAPITAL, POINT, SYMBOL = 8, 16, 32, 64, 128


def _table() -> np.ndarray:
    """uint8[state, byte]: the next state and what is put out.

    A word's end shows at the byte after it. A byte that can't go on is a code point of its own, as is a lead byte that
    breaks off another; texts from Spark are valid UTF-8 and never come there.
    """
    out = np.zeros((5, 256), np.uint8)
    for state in range(5):
        for byte in range(256):
            inside = state != OUT
            if byte == 32 or 9 <= byte <= 13:
                out[state, byte] = OUT | POINT | (END if inside else 0)
            elif 128 <= byte < 192:
                left = max(0, state - IN - 1) if state > IN else 0
                out[state, byte] = IN + left | (0 if state > IN else POINT) | (0 if inside else START)
            else:
                left = 0 if byte < 192 else 1 if byte < 224 else 2 if byte < 240 else 3
                flags = POINT | (0 if inside else START) | (CAPITAL if 65 <= byte <= 90 else 0) | (SYMBOL if chr(byte) in SYMBOLS else 0)
                out[state, byte] = IN + left | flags
    return out


TABLE = _table().ravel()


def transduce(data: np.ndarray) -> np.ndarray:
    """What the transducer puts out at each byte of `data`, from the state outside a word.

    The bytes are cut into lanes that take each step together. A lane starts in the state that its last bytes before it
    lead to: from any state, four bytes decide it.
    """
    n = len(data)
    lanes = -(-n // LANE)
    padded = np.full(lanes * LANE + 4, 32, np.uint8)
    padded[4 : 4 + n] = data
    state = np.zeros(lanes, np.uint16)
    at = np.arange(lanes) * LANE
    out = np.empty((LANE, lanes), np.uint8)
    for i in range(LANE + 4):
        step = TABLE[(state << 8) | padded[at + i]]
        state = (step & 7).astype(np.uint16)
        if i >= 4:
            out[i - 4] = step
    return out.T.ravel()[:n]


#: Odd, so that its powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """uint64 for each span: a polynomial of its bytes, its length and its owner, mixed."""
    powers = np.full(len(data), BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    inverse = np.full(len(data), BACK, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = (sums[end] - sums[start]) * inverse[start]
    h ^= owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of the spans of `size` bytes at `a` and at `b` are equal: short ones in step, long ones whole."""
    equal = np.ones(len(a), bool)
    left = np.arange(len(a))
    for i in range(min(int(size.max(initial=0)), 64)):
        left = left[(size[left] > i) & equal[left]]
        equal[left] = data[a[left] + i] == data[b[left] + i]
    for k in np.flatnonzero(equal & (size > 64)):
        equal[k] = np.array_equal(data[a[k] : a[k] + size[k]], data[b[k] : b[k] + size[k]])
    return equal


def first_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each span is the one of its equals (same owner, same bytes) that stays in the hash table.

    An open table of twice as many slots; all spans that aren't placed yet try a slot at once. A span that finds another
    of its hash there is compared with it byte by byte; where they differ it goes to the next slot.
    """
    n = len(start)
    first = np.zeros(n, bool)
    mask = np.uint64((1 << max(4, int(2 * n).bit_length())) - 1)
    table = np.full(int(mask) + 1, -1, np.int64)
    slot = (hashes & mask).astype(np.int64)
    waiting = np.arange(n)
    while len(waiting):
        free = waiting[table[slot[waiting]] < 0]
        table[slot[free]] = free
        holder = table[slot[waiting]]
        own = holder == waiting
        first[waiting[own]] = True
        a, b = waiting[~own], holder[~own]
        size = end[a] - start[a]
        like = (hashes[a] == hashes[b]) & (owner[a] == owner[b]) & (size == end[b] - start[b])
        like[like] = _same(data, start[a[like]], start[b[like]], size[like])
        waiting = a[~like]
        slot[waiting] = (slot[waiting] + 1) & np.int64(mask)
    return first


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points and symbols of each text, from one pass over the bytes."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a space ends each text's last word
    edge = np.concatenate([[0], np.cumsum(sizes)])
    out = transduce(data)
    start, end = np.flatnonzero(out & START), np.flatnonzero(out & END)
    owner = np.searchsorted(edge, start, "right") - 1
    first = first_spans(data, start, end, owner, _hashes(data, start, end, owner)) if len(start) else np.zeros(0, bool)
    per = lambda flag: np.bincount(np.searchsorted(edge, np.flatnonzero(out & flag), "right") - 1, minlength=len(texts))
    return {"words": np.bincount(owner, minlength=len(texts)), "distinct": np.bincount(owner[first], minlength=len(texts)), "capitals": per(CAPITAL), "points": per(POINT) - 1, "symbols": per(SYMBOL)}


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about PART bytes."""
    since = size = 0
    for i, t in enumerate(texts):
        if i > since and size + len(t) > PART:
            yield since, i
            since, size = i, 0
        size += len(t)
    if since < len(texts):
        yield since, len(texts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["words", "distinct", "capitals", "points", "symbols"]
    for batch in batches:
        texts = batch.column("_b").to_pylist()
        for a, b in _parts(texts):
            found = text_counts(texts[a:b])
            kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[n].astype(np.int64)) for n in names]], [*batch.schema.names[:-1], *names])


def text_measures(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, the text's SHA-256 as `digest`, and words, distinct words, capitals (A-Z), code points and
    symbols of each whole text (null: empty), a row for each row. Names of `keep` are numbered `_0, _1, ...`."""
    ship(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("_b"))
    kinds = [f"_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    return rows.mapInArrow(_counts, ", ".join([*kinds, "digest binary", *[f"{n} long" for n in ("words", "distinct", "capitals", "points", "symbols")]]))


def failure_masks(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """`part, mask, good, toxic, n`: how many rows of each part fail just the filters of each mask (bit i: FILTERS[i]).

    E fails where a row with a smaller id, anywhere in the table, has the same text (by SHA-256): the smallest id of each
    text comes from an aggregate with map-side partial results, and rows meet it by text and id together, so that no
    copies gather in a task. Rows with null ids never fail E and have no label, and rows of equal id and text fail it together or not at
    all. Labels of one id, where they repeat, count as one: good or toxic if any is.
    """
    measured = text_measures(df, [id_col, part_col], text_col)
    failed = [F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"), 100 * F.col("capitals") > CAPITAL_PERCENT * F.col("points"), F.col("symbols") > 0]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    rows = written(measured.select(F.col("_0").alias("id"), F.coalesce(F.col("_1").cast("string"), F.lit("")).alias("part"), "digest", mask.alias("mask")), "measures")
    firsts = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    late = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    # null ids stay out of the joins, whose null key would gather them
    known = rows.where("id is not null").join(firsts, ["digest", "id"], "left").join(marks, "id", "left").select("part", F.col("mask").bitwiseOR(late).alias("mask"), no("good"), no("toxic"))
    nameless = rows.where("id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.union(nameless).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def order_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) for all orders of FILTERS."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(p), k + 1, bit[p[k]], sum(bit[f] for f in p[:k])) for p in permutations(FILTERS) for k in range(len(p))]


def interactions(masks: DataFrame) -> DataFrame:
    """`part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley` from
    `failure_masks`, for every part, order and step; zeros included. No row gives no row.

    shapley sums what the step's filter removes over all orders at any place: of the orders of a mask's k filters each
    comes first in one of k, so a row that fails k filters counts 120 / k.
    """
    # one literal, as a plan of 600 structs takes its time
    steps = F.split(F.lit(" ".join(":".join(map(str, s)) for s in order_steps())), " ")
    cut = masks.select("part", "mask", "good", "toxic", "n", F.explode(F.transform(steps, lambda x: F.split(x, ":"))).alias("s"))
    each = cut.select("*", *[F.col("s")[i].cast(kind).alias(c) for i, (c, kind) in enumerate({"filter_order": "string", "step": "int", "own": "int", "before": "int"}.items())])
    fails, passed = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    orders = len(order_steps()) // len(FILTERS)
    share = F.when(fails, F.col("n") * (F.lit(orders) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")).otherwise(0)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & passed).alias("kept"),
        total(fails & passed).alias("removed"),
        total(fails & ~passed).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & passed & F.col("good")).alias("good_lost"),
        total(fails & passed & F.col("toxic")).alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """`interactions` of the five filters over `df`, per value of `part_col` (null: empty string).

    Filters fail a text with A: under 100 words; B: distinct words under 80 % of them; C: A-Z above 10 % of its code
    points; D: any of # $ % & * |; E: an equal text under a smaller id. Only the id, text, part and label columns are read.
    """
    return interactions(failure_masks(df, labels, id_col, text_col, part_col))
