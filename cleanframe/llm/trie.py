"""The prefix trie of conversations: screened by a count-min sketch, so that only prefixes that may be shared are shuffled.

Turns travel as 128-bit digests and word counts in segments of bounded length. A prefix has a 128-bit key, the sum of its
turns' digests salted by their places. A sketch counts all keys; an estimate of one proves that a prefix is one conversation's, and
its node is made where it stands. All others are grouped exactly by their keys.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.llm.common import ship, words_of, written

#: A conversation is cut into segments by spans of so many turn numbers, and ids into blocks of so many, as a power of two.
SEGMENT_BITS = 12
#: Counters of a prefix in the sketch, cells for a prefix at least, and cells of a row of counters at most.
ROWS, CELLS, MOST_CELLS = 4, 4, 1 << 24
#: Cells of a piece of the sketch on its way.
BLOCK = 1 << 14
#: A node of more children than this, or than this share of all, is known to every task: so many nodes at most.
CROWD, MOST_CROWDS = 256, 10_000


def segments(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`c, part, off, total, a`: each conversation's turns in order, cut into segments; a row a segment.

    `a` holds (h1, h2, w) a turn: two hashes of role and text (null: empty) and the words of the text. Turns go by their
    number, null first, ties by hash; `off` turns stand before the segment, `total` are in the conversation. Rows with a
    null id belong to no conversation and are left out.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turn = F.struct(
        F.col(f"`{turn_col}`").cast("long").alias("turn"), F.xxhash64(F.lit(0), text(role_col), text(text_col)).alias("h1"),
        F.xxhash64(F.lit(1), text(role_col), text(text_col)).alias("h2"), F.size(words_of(text(text_col))).alias("w"),
    )
    named = conversations.where(F.col(f"`{id_col}`").isNotNull())
    rows = named.select(F.col(f"`{id_col}`").cast("long").alias("c"), F.coalesce(F.shiftright(F.col(f"`{turn_col}`").cast("long"), SEGMENT_BITS), F.lit(-(1 << 62))).alias("part"), turn.alias("t"))
    sorted_turns = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["w"].alias("w")))
    cut = written(rows.groupBy("c", "part").agg(sorted_turns.alias("a")), "segments")
    spans = cut.select("c", "part", F.size("a").cast("long").alias("n"))
    w = Window.partitionBy("c").orderBy("part")
    placed = spans.select("c", "part", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"), F.sum("n").over(Window.partitionBy("c")).alias("total"))
    return written(cut.join(placed, ["c", "part"]), "segments")


def paths(segs: DataFrame) -> DataFrame:
    """`c, d0, depth, a`: the segments of conversations as they are; `d0` turns stand before one, `depth` are in all."""
    return segs.select("c", F.col("off").alias("d0"), F.col("total").alias("depth"), "a")


def with_heads(segs: DataFrame, home: Column, taken: Column, most: int) -> DataFrame:
    """`paths` of conversations rebuilt on another's head: the first `taken` turns of conversation `home` (all if it has fewer,
    none if it is absent), then the own turns after the first `taken`. Both are expressions of `c`; `most` bounds `taken`.

    `%` of a negative id has its sign, as in SQL."""
    # all within the first `most` turns: at most so many segments a conversation
    early = segs.where(F.col("off") < most).select("c", F.struct("off", F.slice("a", 1, most).alias("a")).alias("s"))
    fronts = early.groupBy("c").agg(F.array_sort(F.collect_list("s")).alias("s")).select("c", F.slice(F.flatten(F.col("s.a")), 1, most).alias("front"))
    heads = fronts.select("c", home.alias("home"), taken.cast("int").alias("h")).join(fronts.select(F.col("c").alias("home"), "front"), "home", "left")
    none = F.array().cast(segs.schema["a"].dataType)
    heads = heads.select("c", "h", F.when(F.col("h") > 0, F.coalesce(F.slice("front", 1, F.greatest("h", F.lit(1))), none)).otherwise(none).alias("head"))
    got, first = F.size("head"), F.col("off") == 0
    own = F.slice("a", F.greatest(F.col("h") - F.col("off"), F.lit(0)).cast("int") + 1, F.greatest(F.size("a"), F.lit(1)))
    depth = got + F.greatest(F.col("total") - F.col("h"), F.lit(0))
    before = F.when(first, F.lit(0)).otherwise(got + F.greatest(F.col("off") - F.col("h"), F.lit(0)))
    return segs.join(heads, "c").select("c", before.cast("long").alias("d0"), depth.cast("long").alias("depth"), F.concat(F.when(first, F.col("head")).otherwise(none), own).alias("a"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """The prefixes of a batch of segments: row of the batch, depth, key, and the key one turn up."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        arrays = batch.column("a")
        self.sizes = np.diff(arrays.offsets.to_numpy())
        turns = arrays.flatten()
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        start = np.cumsum(self.sizes) - self.sizes
        d0 = batch.column("d0").to_numpy()
        self.depth = np.arange(len(turns)) - start[self.row] + d0[self.row] + 1
        self.words = turns.field("w").to_numpy()
        self.keys, self.up = [], []
        for name, carry, salt in (("h1", "s1", 0x9E3779B97F4A7C15), ("h2", "s2", 0xD6E8FEB86659FD93)):
            h = turns.field(name).to_numpy().view(np.uint64)
            x = _mixed(h ^ _mixed(self.depth.astype(np.uint64) * np.uint64(salt)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
            base = batch.column(carry).to_numpy().view(np.uint64)[self.row] - sums[start[self.row]]
            self.keys.append(sums[1:] + base)
            self.up.append(sums[:-1] + base)

    def sums(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """The key at the end of each row's segment, less what was carried in."""
        end, out = np.cumsum(self.sizes) - 1, []
        for k, name in zip(self.keys, ("s1", "s2"), strict=True):
            carried = batch.column(name).to_numpy().view(np.uint64)
            total = np.zeros(len(self.sizes), np.uint64)
            full = self.sizes > 0
            total[full] = k[end[full]] - carried[full]
            out.append(total.view(np.int64))
        return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s1, s2 = Prefixes(batch).sums(batch)
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("d0"), pa.array(s1), pa.array(s2)], ["c", "d0", "t1", "t2"])


def _carried(rows: DataFrame) -> DataFrame:
    """`rows` with s1, s2: the sums of the segments before each. Only conversations of several segments are looked at."""
    zero = F.lit(0).cast("long")
    alone = (F.col("d0") == 0) & (F.col("depth") == F.size("a"))
    several = rows.where(~alone).withColumns({"s1": zero, "s2": zero})
    w = Window.partitionBy("c").orderBy("d0").rowsBetween(Window.unboundedPreceding, -1)
    # sums of 64 bits that wrap around, by way of decimals
    half, whole = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    around = lambda c: (F.pmod(F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")).over(w), F.lit(Decimal(0))) + half, whole) - half).cast("long")
    sums = several.where(F.size("a") > 0).mapInArrow(_sums, "c long, d0 long, t1 long, t2 long").select("c", "d0", around("t1").alias("s1"), around("t2").alias("s2"))
    more = several.drop("s1", "s2").join(sums, ["c", "d0"], "left").withColumns({s: F.coalesce(s, zero) for s in ("s1", "s2")})
    return rows.where(alone).withColumns({"s1": zero, "s2": zero}).unionByName(more)


def _cells(keys: list[np.ndarray], width: int) -> list[np.ndarray]:
    mask = np.uint64(width - 1)
    return [((keys[0] + np.uint64(r) * keys[1]) & mask).astype(np.int64) + r * width for r in range(ROWS)]


def _sketch(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sketch: counters up to 2, in compressed blocks; those without a count are left out."""
    table = np.zeros(ROWS * width, np.uint8)
    for batch in batches:
        for cells in _cells(Prefixes(batch).keys, width):
            at, n = np.unique(cells, return_counts=True)
            table[at] = np.minimum(2, table[at] + np.minimum(n, 2))
    blocks = table.reshape(-1, BLOCK)
    full = np.flatnonzero(blocks.any(axis=1))
    for part in np.array_split(full, max(1, len(full) // 64)):
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in part], pa.binary())], ["block", "counts"])


def _merged(partials: pa.Table) -> pa.Table:
    """A block's counters over all tasks, as bits: whether two or more were counted."""
    total = np.zeros(BLOCK, np.uint8)
    for counts in partials.column("counts"):
        total = np.minimum(2, total + np.frombuffer(zlib.decompress(counts.as_py()), np.uint8))
    return pa.table({"block": partials.column("block").slice(0, 1), "bits": pa.array([np.packbits(total == 2).tobytes()], pa.binary())})


def sketch(rows: DataFrame, prefixes: int) -> tuple[int, bytes]:
    """(cells of a row, bits of all cells that count two prefixes or more): ROWS * MOST_CELLS / 8 bytes at most."""
    width = BLOCK
    while width < min(CELLS * prefixes, MOST_CELLS):
        width *= 2
    bits = bytearray(ROWS * width // 8)
    found = rows.mapInArrow(partial(_sketch, width), "block long, counts binary").groupBy("block").applyInArrow(_merged, "block long, bits binary")
    for r in found.toLocalIterator():
        bits[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = r["bits"]
    return width, bytes(bits)


def _single(keys: list[np.ndarray], width: int, bits: np.ndarray) -> np.ndarray:
    """Whether the sketch's estimate of each key, the least of its counters, is one."""
    least = np.zeros(len(keys[0]), bool)
    for cells in _cells(keys, width):
        least |= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 0
    return least


PREFIX = "c long, d long, k1 long, k2 long, p1 long, p2 long, w long, last boolean, single boolean, psingle boolean"


def _screened(width: int, sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a prefix, and one a conversation for the root; `single` where the sketch proves it, `psingle` one turn up."""
    bits = np.frombuffer(sent.value, np.uint8)
    for batch in batches:
        p = Prefixes(batch)
        ids, depths = batch.column("c").to_numpy(), batch.column("depth").to_numpy()
        top = np.flatnonzero(batch.column("d0").to_numpy() == 0)
        zero, n = np.zeros(len(top), np.int64), len(top)
        both = lambda a, b: pa.array(np.concatenate([a, b]))
        up = [pa.array(np.concatenate([zero, k.view(np.int64)]), mask=np.concatenate([np.ones(n, bool), np.zeros(len(k), bool)])) for k in p.up]
        above = _single(p.up, width, bits) & (p.depth > 1)  # the root is never single
        cols = [both(ids[top], ids[p.row]), both(zero, p.depth), both(zero, p.keys[0].view(np.int64)), both(zero, p.keys[1].view(np.int64)), *up, both(zero, p.words.astype(np.int64)), both(depths[top] == 0, p.depth == depths[p.row]), both(np.zeros(n, bool), _single(p.keys, width, bits)), both(np.zeros(n, bool), above)]
        yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PREFIX.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's id lists, joined: rows come sorted by key and block, and a key may go on in the next batch."""
    key, sha, done = None, None, []
    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) != key:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])
            done = []
    if key:
        done.append((*key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])


def _later(rows: DataFrame, deepest: int) -> DataFrame:
    """`rows` of (c, d, y, leaf, ...) with y and leaf summed over the conversation's rows at this depth and deeper.

    Long conversations are summed by spans of depths, and spans by a table of one row each.
    """
    spans = deepest >> SEGMENT_BITS
    if spans:
        rows = written(rows, "paths")
    span = F.shiftright("d", SEGMENT_BITS) if spans else F.lit(0).cast("long")
    w = Window.partitionBy("c", "b").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("b", span).withColumns({"y": F.sum("y").over(w), "leaf": F.sum("leaf").over(w)})
    if not spans:
        return out.drop("b")
    after = Window.partitionBy("c").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("c", span.alias("b")).agg(F.sum("y").alias("ys"), F.sum("leaf").alias("leaves"))
    carry = sums.select("c", "b", F.sum("ys").over(after).alias("ys"), F.sum("leaves").over(after).alias("leaves")).where("ys is not null")
    joined = out.join(carry, ["c", "b"], "left")
    return joined.withColumns({"y": F.col("y") + F.coalesce("ys", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("leaves", F.lit(0))}).drop("b", "ys", "leaves")


def trie(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The nodes of the prefix trie of `paths`: a row for each distinct sequence of first turns, the empty one included.

    `conv_id` (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes below, itself
    included), saved_tokens (words that need not be read again below: members less one, times the words of the last
    turn), ends_sha256 (of the ids of the members that end here, ascending). Prefixes are told apart by 128 bits. No conversation gives no row.

    Hot nodes are counted by aggregates with map-side partial results. What a node sums over its subtree is summed along
    conversations: a node's share goes to its smallest member's row, found by (conversation, depth), and each node adds up
    the suffix sums of its members. Children meet crowded parents by a broadcast of at most MOST_CROWDS rows, others by a shuffle.
    The sketch grows with the prefixes up to ROWS * MOST_CELLS cells; beyond that fewer prefixes are proved single and more
    are shuffled, with the same result.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = written(_carried(rows), "paths")
    prefixes, deepest = rows.agg(F.coalesce(F.sum(F.size("a")), F.lit(0)), F.coalesce(F.max("depth"), F.lit(0))).first()
    width, bits = sketch(rows, prefixes)
    every = written(rows.mapInArrow(partial(_screened, width, spark.sparkContext.broadcast(bits)), PREFIX), "prefixes")
    shared, single = every.where("not single"), every.where("single")
    grouped = shared.groupBy("k1", "k2").agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.col("last").cast("long")).alias("ends"), F.max("w").alias("w"), F.max("d").alias("d"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("psingle").alias("psingle"))
    nodes = written(grouped, "nodes")

    own = nodes.select(F.col("rep").alias("c"), "d", ((F.col("n") - 1) * F.col("w")).alias("y"), (F.col("ends") == F.col("n")).alias("childless"))
    walked = shared.select("c", "d", "k1", "k2", "last").join(own, ["c", "d"], "left")
    walked = walked.select("c", "d", "k1", "k2", F.coalesce("y", F.lit(0)).cast("long").alias("y"), (F.col("last") & F.coalesce("childless", F.lit(False))).cast("long").alias("leaf"))
    tips = single.where("last").select("c", "d", *[F.lit(None).cast("long").alias(k) for k in ("k1", "k2")], F.lit(0).cast("long").alias("y"), F.lit(1).cast("long").alias("leaf"))
    below = _later(walked.union(tips), deepest).where("k1 is not null").groupBy("k1", "k2").agg(F.sum("y").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    # a single node of a parent that is not is the first of a tail
    asking = nodes.where("d > 0 and not psingle").select("p1", "p2").union(single.where("not psingle").select("p1", "p2"))
    children = written(asking.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")), "children")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent"))
    asked = children.agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    crowd = max(CROWD, asked // MOST_CROWDS)
    crowded = F.broadcast(children.where(F.col("n_children") > crowd).select("p1", "p2").join(parents, ["p1", "p2"]))

    def with_parent(df: DataFrame) -> DataFrame:
        quiet = df.join(crowded.select("p1", "p2"), ["p1", "p2"], "left_anti").join(parents, ["p1", "p2"], "left")
        return df.join(crowded, ["p1", "p2"]).unionByName(quiet)

    blocks = shared.where("last").groupBy("k1", "k2", F.shiftright("c", SEGMENT_BITS).alias("b")).agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    ends = blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "b").select("k1", "k2", "ids").mapInArrow(_joined, "k1 long, k2 long, ends_sha256 string")

    nothing = F.sha2(F.lit("").cast("binary"), 256)
    named = with_parent(nodes.where("d > 0 and not psingle")).unionByName(nodes.where("d = 0 or psingle").withColumn("parent", F.when(F.col("d") > 0, F.col("rep"))))
    kin = children.withColumnsRenamed({"p1": "k1", "p2": "k2"})
    inner = named.join(below, ["k1", "k2"], "left").join(kin, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    inner = inner.select(F.col("rep").alias(id_col), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), zero("n_children"), zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

    tails = single.where("psingle").withColumn("parent", F.col("c")).unionByName(with_parent(single.where("not psingle")))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    outer = tails.select(F.col("c").alias(id_col), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"))
    return inner.unionByName(outer)


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`trie` of the conversations as they are."""
    return trie(paths(segments(conversations, id_col, turn_col, role_col, text_col)), id_col)


def shared_head_trie(conversations: DataFrame, every: int = 20, most: int = 4, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`trie` of conversations that begin with the first crc32(id) mod `most` turns of the conversation c - c % `every`."""
    segs = segments(conversations, id_col, turn_col, role_col, text_col)
    c = F.col("c")
    return trie(with_heads(segs, c - c % every, F.crc32(c.cast("string").cast("binary")) % most, max(1, most - 1)), id_col)
