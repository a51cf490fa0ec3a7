"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.llm.common import as_binary, dropped, keyed, lean, written
from cleanframe.llm.components import components, stars

#: Shingles whose bits are unpacked at once: bounds a task's memory for texts of any length.
CHUNK = 1 << 15
#: Bits of a segment at least: shorter ones fill unevenly. A key looked up costs as much as KEY_COST comparisons.
NARROW, KEY_COST = 21, 50
#: Ids of rows to drop are broadcast up to so many (8 MB); beyond that they are joined by shuffle. Tables that Spark may size
#: too low are never broadcast beyond so many rows.
BROADCAST_IDS = 1_000_000
#: Texts of more bytes in all are not broadcast either: some are a twentieth of that as files.
BROADCAST_BYTES = 64 << 20
#: Shingles that come last in prefixes: the most frequent of every SAMPLE-th text, so many at most.
SAMPLE, FREQUENT = 16, 100_000
#: Sets of fewer shingles have no verdict by fingerprint: their bits are too few votes to follow the angle.
FEW = 64
#: Shingles found so often in the sample are hot: their buckets are never shuffled.
HOT = 2_000
#: Bits of 64 within which near copies are looked up by fingerprint.
RADIUS = 4
#: Rows and shingles of a block within which all pairs are looked at.
BLOCK, BLOCK_TOKENS = 512, 1 << 18


def shingles(text: bytes, ngram: int) -> list[bytes]:
    """Word n-grams of the text with A-Z lower-cased, repeats included; fewer words: the whole sequence."""
    words = text.lower().split()
    if len(words) <= ngram:
        return [b" ".join(words)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined = b" ".join(words)
    return list(map(joined.__getitem__, map(slice, starts[: len(words) - ngram + 1].tolist(), ends[ngram - 1 :].tolist())))


def simhash_bits(terms: list[bytes], longs: int) -> np.ndarray:
    """The fingerprint as `longs` uint64: a bit is 1 where it is set in over half of the terms' hashes.

    One long: XXH64 with seed 42. More: XXH3 of 128 bits with seeds 42, 43, ... for each two longs.
    """
    votes = np.zeros(64 * longs, np.int64)
    for i in range(0, len(terms), CHUNK):
        part = terms[i : i + CHUNK]
        if longs == 1:
            h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), part), np.uint64, len(part)).view(np.uint8).reshape(len(part), 8)
        else:
            h = np.concatenate([np.frombuffer(b"".join(map(partial(xxhash.xxh3_128_digest, seed=42 + s), part)), np.uint8).reshape(len(part), 16) for s in range(longs // 2)], axis=1)
        votes += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(terms), bitorder="little").view(np.uint64)


def _sketch(ngram: int, longs: int, once: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [shingles(b, ngram) for b in batch.column("_b").to_pylist()]
        out = [simhash_bits(list(set(t)) if once else t, longs).view(np.int64).tolist() for t in terms]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(out, pa.list_(pa.int64()))], ["_k", "_f"])


def sketches(rows: DataFrame, ngram: int, longs: int, once: bool = False) -> DataFrame:
    """`_k, _f array<long>` for every row of `_k, _text`; texts without a word have zeros.

    A shingle votes at every occurrence, or `once` a text: then the angle is that of the shingle sets."""
    return as_binary(rows).mapInArrow(partial(_sketch, ngram, longs, once), "_k long, _f array<long>")


def segments_for(radius: int, n: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of the segments of 64 bits, at least NARROW wide, whose search costs least at n fingerprints.

    With m segments and radius = m * a + b, a pair within the radius is within a on one of the first b + 1
    segments or within a - 1 on one of the others, so the search loses no pair at any m. Wider segments have
    larger balls, so more keys a fingerprint; narrower ones have fuller buckets, so more comparisons a key.
    """

    def cut(m: int) -> list[tuple[int, int, int]]:
        a, b = divmod(radius, m)
        cuts = [64 * i // m for i in range(m + 1)]
        return [(cuts[i], cuts[i + 1] - cuts[i], a if i <= b else a - 1) for i in range(m) if i <= b or a >= 1]

    def cost(segments: list[tuple[int, int, int]]) -> float:
        return sum(sum(comb(width, i) for i in range(within + 1)) * (KEY_COST + n / 2**width) for _, width, within in segments)

    return min((cut(m) for m in range(1, min(64 // NARROW, radius + 1) + 1)), key=cost)


def ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def differing(f: Column, g: Column, longs: int) -> Column:
    return sum((F.bit_count(f[j].bitwiseXOR(g[j])) for j in range(longs)), F.lit(0))


def _segment(s: int, at: int, width: int) -> Column:
    v = F.shiftrightunsigned(F.col("f"), at)
    return v if width == 64 else v.bitwiseAND(F.lit((1 << width) - 1))


def _stored(segments: list[tuple[int, int, int]], rows: DataFrame) -> DataFrame:
    """A row a segment, `_key` being its exact value."""
    return rows.select("*", F.explode(F.array(*[F.xxhash64(F.lit(s), _segment(s, at, w)) for s, (at, w, _) in enumerate(segments)])).alias("_key"))


def _unless_many(df: DataFrame) -> DataFrame:
    """`df`, made by `written`, for a join that sorts and merges beyond BROADCAST_IDS rows.

    Spark goes by the compressed files, of which it takes a share by types: of a binary beside it an id gets too little."""
    return df if df.count() <= BROADCAST_IDS else df.hint("merge")


def _asked(segments: list[tuple[int, int, int]], rows: DataFrame) -> DataFrame:
    """A row for each value of each segment's Hamming ball, as `_key`, for a join that sorts and merges.

    Spark sizes them as if there were one a row, and would broadcast 45 times its bound."""

    def around(s: int, at: int, width: int, within: int) -> Column:
        masks = ", ".join(f"{m - (1 << 64) if m >= 1 << 63 else m}L" for m in ball(width, within))
        return F.transform(F.expr(f"array({masks})"), lambda m: F.xxhash64(F.lit(s), _segment(s, at, width).bitwiseXOR(m)))

    return rows.select("*", F.explode(F.concat(*[around(s, *x) for s, x in enumerate(segments)])).alias("_key")).hint("merge")


def leading_pairs(marks: DataFrame, radius: int, segments: list[tuple[int, int, int]]) -> DataFrame:
    """`u, v`: pairs of `marks(u long, f long)` at most `radius` bits apart, each look-up meeting the smallest mark of its bucket."""
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius
    least = _stored(segments, marks).groupBy("_key").agg(F.min("u").alias("v"), F.min_by("f", "u").alias("g"))
    return _asked(segments, marks).join(least, "_key").where((F.col("u") != F.col("v")) & near).select("u", "v").distinct()


def joining_links(marks: DataFrame, radius: int, segments: list[tuple[int, int, int]]) -> DataFrame:
    """`u, v`: links that make the same groups as all pairs of `marks(u long, f long)` at most `radius` bits apart.

    Every mark is stored once a segment (shift, width, segment radius) under the exact segment value, and looked up
    under each value of the segment's Hamming ball; complete distances are verified in the joins. First a look-up
    meets the smallest mark of its bucket alone. Then look-ups meet marks of groups that are not joined by then:
    members of a bucket's largest group meet only the rest, and the rest meets all, so that a group, however large,
    is not held against itself. A look-up that is too far from the bits all members share, as chance meetings are, does not
    leave the join. Of two groups that meet, one link between their roots leaves.
    """

    stored, asked = partial(_stored, segments), partial(_asked, segments)
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius
    first = written(leading_pairs(marks, radius, segments), "first")
    roots = components(first)
    groups = written(marks.join(roots, F.col("u") == F.col("node"), "left").select("f", F.coalesce("root", "u").alias("r")), "groups")
    sizes = stored(groups).groupBy("_key", "r").agg(F.count(F.lit(1)).alias("c"), F.bit_and("f").alias("ones"), F.bit_or("f").alias("any"))
    tops = sizes.groupBy("_key").agg(F.max_by(F.struct("r", "ones", "any"), "c").alias("t"))
    tops = written(tops.select("_key", F.col("t.r").alias("top"), F.col("t.ones").alias("ones"), F.col("t.any").alias("any")), "tops")
    # merged, for what Spark sizes exploded rows and files of like rows at is too low to broadcast them
    members = stored(groups).hint("merge").join(tops.select("_key", "top"), "_key").select("_key", F.col("f").alias("g"), F.col("r").alias("s"), "top").hint("merge")
    # bits that all members of the largest group share: one as far from them is near no member, one alone is measured whole
    apart = F.bit_count(F.col("f").bitwiseXOR(F.col("ones")).bitwiseAND(F.bitwise_not(F.col("ones").bitwiseXOR(F.col("any")))))
    pair = (F.least("r", "s").alias("u"), F.greatest("r", "s").alias("v"))
    rest = asked(groups).join(members.where("s <> top"), "_key").where((F.col("r") != F.col("s")) & near)
    rest = written(rest.select(*pair).distinct(), "rest")
    # written before the next join, so that Spark can split the skewed keys of both
    strangers = written(asked(groups).join(tops, "_key").where((F.col("r") != F.col("top")) & (apart <= radius)).select("_key", "f", "r"), "strangers")
    most = written(strangers.join(members.where("s = top"), "_key").where(near).select(*pair).distinct(), "most")
    dropped(groups, tops, strangers)
    # a star for each group of the first step: the caller's search for components starts from it
    return stars(roots).union(rest).union(most)


def fingerprint_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, radius: int = 4) -> DataFrame:
    """`id, fingerprint, component_id`: SimHash of 64 bits and the groups that links of `radius` bits make.

    Equal fingerprints are one node, so copies cost one row however many they are; nodes are named by the
    smallest id, and the component's id is the smallest id reachable. Null or blank texts have the fingerprint
    zero and link like any other. Rows with null or repeated ids are separate rows, ordered by `keyed`.
    """
    rows, plain = keyed(df, id_col, text_col)
    marks = written(sketches(rows, ngram, 1), "sketches")
    nodes = written(marks.groupBy(F.col("_f")[0].alias("f")).agg(F.min("_k").alias("u")), "nodes")
    roots = components(joining_links(nodes, radius, segments_for(radius, nodes.count())))
    named = nodes.join(roots, nodes["u"] == roots["node"], "left").select("f", F.coalesce("root", "u").alias("_c"))
    # copies' fingerprints take next to nothing in files
    out = _unless_many(marks).join(named, F.col("_f")[0] == F.col("f"))
    hexed = F.lpad(F.lower(F.hex(F.col("_f")[0])), 16, "0").alias("fingerprint")
    if plain:
        return out.select(F.col("_k").alias(id_col), hexed, F.col("_c").alias("component_id"))
    ids = rows.select("_k", "_id")
    smallest = ids.select(F.col("_k").alias("_c"), F.col("_id").alias("component_id"))
    return out.join(ids, "_k").join(smallest, "_c").select(F.col("_id").alias(id_col), hexed, "component_id")


@lean
def _jaccard(ngram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        like = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            s, t = set(shingles(a, ngram)), set(shingles(b, ngram))
            like.append(len(s & t) / max(1, len(s | t)))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(like, pa.float64())], ["u", "v", "like"])


def _hashes(text: bytes, ngram: int) -> np.ndarray:
    """Sorted XXH3 hashes of 64 bits of the text's shingle set."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(t) for t in set(shingles(text, ngram))], np.uint64)).view(np.int64)


@lean
def _set_of(ngram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array([_hashes(b, ngram) for b in batch.column("_b").to_pylist()], pa.list_(pa.int64()))], ["k", "h"])


def _sampled(ngram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.column("_b").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(b, ngram))], ["t"])


def _frequent(texts: DataFrame, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, counts) of the shingles most frequent in every SAMPLE-th text.

    They only say which shingles come last in a prefix: any order finds all pairs, this one keeps buckets small.
    """
    part = texts.where(F.pmod(F.xxhash64(F.lit(3), "_k"), F.lit(SAMPLE)) == 0)
    counts = as_binary(part).mapInArrow(partial(_sampled, ngram), "t long").groupBy("t").agg(F.count("*").alias("c")).where("c > 2")
    got = counts.orderBy(F.desc("c"), "t").limit(FREQUENT).toPandas().sort_values("t")
    return got["t"].to_numpy(np.int64), got["c"].to_numpy(np.int64)


@lean
def _marked(ngram: int, longs: int, similarity: float, often: tuple[np.ndarray, np.ndarray], much: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, counts = often
    for batch in batches:
        f, size, same, prefix, hot = [], [], [], [], []
        for b in batch.column("_b").to_pylist():
            h = _hashes(b, ngram)
            rank = np.zeros(len(h), np.int64)
            if len(known) and len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, counts[at], 0)
            least = int(np.ceil(similarity * len(h) - 1e-9))
            first = np.lexsort((h, rank))[: len(h) - least + 1] if len(h) else np.zeros(0, np.int64)
            prefix.append(h[first[rank[first] < much]])
            hot.append(h[first[rank[first] >= much]])
            f.append(simhash_bits(list(set(shingles(b, ngram))), longs).view(np.int64).tolist())
            size.append(len(h))
            same.append(xxhash.xxh3_128_digest(h.tobytes()))
        longs_of = lambda x: pa.array(x, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("_k"), longs_of(f), pa.array(size, pa.int32()), pa.array(same, pa.binary()), longs_of(prefix), longs_of(hot)], ["_k", "_f", "_n", "_set", "_prefix", "_hot"])


MARKS = "_k long, _f array<long>, _n int, _set binary, _prefix array<long>, _hot array<long>"


def _buckets(tokens: DataFrame) -> DataFrame:
    """`t, a, u`: the members of each bucket of two or more, with its first one; one shuffle, of what is not hot.

    `tokens` are `u, cold array<long>, hot array<long>`. Hot shingles, of which there are FREQUENT at most, are not
    shuffled: their first members are aggregated, partly in each task, and broadcast.
    """
    whole = Window.partitionBy("t")
    cold = tokens.select("u", F.explode("cold").alias("t")).select("t", F.min("u").over(whole).alias("a"), "u", F.count(F.lit(1)).over(whole).alias("c")).where("c > 1")
    hot = tokens.select("u", F.explode("hot").alias("t"))
    first = hot.groupBy("t").agg(F.min("u").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "a")
    return cold.select("t", "a", "u").union(hot.join(F.broadcast(first), "t").select("t", "a", "u"))


def _spanning(similarity: float, pdf: pd.DataFrame) -> pd.DataFrame:
    """`u, v`: links that join the near copies of a block, of pairs whose left row is marked `probe`.

    Rows of one root count as joined before; a block's rows and shingles are bounded by the caller.
    """
    k, n = pdf["k"].to_numpy(), pdf["h"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(k)), n)
    _, token = np.unique(np.concatenate(list(pdf["h"])), return_inverse=True)
    order = np.argsort(token, kind="stable")
    doc, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(token))))
    edge = np.concatenate(([0], np.cumsum(n)))
    root = {r: r for r in pdf["r"].tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    own, links, left = pdf["r"].tolist(), [], len(root)
    for i in np.flatnonzero(pdf["probe"].to_numpy()).tolist():
        if left == 1:
            break
        mine = token[edge[i] : edge[i + 1]]
        count = begin[mine + 1] - begin[mine]
        at = np.arange(int(count.sum())) + np.repeat(begin[mine] - (np.cumsum(count) - count), count)
        both = np.bincount(doc[at], minlength=len(k))
        for j in np.flatnonzero(both >= similarity * (n[i] + n - both) - 1e-9).tolist():
            x, y = find(own[i]), find(own[j])
            if x != y:
                root[x] = y
                left -= 1
                links.append((int(k[i]), int(k[j])))
    return pd.DataFrame(links, columns=["u", "v"]).astype("int64")


def _inside(members: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """`u, v`: links that join all near copies within each home, of `members(k, home, n, h)`; `first` are links found before.

    Homes are dealt into blocks of about BLOCK rows and BLOCK_TOKENS shingles. Two rounds hold the rows of a block
    against each other, dealt anew each time. Then the rows that are not of their home's largest group, few by now,
    are held against all blocks: so every pair of different groups is looked at, none is emitted but spanning links.
    """
    sizes = members.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    members = written(members.join(sizes, "home"), "members")
    most = members.agg(F.max("blocks")).first()[0] or 0
    found, rounds = first, 1 if most <= 1 else 2

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        return _spanning(similarity, block)

    none = F.lit(None).cast("long")
    for i in range(rounds + (most > 1)):
        roots = components(found)
        placed = members.join(roots, F.col("k") == F.col("node"), "left").select("k", "home", "h", "blocks", F.coalesce("root", "k").alias("r"))
        ends = placed.groupBy("home").agg(F.min("r").alias("x"), F.max("r").alias("y")).where("x <> y").select("home")
        placed = placed.join(ends, "home", "left_semi").withColumn("b", F.pmod(F.xxhash64(F.lit(i), "k"), F.col("blocks")))
        if i < rounds:
            groups = placed.select("k", "home", "h", "r", "b", none.alias("p"), F.lit(True).alias("probe"))
        else:
            placed = written(placed.where("blocks > 1"), "placed")
            counts = placed.groupBy("home", "r").agg(F.count(F.lit(1)).alias("c"))
            top = counts.groupBy("home").agg(F.max_by("r", "c").alias("top"))
            rest = placed.join(top, "home").where("r <> top").drop("top")
            parts = rest.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
            asked = rest.join(parts, "home").withColumn("p", F.pmod(F.xxhash64(F.lit(-1), "k"), F.col("parts")))
            targets = placed.join(parts, "home").select("k", "home", "h", "r", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), F.lit(False).alias("probe"))
            groups = asked.select("k", "home", "h", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), "p", F.lit(True).alias("probe")).union(targets)
        more = groups.groupBy("home", "b", "p").applyInPandas(compare, "u long, v long")
        found = written(stars(roots).union(more), "found")
    dropped(members)
    return found


def _groups(rows: DataFrame, ngram: int, similarity: float, longs: int) -> DataFrame:
    """`_k, _c`: the group of each row of `_k, _text`; see `near_duplicates`."""
    bits = 64 * longs
    share = acos(2 * similarity / (1 + similarity)) / pi
    deviation = sqrt(bits * share * (1 - share))
    far = int(bits * share + 6 * deviation)
    texts = rows.select("_k", F.coalesce("_text", F.lit("")).alias("_text"))
    marks = written(as_binary(texts).mapInArrow(partial(_marked, ngram, longs, similarity, _frequent(texts, ngram), HOT), MARKS), "sketches")
    nodes = written(marks.groupBy("_set").agg(F.min("_k").alias("u")), "nodes")
    firsts = _unless_many(nodes).select(F.col("u").alias("_k"))
    tokens = marks.join(firsts, "_k", "left_semi").select(F.col("_k").alias("u"), F.col("_prefix").alias("cold"), F.col("_hot").alias("hot"))
    shared = written(_buckets(tokens), "shared")
    mark = lambda c, f, n: marks.select(F.col("_k").alias(c), F.col("_f").alias(f), F.col("_n").alias(n))
    d, small = differing(F.col("f"), F.col("g"), longs), F.least("m", "n") < FEW
    alike = F.least("m", "n") >= F.greatest("m", "n") * F.lit(similarity - 1e-9)
    maybe = alike & (small | (d <= far))
    binary = texts.select("_k", F.col("_text").cast("binary").alias("_b"))

    def real(pairs: DataFrame) -> DataFrame:
        """Those of the pairs `u, v` whose whole texts are near copies."""
        seen = written(pairs.select("u", "v"), "pairs")
        wanted = seen.select(F.col("u").alias("_k")).union(seen.select(F.col("v").alias("_k"))).distinct()
        if 2 * seen.count() <= BROADCAST_IDS:
            # few of all texts: those that aren't needed stay where they are
            wanted = F.broadcast(wanted)
        shown = written(binary.join(wanted, "_k", "left_semi"), "shown")
        long = (shown.agg(F.sum(F.octet_length("_b"))).first()[0] or 0) > BROADCAST_BYTES
        sides = shown.hint("merge") if long else shown
        both = seen.join(sides.select(F.col("_k").alias("u"), F.col("_b").alias("a")), "u").join(sides.select(F.col("_k").alias("v"), F.col("_b").alias("b")), "v")
        held = both.select("u", "v", "a", "b").mapInArrow(partial(_jaccard, ngram), "u long, v long, like double").where(F.col("like") >= similarity)
        out = written(held.select("u", "v"), "near")
        dropped(seen, shown)
        return out

    # by SimHash: fingerprints of 64 bits, equal or found by multi-index hashing, their texts verified whole
    prints = marks.join(firsts, "_k", "left_semi").select(F.col("_k").alias("u"), F.col("_f")[0].alias("f"))
    heads = written(prints.groupBy("f").agg(F.min("u").alias("u")), "heads")
    equal = prints.join(heads.select("f", F.col("u").alias("v")), "f").where("u <> v").select("u", "v")
    close = leading_pairs(heads, RADIUS, segments_for(RADIUS, heads.count())).union(equal)
    hashed = real(close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    dropped(heads)
    # the exact search goes on to what is farther apart; every member of a bucket against its first: a row each, however
    # large a group of copies is
    led = shared.where("u <> a").select(F.col("a").alias("u"), F.col("u").alias("v")).distinct()
    led = written(led.join(mark("u", "f", "m"), "u").join(mark("v", "g", "n"), "v").where(maybe).select("u", "v", (d <= far).alias("about")), "led")
    first = hashed.union(real(led.join(hashed, ["u", "v"], "left_anti")))
    # the rows that are about alike one first member, their home, against each other
    near_home = led.where("about").groupBy(F.col("v").alias("k")).agg(F.min("u").alias("home"))
    further = near_home.select(F.col("k").alias("home"), F.col("home").alias("_further"))
    settled = near_home.join(further, "home", "left").select("k", F.coalesce("_further", "home").alias("home"))
    own = settled.select(F.col("home").alias("k")).distinct().join(near_home, "k", "left_anti").select("k", F.col("k").alias("home"))
    homes = written(settled.union(own), "homes")
    several = homes.groupBy("home").agg(F.count(F.lit(1)).alias("c")).where("c > 2").select("home")
    members = homes.join(several, "home", "left_semi")
    sets = binary.join(members.select(F.col("k").alias("_k")), "_k", "left_semi").mapInArrow(partial(_set_of, ngram), "k long, h array<long>")
    inner = _inside(members.join(sets, "k").withColumn("n", F.size("h")), first, similarity)
    # what is left: pairs of a bucket that are of different homes and of different groups by now
    roots = components(inner)
    named = homes.select(F.col("k").alias("_k"), "home").join(roots, F.col("_k") == F.col("node"), "full").select(F.coalesce("_k", "node").alias("_k"), F.coalesce("home", "_k", "node").alias("home"), F.coalesce("root", "_k").alias("r"))
    placed = shared.join(named, F.col("u") == F.col("_k"), "left").select("t", "u", F.coalesce("home", "u").alias("o"), F.coalesce("r", "u").alias("r"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("t").agg(F.min("r").alias("x"), F.max("r").alias("y"), F.min("o").alias("z"), F.max("o").alias("w"), F.count(F.lit(1)).alias("c")).where("x <> y and z <> w and c > 2").select("t")
    open_ = written(placed.join(mixed, "t", "left_semi").join(mark("u", "f", "m"), "u"), "open")
    # merged: fingerprints that repeat in each bucket are many times their files' size when read
    other = open_.select("t", F.col("u").alias("v"), F.col("r").alias("s"), F.col("o").alias("q"), F.col("f").alias("g"), F.col("m").alias("n")).hint("merge")
    met = open_.join(other, (open_["t"] == other["t"]) & (F.col("u") < F.col("v")) & (F.col("r") != F.col("s")) & (F.col("o") != F.col("q")) & maybe)
    met = met.select("u", "v").distinct().join(led.select("u", "v"), ["u", "v"], "left_anti")
    linked = stars(roots).union(real(met))
    dropped(shared, placed, open_)
    named = nodes.join(components(linked), F.col("u") == F.col("node"), "left").select("_set", F.coalesce("root", "u").alias("_c"))
    return marks.select("_k", "_set").join(named, "_set").select("_k", "_c")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similarity: float = 0.8, longs: int = 4) -> DataFrame:
    """`id, group_id`: rows in groups of near copies (Jaccard of word n-grams >= similarity); alone: own id.

    1. Texts of equal shingle sets are one node, so exact copies cost one row however many they are. SimHash fingerprints
    of 64 bits at most RADIUS apart are found by multi-index hashing and verified on whole texts. 2. For those farther apart: two sets
    of that similarity share a shingle among the first (1 - similarity) of each, in any order that is the same
    for all; rare shingles come first. So texts that meet in a shingle of these prefixes are all the candidates:
    no pair is lost. 3. The members of a bucket are held against its first one. Those about alike it make it their
    home: within a home, blocks of bounded size are held against each other on whole shingle sets, and only links
    that join groups leave a block. Then members of different homes and groups that still share a bucket meet.
    4. Fingerprints of 64 * longs bits, a vote a distinct shingle, estimate the angle: pairs six standard deviations
    beyond that of `similarity` are none, all others and small texts are verified on whole texts. 5. Groups are the connected components, named by their smallest id. Null and blank
    texts are copies of each other.
    """
    rows, plain = keyed(df, id_col, text_col)
    out = _groups(rows, ngram, similarity, longs)
    if plain:
        return out.select(F.col("_k").alias(id_col), F.col("_c").alias("group_id"))
    ids = rows.select("_k", "_id")
    return out.join(ids, "_k").join(ids.select(F.col("_k").alias("_c"), F.col("_id").alias("group_id")), "_c").select(F.col("_id").alias(id_col), "group_id")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similarity: float = 0.8, longs: int = 4) -> DataFrame:
    """The rows of `df`, all columns, less the near copies: of each group of `near_duplicates`, the first row stays.

    Where ids repeat or are null, rows are found again by id and a digest of the text, and one of the rows that
    share both stays.
    """
    rows, plain = keyed(df, id_col, text_col)
    gone = written(_groups(rows, ngram, similarity, longs).where("_k <> _c").select("_k"), "gone")
    if plain:
        drop = gone.select(F.col("_k").alias("__cleanframe_key"))
        base = df.withColumn("__cleanframe_key", F.col(f"`{id_col}`").cast("long"))
    else:
        mark = lambda i, t: F.sha2(F.to_json(F.struct(i.cast("string").alias("i"), t.cast("string").alias("t"))).cast("binary"), 256)
        own = rows.withColumn("__cleanframe_key", mark(F.col("_id"), F.col("_text")))
        stay = own.join(gone, "_k", "left_anti").select("__cleanframe_key").distinct()
        base = df.withColumn("__cleanframe_key", mark(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))).dropDuplicates(["__cleanframe_key"])
        return base.join(stay, "__cleanframe_key", "left_semi").select(*[f"`{c}`" for c in df.columns])
    if gone.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    return base.join(drop, "__cleanframe_key", "left_anti").select(*[f"`{c}`" for c in df.columns])
