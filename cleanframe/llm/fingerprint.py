"""Document fingerprints: SimHash votes and permuted block tables, in DataFrame functions alone."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.llm.common import ascii_lower, keyed, words_of, written

#: Two bits' votes share a long: bit i counts in the low half, bit i + 32 in the high half (2**31 terms at most).
PAIR = 0x0000000100000001
#: Rows of one window bucket of `with_next`.
BUCKET_ROWS = 2000


def _terms(text: Column, ngram: int) -> tuple[Column, Column]:
    """(the text's words, for `_w`; array of structs w0..w{n-1}: n-grams of `_w`; fewer words: one term with nulls)."""
    w = words_of(ascii_lower(F.coalesce(text, F.lit(""))))
    shifted = [F.slice(F.col("_w"), i + 1, F.greatest(F.size("_w") - i, F.lit(0))).alias(f"w{i}") for i in range(ngram)]
    return w, F.slice(F.arrays_zip(*shifted), 1, F.when(F.size("_w") == 0, 0).otherwise(F.greatest(F.size("_w") - ngram + 1, F.lit(1))))


def _packed(h: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR))).alias(f"{h}_{i}") for i in range(32)]


def _word(h: str, n: Column) -> Column:
    """The long whose bit is 1 where over half of the n votes are."""
    out = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}_{i}", 32)
        for votes, bit in ((low, i), (high, i + 32)):
            mask = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(votes * 2 > n, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def simhash(texts: DataFrame, keys: list[str], text: str, ngram: int = 5, longs: int = 2) -> DataFrame:
    """`keys..., _f array<long>`: SimHash of `text` over its lower-cased word n-grams, by 64 * longs bits.

    Each term's hash votes +1 or -1 on every bit, once for every occurrence, so a term weighs its count. Terms
    are exploded and summed per document before the shuffle: one document's terms are in one task, so a row
    for each document is all that moves, however long it is. Documents without a word are absent.
    """
    words, terms = _terms(F.col(text), ngram)
    each = texts.select(*keys, words.alias("_w")).select(*keys, F.inline(terms))
    cols = [f"w{i}" for i in range(ngram)]
    hashes = [F.xxhash64(*([F.lit(j)] if j else []), *cols).alias(f"h{j}") for j in range(longs)]
    votes = each.select(*keys, *hashes).groupBy(*keys).agg(F.count("*").alias("_n"), *[c for j in range(longs) for c in _packed(f"h{j}")])
    return votes.select(*keys, F.array(*[_word(f"h{j}", F.col("_n")) for j in range(longs)]).alias("_f"))


def hex_of(f: Column, longs: int) -> Column:
    """16 lowercase hex digits for each long; null fingerprint: all zero."""
    return F.coalesce(F.concat(*[F.lpad(F.lower(F.hex(f[j])), 16, "0") for j in range(longs)]), F.lit("0" * 16 * longs))


def distance(f: Column, g: Column, longs: int) -> Column:
    return sum((F.bit_count(f[j].bitwiseXOR(g[j])) for j in range(longs)), F.lit(0))


def likeness(bits: Column, longs: int) -> Column:
    """The cosine that the share of differing bits estimates: 1 for equal fingerprints, 0 for unrelated ones."""
    return F.greatest(F.lit(0.0), F.cos(bits * F.lit(3.141592653589793) / (64 * longs)))


def with_next(rows: DataFrame) -> DataFrame:
    """`_k, _text, _next_k, _next`: each row of `_k, _text` and the row after it by descending `_k`.

    Rows go to range buckets of about BUCKET_ROWS by exact split points; the largest row of a bucket is also
    dealt to the bucket above, as the follower of its smallest row (the lowest bucket gets the largest of all).
    So no window spans more than a bucket, and texts are shuffled once.
    """
    n = rows.count()
    buckets = max(1, n // BUCKET_ROWS)
    cuts = rows.agg(F.percentile_approx("_k", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 20 * buckets)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if blocks:
        longs = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})")
        tops = longs([b[-1] for b in blocks])
        coarse = F.size(F.filter(tops, lambda x: x < F.col("_k")))
        fine = F.get(F.array(*map(longs, blocks)), F.col("_c"))
        bucket = F.col("_c") * step + F.coalesce(F.size(F.filter(fine, lambda x: x < F.col("_k"))), F.lit(0))
        placed = rows.withColumn("_c", coarse).withColumn("_bucket", F.when(F.col("_c") == len(blocks), len(cuts)).otherwise(bucket)).drop("_c")
    else:
        placed = rows.withColumn("_bucket", F.lit(0))
    # A bucket's largest key: a table of one row a bucket.
    largest = [(r["_bucket"], r["m"]) for r in placed.groupBy("_bucket").agg(F.max("_k").alias("m")).orderBy("_bucket").collect()]
    # the largest of each bucket follows in the bucket above; the largest of all follows the smallest row
    above = [(m, largest[(i + 1) % len(largest)][0]) for i, (_, m) in enumerate(largest)]
    spark = rows.sparkSession
    carry = F.broadcast(spark.createDataFrame(above, "_k long, _above int"))
    spot = lambda b, extra: F.struct(F.col(b).cast("int").alias("b"), F.lit(extra).alias("extra"))
    spots = F.when(F.col("_above").isNull(), F.array(spot("_bucket", False))).otherwise(F.array(spot("_bucket", False), spot("_above", True)))
    dealt = placed.join(carry, "_k", "left").select("_k", "_text", F.inline(spots).alias("_bucket", "_extra"))
    w = Window.partitionBy("_bucket").orderBy("_extra", F.col("_k").desc())
    led = dealt.select("_k", "_text", "_extra", F.lead("_k").over(w).alias("_next_k"), F.lead("_text").over(w).alias("_next"))
    return led.where(~F.col("_extra")).drop("_extra")


def edited(rows: DataFrame) -> DataFrame:
    """`_k, _next_k, _n_chars, _text, _edited`: the last floor(n/2) code points give way to the next text's first."""
    text, after = F.coalesce("_text", F.lit("")), F.coalesce("_next", F.lit(""))
    n = F.length(text).cast("long")
    half = F.floor(n / 2).cast("int")
    return rows.select("_k", "_next_k", n.alias("_n_chars"), text.alias("_text"), F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(after, F.lit(1), half)).alias("_edited"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, longs: int = 2) -> DataFrame:
    """One row per row of `df`: id and `fingerprint`, 16 * longs hex digits.

    Null and blank texts have the fingerprint of all zeros. Equal texts have equal fingerprints; repeated
    rows give a row each. Words are lower-cased (A-Z), a text of fewer words than `ngram` is one term.
    """
    rows, _ = keyed(df, id_col, text_col)
    marks = simhash(rows, ["_k"], "_text", ngram, longs)
    return rows.select("_k", "_id").join(marks, "_k", "left").select(F.col("_id").alias(id_col), hex_of(F.col("_f"), longs).alias("fingerprint"))


def near_fingerprints(marks: DataFrame, radius: int = 3, blocks: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Links of all fingerprints (`id_col, fingerprint` in hex) within `radius` differing bits.

    Returns `(fingerprint_a, fingerprint_b, distance, id_a, id_b)` between different fingerprints, by their
    smallest ids; membership of equal ones is the input itself. The bits are cut into `blocks` blocks; a pair
    within the radius agrees on at least blocks - radius of them, so there is a table for each choice of those,
    keyed by the blocks put in front, and every pair meets in one: the search is exact. Null ids count, null
    fingerprints are left out; an empty table gives no row.
    """
    first = marks.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min(id_col).alias("_id"))
    first = written(first, "marks")
    got = first.agg(F.max(F.length("fingerprint"))).first()[0] or 16
    blocks = blocks or radius + 3
    cuts = [round(got * i / blocks) for i in range(blocks + 1)]
    piece = [F.substring("fingerprint", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
    tables = [F.xxhash64(F.lit(t), *[piece[i] for i in choice]) for t, choice in enumerate(combinations(range(blocks), blocks - radius))]
    keyed_rows = first.select(F.col("_id"), "fingerprint", F.explode(F.array(*tables)).alias("_key"))
    a = keyed_rows.select("_key", F.col("_id").alias("id_a"), F.col("fingerprint").alias("fingerprint_a"))
    b = keyed_rows.select("_key", F.col("_id").alias("id_b"), F.col("fingerprint").alias("fingerprint_b"))
    bits = sum((F.bit_count(F.conv(F.substring("fingerprint_a", i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("fingerprint_b", i + 1, 8), 16, 10).cast("long"))) for i in range(0, got, 8)), F.lit(0))
    near = a.join(b, (a["_key"] == b["_key"]) & (F.col("fingerprint_a") < F.col("fingerprint_b")) & (bits <= radius))
    return near.select("fingerprint_a", "fingerprint_b", bits.alias("distance"), "id_a", "id_b").distinct()


def fingerprint_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, longs: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text ends in the first half of the next text, by descending id (after the last, the first).
    A table of one row is its own next; null texts are empty; rows with null or repeated ids are ordered by
    `keyed`. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    the differing bits as bits_edited, bits_next.
    """
    rows, plain = keyed(df, id_col, text_col)
    both = edited(with_next(rows.select("_k", "_text")))
    two = both.select("_k", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("t")))).alias("x")).select("_k", F.col("x.which").alias("_which"), F.col("x.t").alias("_t"))
    marks = written(simhash(two, ["_k", "_which"], "_t", ngram, longs), "marks")
    zero = F.array(*[F.lit(0).cast("long")] * longs)
    base = both.select("_k", "_next_k", "_n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("_sha"))
    own = marks.where("_which = 0").select("_k", F.col("_f").alias("_f0"))
    changed = marks.where("_which = 1").select("_k", F.col("_f").alias("_f1"))
    after = own.select(F.col("_k").alias("_next_k"), F.col("_f0").alias("_f2"))
    out = base.join(own, "_k", "left").join(changed, "_k", "left").join(after, "_next_k", "left")
    if not plain:
        out = out.join(rows.select("_k", "_id"), "_k")
    f = {i: F.coalesce(f"_f{i}", zero) for i in range(3)}
    bits = {i: distance(f[0], f[i], longs) for i in (1, 2)}
    return out.select(
        (F.col("_k") if plain else F.col("_id")).alias(id_col),
        F.col("_n_chars").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        hex_of(f[0], longs).alias("fingerprint"),
        hex_of(f[1], longs).alias("edited_fingerprint"),
        likeness(bits[1], longs).alias("near_edited"),
        likeness(bits[2], longs).alias("near_next"),
        bits[1].alias("bits_edited"),
        bits[2].alias("bits_next"),
    )
