from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from cleanframe.llm import audit, bytebpe, trie

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def vocabulary():
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    texts = ["", " ", "a", "  \n\n x", "don't 'll " * 3, "x" * 700, " " * 900 + "a", "".join(rng.choice("abcdefgh") for _ in range(1500)), "\x1c\x85\xa0 x", "é" * 600, "<|endoftext|>", "͸ Ᲊa \U00010d40\U00010d4a \U000323b0", "word " * 3000]
    for _ in range(120):
        pick = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.choice([9, 10, 13, 32, 32]), rng.randrange(0x4E00, 0x4F00), rng.randrange(0xE000, 0x110000)])
        texts.append("".join(chr(pick()) for _ in range(rng.randrange(60))))
    return texts


def test_byte_bpe_as_the_library(spark, vocabulary):
    path, pattern, library = vocabulary
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "null id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS ids", "'x' AS _b")
    want = sorted(repr((k, library.encode_ordinary(t or ""))) for k, t in rows)
    coded = bytebpe.encoded(df, path, pattern)
    assert coded.columns == ["doc_id", "ids"] and sorted(repr((r.doc_id, r.ids)) for r in coded.collect()) == want
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.encode_digests(df, path, pattern).collect())
    assert got == Counter((k, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for k, t in rows for ids in [library.encode_ordinary(t or "")])
    back = bytebpe.decoded(coded.where("doc_id < 900"), path, pattern)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((k, t) for k, t in rows if k is not None and k < 900)
    none = bytebpe.decoded(spark.createDataFrame([("a", None), ("b", [])], "doc_id string, ids array<int>"), path, pattern)
    assert sorted(tuple(r) for r in none.collect()) == [("a", None), ("b", "")]
    assert bytebpe.encoded(df.where("doc_id > 9000"), path, pattern).collect() == []


def test_byte_bpe_long_words_and_small_memory(vocabulary, monkeypatch):
    path, pattern, library = vocabulary
    coder = bytebpe.Coder(path, pattern)
    monkeypatch.setattr(bytebpe, "KEPT", 50)
    monkeypatch.setattr(bytebpe, "WORDS", 7)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeü") for _ in range(rng.randrange(1, 14))) for _ in range(30)) for _ in range(20)] + ["ab" * 20_000, "".join(rng.choice("abc") for _ in range(30_000))]
    for t in texts:
        assert coder.encode([t, t]) == [",".join(map(str, library.encode_ordinary(t)))] * 2
    word = b"abcabcabdd" * 20
    assert bytebpe.contract(word, coder.ranks) == list(map(int, coder.encode([word.decode()])[0].split(",")))
    # texts of the fast pattern, all its code points
    rng.shuffle(plain := [chr(i) for i in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]] * 3)
    for i in range(0, len(plain), 50):
        assert not bytebpe.WIDE.search(t := "".join(plain[i : i + 50]))
        assert coder.narrow.findall(t) == coder.pattern.findall(t) and coder.encode([t]) == [",".join(map(str, library.encode_ordinary(t)))]
    assert bytebpe.narrow(r"\p{Lu}+|\s") is None and bytebpe.narrow(r"\w+") is None and bytebpe.narrow(r"[\S]") is None
    # the newest letters of the pattern's library
    odd = "".join(chr(i) for i in range(0x370, 0x32400, 7) if not 0xD800 <= i < 0xE000)
    assert coder.encode([odd]) == [",".join(map(str, library.encode_ordinary(odd)))]


def rebuilt(rows, every, most):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    if not every:
        return turns
    h = {c: zlib.crc32(str(c).encode()) % most for c in turns}
    return {c: turns.get(c - int(math.fmod(c, every)), [])[: h[c]] + v[h[c] :] for c, v in turns.items()}


def naive_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(cs) - 1) * len(SPACE.findall(k[-1][1])) if k else 0
    return sorted((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, cs in members.items())


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=lambda x: tuple(-1 if v is None else v for v in x))


def conversations():
    rng = random.Random(9)
    rows = []
    for c in [*range(60), 140, 5000, -7, 9000]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn * 3, rng.choice(["user", "bot", None]) if turn % 3 else "user", rng.choice([None, "", "hello there", "a b  c\n"])))
    rows += [(c, t, "user", f"same turn {t}") for c in range(20_000, 20_040) for t in range(12)]  # copies
    rows += [(77, t, "user", "long talk" if t % 2 else "again") for t in range(40)] + [(97, t, "user", "long talk" if t % 2 else "again") for t in range(39)]
    return [*rows, (None, 1, "user", "nobody")]


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("case", ["plain", "heads", "short segments", "full sketch", "crowds"])
def test_trie(spark, monkeypatch, case):
    rows = conversations()
    df = spark.createDataFrame(rows, CONVERSATION).selectExpr("*", "1 AS c", "2 AS part", "'x' AS d")
    if case == "short segments":
        monkeypatch.setattr(trie, "SEGMENT_BITS", 2)
    if case == "full sketch":
        monkeypatch.setattr(trie, "sketch", lambda rows, n: (trie.BLOCK, b"\xff" * (trie.ROWS * trie.BLOCK // 8)))
    if case == "crowds":
        monkeypatch.setattr(trie, "CROWD", 1)
    got = trie.prefix_trie(df) if case == "plain" else trie.shared_head_trie(df, every=20, most=4)
    want = naive_trie(rebuilt(rows, 0 if case == "plain" else 20, 4))
    assert found(got) == sorted(want, key=lambda x: tuple(-1 if v is None else v for v in x))


def test_trie_of_nothing_and_of_ties(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATION)).collect() == []
    # rows that share a turn number go by hash: the same order in every conversation
    tied = [(c, 1, "user", t) for c in (1, 2) for t in (("x", "y", "y", "z") if c == 1 else ("z", "y", "x", "y"))]
    got = found(trie.prefix_trie(spark.createDataFrame(tied, CONVERSATION)))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, d, 2) for d in range(5)]
    very_long = [(1, 0, "user", "w " * 300_000), (2, 0, "user", "w " * 300_000), (2, 1, None, None)]
    got = found(trie.prefix_trie(spark.createDataFrame(very_long, CONVERSATION)))
    assert got == sorted(naive_trie(rebuilt(very_long, 0, 4)), key=lambda x: tuple(-1 if v is None else v for v in x))


def naive_counts(t):
    ws = SPACE.findall(t)
    return len(ws), len(set(ws)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))


def naive_audit(rows, labels):
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, x in labels if x == 1}
    docs = defaultdict(list)
    for k, t, lang in rows:
        w, u, cap, n, sym = naive_counts(t or "")
        fails = (w < 100, 100 * u < 80 * w, 100 * cap > 10 * n, sym > 0, k is not None and first[t or ""] < k)
        docs[lang or ""].append(({f for f, x in zip("ABCDE", fails, strict=True) if x}, k is not None and k in good, k is not None and k in toxic))
    out = []
    for part, ds in docs.items():
        removed = {(o, i): [x for x in ds if o[i] in x[0] and not x[0] & set(o[:i])] for o in permutations("ABCDE") for i in range(5)}
        total = Counter()
        for (o, i), xs in removed.items():
            total[o[i]] += len(xs)
        for (o, i), xs in removed.items():
            out.append((part, "".join(o), i + 1, sum(not x[0] & set(o[: i + 1]) for x in ds), len(xs), sum(o[i] in x[0] and bool(x[0] & set(o[:i])) for x in ds), sum(x[0] == {o[i]} for x in ds), sum(x[1] for x in xs), sum(x[2] for x in xs), total[o[i]]))
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "é", "日本", "x|y", "50%", "delta", *(f"w{i}" for i in range(150))]
    texts = [None, "", " \t", "A", "A" * 20, *(rng.choice([" ", "\n", " \x0b "]).join(rng.choice(words[: rng.choice([8, 158])]) for _ in range(rng.randrange(1, 200))) for _ in range(60))]
    texts += rng.choices(texts, k=40) + ["w" * 100_000 + " " + "w" * 100_000, " ".join(map(str, range(30_000))), "\U0001f600 " * 120 + "\U0001f600\U0001f600"]
    rows = [(i * 3 % 101, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)] + [(None, "", "en"), (None, "A", "en"), (7, "again", "fr"), (7, "again", "fr"), (8, "again", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 101, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS mask", "'q' AS part", "1 AS quality")
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS id", "'y' AS text"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == naive_audit(rows, labels)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs.where("doc_id > 5000"), none).collect() == []
    assert {r.good_lost for r in audit.filter_audit(docs, none).collect()} == {0}
    plain = audit.text_measures(docs, ["doc_id"]).collect()
    assert Counter((r["_0"], r.words, r.distinct, r.capitals, r.points, r.symbols) for r in plain) == Counter((k, *naive_counts(t or "")) for k, t, _ in rows)


def test_words_of_one_hash_are_compared(monkeypatch):
    texts = [t.encode() for t in ("a b a c " + "long" * 30 + " " + "long" * 30 + " " + "long" * 29 + "lonG", "a a", "")]
    want = {"words": [7, 2, 0], "distinct": [5, 1, 0], "capitals": [1, 0, 0], "points": [len(texts[0]), 3, 0], "symbols": [0, 0, 0]}
    assert {k: v.tolist() for k, v in audit.text_counts(texts).items()} == want
    monkeypatch.setattr(audit, "_hashes", lambda data, start, end, owner: np.zeros(len(start), np.uint64))
    assert {k: v.tolist() for k, v in audit.text_counts(texts).items()} == want


def test_transducer_in_lanes(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "Z", " ", "é", "日", "\U0001f600", "#", "\n"]) for _ in range(5000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = None
    for lane in (1 << 20, 512, 7, 1):
        monkeypatch.setattr(audit, "LANE", lane)
        out = audit.transduce(data)
        assert whole is None or (out == whole).all()
        whole = out
