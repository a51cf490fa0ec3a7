"""Byte-level BPE: encoding by recursive DuckDB queries over token-position rows, decoding by ordered aggregation.

Spark deals the texts out; each task cuts them by the pattern, and DuckDB contracts the distinct words that the task
hasn't met yet, some thousands in one recursion.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.llm.common import ship

#: Bytes of text worked on at once, and words of one recursion.
PART, WORDS = 2 << 20, 5_000
#: Distinct words whose ids a task keeps; when there are more it starts anew.
KEPT = 600_000
#: Bytes of a word up to which the recursion contracts it: its steps and rows both grow with the word.
LONG = 512

#: Letters and numbers that Unicode 16 added, as the pattern's library counts them and Python's tables (15.1) don't.
SINCE = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]

#: Every way to cut a token into two tokens; the lower rank of a pair is the id of what it makes.
MERGES = """
CREATE TABLE merges AS
SELECT l.id::BIGINT << 32 | r.id AS pair, c.id AS merged
FROM (SELECT id, hex, unnest(range(2, length(hex), 2)) AS cut FROM vocab) c
JOIN vocab l ON l.hex = c.hex[:c.cut] JOIN vocab r ON r.hex = c.hex[c.cut + 1:]"""

#: start(w, place, token): the bytes of the words as tokens, with a gap in the places before the next word. A step joins
#: each token to the one after it and the pair to the merges, takes each word's least (rank, place), puts the merged
#: token there and leaves out the one after it. Words without a pair to merge come out done and take no further step.
ENCODE = """
WITH RECURSIVE step(w, place, past, token, done) AS (
  SELECT w, place, place + 1, token, false FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT l.w, l.place, l.past, l.token, r.past AS past_both, m.merged
     FROM (FROM step WHERE NOT done) l LEFT JOIN step r ON r.place = l.past LEFT JOIN merges m ON m.pair = (l.token::BIGINT << 32 | r.token)),
   least AS (
     SELECT w, min(merged::BIGINT << 32 | place) AS least, arg_min(past, merged::BIGINT << 32 | place) AS gone FROM pairs GROUP BY w)
   SELECT p.w, p.place, CASE WHEN p.place = least & 4294967295 THEN p.past_both ELSE p.past END,
          CASE WHEN p.place = least & 4294967295 THEN p.merged ELSE p.token END, least IS NULL
   FROM pairs p JOIN least USING (w) WHERE least IS NULL OR p.place <> gone))
SELECT w, string_agg(token::VARCHAR, ',' ORDER BY place) AS ids FROM step WHERE done GROUP BY w"""

DECODE = "SELECT d, unhex(array_to_string(list(hex ORDER BY place), '')) AS b FROM tokens JOIN vocab USING (id) GROUP BY d"


#: Letters, numbers and white space among the code points up to U+024F, as parts of a class; what else such a text may hold
#: are the dashes, quotes and signs of U+2010 to U+205E, which are none of them (but for U+2028, U+2029 and U+202F).
NARROW = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "s": "\t-\r \x85\xa0"}
WIDE = re.compile("[^\0-\u024f\u2010-\u2027\u2030-\u205e]")


def narrow(pattern: str) -> re.Pattern | None:
    """The pattern for `re`, several times as fast, on texts in which WIDE finds nothing: its classes spelt out. None where the
    pattern has others."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{[^}]*\}|\\.|\[\^?|\]|[^\\\[\]]+", pattern, re.S):
        name = part[3:-1] if part.startswith("\\p{") else "s" if part == "\\s" else None
        if name in NARROW:
            out.append(NARROW[name] if inside else f"[{NARROW[name]}]")
        elif part == "\\S" and not inside:
            out.append(f"[^{NARROW['s']}]")
        elif re.match(r"\\[a-zA-Z]|\(\?[a-zA-Z]", part):
            return None
        else:
            inside = part.startswith("[") or inside and part != "]"
            out.append(part)
    try:
        return re.compile("".join(out))
    except re.error:
        return None


@lru_cache(1)
def _newer() -> regex.Pattern:
    """Code points that `regex` may take for letters or numbers but Unicode 16 has not."""
    since = {i for a, b in SINCE for i in range(a, b + 1)}
    spare = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and i not in since and unicodedata.category(chr(i)) == "Cn")
    runs, last = [], -2
    for i in map(ord, "".join(regex.findall(r"[\p{L}\p{N}]+", spare))):
        if i != last + 1:
            runs.append([i, i])
        last = runs[-1][1] = i
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]" if runs else r"(?!)")


def _is_narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not WIDE.search(text)
    return True


class Coder:
    """A vocabulary in DuckDB, and the ids of the words met so far as decimal text."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern, self.narrow, self.known = regex.compile(pattern), narrow(pattern), {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        # nothing goes to disk: what a query holds is bounded by PART, WORDS and LONG
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.duck.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())}))
        self.duck.execute("CREATE TABLE vocab AS SELECT id, hex(bytes) AS hex FROM given")
        self.duck.unregister("given")
        self.duck.execute(MERGES)

    def cut(self, text: str) -> list[str]:
        """The pattern's matches; letters newer than its Unicode version count as other signs."""
        if self.narrow and _is_narrow(text):
            return self.narrow.findall(text)
        if not _newer().search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_newer().sub("\x01", text))]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of new words into `known`."""
        rest, long = [], []
        for word in words:
            b = word.encode()
            if b in self.ranks:
                self.known[word] = str(self.ranks[b])
            else:
                (long if len(b) > LONG else rest).append((word, b))
        rest.sort(key=lambda x: len(x[1]))
        for a in range(0, len(rest), WORDS):
            part = rest[a : a + WORDS]
            flat = np.frombuffer(b"".join(b for _, b in part), np.uint8)
            w = np.repeat(np.arange(len(part), dtype=np.int32), [len(b) for _, b in part])
            self.duck.register("start", pa.table({"w": w, "place": np.arange(len(flat), dtype=np.int64) + w, "token": self.byte_ids[flat]}))
            for w, ids in self.duck.execute(ENCODE).fetchall():
                self.known[part[w][0]] = ids
        for word, b in long:
            self.known[word] = ",".join(map(str, contract(b, self.ranks)))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, as decimal text joined by commas."""
        cut = [self.cut(t) for t in texts]
        fresh = set().union(*cut)
        if len(self.known) + len(fresh) > KEPT:
            self.known.clear()
        self.learn(fresh.difference(self.known))
        return [",".join(map(self.known.__getitem__, ws)) for ws in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids."""
        sizes = [len(x) for x in ids]
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        self.duck.register("tokens", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "place": np.arange(len(flat), dtype=np.int32), "id": flat.astype(np.int32)}))
        found = dict(self.duck.execute(DECODE).fetchall())
        return [found.get(i, b"") for i in range(len(ids))]


def contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long word: the same contraction with a heap of pairs and links to both neighbours."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n):
        pair(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not alive[i] or end[i] != j or j >= n or end[j] != k:
            continue
        alive[j], end[i] = False, k
        if k < n:
            before[k] = i
        pair(i)
        if before[i] >= 0:
            pair(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about PART bytes."""
    since = total = 0
    for i, n in enumerate(sizes):
        if i > since and total + n > PART:
            yield slice(since, i)
            since, total = i, 0
        total += n
    if since < len(sizes):
        yield slice(since, len(sizes))


def _numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)


def _encode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = coder(path, pattern)
    for batch in batches:
        texts = batch.column("_b").to_pylist()
        for part in _parts(list(map(len, texts))):
            ids = own.encode([t.decode("utf-8", "replace") for t in texts[part]])
            keys = batch.column("_id")[part.start : part.stop]
            yield pa.RecordBatch.from_arrays([keys, pa.array([_numbers(x).astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["_id", "ids"])


def _digests(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, sha = coder(path, pattern), lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        texts = batch.column("_b").to_pylist()
        for part in _parts(list(map(len, texts))):
            ids = own.encode([t.decode("utf-8", "replace") for t in texts[part]])
            numbers = list(map(_numbers, ids))
            back = own.decode(numbers)
            cols = [batch.column("_id")[part.start : part.stop], pa.array(list(map(len, numbers)), pa.int64()), pa.array([sha(x.encode()) for x in ids]), pa.array(list(map(sha, back)))]
            yield pa.RecordBatch.from_arrays(cols, ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _decode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = coder(path, pattern)
    for batch in batches:
        ids = batch.column("_ids").to_pylist()
        for part in _parts([0 if x is None else 4 * len(x) for x in ids]):
            found = own.decode([np.array(x or [], np.int64) for x in ids[part]])
            texts = [None if x is None else b.decode("utf-8", "replace") for x, b in zip(ids[part], found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id")[part.start : part.stop], pa.array(texts, pa.string())], ["_id", "text"])


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(`_id, _b`, the id's type): only the named columns are read, so that extra ones can't clash."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_b")), df.schema[id_col].dataType.simpleString()


def encoded(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, ids array<int>`: the tokens of each whole text, each match of `pattern` separately, without special tokens.

    `vocabulary` is a file of base64 tokens and ranks that every node holds. A match that is a token is that token; in
    others the leftmost pair of least rank is contracted until none is left. Matches of more than LONG bytes are
    contracted by the same rule with a heap, as the recursion's rows grow with a word's square. Null and empty texts
    have no token; bytes that are no UTF-8 are read as replacement characters. A row for each row, whatever its id.
    """
    rows, kind = _rows(df, id_col, text_col)
    return rows.mapInArrow(partial(_encode, vocabulary, pattern), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def encode_digests(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_tokens, ids_sha256, decoded_sha256` of `encoded`: of the decimal ids joined by commas, and of the bytes that
    those ids decode to."""
    rows, kind = _rows(df, id_col, text_col)
    return rows.mapInArrow(partial(_digests, vocabulary, pattern), f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def decoded(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id, text`: what the ids of each row stand for, in order; null ids give null, ids of no token nothing. Bytes that
    are no UTF-8 become replacement characters."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").cast(T.ArrayType(T.IntegerType())).alias("_ids"))
    return rows.mapInArrow(partial(_decode, vocabulary, pattern), f"_id {df.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)
