"""Subword segmentation: best and sampled segmentations over the piece lattice, and decoding.

The lattice of a text is a chain of the lattices of its chunks: no piece spans a blank's left edge or a line
break, so chunks are independent given the text. All chunks of some megabytes of text are worked on at once in numpy.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import as_binary, keyed, lean, ship

BLANK = "▁"
#: Stands for a blank sign that is in the text itself; no UTF-8 text holds it.
OWN_BLANK = "\ud800"
CHUNK = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: Bytes of text whose chunks are worked on at once.
PART = 1 << 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1
#: Cumulative probabilities and draws lie on this grid (draws between its points): a probability below it is never drawn
#: by chance, but is reached where all likelier ways are drawn already.
GRID = 2.0**-30
#: Slots, as a power of two, of the table in which pieces are looked up.
TABLE_BITS = 19
#: Distinct chunks whose lattices a task keeps.
KEPT = 40_000
#: Characters of a chunk that is looked over for further cuts.
LONG = 256
#: Cells (character, piece length) of lattices built at once.
CELLS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64: a counter-based random number for each uint64."""
    x = x + MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, index: np.ndarray) -> np.ndarray:
    """In (0, 1), by row seed and place in the row: the same for any split into batches and tasks."""
    return ((mixed(seeds ^ mixed(index.astype(np.uint64))) >> np.uint64(34)).astype(np.float64) + 0.5) * GRID


class Vocabulary:
    """Pieces with log weights, and look-up of all pieces in many strings at once.

    A piece of rank r in the model's order weighs 1 / (r + 10), as word frequencies go; characters without a
    piece have one arc, their UTF-8 bytes.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        back = {v: k for k, v in self.byte_id.items()}
        self.spelling = [bytes([back[i]]) if i in back else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelled = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.spelled_at = np.cumsum([0, *map(len, self.spelling)])
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        bad = [self.pieces[i] for i in normal if BLANK in self.pieces[i].lstrip(BLANK) or ("\n" in self.pieces[i] and len(self.pieces[i]) > 1)]
        if bad:
            raise ValueError(f"pieces across chunks: {bad[:3]}")
        score = np.array([model.get_score(i) for i in normal])
        if (score == np.round(score)).all():
            # merge ranks instead of probabilities
            rank = np.where(score > -1e8, -score, normal)
            total = np.log(np.sum(1 / (rank + 10)))
            logp, self.unknown = -np.log(rank + 10) - total, float(-np.log(n + 10) - total)
        else:
            logp, self.unknown = score, float(score.min() - 10)
        # entry 0 is none; entries of one slot are chained
        self.key = np.array([0, *[self.hash(self.pieces[i]) for i in normal]], np.uint64)
        self.id = np.array([0, *normal], np.int32)
        self.logp = np.concatenate(([-np.inf], logp))
        self.table = np.zeros(1 << TABLE_BITS, np.int32)
        self.chain = np.zeros(len(self.key), np.int32)
        for e, at in enumerate(self.slot(self.key[1:]).tolist(), 1):
            self.chain[e], self.table[at] = self.table[at], e
        # which slots have the beginning of a piece: a string that has none begins no longer piece either
        self.begins = np.zeros(1 << TABLE_BITS, bool)
        self.begins[self.slot(np.array([self.hash(b) for b in {self.pieces[i][:j] for i in normal for j in range(1, len(self.pieces[i]) + 1)}], np.uint64))] = True
        self.ascii = np.array([self.byte_id.get(b, 0) for b in range(128)])
        self.lengths = set(map(len, map(self.pieces.__getitem__, normal)))
        self.pairs = {p[j : j + 2] for p in map(self.pieces.__getitem__, normal) for j in range(len(p) - 1)}
        self.longest = max(self.lengths)

    def entry(self, h: np.ndarray) -> np.ndarray:
        """The entries of hashes, 0 for none."""
        flat = h.ravel()
        e = self.table[self.slot(flat)]
        wrong = np.flatnonzero(e)
        while len(wrong := wrong[self.key[e[wrong]] != flat[wrong]]):
            e[wrong] = self.chain[e[wrong]]
            wrong = wrong[e[wrong] > 0]
        return e.reshape(h.shape)

    def cut(self, words: list[str]) -> list[str]:
        """The chunks, those over LONG characters cut wherever no piece holds both neighbours: no way crosses that."""
        if not words or max(map(len, words)) <= LONG:
            return words
        out = []
        for w in words:
            at = [0, *([j for j in range(1, len(w)) if w[j - 1 : j + 1] not in self.pairs] if len(w) > LONG else []), len(w)]
            out += [w[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * MULTIPLIER) >> np.uint64(64 - TABLE_BITS)

    @staticmethod
    def hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(MULTIPLIER) + ord(c) + 1) & MASK
        return h

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of piece ids: bytes join to characters, blanks become spaces, the first space goes."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.pieces)):
            raise IndexError("a piece id is out of range")
        begin = self.spelled_at[ids]
        size = self.spelled_at[ids + 1] - begin
        at = np.repeat(begin - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        text = self.spelled[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


@lru_cache(1)
def lattice_of(model_file: str, alpha: float) -> Lattice:
    """A worker's lattice: its tasks, one at a time, share the chunks met. No result depends on them."""
    return Lattice(vocabulary(model_file), alpha)


def chunks(text: str) -> list[str]:
    return CHUNK.findall(BLANK + text.replace(BLANK, OWN_BLANK).replace(" ", BLANK)) if text else []


def _spaced(text: str) -> str:
    """The chunks of a text without blank signs, joined by spaces, which no chunk holds."""
    if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text:
        return " ".join(chunks(text))
    return (BLANK + text.replace(" ", " " + BLANK)).replace("\n", " \n ").replace("  ", " ").rstrip(" ")


def distinct_chunks(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(chunks of each text; distinct chunks in order of appearance; which of them each chunk is)."""
    if not any(BLANK in t for t in texts):
        spaced = [*map(_spaced, texts)]
        joined = " ".join(filter(None, spaced))
        coded = pc.split_pattern(pa.array([joined] if joined else [], pa.large_string()), " ").flatten().dictionary_encode()
        if (pc.max(pc.utf8_length(coded.dictionary)).as_py() or 0) <= LONG:
            return np.array([x.count(" ") + 1 if x else 0 for x in spaced], np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    each, number = [vocab.cut(chunks(t)) for t in texts], Numbers()
    size = np.fromiter(map(len, each), np.int64, len(each))
    index = np.fromiter(map(number.__getitem__, chain.from_iterable(each)), np.int64, int(size.sum()))
    return size, list(number), index


class Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Lattice:
    """The piece lattices of distinct chunks: arcs sorted by (chunk, end), with their conditional probability.

    A node is a place in a chunk; `first[c] + j` is the node after j characters. Walking back from a chunk's
    last node by the arcs' probabilities samples a segmentation exactly; a node's likeliest arc comes first.
    Chunks are added as they are met; of more than KEPT the most used stay: text repeats its frequent words.
    """

    def __init__(self, vocab: Vocabulary, alpha: float) -> None:
        self.vocab, self.smooth = vocab, alpha
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.spelled: dict[int, list[int]] = {}
        self.nodes, self.used = 0, np.zeros(0, np.int64)
        self.first, self.last, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.start, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.q, self.cum, self.rest, self.leave = np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0)
        self.main_begin, self.main_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def numbers(self, words: list[list[str]]) -> np.ndarray:
        """The numbers of all chunks, adding those that are new."""
        every = list(chain.from_iterable(words))
        return self.numbered(every, np.arange(len(every)))

    def numbered(self, words: list[str], index: np.ndarray) -> np.ndarray:
        """The numbers of the chunks words[index], adding those of `words` that are new."""
        if len(self.number) > KEPT:
            self._forget()
        known = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[index]
        if len(self.number) > known:
            self._add(list(islice(reversed(self.number), len(self.number) - known))[::-1])
        used = np.bincount(out, minlength=len(self.number))
        used[:known] += self.used
        self.used = used
        return out

    def _forget(self) -> None:
        """Keeps the half of KEPT chunks that were used most."""
        keep = np.sort(np.argpartition(-self.used, KEPT // 2)[: KEPT // 2])
        size = self.last[keep] - self.first[keep] + 1
        shift = np.cumsum(size) - size - self.first[keep]
        node = np.arange(int(size.sum())) - np.repeat(shift, size)
        degree = np.diff(self.begin)[node]
        begin = np.cumsum(degree) - degree
        arc = np.arange(int(degree.sum())) + np.repeat(self.begin[node] - begin, degree)
        self.start = (self.start[arc] + np.repeat(np.repeat(shift, size), degree)).astype(np.int32)
        self.piece, self.q, self.cum = self.piece[arc], self.q[arc], self.cum[arc]
        self.rest, self.leave, self.begin = self.rest[node], self.leave[keep], np.concatenate((begin, [len(arc)]))
        length = np.diff(self.main_begin)[keep]
        place = np.cumsum(length) - length
        self.main_ids = self.main_ids[np.arange(int(length.sum())) + np.repeat(self.main_begin[keep] - place, length)]
        self.main_begin = np.concatenate((place, [int(length.sum())]))
        self.first, self.last, self.nodes, self.used = self.first[keep] + shift, self.last[keep] + shift, len(node), self.used[keep]
        words = list(self.number)
        self.number = Numbers(zip(map(words.__getitem__, keep.tolist()), range(len(keep)), strict=True))

    def _add(self, words: list[str]) -> None:
        """Builds the lattices of new chunks: blocks of chunks, the longest first, a character a step for all."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        first, off, known = np.empty(len(words), np.int64), np.empty(len(words)), len(self.first)
        made, nodes, arcs = [], self.nodes, len(self.start)
        order = np.argsort(-size, kind="stable")
        block = (np.cumsum(size[order]) - 1) // max(1, CELLS // self.vocab.longest)
        for some in np.split(order, np.flatnonzero(np.diff(block)) + 1):
            degree, start, piece, q, cum, rest, off[some] = self._block([*map(words.__getitem__, some.tolist())], size[some])
            first[some] = nodes + np.cumsum(size[some] + 1) - size[some] - 1
            made.append((arcs + np.cumsum(degree), start + nodes, piece, q, cum, rest))
            nodes, arcs = nodes + len(degree), arcs + len(start)
        for name, x in zip(("begin", "start", "piece", "q", "cum", "rest"), zip(*made, strict=True), strict=True):
            self._grow(name, x)
        self.first, self.last, self.leave = np.concatenate((self.first, first)), np.concatenate((self.last, first + size)), np.concatenate((self.leave, off))
        self.nodes = nodes
        fresh = np.arange(known, len(self.first))
        who, step, arc = self._walk(self.last[fresh], fresh, None)
        _, path = _ordered(who, step, arc, len(words))
        who = np.sort(who)
        ids, owner = self.ids(_reversed(who, path), who)
        self.main_begin = np.concatenate((self.main_begin, self.main_begin[-1] + np.cumsum(np.bincount(owner, minlength=len(words)))))
        self._grow("main_ids", (ids,))

    def _grow(self, name: str, parts: tuple[np.ndarray, ...]) -> None:
        """Appends to an array, which is the front of a larger one while that has room."""
        old = getattr(self, name)
        n = len(old) + sum(map(len, parts))
        room = old.base if old.base is not None and len(old.base) >= n else None
        if room is None:
            room = np.empty(n + n // 4, old.dtype)
            room[: len(old)] = old
        at = len(old)
        for x in parts:
            room[at : at + len(x)] = x
            at += len(x)
        setattr(self, name, room[:n])

    def _block(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(arcs into each node; start node, piece, probability and cumulative probability of each arc; main path's
        probability from each node back, and that of all other ways of each chunk) of chunks, the longest first.

        Nodes and arcs are first laid out by step: step j has a node of each chunk of j characters or more, those first.
        """
        vocab, count = self.vocab, len(words)
        char = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chunk = np.repeat(np.arange(count), size)
        within = np.arange(len(char)) - np.repeat(np.cumsum(size) - size, size)
        left = size[chunk] - within
        edge = np.concatenate(([0], np.cumsum(np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="right"))))
        before, after = edge[within] + chunk, edge[within + 1] + chunk
        # all pieces, as (last character, length, entry); a character without a piece has an arc of its own
        code = char.astype(np.uint64) + np.uint64(1)
        found = [(np.arange(len(char)), 1, vocab.entry(code))]
        start, h = found[0][0], code
        for length in range(2, min(int(size[0]), vocab.longest) + 1):
            more = vocab.begins[vocab.slot(h)]
            more &= left[start] >= length
            start = start[more]
            if not len(start):
                break
            h = h[more] * MULTIPLIER + code[start + (length - 1)]
            if length in vocab.lengths:
                e = vocab.entry(h)
                some = np.flatnonzero(e)
                if len(some):
                    found.append((start[some] + (length - 1), length, e[some]))
        degree = np.zeros(int(edge[-1]), np.int64)
        ranks = []
        for last, _, _ in found:
            node = after[last]
            ranks.append(degree[node])
            degree[node] += 1
        begin = np.cumsum(degree) - degree
        arcs = int(degree.sum())
        entry, end, source = np.empty(arcs, np.int32), np.empty(arcs, np.int64), np.empty(arcs, np.int64)
        for (last, length, e), rank in zip(found, ranks, strict=True):
            at = begin[after[last]] + rank
            entry[at], end[at], source[at] = e, last, before[last - (length - 1)]
        x = vocab.logp[entry]
        x[entry == 0] = vocab.unknown
        x *= self.smooth
        owner = np.repeat(np.arange(len(degree)), degree)
        alpha, first, top = np.zeros(len(degree)), np.zeros(len(degree)), np.zeros(len(degree), np.int64)
        rest, leave = np.ones(len(degree)), np.zeros(len(degree))
        for m, n in zip(edge[1:].tolist(), edge[2:].tolist(), strict=False):
            a, b = int(begin[m]), int(begin[n]) if n < len(begin) else arcs
            y, own, lead = x[a:b], owner[a:b] - m, begin[m:n] - a
            y += alpha[source[a:b]]
            most = np.maximum.reduceat(y, lead)
            y -= most[own]
            # of equals the first, the shortest
            best = np.flatnonzero(y == 0)[::-1]
            lead[own[best]] = best
            np.exp(y, out=y)
            y[lead] = 0.0
            other = np.bincount(own, y, n - m)
            alpha[m:n] = most + np.log1p(other)
            sure = first[m:n] = 1 / (1 + other)
            y *= sure[own]
            top[m:n] = lead + a
            back = source[top[m:n]]
            rest[m:n] = sure * rest[back]
            leave[m:n] = other * sure + sure * leave[back]
        run = x.copy()
        node, r = np.flatnonzero(degree > 1), 1
        while len(node):
            at = begin[node] + r
            run[at] += run[at - 1]
            r += 1
            node = node[degree[node] > r]
        run += first[owner]
        some = np.flatnonzero(degree)
        x[top[some]] = run[top[some]] = first[some]
        # from steps to chunks, a node's likeliest arc first
        place = np.empty(len(degree), np.int64)
        place[:count] = np.cumsum(size + 1) - size - 1
        place[after] = np.arange(len(char)) + chunk + 1
        arcs_in, main = np.empty_like(degree), np.empty_like(rest)
        arcs_in[place], main[place] = degree, rest
        lead = (np.cumsum(arcs_in) - arcs_in)[place]
        to = np.arange(arcs) + (lead - begin)[owner]
        to += np.arange(arcs) < top[owner]
        to[top[some]] = lead[some]
        piece = vocab.id[entry].astype(np.int64)
        unknown = np.flatnonzero(entry == 0)
        c = char[end[unknown]].astype(np.int64)
        piece[unknown] = np.where(c < 128, vocab.ascii[np.minimum(c, 127)], -1 - c)
        for u in set(c[c >= 128].tolist()):
            self.spelled[-1 - u] = [vocab.byte_id[b] for b in (BLANK if u == ord(OWN_BLANK) else chr(u)).encode()]
        starts, pieces, q, cum = np.empty(arcs, np.int64), np.empty(arcs, np.int32), np.empty(arcs), np.empty(arcs)
        starts[to], pieces[to], q[to], cum[to] = place[source], piece, x, np.round(np.minimum(run, 1.0) / GRID) * GRID
        cum[(np.cumsum(arcs_in) - 1)[arcs_in > 0]] = 1.0
        return arcs_in, starts, pieces, q, cum, main, leave[edge[size] + np.arange(count)]

    def _walk(self, at: np.ndarray, chunk: np.ndarray, draw, off: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(walker, step, arc) of walks from nodes `at` back to their chunks' first nodes.

        `draw(walkers, step)` gives uniform numbers; without it all walks take the main path. With `off`, they must
        leave it: at a node still on it, the share of the draws that would stay to the end is left out.
        """
        who, steps, arcs = [], [], []
        live, node, step = np.arange(len(at)), at, 0
        home = self.first[chunk]
        keep = node > home
        live, node = live[keep], node[keep]
        on = np.full(len(live), off)
        while len(live):
            arc = self.begin[node]
            if draw is not None:
                u, top = draw(live, step), self.cum[arc]
                if off and on.any():
                    stay = self.rest[node]
                    x = np.where(on, stay + u * (1 - stay), u)
                    # where the rest of the path is sure, only another arc leaves it
                    u = np.where(on & (self.rest[self.start[arc]] > 1 - 2 * GRID), np.maximum(x, top), x)
                more = np.flatnonzero(u >= top)
                on[more] = False
                while len(more):
                    more = more[self.begin[node[more] + 1] - arc[more] > 1]
                    arc[more] += 1
                    more = more[u[more] >= self.cum[arc[more]]]
            who.append(live)
            steps.append(np.full(len(live), step))
            arcs.append(arc)
            node = self.start[arc]
            keep = node > home[live]
            live, node, on = live[keep], node[keep], on[keep]
            step += 1
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, steps, arcs))

    def ids(self, arcs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of arcs, and their owners; characters without a piece give an id for each byte."""
        p = self.piece[arcs]
        if (p < 0).any():
            count = np.array([1 if x >= 0 else len(self.spelled[x]) for x in p.tolist()])
            return np.array([i for x in p.tolist() for i in ([x] if x >= 0 else self.spelled[x])], np.int64), np.repeat(owner, count)
        return p, owner


def _ordered(owner: np.ndarray, step: np.ndarray, arc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, arc) by owner and step."""
    count = np.bincount(owner, minlength=n)
    offset = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(len(arc), np.int64)
    out[offset[owner] + step] = arc
    return np.repeat(np.arange(n), count), out


def _reversed(owner: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x with the run of each owner turned round: walks go from a chunk's end."""
    if not len(x):
        return x
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.concatenate((edge, [len(x)])))
    return x[np.repeat(2 * edge + count - 1, count) - np.arange(len(x))]


def _truncated(mu: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel of location mu (the largest of a set of that log mass), given that it is below `top`."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        g = mu - np.log(np.exp(mu - top) - np.log(u))
    return np.where(np.isneginf(mu), -np.inf, np.where(np.isnan(g) | (g > top), top, g))


class Sample:
    """A segmentation of each text of a part: chunks on their main path, but for those of `off` (sorted), whose
    arcs are listed in the walk's order; `logp` of each chunk; `g`: the values of the sets that leave it there."""

    def __init__(self, logp: np.ndarray, off: np.ndarray, owner: np.ndarray, arcs: np.ndarray) -> None:
        self.logp, self.off, self.owner, self.arcs = logp, off, owner, arcs
        self.g = self.prefix = np.zeros(0)
        self.gone: dict[int, list[tuple[int, ...]]] = {}

    def path(self, token: int) -> tuple[int, ...]:
        a, b = np.searchsorted(self.owner, (token, token + 1))
        return tuple(self.arcs[a:b].tolist())


class Sampler:
    """Gumbel top-k without replacement over the segmentations of several texts at once.

    A segmentation's perturbed value is its log probability plus a Gumbel; the k largest are k distinct samples.
    The search is A*: the set of all segmentations has its largest value drawn first; the sample that attains
    it is drawn from the lattice; the rest splits into the sets that agree with the sample up to some chunk
    and differ there, whose largest values are Gumbels of their log mass, truncated at the set's own. The best
    set is split next. What is left of a chunk's ways is summed from the ways themselves, never as one less the
    others, so that ways of any probability are reached and none is made up.
    """

    def __init__(self, lattice: Lattice, texts: list[str], seeds: list[int], k: int) -> None:
        self.n, words, index = distinct_chunks(lattice.vocab, texts)
        self.chunk = lattice.numbered(words, index)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.begin = np.concatenate(([0], np.cumsum(self.n)))
        self.place = np.arange(len(self.chunk)) - self.begin[self.doc]
        self.seed = mixed(np.array([s & MASK for s in seeds], np.uint64))
        self.k = k
        self.lattice = lattice
        if len(self.chunk):
            main = lattice.rest[lattice.last]
            with np.errstate(divide="ignore"):
                self.main = main[self.chunk]
                self.main_log = np.log(main)[self.chunk]
            self.leave = lattice.leave[self.chunk]

    def run(self) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text, its samples in the order drawn: (piece ids, log probability, perturbed value).

        A last value after the k-th, (None, nan, kappa), is the threshold that the samples beat; it is -inf
        where all segmentations were drawn.
        """
        docs = len(self.n)
        if not len(self.chunk):
            return [[(np.zeros(0, np.int64), 0.0, np.inf), (None, np.nan, -np.inf)] for _ in range(docs)]
        everyone = np.arange(docs)
        top = -np.log(-np.log(uniform(self.seed ^ np.uint64(1 << 40), everyone * 0)))
        samples = [self._sets(self._fresh(np.arange(len(self.chunk)), 0), top, self.begin[:-1], 0)]
        out = [[x] for x in self._emit(samples[0], everyone, top)]
        live = everyone
        for r in range(1, self.k + 1):
            best, pick = np.full(docs, -np.inf), np.full(docs, -1)
            for f, sample in enumerate(samples):
                most = np.full(docs, -np.inf)
                some = self.n > 0
                most[some] = np.maximum.reduceat(sample.g, self.begin[:-1][some])
                better = most > best
                best, pick = np.where(better, most, best), np.where(better, f, pick)
            for d in live[np.isneginf(best[live])].tolist():
                out[d].append((None, np.nan, -np.inf))
            live = live[~np.isneginf(best[live])]
            if r == self.k:
                for d in live.tolist():
                    out[d].append((None, np.nan, float(best[d])))
            elif len(live):
                samples.append(self._split(samples, pick, best, live, r))
                for d, x in zip(live.tolist(), self._emit(samples[-1], live, best), strict=True):
                    out[d].append(x)
        return out

    def _fresh(self, tokens: np.ndarray, round_: int) -> Sample:
        """Draws the chunks `tokens` anew; others keep the main path."""
        lat = self.lattice
        seed = self.seed[self.doc[tokens]] ^ np.uint64(2 * round_ + 1)
        leave = tokens[uniform(seed, self.place[tokens] << 14) >= self.main[tokens]]
        place, seed = (self.place[leave] << 14) + 1, self.seed[self.doc[leave]] ^ np.uint64(2 * round_ + 1)
        who, step, arc = lat._walk(lat.last[self.chunk[leave]], self.chunk[leave], lambda live, t: uniform(seed[live], place[live] + t), off=True)
        owner, arcs = _ordered(who, step, arc, len(leave))
        logp = self.main_log.copy()
        logp[leave] = np.bincount(owner, np.log(lat.q[arcs]), minlength=len(leave))
        return Sample(logp, leave, leave[owner], arcs)

    def _sets(self, sample: Sample, top: np.ndarray, since: np.ndarray, round_: int) -> Sample:
        """Values of the sets that leave the sample at a chunk from `since` on, below its own value `top`."""
        run = np.cumsum(sample.logp)
        before = np.concatenate(([0.0], run))[self.begin[:-1]]
        sample.prefix = run - sample.logp - before[self.doc]
        sample.total = np.concatenate(([0.0], run))[self.begin[1:]] - before
        other = self.leave.copy()
        other[sample.off] = -np.expm1(sample.logp[sample.off])
        with np.errstate(divide="ignore"):
            mu = sample.prefix + np.where(np.arange(len(run)) >= since[self.doc], np.log(other), -np.inf)
        sample.g = _truncated(mu, top[self.doc], uniform(self.seed[self.doc] ^ np.uint64((2 * round_ + 2) << 20), self.place))
        return sample

    def _left(self, chunk: int, gone: list[tuple[int, ...]]) -> tuple[list[tuple[int, dict[int, int]]], list[float]]:
        """The tree of the ways `gone`, walked back from a chunk's end, as (node, next of each arc), and the
        probability of the ways that leave it from each of its nodes on."""
        lat = self.lattice
        tree, tails = [(int(lat.last[chunk]), {})], [[(p, 0) for p in gone]]
        for i, (_, kids) in enumerate(tree):
            by: dict[int, list] = {}
            for p, at in tails[i]:
                if at < len(p):
                    by.setdefault(p[at], []).append((p, at + 1))
            for arc, rest in by.items():
                kids[arc] = len(tree)
                tree.append((int(lat.start[arc]), {}))
                tails.append(rest)
        mass = [0.0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            node, kids = tree[i]
            if kids:
                a = int(lat.begin[node])
                mass[i] = sum(w * mass[kids[x]] if x in kids else w for x, w in enumerate(lat.q[a : int(lat.begin[node + 1])].tolist(), a))
        return tree, mass

    def _other(self, chunk: int, gone: list[tuple[int, ...]], draws: list[float]) -> tuple[int, ...]:
        """A way through a chunk that is none of `gone`, by its probability among those left."""
        lat = self.lattice
        tree, mass = self._left(chunk, gone)
        node, at, path, home = int(lat.last[chunk]), 0, [], int(lat.first[chunk])
        while node > home:
            a = int(lat.begin[node])
            w = lat.q[a : int(lat.begin[node + 1])].tolist()
            kids = tree[at][1] if at is not None else {}
            for x, kid in kids.items():
                w[x - a] *= mass[kid]
            run = list(accumulate(w))
            i = min(bisect_right(run, draws[len(path)] * run[-1]), len(w) - 1)
            while w[i] <= 0:
                i -= 1
            path.append(a + i)
            at = kids.get(a + i)
            node = int(lat.start[a + i])
        return tuple(path)

    def _main(self, chunk: int) -> tuple[int, ...]:
        lat, path = self.lattice, []
        node = int(lat.last[chunk])
        while node > lat.first[chunk]:
            path.append(int(lat.begin[node]))
            node = int(lat.start[path[-1]])
        return tuple(path)

    def _split(self, samples: list[Sample], pick: np.ndarray, best: np.ndarray, live: np.ndarray, round_: int) -> Sample:
        """Draws the best set's sample for each text of `live`, and what is left of that set."""
        lat = self.lattice
        since = np.full(len(self.n), len(self.chunk))
        kept, forced = [], []
        spot = np.zeros(len(self.n), np.int64)
        for f, sample in enumerate(samples):
            for d in live[pick[live] == f].tolist():
                spot[d] = self.begin[d] + np.argmax(sample.g[self.begin[d] : self.begin[d + 1]])
        at = spot[live]
        size = (lat.last - lat.first)[self.chunk[at]]
        owner = np.repeat(np.arange(len(live)), size)
        seed = self.seed[live] ^ np.uint64((round_ + 1) << 50)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        draws = np.split(uniform(seed[owner], (self.place[at][owner] << 14) + within), np.cumsum(size)[:-1])
        mu = np.full(len(live), -np.inf)
        for j, (d, t) in enumerate(zip(live.tolist(), at.tolist(), strict=True)):
            sample, a, chunk = samples[pick[d]], self.begin[d], int(self.chunk[t])
            gone = sample.gone.get(t)
            if gone is None:
                gone = sample.gone[t] = [sample.path(t) or self._main(chunk)]
            new = self._other(chunk, gone, draws[j].tolist())
            gone.append(new)
            rest = self._left(chunk, gone)[1][0]
            if rest > 0:
                mu[j] = sample.prefix[t] + np.log(rest)
            lo, hi = np.searchsorted(sample.owner, (a, t))
            kept.append((sample.logp[a:t], sample.owner[lo:hi], sample.arcs[lo:hi]))
            forced.append((t, new))
            since[d] = t + 1
        left = _truncated(mu, best[live], uniform(seed ^ np.uint64(1 << 54), self.place[at]))
        for f, sample in enumerate(samples):
            mine = pick[live] == f
            sample.g[at[mine]] = left[mine]
        tokens = np.concatenate([np.arange(since[d], self.begin[d + 1]) for d in live.tolist()])
        fresh = self._fresh(tokens, round_)
        for d, (t, new), (logp, _, _) in zip(live.tolist(), forced, kept, strict=True):
            fresh.logp[self.begin[d] : t] = logp
            fresh.logp[t] = np.log(lat.q[list(new)]).sum()
        owner = np.concatenate([fresh.owner, *[k[1] for k in kept], *[np.full(len(p), t) for t, p in forced]])
        arcs = np.concatenate([fresh.arcs, *[k[2] for k in kept], *[np.array(p, np.int64) for _, p in forced]])
        order = np.argsort(owner, kind="stable")
        fresh.owner, fresh.arcs = owner[order], arcs[order]
        fresh.off = np.unique(fresh.owner)
        return self._sets(fresh, np.where(since <= len(self.chunk), best, -np.inf), since, round_)

    def _emit(self, sample: Sample, docs: np.ndarray, value: np.ndarray) -> list[tuple[np.ndarray, float, float]]:
        """(piece ids, log probability, perturbed value) of the sample of each text."""
        lat = self.lattice
        ids, owner = lat.ids(_reversed(sample.owner, sample.arcs), sample.owner)
        count = lat.main_begin[self.chunk + 1] - lat.main_begin[self.chunk]
        own = np.bincount(owner, minlength=len(self.chunk))
        count[sample.off] = own[sample.off]
        end = np.cumsum(count)
        offset = end - count
        flat = np.empty(int(end[-1]), np.int64)
        main = np.ones(len(self.chunk), bool)
        main[sample.off] = False
        c = count[main]
        inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        flat[np.repeat(offset[main], c) + inner] = lat.main_ids[np.repeat(lat.main_begin[self.chunk[main]], c) + inner]
        if len(ids):
            o = own[sample.off]
            flat[np.repeat(offset[sample.off], o) + np.arange(len(ids)) - np.repeat(np.cumsum(o) - o, o)] = ids
        edge = np.concatenate(([0], end))[self.begin]
        return [(flat[edge[d] : edge[d + 1]], float(sample.total[d]), float(value[d])) for d in docs.tolist()]


def best_ids(lattice: Lattice, texts: list[str]) -> list[np.ndarray]:
    """The best segmentation of each text, by Viterbi over the distinct chunks; ties go to the shorter last piece."""
    words = [lattice.vocab.cut(chunks(t)) for t in texts]
    if not any(words):
        return [np.zeros(0, np.int64) for _ in texts]
    lattice.numbers(words)
    paths = {}
    logq = np.log(np.maximum(lattice.q, 1e-300))
    for w in {w for ws in words for w in ws}:
        c = lattice.number[w]
        a, b = int(lattice.first[c]), int(lattice.last[c])
        best, into = [0.0] * (b - a + 1), [-1] * (b - a + 1)
        for node in range(a + 1, b + 1):
            arcs = range(int(lattice.begin[node]), int(lattice.begin[node + 1]))
            # the arcs' conditional probabilities, chained from the front, order paths as their scores do
            best[node - a], into[node - a] = max((best[int(lattice.start[x]) - a] + float(logq[x]), -x) for x in arcs)
        node, path = b, []
        while node > a:
            path.append(-into[node - a])
            node = int(lattice.start[path[-1]])
        paths[w] = lattice.ids(np.array(path[::-1], np.int64), np.zeros(len(path), np.int64))[0]
    return [np.concatenate([paths[w] for w in ws]) if ws else np.zeros(0, np.int64) for ws in words]


def _parts(keys: list, texts: list[bytes]) -> Iterator[tuple[list, list[str]]]:
    k, part, size = [], [], 0
    for key, t in zip(keys, texts, strict=True):
        k.append(key)
        part.append(t.decode())
        size += len(t)
        if size >= PART:
            yield k, part
            k, part, size = [], [], 0
    if part:
        yield k, part


def _inclusion(logp: float, kappa: float) -> float:
    """The probability that a segmentation's value beats the threshold."""
    if kappa == -np.inf:
        return 1.0
    return float(-np.expm1(-np.exp(min(700.0, logp - kappa))))


SAMPLE_FIELDS = "sample int, ids array<int>, log_prob double, inclusion double"


@lean
def _sample(model_file: str, k: int, alpha: float, seed: int, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(model_file)
    lattice = lattice_of(model_file, alpha)
    for batch in batches:
        for keys, texts in _parts(batch.column("_k").to_pylist(), batch.column("_b").to_pylist()):
            rows = []
            for key, text, drawn in zip(keys, texts, Sampler(lattice, texts, [(x * 1_000_003 + seed) & MASK for x in keys], k).run(), strict=True):
                kappa = drawn[-1][2]
                for i, (ids, logp, _) in enumerate(drawn[:-1]):
                    if digest:
                        rows.append((key, i, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), logp, _inclusion(logp, kappa), vocab.decode(ids) == text))
                    else:
                        rows.append((key, i, ids.astype(np.int32), logp, _inclusion(logp, kappa)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (7 if digest else 5)
            if digest:
                kinds, names = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()], ["_k", "sample", "n_pieces", "ids_sha256", "log_prob", "inclusion", "round_trip"]
            else:
                kinds, names = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64()], ["_k", "sample", "ids", "log_prob", "inclusion"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _best(model_file: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lattice = Lattice(vocabulary(model_file), 1.0)
    for batch in batches:
        for keys, texts in _parts(batch.column("_k").to_pylist(), batch.column("_b").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.astype(np.int32) for x in best_ids(lattice, texts)], pa.list_(pa.int32()))], ["_k", "ids"])


def _decode(model_file: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(model_file)
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        yield batch.append_column("text", pa.array([None if x is None else vocab.decode(x) for x in batch.column(at).to_pylist()], pa.string()))


def _named(out: DataFrame, rows: DataFrame, plain: bool, id_col: str) -> DataFrame:
    if plain:
        return out.withColumnRenamed("_k", id_col)
    rest = [c for c in out.columns if c != "_k"]
    return out.join(rows.select("_k", F.col("_id").alias(id_col)), "_k").select(id_col, *rest)


def sampled(df: DataFrame, model_file: str, k: int = 2, alpha: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, sample, ids, log_prob, inclusion`: k distinct segmentations of each text (fewer where it has fewer).

    Drawn without replacement in proportion to their probability to the power `alpha`, by Gumbel top-k; `inclusion` is the chance
    to be among the k, given the threshold that the (k + 1)-th value sets. The draws depend on the row's key,
    its text and `seed` alone. Null texts count as empty, which has one segmentation, of no piece.
    """
    rows, plain = keyed(df, id_col, text_col)
    return _named(as_binary(rows).mapInArrow(partial(_sample, model_file, k, alpha, seed, False), f"_k long, {SAMPLE_FIELDS}"), rows, plain, id_col)


def sample_digests(df: DataFrame, model_file: str, k: int = 2, alpha: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`sampled` with the SHA-256 of the ids (32-bit little-endian) in their place, and whether they decode to the text."""
    rows, plain = keyed(df, id_col, text_col)
    fields = "_k long, sample int, n_pieces long, ids_sha256 string, log_prob double, inclusion double, round_trip boolean"
    return _named(as_binary(rows).mapInArrow(partial(_sample, model_file, k, alpha, seed, True), fields), rows, plain, id_col)


def encoded(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, ids`: the most probable segmentation of each text. Null texts count as empty."""
    rows, plain = keyed(df, id_col, text_col)
    return _named(as_binary(rows).mapInArrow(partial(_best, model_file), "_k long, ids array<int>"), rows, plain, id_col)


def decoded(df: DataFrame, model_file: str) -> DataFrame:
    """`df` (with `ids array<int>`, without `text`) and the `text` of its ids; null ids give null."""
    from pyspark.sql import types as T

    ship(df.sparkSession)
    return df.mapInArrow(partial(_decode, model_file), T.StructType([*df.schema.fields, T.StructField("text", T.StringType())]))
