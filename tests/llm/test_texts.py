from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from cleanframe.llm import components, debruijn, fingerprint, neardup, segment, warc

WORDS = [f"w{i}" for i in range(400)]


def corpus(rng, n=60):
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 120))) for _ in range(n)]
    out = []
    for i in range(n):
        t = base[i]
        if i % 3 == 1:
            t = base[i - 1]
        elif i % 3 == 2 and t:
            ws = base[i - 1].split()
            if ws:
                ws[rng.randrange(len(ws))] = "changed"
            t = " ".join(ws)
        out.append((i, t))
    return out


def test_fingerprint_report(spark):
    rng = random.Random(1)
    rows = [*corpus(rng), (200, None), (201, ""), (202, "one"), (203, "É" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _bucket")
    got = {r.doc_id: r for r in fingerprint.fingerprint_report(df).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(t)
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    text = dict(rows)
    for k in range(1, 60, 3):
        assert got[k].fingerprint == got[k - 1].fingerprint or text[k] != text[k - 1]
    long = [k for k, t in rows if t and len(t) > 150 and text.get(k - 1) != t]
    assert np.mean([got[k].near_edited >= got[k].near_next for k in long]) > 0.9


def test_next_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(k * k, f"text {k}") for k in range(40)]
    got = {r["_k"]: (r["_next_k"], r["_next"]) for r in fingerprint.with_next(spark.createDataFrame(rows, "_k long, _text string")).collect()}
    keys = sorted((k for k, _ in rows), reverse=True)
    assert got == {k: (keys[(i + 1) % 40], dict(rows)[keys[(i + 1) % 40]]) for i, k in enumerate(keys)}


def test_permuted_tables_find_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    marks = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))) for b in base * 3] + base[:3]
    rows = [(i, f"{m:016x}") for i, m in enumerate(marks)] + [(900, None)]
    got = {(r.fingerprint_a, r.fingerprint_b, r.distance) for r in fingerprint.near_fingerprints(spark.createDataFrame(rows, "doc_id long, fingerprint string"), radius=3).collect()}
    u = sorted(set(marks))
    assert got == {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in u for b in u if a < b and (a ^ b).bit_count() <= 3}


def naive_fingerprint(text, n=4):
    ws = text.encode().lower().split()
    terms = [b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(t, 42) for t in terms]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_fingerprints(spark):
    rng = random.Random(3)
    rows = [*corpus(rng), (300, None), (301, " \t"), (302, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS u", "2 AS f")
    f = {k: naive_fingerprint(t or "") for k, t in rows}
    root = {k: k for k in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in f:
        for b in f:
            if a < b and (f[a] ^ f[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in neardup.fingerprint_components(df).collect()}
    assert got == {k: (f[k], find(k)) for k in f}


@pytest.mark.parametrize("n", [1000, 10**10])
def test_links_of_balls_make_all_groups(spark, n):
    """Random fingerprints, a large near group that shares segments, chains, and two groups that meet in one pair."""
    rng = random.Random(7)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    f = [rng.getrandbits(64) for _ in range(150)]
    f += [flip(x, k) for x in f[:40] for k in (1, 4, 5)]
    f += [flip(f[0], rng.randrange(1, 4)) for _ in range(400)]
    for _ in range(60):
        f.append(flip(f[-1], 4))
    far = flip(f[1], 8)
    f += [flip(far, 1) for _ in range(60)] + [f[1] ^ (f[1] ^ far) & (1 << (f[1] ^ far).bit_length()) // 2 - 1]
    f = sorted(set(f), key=lambda _: rng.random())
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 4]
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    segments = neardup.segments_for(4, n) if n == 1000 else [(0, 32, 1), (32, 32, 2)]
    marks = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(f)], "u long, f long")
    links = neardup.joining_links(marks, 4, segments)
    got = dict(components.components(links).collect())
    assert {i: got.get(i, i) for i in range(len(f))} == {i: find(i) for i in range(len(f))}
    if n == 1000:  # in proportion to the rows, not to the pairs
        assert links.count() < 10 * len(f) < len(pairs)


def test_chance_meetings_stay_in_the_join(spark, monkeypatch):
    rng, seen, real = random.Random(9), {}, neardup.written

    def counted(df, what):
        out = real(df, what)
        seen[what] = out.count()
        return out

    monkeypatch.setattr(neardup, "written", counted)
    f = [rng.getrandbits(64) for _ in range(1500)]
    f += [x ^ 1 << 40 ^ 1 << 50 for x in f[:20]]
    marks = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(f)], "u long, f long")
    # segments so short that every look-up meets fingerprints that are far
    links = neardup.joining_links(marks, 4, [(8 * i, 8, 0) for i in range(5)])
    assert sorted(components.components(links).where("node <> root").collect()) == [(1500 + i, i) for i in range(20)]
    assert seen["strangers"] < 100


def test_keys_do_not_jump():
    keys = lambda n: sum(len(neardup.ball(w, r)) for _, w, r in neardup.segments_for(4, n))
    assert {keys(n) for n in (2, 5000, 10**5, 3 * 10**6, 10**8)} == {45}


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
@pytest.mark.parametrize("n", [2, 3000, 10**6, 10**9])
def test_segments_lose_no_pair(radius, n):
    rng = random.Random(radius * n)
    segments = neardup.segments_for(radius, n)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), radius))
        assert any((x >> at & (1 << w) - 1).bit_count() <= r for at, w, r in segments)


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 0, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows, pairs = [], []
    for i in range(40):
        ws = [rng.choice(WORDS) for _ in range(300)]
        rows.append((10 * i, " ".join(ws)))
        for j, edits in enumerate((1, 3, 30)):
            copy = list(ws)
            for p in rng.sample(range(300), edits):
                copy[p] = "x"
            rows.append((10 * i + 1 + j, " ".join(copy)))
            a, b = ({tuple(x[q : q + 5]) for q in range(296)} for x in (ws, copy))
            pairs.append((10 * i, 10 * i + 1 + j, len(a & b) / len(a | b)))
    rows += [(1000, None), (1001, ""), (1002, "solo"), (1003, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _f")
    group = {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()}
    assert len(group) == len(rows)
    assert np.mean([group[a] == group[b] for a, b, like in pairs if like >= 0.85]) > 0.95
    assert not any(group[a] == group[b] for a, b, like in pairs if like < 0.6)
    assert group[1000] == group[1001] == 1000 and group[1002] == group[1003] == 1002
    kept = neardup.without_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, g in group.items() if k == g}


def test_near_duplicates_with_repeats_in_a_text(spark):
    rng = random.Random(6)
    rows = []
    for i in range(12):
        text = " ".join(rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(300))
        rows += [(10 * i, text), (10 * i + 1, text + "\none short line said again" * (10 if i % 2 else 20))]
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == k // 10 * 10 for k in got)


@pytest.mark.parametrize("words", [12, 300])
def test_near_duplicates_are_all_found(spark, words):
    rng = random.Random(words)
    rows, edits = [], 1 if words < 50 else 7
    common = " ".join(rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(words // 4))
    for i in range(60):
        ws = [rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(words)]
        rows.append((10 * i, " ".join(ws) + (" " + common if i % 3 == 0 else "")))
        for j in range(4):
            copy = list(ws)
            for p in rng.sample(range(words), rng.randrange(edits - 1, edits + 2)):
                copy[p] = "x"
            rows.append((10 * i + 1 + j, " ".join(copy) + (" " + common if i % 3 == 0 else "")))
    sets = {k: set(neardup.shingles(t.encode(), 5)) for k, t in rows}
    want = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(8):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(pairs) > 20


def test_large_groups_of_near_copies_are_dealt_into_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("HOT", 3), ("SAMPLE", 2)):
        monkeypatch.setattr(neardup, name, value)
    rng, rows = random.Random(9), []
    for g in range(3):
        base = [rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(90)]
        for j in range(60):
            copy = list(base)
            for p in rng.sample(range(90), rng.randrange(1, 4)):
                copy[p] = f"y{j}"
            rows.append((100 * g + j, " ".join(copy)))
    sets = {k: set(neardup.shingles(t.encode(), 5)) for k, t in rows}
    want, before = {k: k for k in sets}, None
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while before != want:
        before = dict(want)
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(pairs) > 150
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == neardup.without_near_duplicates(empty).count() == 0


def naive_repeats(rows, window):
    docs = {k: (t or "").encode().split() for k, t in rows}
    seen, gone = set(), {k: set() for k in docs}
    for k in sorted(docs):
        for i in range(len(docs[k]) - window + 1):
            w = tuple(docs[k][i : i + window])
            if w in seen:
                gone[k].update(range(i, i + window))
            seen.add(w)
    return {k: (len(ws), len(gone[k]), " ".join(w.decode() for i, w in enumerate(ws) if i not in gone[k])) for k, ws in docs.items()}


@pytest.mark.parametrize("window", [2, 5, 20])
def test_repeats_against_brute_force(spark, window):
    rng = random.Random(window)
    few = WORDS[:6]
    shared = " ".join(rng.choice(few) for _ in range(45))
    rows = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(0, 60))) + (" " + shared if i % 4 == 0 else "")) for i in range(50)]
    rows += [(90, None), (91, " \n"), (92, "a " * 500), (93, shared + "\n" + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS _paths")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in debruijn.without_repeats(df, window).collect()}
    assert got == naive_repeats(rows, window)


def test_repeats_with_odd_ids(spark):
    t = " ".join(WORDS[:30])
    rows = [(1, t), (1, t), (None, t), (2, "x " + t)]
    out = debruijn.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in out), key=str) == sorted([(1, 0), (1, 30), (2, 30), (None, 30)], key=str)


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "http://a/", "<p>x</p>"), (1, None, None), (2, "http://b/\r\nX: y", ""), (5, "http://c/", "<p>x</p>"), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (9, "u", "é" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS _digest", "'k' AS kind")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got[5] == (8, warc.digest(b"<p>x</p>"), "revisit", 3) and got[3][2:] == ("response", None)
    assert got[1] == (0, warc.digest(b""), "response", None) and got[2][2:] == ("revisit", 1)
    assert got[9][0] == 200_000 and got[7][1] == warc.digest(pages[4][2].encode())
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_warc(df, path, min_bytes=1, compression=compression)
        records = warc.read_records(spark, path, payloads=True)
        assert sorted(bytes(r.payload).decode() for r in records.where("kind = 'response'").collect()) == sorted((p[2] or "") for p in pages if p[0] != 5)
        one = warc.captures(records).where("page = '5'").first()
        assert one.kind == "revisit" and one.request.uri == one.uri == "http://c/" and one.metadata.page == "5"
    twice = spark.createDataFrame([(1, "u", "x"), (1, "v", "x"), (None, "w", "y")], "page_id long, url string, html string")
    got = warc.round_trip(twice).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == [(1, "response", None), (1, "revisit", 1), (None, "response", None)]
    warc.write_warc(twice, str(tmp_path / "twice"))
    seen = warc.captures(warc.read_records(spark, str(tmp_path / "twice"))).collect()
    assert sorted((r.page or "", r.uri, r.request.uri, r.kind) for r in seen) == [("", "w", "w", "response"), ("1", "u", "u", "response"), ("1", "v", "v", "revisit")]
    named = spark.createDataFrame([(" a", "u", "x"), ("b ", "v", "x"), ("é%20\n", "w", "y" * 2_000_000)], "page_id string, url string, html string")
    got = warc.round_trip(named).collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got} == {(" a", "response", None, 1), ("b ", "revisit", " a", 1), ("é%20\n", "response", None, 2_000_000)}
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    P = pytest.importorskip("public_tokenizers")
    return P.path("piece_bpe_32k.model")


def all_ways(vocab, text):
    score = {vocab.pieces[i]: (i, s) for i, s in zip(vocab.id[1:].tolist(), vocab.logp[1:].tolist(), strict=True)}
    s, out = segment.BLANK + text.replace(" ", segment.BLANK), []

    def go(at, ids, logp):
        if at == len(s):
            out.append((tuple(ids), logp))
        for n in range(1, vocab.longest + 1):
            if s[at : at + n] in score and at + n <= len(s):
                i, w = score[s[at : at + n]]
                go(at + n, [*ids, i], logp + w)

    go(0, [], 0.0)
    return out


def test_samples_are_drawn_without_replacement(model):
    vocab, alpha, n = segment.vocabulary(model), 0.3, 6000
    ways = all_ways(vocab, "théns a")
    logs = np.array([w for _, w in ways]) * alpha
    p = dict(zip([w for w, _ in ways], np.exp(logs - np.logaddexp.reduce(logs)), strict=True))
    runs = segment.Sampler(segment.Lattice(vocab, alpha), ["théns a"] * n, list(range(n)), 3).run()
    firsts = [tuple(r[0][0].tolist()) for r in runs]
    for w in sorted(p, key=p.get)[-4:]:
        assert abs(firsts.count(w) / n - p[w]) < 4 * np.sqrt(p[w] / n) + 2e-3
        second = sum(tuple(r[1][0].tolist()) == w for r in runs) / n
        assert abs(second - sum(p[a] * p[w] / (1 - p[a]) for a in p if a != w)) < 0.03
    for r in runs[:500]:
        assert len({tuple(x[0].tolist()) for x in r[:-1]}) == 3 and r[0][2] > r[1][2] > r[2][2] >= r[3][2]
        assert all(abs(x[1] - np.log(p[tuple(x[0].tolist())])) < 1e-9 for x in r[:-1])


def test_segmentations_decode_to_the_text(spark, model):
    texts = [None, "", " ", "a▁b  c\n\n d\t\x00 ①", "\n", "x" * 3000, "Ein Wort, zwei Wörter und 12345.", " führt", "a" * 40 + " " + "日本"]
    rows = list(enumerate(texts)) + [(2, "again"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    out = segment.sampled(df, model, k=3).collect()
    vocab = segment.vocabulary(model)
    assert {(r.doc_id, vocab.decode(r.ids)) for r in out} == {(k, t or "") for k, t in rows}
    assert [len(r.ids) for r in out if r.doc_id == 0] == [0]
    assert all(0 < r.inclusion <= 1 and r.log_prob <= 1e-9 for r in out)
    again = segment.sampled(df.repartition(3), model, k=3).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.ids)
    assert sorted(map(key, out)) == sorted(map(key, again))
    best = segment.encoded(df, model)
    assert {(r.doc_id, r.text) for r in segment.decoded(best, model).collect()} == {(k, t or "") for k, t in rows}


def test_best_segmentation(model):
    vocab = segment.vocabulary(model)
    for text in ("théns a", "eronent"):
        ways = all_ways(vocab, text)
        top = max(w for _, w in ways)
        got = segment.best_ids(segment.Lattice(vocab, 1.0), [text])[0]
        assert dict(ways)[tuple(got.tolist())] == pytest.approx(top)


def test_every_segmentation_is_reached_once(model):
    vocab, alpha = segment.vocabulary(model), 3.0
    for text in ("the end", "ation s"):
        ways = all_ways(vocab, text)
        logs = np.array([w for _, w in ways]) * alpha
        p = dict(zip([w for w, _ in ways], logs - np.logaddexp.reduce(logs), strict=True))
        assert min(p.values()) < np.log(1e-13)
        drawn = segment.Sampler(segment.Lattice(vocab, alpha), [text], [5], len(ways) + 3).run()[0]
        assert drawn[-1][0] is None and drawn[-1][2] == -np.inf
        got = [tuple(x[0].tolist()) for x in drawn[:-1]]
        assert len(got) == len(ways) and set(got) == set(p)
        assert all(x[1] == pytest.approx(p[tuple(x[0].tolist())]) for x in drawn[:-1])


def test_blocks_find_all_pieces_and_no_longer_cells(model):
    vocab, rng = segment.vocabulary(model), random.Random(8)
    known = {vocab.pieces[i]: i for i in vocab.id[1:].tolist()}
    words = ["".join(rng.choice("aeinorst▁éQ") for _ in range(rng.randint(1, 12))) for _ in range(300)] + rng.sample(sorted(known), 300)
    lattice = segment.Lattice(vocab, 0.5)
    lattice.numbers([words])
    numbers = set(known.values())
    for w in words:
        c = lattice.number[w]
        for j in range(1, len(w) + 1):
            node = int(lattice.first[c]) + j
            arcs = range(int(lattice.begin[node]), int(lattice.begin[node + 1]))
            got = {(int(lattice.start[x] - lattice.first[c]), int(lattice.piece[x])) for x in arcs}
            assert {a for a in got if a[1] in numbers} == {(i, known[w[i:j]]) for i in range(j) if w[i:j] in known}
    # what leaves the main path is kept once a chunk, not once a node; a worker's tasks share their chunks
    assert len(lattice.leave) == len(lattice.number) and segment.lattice_of(model, 0.5) is segment.lattice_of(model, 0.5)
    ids = np.array([known[w] for w in words[300:]])
    assert vocab.decode(ids) == vocab.decode(ids.tolist()) == "".join(words[300:]).replace("▁", " ").removeprefix(" ") and vocab.decode([]) == ""


def test_chunks_are_split_at_once_and_built_in_one_block(model, monkeypatch):
    vocab, rng = segment.vocabulary(model), random.Random(9)
    odd = ["", " ", "\n", "a", " a", "a ", "a  b", "a \nb", "a\n b", "\n\n a\n\n\nb\n", "x\x00 \ty\r\n é日 z", "\u00a0 a\u2028b", "w" * 300 + " w"]
    odd += ["".join(rng.choice("ab \né") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for texts in (odd, odd[:-301], ["a▁ b"] + odd, [""], []):
        n, words, index = segment.distinct_chunks(vocab, texts)
        want = [vocab.cut(segment.chunks(t)) for t in texts]
        assert n.tolist() == [*map(len, want)] and [words[i] for i in index.tolist()] == [w for ws in want for w in ws] and len({*words}) == len(words)
    # chunks of all lengths go in one block, whose draws are those of chunks built one by one
    built, block = [], segment.Lattice._block
    monkeypatch.setattr(segment.Lattice, "_block", lambda self, words, *more: built.append(len(words)) or block(self, words, *more))
    words = sorted({"".join(rng.choice("▁aeinorstQé") for _ in range(rng.randint(1, 40))) for _ in range(200)})
    whole, single = segment.Lattice(vocab, 0.5), segment.Lattice(vocab, 0.5)
    whole.numbers([words])
    assert built == [len(words)]
    for w in words:
        single.numbers([[w]])
    for w in words:
        got = []
        for lat in (whole, single):
            c = lat.number[w]
            a, b = int(lat.first[c]), int(lat.last[c])
            x, y = int(lat.begin[a]), int(lat.begin[b + 1])
            ids = lat.main_ids[lat.main_begin[c] : lat.main_begin[c + 1]].tolist()
            got.append((b - a, (lat.start[x:y] - a).tolist(), lat.piece[x:y].tolist(), lat.q[x:y].tolist(), lat.cum[x:y].tolist(), lat.rest[a : b + 1].tolist(), lat.leave[c], ids))
        assert got[0] == got[1]


def test_draws_do_not_depend_on_kept_chunks(model, monkeypatch):
    vocab, rng = segment.vocabulary(model), random.Random(3)
    texts = [" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(30)]
    run = lambda lattice, some, at: [[(tuple(x[0].tolist()), round(x[1], 9)) for x in r[:-1]] for r in segment.Sampler(lattice, some, list(range(at, at + len(some))), 2).run()]
    once = run(segment.Lattice(vocab, 0.5), texts, 0)
    monkeypatch.setattr(segment, "KEPT", 40)
    lattice = segment.Lattice(vocab, 0.5)
    assert [x for i in range(0, 30, 3) for x in run(lattice, texts[i : i + 3], i)] == once
    assert len(lattice.number) < 300


def test_long_chunks_are_cut_only_where_no_piece_lies(model):
    vocab, rng = segment.vocabulary(model), random.Random(4)
    word = "".join(rng.choice("aeinorstqxzQ7é日") for _ in range(segment.LONG + 50))
    parts = vocab.cut([word, "short"])
    assert "".join(parts) == word + "short" and len(parts) > 2
    pieces = [vocab.pieces[i] for i in vocab.id[1:].tolist()]
    for a, b in zip(parts[:-2], parts[1:-1], strict=True):
        assert not any(a[-1] + b[0] in p for p in pieces)


def test_sampling_of_an_empty_table(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert segment.sampled(empty, model).count() == segment.sample_digests(empty, model).count() == segment.encoded(empty, model).count() == 0


def test_near_copies_are_found_by_their_fingerprints(spark, monkeypatch):
    found, real = [], neardup.written

    def kept(df, what):
        out = real(df, what)
        if what in ("heads", "near"):
            found.append((what, sorted(map(tuple, out.collect()))))
        return out

    monkeypatch.setattr(neardup, "written", kept)
    words = lambda a: [f"{a}{i}" for i in range(600)]
    texts = [words("x"), [*words("x"), "end"], words("y")]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2}
    assert found[0][0] == "heads" and len(found[0][1]) in (2, 3)
    assert found[1] == ("near", [(0, 1)])  # before the exact search, which finds no more
    assert found[2] == ("near", [])


def test_paths_are_cut_in_numpy():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    firsts = [[{"i": i, "n": rng.choice([2, 2, 2, 3])} for i in range(60) if rng.random() < 0.8] or [{"i": 7, "n": 2}] for _ in range(1000)]
    kind = pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(firsts, kind)], ["_k", "_firsts"])
    want = []
    for edges in firsts:
        runs = []
        for e in edges:
            if runs and e["i"] == runs[-1]["start"] + runs[-1]["edges"] and e["n"] == runs[-1]["count"]:
                runs[-1]["edges"] += 1
            else:
                runs.append({"start": e["i"], "edges": 1, "count": e["n"]})
        want.append(runs)
    for part in (batch, batch.slice(400, 300), batch.slice(0, 0)):
        got = [r for b in debruijn._paths(iter([part])) for r in b.to_pylist()]
        assert got == [{"_k": k, "_paths": want[k]} for k in part.column("_k").to_pylist()]
    tracemalloc.start()
    list(debruijn._paths(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * sum(map(len, firsts))  # no object an edge


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_are_not_broadcast(spark):
    """Spark sizes a fingerprint's 45 look-ups as one row."""
    plan = plan_of(neardup.leading_pairs(spark.range(1000).selectExpr("id AS u", "xxhash64(id) AS f"), 4, neardup.segments_for(4, 1000)))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_near_copies_broadcast_no_more_than_the_bound(spark, monkeypatch):
    plans, real = {}, neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, what: plans.setdefault(what, []).append(plan_of(df)) or real(df, what))
    words = lambda a: [f"{a}{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([words("x"), [*words("x"), "end"], words("y")])], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2}
    few = plans.copy()
    plans.clear()
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", 0)
    assert {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2}
    assert "LeftSemi, BuildRight" in few["shared"][0] and "LeftSemi, BuildRight" not in plans["shared"][0]
    assert "BroadcastHashJoin [t" not in plans["pairs"][-1]
    assert "BroadcastHashJoin" in few["near"][0] and "BroadcastHashJoin" not in plans["near"][0]


def test_simhash_groups_broadcast_no_look_ups(spark, monkeypatch):
    plans, real = {}, neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, what: plans.setdefault(what, plan_of(df)) and real(df, what))
    df = spark.createDataFrame([(i, f"w{i // 2} x y z " * 9) for i in range(20)], "doc_id long, text string")
    out = neardup.fingerprint_components(df)
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i // 2 * 2 for i in range(20)}
    assert all("BroadcastHashJoin" not in plans[x] for x in ("first", "rest", "strangers", "most"))
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert "BroadcastHashJoin [_f" in plan_of(out) and "BroadcastHashJoin [_f" not in plan_of(neardup.fingerprint_components(df))
