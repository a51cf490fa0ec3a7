from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cleanframe.llm import decontam, hmm, langid, linededup, toxic

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def naive_distance(pattern, text):
    """(least edit distance of the pattern to a part of the text)."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25))
def test_myers_is_the_edit_distance(pattern, text):
    d, end = decontam.myers(pattern, text)
    assert d == naive_distance(pattern, text)
    assert end == 0 and d == len(pattern) or naive_distance(pattern, text[:end]) == d


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(8, 30)))) for i in range(12)]
    docs = []
    for k in range(60):
        words = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(5, 80))]
        if k % 2:
            cut = items[k % 12][1].split()
            for _ in range(rng.randrange(0, 6)):
                cut[rng.randrange(len(cut))] = "x"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in cut]
        docs.append((k, " ".join(words), "extra"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[0][1], "x"), (5, items[1][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _k string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.leaks(df, bench).collect()}
    want = set()
    for k, text, _ in docs:
        for i, t in items:
            p = decontam.fold_words(t.encode())
            d = naive_distance(p, decontam.fold_words((text or "").encode()))
            if d <= int(len(p) * 0.2):
                want.add((k, i, d))
    assert got == want and len(want) > 20
    kept = decontam.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == len([1 for k, t, _ in docs if not any((k, i) in {(a, b) for a, b, _ in want} for i, _ in items)]) - (1 if (5, 1) in {(a, b) for a, b, _ in want} and not any(a == 5 for a, b, _ in want if b != 1) else 0)


def test_short_items_match_word_for_word(spark):
    df = spark.createDataFrame([(1, "so: Who wrote the Iliad? they asked"), (2, "who wrote an Iliad"), (3, "the iliad")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "who wrote the iliad"), (8, "?!"), (9, None)], "item_id long, text string")
    assert [tuple(r) for r in decontam.leaks(df, bench).collect()] == [(1, 7, 0, 1, 5)]
    assert {r.doc_id for r in decontam.decontaminated(df, bench).collect()} == {2, 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert decontam.leaks(none, items).count() == 0 and decontam.decontaminated(none, items).count() == 0
    assert langid.train(none) is None and langid.predict(none, None).count() == 0
    assert toxic.train(none, none) is None and toxic.score(none, None).count() == 0
    assert linededup.line_bitmaps(none).count() == 0
    assert hmm.scores(none).count() == 0


def naive_lines(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    seen = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    for rank, i in enumerate(order):
        for line in (rows[i][1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                seen.setdefault(key(line), []).append((rank, i))
    gone = {k: max(v)[1] for k, v in seen.items() if len({i for _, i in v}) >= min_docs}
    return [(k, "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i)) for i, (k, t) in enumerate(rows)]


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    long = [f"{c} line that is Repeated É and has many characters {c}" for c in "abcdefg"]
    rows = [(i, "\n".join(rng.choice([*long, "short", "", f"own line of document {i} which nobody else has at all", "  " + long[0].upper().replace("É", "É") + "\t"]) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (7, long[1]), (None, long[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _runs", "1 AS h1")
    got = sorted(((r.doc_id, r.kept) for r in linededup.deduped_lines(df).collect()), key=str)
    assert got == sorted(naive_lines(rows), key=str)
    unique = [r for r in rows if r[0] is not None and r[0] != 7]
    df = spark.createDataFrame(unique, "doc_id long, text string").selectExpr("*", "'x' AS _dropped")
    stay = linededup.deduped_rows(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in stay.collect()) == sorted(naive_lines(unique))
    for r in linededup.line_bitmaps(df).collect():
        assert sum(x["length"] for x in r.keep_runs) == r.n_lines - r.n_dropped


def test_bitmap_of_a_long_text(spark):
    line = "a line of forty characters, at the least."
    rows = [(i, line) for i in range(5)] + [(9, "\n".join([line, "x"] * 5000))]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 9: (10000, 0)}


SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ber", "ung", "ach"], "cc": ["éau", "ère", "oux", "ion"]}


def prose(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(i, prose(lang, rng, rng.randrange(5, 200)), lang) for i in range(360) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (1003, "x" * 300_000, None), (3, "ka to mi", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5 AS score")
    net = langid.train(langid.learned(df), per_lang=80)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, net).collect()]
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows if i < 1000}
    held = [(truth[i] == p) for i, p, _ in got if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95
    by = {i: (p, s) for i, p, s in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, _, s in got)
    kept = {r.doc_id for r in langid.recognised(df, net).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) > 350


def test_language_without_latin_letters(spark):
    rng = random.Random(3)
    cyrillic = lambda n: " ".join(rng.choice(["мир", "слово", "река", "город", "время", "книга"]) for _ in range(n))
    rows = [(i, cyrillic(rng.randrange(5, 80)) if i % 2 else prose("aa", rng, rng.randrange(5, 80)), "ru" if i % 2 else "aa") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(langid.learned(df), per_lang=80)
    assert net.langs == ["aa", "ru"]
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in langid.predict(df, net).collect()]) > 0.95


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(0)
    net = langid.ByteNet(["a", "b"])
    x, y = langid.CLASS[rng.integers(97, 122, (6, langid.WINDOW))], rng.integers(0, 2, 6)

    def loss():
        h = np.concatenate([sum(net.embed[x][:, j : langid.WINDOW - w + 1 + j] @ k[j] for j in range(w)).max(axis=1) for w, k in zip(langid.WIDTHS, net.conv, strict=True)], axis=1)
        z = np.maximum(h + net.bias, 0) @ net.out + net.top
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(6), y]))

    net.embed, net.conv = net.embed.astype(float), [k.astype(float) for k in net.conv]
    net.out, net.bias, net.top = net.out.astype(float), net.bias.astype(float), net.top.astype(float)
    grads = net._gradients(x, y)
    for p, g in zip([net.embed, *net.conv, net.bias, net.out, net.top], grads, strict=True):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        p[i] += 1e-5
        up = loss()
        p[i] -= 2e-5
        down = loss()
        p[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) < 1e-3 * max(1e-2, abs(g[i])) + 1e-5


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = prose("aa", rng, rng.randrange(20, 120)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "grobian" + rng.choice(SYLLABLES["aa"]))
        rows.append((i, " ".join(words) + "\n" + prose("bb", rng, 10)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "grobianka " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5, None), (900, None)], "doc_id long, toxic int")
    field = toxic.train(df, lab)
    got = {r.doc_id: r for r in toxic.score(df, field).collect()}
    held = [(got[i].score >= 0.3) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95
    assert got[900].score == got[901].score < 0.3 <= got[902].score
    text = dict(rows)
    marked = [text[i][s["start"] : s["end"]] for i, r in got.items() if i < 400 for s in r.spans]
    assert marked and np.mean([m.startswith("grobian") for m in marked]) > 0.95


def test_field_marginals_against_enumeration():
    from itertools import product

    field = toxic.Field()
    field.move = np.array([[0.3, -0.5], [-0.2, 0.9]])
    e = np.array([0.5, -1.0, 2.0, 0.1, -0.7])
    sizes = np.array([2, 3])
    got = field.marginals(e, sizes)
    at = 0
    for n in sizes:
        part, total = np.zeros(n), 0.0
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(field.move[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            part += w * np.array(y)
        assert np.allclose(got[at : at + n], part / total)
        at += n


def test_hmm_likelihood_and_counts_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(rng.random(2)), norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))).T.copy())
    texts = [np.array([0, 3, 1, 1]), np.array([2]), np.array([1, 0])]
    got = model.log10(texts)
    emit = np.zeros((4, 2))
    for t, g in zip(texts, got, strict=True):
        total, part = 0.0, np.zeros((4, 2))
        for path in product((0, 1), repeat=len(t)):
            w = model.start[path[0]] * np.prod([model.emit[o, s] for o, s in zip(t, path, strict=True)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += w
            for o, s in zip(t, path, strict=True):
                part[o, s] += w
        assert abs(np.log10(total) - g) < 1e-9
        emit += part / total
    start, share, move, got_emit = model.counts(texts)
    assert np.allclose(got_emit, emit) and np.isclose(start.sum(), 3) and np.isclose(share.sum(), 7) and np.isclose(move.sum(), 4)


def test_lm_scores(spark):
    rng = random.Random(5)
    rows = [(i, prose(["aa", "bb"][i % 2], rng, rng.randrange(1, 60)).title()) for i in range(200)] + [(500, None), (501, ""), (502, "never seen words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n")
    got = hmm.scores(df, states=4, warm=6).toPandas().set_index("doc_id")
    from collections import Counter

    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = {i: (t or "").lower().encode().split() for i, t in rows}
    c = Counter(w for i, ws in split.items() if not held(i) for w in ws)
    ends = sum(not held(i) for i in split)
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, ws in split.items():
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws) + np.log10((ends + 1) / (n + v + 1))
        assert abs(got.base_score[i] - base) < 1e-9 * max(1, abs(base)) and got.n_tokens[i] == len(ws) + 1
        assert got.n_known[i] == sum(c[w] > 0 for w in ws) + 1 and got.train_tokens[i] == n and got.held_out[i] == held(i)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_early_steps_see_all_training_rows(spark, monkeypatch):
    rows = [(i, f"word{i} again") for i in range(3000)]
    seen = []
    monkeypatch.setattr(hmm, "_iterate", lambda texts, model, *a: (seen.append({r._k for r in texts.select("_k").collect()}), model)[1])
    hmm.scores(spark.createDataFrame(rows, "doc_id long, text string"), warm=4, full=1)
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    assert set().union(*seen[:4]) == train and sum(map(len, seen[:4])) == len(train) and seen[4] == train


@pytest.mark.parametrize("text", ["", "   ", "a"])
def test_symbols(text):
    s = hmm.Symbols([b"a"])
    assert s.of(text.encode().split()).tolist()[-1] == s.end


def test_words_are_counted_in_parts(monkeypatch):
    import pyarrow as pa
    from cleanframe.llm import hmm

    monkeypatch.setattr(hmm, "MEMO", 3)
    texts = ["A a\x0bb É é", "", "c d e f a", "b\x85b b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["_k", "_b"])
    parts = list(hmm._counted(iter([batch, batch])))
    got = {}
    for r in (r for b in parts for r in b.to_pylist()):
        got[r["word"]] = got.get(r["word"], 0) + r["c"]
    assert len(parts) > 2 and got == {"a": 6, "b": 4, "É": 2, "é": 2, "c": 2, "d": 2, "e": 2, "f": 2, "b\x85b": 2}


def test_words_become_symbols_without_an_object_each(monkeypatch):
    import pyarrow as pa
    from cleanframe.llm import hmm

    rng = random.Random(5)
    texts = ["", " ", "A a\x0bb É é\x00 \x00", "\tab\r\n", "x\u00a0y\x85z ÀÉ à", "".join(rng.choice("aB é\n…") for _ in range(400)), "w" * 40 + " Q", "q q"]
    head = [b"a", "é".encode(), b"ab"]
    monkeypatch.setattr(hmm.Symbols, "__missing__", lambda self, word: self.head + hmm.word_class(word))
    symbols = hmm.Symbols(head)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["_k", "_b"])
    asked, of = [], hmm.word_class
    monkeypatch.setattr(hmm, "word_class", lambda word: asked.append(word) or of(word))
    hmm._class_of_key.cache_clear()
    got = [r for b in hmm._encode(head, iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    # a class is found once for each ending and length
    assert len({(w[-3:], min(len(w), 15)) for w in asked}) == len(asked)
    monkeypatch.setattr(hmm, "word_class", of)
    assert [r["_k"] for r in got] == [*range(len(texts))]
    for r, t in zip(got, texts, strict=True):
        words = t.encode().lower().split()
        assert r["s"] == symbols.of(words).tolist()
        rare = [w.decode() for w in words if w not in head]
        assert len(r["rare"]) == len(r["times"]) and dict(zip(r["rare"], r["times"], strict=True)) == {w: rare.count(w) for w in rare}
    words = pa.array([b"", b"a", "é".encode(), b"abc", b"abcd", b"x" * 14, b"x" * 15, b"x" * 16, b"\x00a"], pa.binary())
    assert hmm.word_classes(words).tolist() == [of(w) for w in words.to_pylist()] and hmm.word_classes(words[3:]).tolist() == [of(w) for w in words[3:].to_pylist()]


def test_forward_recursion_is_scaled_now_and_then():
    from cleanframe.llm import hmm

    rng = np.random.default_rng(6)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(rng.random(3)), norm(rng.random(3)), norm(rng.random((3, 3))), rng.random((5, 3)) * 1e-18)
    texts = [rng.integers(0, 5, n) for n in (1, 2, 7, 8, 9, 16, 17, 40, 3, 500)]
    made = []
    log10 = np.log10
    got = model.log10(texts)
    for t in texts:
        x, total = model.start * model.emit[t[0]], 0.0
        for s in t[1:]:
            total += log10(x.sum())
            x = (x / x.sum() @ model.move) * model.emit[s]
        made.append(total + log10(x.sum()))
    assert got == pytest.approx(made, rel=1e-12)
