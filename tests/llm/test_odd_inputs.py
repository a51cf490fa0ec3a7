"""Nulls, ties, repeated ids, clashing columns, empty tables and very long texts: the results that the docstrings state."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from cleanframe.llm import debruijn, decontam, fingerprint, hmm, langid, neardup, toxic

LONG = "one two three four five six seven eight nine ten " * 30_000
DOCS = "doc_id long, text string"


def shown(df, *cols):
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def test_fingerprints(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, None), (None, "x"), (2, LONG), (3, "")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS _f", "2 AS _w"))
    marks = {}
    for r in got.collect():
        marks.setdefault(r.doc_id, []).append(r.fingerprint)
    assert {k: len(v) for k, v in marks.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert marks[3] == ["0" * 32] and sorted(marks[1])[0] == "0" * 32 and len(set(marks[1])) == 2
    report = fingerprint.fingerprint_report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.n_chars for r in report) == sorted(len(t or "") for _, t in rows)
    # descending: null id (largest), 3, 2, then the rows of id 1 by text, latest first
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    want = []
    for i, (_, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        want.append(hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in report) == sorted(want)
    assert fingerprint.fingerprint_report(spark.createDataFrame([], DOCS)).collect() == []


def test_components(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (2, LONG), (4, LONG), (7, None), (8, " ")]
    got = neardup.fingerprint_components(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS component_id"))
    assert shown(got, "doc_id", "component_id") == sorted(map(repr, [(5, 5), (5, 5), (None, 5), (2, 2), (4, 2), (7, 7), (8, 7)]))
    assert neardup.fingerprint_components(spark.createDataFrame([], DOCS)).collect() == []


def test_near_duplicates(spark):
    rows = [(5, LONG), (6, LONG + "end"), (7, None), (8, None), (None, "p q r s t u v"), (9, "p q r s t u v")]
    got = neardup.without_near_duplicates(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS _k", "'x' AS _text"))
    assert got.columns == ["doc_id", "text", "_k", "_text"]
    assert {r.doc_id for r in got.collect()} >= {5, 9} and 6 not in {r.doc_id for r in got.collect()}
    assert neardup.without_near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_decontamination(spark):
    item = "which of the seven old bridges over the river was the first to be rebuilt"
    rows = [(1, LONG + item), (1, LONG + item), (None, item), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS item_id", "'x' AS _b")
    items = spark.createDataFrame([(1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    got = decontam.leaks(docs, items)
    assert {r.doc_id for r in got.collect()} == {1, None}
    left = decontam.decontaminated(docs, items)
    assert left.columns == docs.columns and shown(left, "doc_id", "text") == sorted(map(repr, [(3, None), (4, "")]))


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["fine", "good", "day", "walk"]) for _ in range(12)) + (" vile" * 3 if i % 2 else "")) for i in range(80)] + [(1, "again"), (500, LONG + "vile"), (501, None), (None, "vile vile")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS toxic", "0 AS score")
    field = toxic.train(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    got = toxic.score(docs, field).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[500] > 0.5 > by[501] and by[None] > 0.5


def test_language_id(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)] + [(900, "the cat and the dog " * 15_000, None), (901, None, None), (None, "der hund und die katze", None), (3, "12", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    net = langid.train(docs)
    got = langid.predict(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id != 3}
    assert by[900] == "en" and by[901] == "und" and by[None] == "de"


def test_lm_scores(spark):
    rows = [(i, "a b c") for i in range(20)] + [(3, "a b c"), (None, "a zzz"), (50, LONG), (51, None)]
    got = hmm.scores(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS c", "2 AS word"), states=2, warm=2, full=1).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[51].n_tokens == 1 and by[50].n_tokens == 300_001 and by[None].n_tokens == 3
    assert all(r.score < 0 and r.base_score < 0 for r in got)


def naive_repeats(rows, window):
    seen, out = set(), []
    for k, t in rows:
        ws = (t or "").split()
        gone = set()
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append((k, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return out


def test_substring_dedup(spark):
    rows = [(1, LONG[:200_000]), (2, "x " + LONG[:3000]), (3, None), (4, "one " * 5000)]
    got = debruijn.repeat_digests(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n_words", "2 AS m"))
    assert shown(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(map(repr, naive_repeats(rows, 20)))
    assert debruijn.repeat_digests(spark.createDataFrame([], DOCS)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, _k int"
    item = "which of the seven old bridges over the river was the first to be rebuilt after the flood"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["the", "and", "river", "old", "house", "went", "was", "over"]) + str(rng.randrange(50)) for _ in range(60))
    rows = [(i, prose(), "en", "s", 5, "k", 1) for i in range(12)] + [(3, prose(), "en", "s", 5, "k", 1), (None, prose(), "en", None, None, None, None), (40, LONG, "en", "s", 5, "k", 1)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, kind)
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, str(tmp_path))
            path = str(tmp_path / f"{name}-{len(table)}")
            at.write.parquet(path)
            at = spark.read.parquet(path)
            if name != "sentencepiece":
                assert at.columns == docs.columns
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in at.collect()) == sorted((r[0] is None, r[0] or 0) for r in table), name
        assert {r.doc_id for r in at.collect()} == {r[0] for r in table}
