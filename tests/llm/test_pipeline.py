from __future__ import annotations

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from cleanframe.llm import common, components, langid, neardup, segment
from cleanframe.llm.queries import piece_model


def test_stages_in_order(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    prose = lambda a, n: " ".join(f"{a}{c}{d}" for c in "abcdefghij" for d in "klmnop")[: n * 8]
    item = "which of the seven old bridges over the river was the first to be rebuilt after the flood"
    texts = [prose("x", 9), prose("y", 12), prose("y", 12), None, "", "1234 ...", prose("z", 5) + " " + item, *(f"{prose(c, 4)}\nthis license line stands in many documents of the corpus\nend {c}" for c in "abcdef")]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        path = str(tmp_path / name)
        at.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "sentencepiece":
            assert at.columns == docs.columns
    assert set(seen["language_id"]) == set(range(13)) - {3, 4, 5}
    assert sum("license line" in r.text for r in seen["line_dedup"].values()) == 1
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    assert set(seen["simhash_near_dedup"]) == set(seen["line_dedup"]) - {2}
    assert set(seen["benchmark_decontamination"]) == set(seen["simhash_near_dedup"]) - {6}
    assert set(seen["sentencepiece"]) == set(seen["benchmark_decontamination"])
    assert all(r.round_trip for r in at.collect())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, at.collect()))


def test_freed_memory_goes_back_between_batches():
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("needs Linux")
    anon = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    @common.lean
    def task(n):
        for _ in range(n):
            held = [b"x" * 60_000 for _ in range(2000)]
            pin = [held[i] for i in range(0, 2000, 100)]
            del held
            yield pin

    before = anon()
    run = task(2)
    next(run), next(run)
    assert list(run) == [] and anon() - before < 40


def test_filters_hold_few_places_at_once():
    net, rng = langid.ByteNet(["a", "b"]), random.Random(3)
    text = bytes(rng.randrange(97, 123) for _ in range(langid.BATCH * langid.WINDOW))
    net.predict([text])
    tracemalloc.start()
    net.predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_kept_lattices_are_small():
    vocab = segment.vocabulary(pytest.importorskip("public_tokenizers") and piece_model())
    lattice, rng, most = segment.Lattice(vocab, 0.5), random.Random(5), 0
    for _ in range(30):
        words = list({segment.BLANK + "".join(rng.choice("aeinorst") for _ in range(7)) for _ in range(3000)})
        lattice.numbered(words, np.arange(len(words)))
        held = {id(y): y.nbytes for x in vars(lattice).values() if isinstance(x, np.ndarray) for y in [x if x.base is None else x.base]}
        most = max(most, sum(held.values()))
    assert most < 45 << 20, most


def test_groups_found_before_cost_one_round(spark, monkeypatch):
    made, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, what: made.append(what) or real(df, what))
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    roots = components.components(links)
    made.clear()
    again = components.components(components.stars(roots))
    assert len(made) == 2 and sorted(again.collect()) == sorted(roots.collect())
    # each search for groups of near copies but the first starts from the groups of the one before
    made.clear()
    rows = [(i, " ".join(f"w{j}" for j in range(10 * i, 10 * i + 200))) for i in range(12)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.group_id for r in got.collect()} == {0} and len(made) <= 9
