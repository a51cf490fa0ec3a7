from __future__ import annotations

import csv
import io
import random

import pytest

from cleanframe.sources import dialect, files, quoted


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("encoding", ["UTF-16", "UTF-16LE", "UTF-16BE", "UTF-8", "UTF-8-SIG", "ISO-8859-1"])
@pytest.mark.parametrize("multi_line", [False, True])
def test_encodings(spark, tmp_path, encoding, multi_line):
    text = "id,note\n1,é ü\n2,\"x, y\"\n3,Zoë\n" + ("" if encoding.startswith("ISO") else "4,ਊ\u000b ਊ日\U0001f600\n")
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode(encoding))
    name = "UTF-8" if encoding == "UTF-8-SIG" else encoding
    want = [(int(r[0]), r[1]) for r in csv.reader(io.StringIO(text), delimiter=",") if r[0] != "id"]
    for schema in (None, "id int, note string"):
        got = files.read_delimited(spark, str(path), encoding=name, schema=schema, multi_line=multi_line)
        assert [f.dataType.simpleString() for f in got.schema] == ["int", "string"] and got.columns == ["id", "note"]
        assert rows_of(got) == sorted(map(repr, want))


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_ends_in_many_splits(spark, tmp_path, header, quote, end):
    rng = random.Random(6)
    pick = lambda: "".join(rng.choice(["a", "b", "\n", end, quote, ",", " ", "é", ""]) for _ in range(rng.choice([0, 1, 3, 9, 40])))
    want = []
    for name in ("one", "two"):
        out = io.StringIO()
        w = csv.writer(out, quotechar=quote, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
        if header:
            w.writerow(["id", "left\nside", "right"])
        for i in range(300):
            row = [str(i), pick() or "x", pick() or "y"] if i != 77 else [str(i), "long " + f"{quote},\n" * 3000, "z"]
            w.writerow(row)
            want.append(row)
        (tmp_path / f"{name}.csv").write_bytes(("﻿" if name == "two" else "").encode() + out.getvalue().encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = files.read_delimited(spark, str(tmp_path), quote=quote, header=header, schema="id int, l string, r string", multi_line=True)
        assert quoted._lines(spark, str(tmp_path), "UTF-8").rdd.getNumPartitions() > 20
        found = got.collect()
        whole = spark.read.schema("id int, l string, r string").options(quote=quote, escape=quote, header=header, multiLine=True).csv(str(tmp_path)).collect()
        typed = files.read_delimited(spark, str(tmp_path), quote=quote, header=header, multi_line=True)
        kinds = [f.dataType.simpleString() for f in typed.schema]
        columns = typed.columns
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((int(a), b, c)) for a, b, c in want)
    if end == "\n":
        assert sorted(map(tuple, found)) == sorted(map(tuple, whole))
    assert kinds == ["int", "string", "string"] and columns == (["id", "left\nside", "right"] if header else ["_c0", "_c1", "_c2"])


def test_inferred_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d,e,f,g\n1,9999999999,1.5,2024-01-31,2024-01-31 10:00:00,true,\n2,1,-2e3,2024-02-01,2024-02-01T11:00:00,FALSE,"x\ny"\n,,,,,,\n')
    got = files.read_delimited(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string"]
    assert got.count() == 3 and got.where("g like 'x%'").first().g == "x\ny"


def test_an_open_quote_ends_with_its_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\n2,y\n')
    assert quoted.records(spark, str(tmp_path / "t.csv")).where("not head").first().record == '1,"x\n2,y'
    (tmp_path / "none.csv").write_text("")
    assert files.read_delimited(spark, str(tmp_path / "none.csv"), schema="a int", multi_line=True).collect() == []


@pytest.mark.parametrize(
    ("text", "delimiter", "quote"),
    [("a;b\n'x;1';'y'\n'z';'it''s'\n", "semicolon", "'"), ('a,b\n"x,1",2\n"y",3\n', "comma", '"'), ("a|b\nit's|2\nthat's|3\n'tis|4\n", "pipe", '"'), ("a\tb\n'1'\t\"x\"\n2\t\"y\"\n3\t\"z\"\n", "tab", '"')],
)
def test_quote_of_a_dialect(spark, tmp_path, text, delimiter, quote):
    (tmp_path / "d.csv").write_text(text)
    got = dialect.dialects(spark, str(tmp_path / "d.csv")).first()
    assert (got.delimiter, got.quote, got.fields) == (delimiter, quote, 2)


def test_a_file_of_a_header_alone_goes_with_its_like(spark, tmp_path):
    # as written where the first task has no rows
    for name, text in (("a", "k|v\n"), ("b", "k|v\nx|1\n"), ("c", "k|v\ny|2\n"), ("d", "p,q\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r.file[-5]: (r.delimiter, r.fields, r.header) for r in dialect.dialects(spark, str(tmp_path)).collect()}
    assert got == {"a": ("pipe", 2, True), "b": ("pipe", 2, True), "c": ("pipe", 2, True), "d": ("comma", 2, False)}


def test_a_header_alone_shows_no_quotes_of_its_own(spark, tmp_path):
    for name, text in (("a", "k;note\n"), ("b", "k;note\n1;'x; it''s'\n2;'y; it''s'\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r.file[-5]: (r.delimiter, r.quote, r.fields, r.quoted) for r in dialect.dialects(spark, str(tmp_path)).collect()}
    assert got == {"a": ("semicolon", "'", 2, True), "b": ("semicolon", "'", 2, True)}


def test_files_of_a_single_row_show_their_quotes(spark, tmp_path):
    # e and f have nothing that tells quotes from prose: e goes with its like, f has none
    texts = {"a": "k;note\n1;'x; it''s'\n", "b": "k;note\n1;'x; it''s'\n2;'y; it''s'\n", "e": "k;note\n1;'it''s'\n", "f": "k;text\n1;'tis what they say'\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r.file[-5]: (r.delimiter, r.quote, r.fields, r.share) for r in dialect.dialects(spark, str(tmp_path)).collect()}
    assert got == {"a": ("semicolon", "'", 2, 1.0), "b": ("semicolon", "'", 2, 1.0), "e": ("semicolon", "'", 2, 1.0), "f": ("semicolon", '"', 2, 1.0)}
    alone = dialect.dialects(spark, str(tmp_path / "a.csv")).first()
    assert (alone.delimiter, alone.quote, alone.fields) == ("semicolon", "'", 2)
