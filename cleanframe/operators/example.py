"""Transform by example: programs as trees, their columns, and the choice among candidates over a table of examples."""

from __future__ import annotations

import json
import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.types import StepError, kind_of, named, new_name
from cleanframe.operators.numeric import spark_pattern
from cleanframe.plans.frame import Frame

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def compiled(df: DataFrame, program: dict) -> Column:
    """A program's column. Kinds: column, literal, slice, split, concat, regexExtract, regexReplace, case,
    datetimeFormat, arithmetic. Text kinds take the text form; case maps ASCII letters alone."""
    kind = program["kind"]
    sub = lambda key="input": compiled(df, program[key])
    if kind == "column":
        kind_of(df, program["name"])
        return named(program["name"])
    if kind == "literal":
        return F.lit(program["value"])
    if kind == "concat":
        return F.concat(*[compiled(df, p).cast("string") for p in program["parts"]])
    if kind == "arithmetic":
        a, b = sub("left"), sub("right")
        whole = all(p["kind"] != "column" or kind_of(df, p["name"]) == "integer" for p in (program["left"], program["right"])) and not any(isinstance(p.get("value"), float) for p in (program["left"], program["right"]))
        if program["operator"] == "divide":
            a, b = a.cast("double"), b.cast("double")
            return F.try_divide(a, b)
        if whole:
            a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
        else:
            a, b = a.cast("double"), b.cast("double")
        out = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b}[program["operator"]]()
        return out.cast("decimal(38,0)") if whole else out
    c = sub().cast("string")
    if kind == "slice":
        start, end = program["start"], program.get("end")
        n = F.length(c)
        a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
        b = n if end is None else F.least(F.lit(end), n) if end >= 0 else n + end
        return F.substring(c, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    if kind == "split":
        parts = F.split(c, r"\Q" + program["delimiter"] + r"\E", -1)
        i = program["index"]
        return F.get(parts, F.lit(i) if i >= 0 else F.size(parts) + i)
    if kind == "regexExtract":
        return F.when(F.regexp_like(c, F.lit(program["pattern"])), F.regexp_extract(c, program["pattern"], program.get("group", 0)))
    if kind == "regexReplace":
        return F.regexp_replace(c, F.lit(program["pattern"]), F.lit(program["replacement"]))
    if kind == "case":
        return F.translate(c, _UPPER, _LOWER) if program["to"] == "lower" else F.translate(c, _LOWER, _UPPER)
    if kind == "datetimeFormat":
        return F.date_format(c.try_cast("timestamp_ntz"), spark_pattern(program["format"]))
    raise StepError(f"no program kind {kind!r}")


def cost(program: dict) -> int:
    """Size of a program; literals cost by their length."""
    if program["kind"] == "literal":
        return 1 + len(str(program["value"]))
    below = [program[k] for k in ("input", "left", "right") if k in program] + program.get("parts", [])
    return 2 + sum(map(cost, below))


def by_example(frame: Frame, program: dict, new: str) -> Frame:
    return frame.with_df(frame.df.withColumn(new_name(frame.df, new), compiled(frame.df, program)))


def candidates(df: DataFrame, inputs: list[str], examples: list[tuple[dict, object]]) -> list[dict]:
    """Programs that a few examples suggest, each right for the first: copies, slices, splits, cases, joins of two
    columns, date formats and arithmetic."""
    row, wanted = examples[0]
    col = lambda c: {"kind": "column", "name": c}
    text = "" if wanted is None else str(wanted)
    found: list[dict] = []
    pieces: dict[str, list[tuple[dict, str]]] = {}
    for c in inputs:
        if row.get(c) is None:
            continue
        v, own = str(row[c]), [(col(c), str(row[c]))]
        for to, f in (("lower", str.lower), ("upper", str.upper)):
            if v.isascii() and f(v) != v:
                own.append(({"kind": "case", "to": to, "input": col(c)}, f(v)))
        for d in sorted(set(re.findall(r"[^\w\s]|\s", v))):
            parts = v.split(d)
            for i, p in enumerate(parts):
                own += [({"kind": "split", "delimiter": d, "index": j, "input": col(c)}, p) for j in (i, i - len(parts)) if p]
        for m in re.finditer(re.escape(text), v) if text else []:
            own.append(({"kind": "slice", "start": m.start(), "end": m.end(), "input": col(c)}, text))
            own.append(({"kind": "slice", "start": m.start(), "end": None, "input": col(c)}, v[m.start() :]))
        for m in re.finditer(r"\d+", v):
            own.append(({"kind": "regexExtract", "pattern": r"\d+", "group": 0, "input": col(c)}, re.search(r"\d+", v)[0]))
            break
        pieces[c] = own
        found += [p for p, t in own if t == text]
        if re.match(r"\d{4}-\d{2}-\d{2}", v):
            y, m, d = v[:4], v[5:7], v[8:10]
            for form, t in (("%m/%Y", f"{m}/{y}"), ("%d/%m/%Y", f"{d}/{m}/{y}"), ("%Y", y), ("%m", m), ("%d", d), ("%Y/%m/%d", f"{y}/{m}/{d}")):
                if t == text:
                    found.append({"kind": "datetimeFormat", "format": form, "input": col(c)})
    for a, b in permutations(pieces, 2):
        for pa, ta in pieces[a]:
            for pb, tb in pieces[b]:
                if ta and tb and text.startswith(ta) and text.endswith(tb) and len(ta) + len(tb) <= len(text):
                    gap = text[len(ta) : len(text) - len(tb)]
                    if len(gap) <= 8:
                        found.append({"kind": "concat", "parts": [pa, *([{"kind": "literal", "value": gap}] if gap else []), pb]})
        if kind_of(df, a) in ("integer", "float") and kind_of(df, b) in ("integer", "float") and isinstance(wanted, (int, float)):
            for op, value in (("add", row[a] + row[b]), ("subtract", row[a] - row[b]), ("multiply", row[a] * row[b])):
                if abs(value - wanted) <= 1e-9 * max(1, abs(wanted)):
                    found.append({"kind": "arithmetic", "operator": op, "left": col(a), "right": col(b)})
    unique = {json.dumps(p, sort_keys=True): p for p in found}
    return [unique[k] for k in sorted(unique, key=lambda k: (cost(unique[k]), k))]


def ranked(examples: DataFrame, inputs: list[str], output: str, seeds: int = 3) -> DataFrame:
    """`program, cost, matched, rows, rank`: every candidate scored on the whole table of examples in one aggregate.

    Programs that give `output` on all rows come first, the cheapest before others, ties by their JSON; two first
    ranks of equal cost mean that the examples leave a choice. Only `seeds` rows reach the driver, to suggest candidates.
    """
    few = [r.asDict() for r in examples.where(named(output).isNotNull()).select(*[named(c) for c in [*inputs, output]]).orderBy(*[named(c) for c in [*inputs, output]]).limit(seeds).collect()]
    spark = examples.sparkSession
    programs = {json.dumps(p, sort_keys=True): p for r in few for p in candidates(examples, inputs, [(r, r[output])])}
    if not programs:
        return spark.createDataFrame([], "program string, cost long, matched long, rows long, rank long")
    texts = sorted(programs, key=lambda k: (cost(programs[k]), k))
    number = kind_of(examples, output) in ("integer", "float", "decimal")
    wanted = named(output).cast("double") if number else named(output).cast("string")

    def right(p: dict) -> Column:
        got = compiled(examples, p)
        same = F.abs(got.try_cast("double") - wanted) <= F.greatest(F.abs(wanted), F.lit(1.0)) * 1e-9 if number else got.cast("string") == wanted
        return F.sum(F.when(F.coalesce(same, got.isNull() & wanted.isNull()), 1).otherwise(0))

    scored = examples.agg(F.count("*").alias("n"), *[right(programs[t]).alias(f"p{i}") for i, t in enumerate(texts)])
    cells = F.array(*[F.struct(F.lit(t).alias("program"), F.lit(cost(programs[t])).cast("long").alias("cost"), F.col(f"p{i}").alias("matched"), F.col("n").alias("rows")) for i, t in enumerate(texts)])
    flat = scored.select(F.inline(cells))
    order = F.array_sort(F.collect_list(F.struct((-F.col("matched")).alias("m"), "cost", "program", "rows")))
    out = flat.agg(order.alias("x")).select(F.posexplode("x").alias("i", "x"))
    return out.select("x.program", "x.cost", (-F.col("x.m")).alias("matched"), "x.rows", (F.col("i") + 1).cast("long").alias("rank"))
