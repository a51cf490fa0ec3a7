"""The registered queries of the cleaning and profiling steps, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanframe.functions.types import StepError
from cleanframe.operators import fill as fill_steps
from cleanframe.operators import profile
from cleanframe.operators.example import ranked
from cleanframe.plans.diff import diff_counts, step_diff
from cleanframe.plans.filters import FilterModel, page
from cleanframe.plans.frame import ROW, Frame, SortRule
from cleanframe.plans.recipe import Recipe, Step
from cleanframe.sources import dialect, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Missing values for the steps that need some: the tables have none.
EVENTS_SQL = """(SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 13 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 0 OR event_id % 50 < 4 THEN NULL ELSE value END AS value, props FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    value = F.when(i % 13 == 0, F.lit(float("nan"))).when((i % 7 != 0) & (i % 50 >= 4), F.col("value"))
    return e.withColumns({"event_type": F.when(i % 11 != 0, F.col("event_type")), "value": value})


BY_ID = (SortRule("event_id"),)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def step(name: str, source: str, columns: list[str], sql: str, *steps: tuple[str, dict]) -> None:
    """A query of recipe steps over the named columns of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir) if source == "events" else table(spark, sf_dir, source)
        recipe = Recipe()
        for kind, params in steps:
            recipe = recipe.then(kind, **params)
        return recipe.apply(Frame(df.select(*columns), BY_ID if source == "events" and "event_id" in columns else ())).result()

    QUERIES[name], ORACLE[name] = run, sql


# -- flagship: filter, then group ---------------------------------------------------------------------------
step(
    "filter_group", "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"],
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_quantity) AS avg_qty, count(l_quantity) AS n
       FROM lineitem WHERE l_quantity > 10 GROUP BY ALL""",
    ("filterRows", {"filterModel": {"filters": [{"column": "l_quantity", "predicates": [{"operator": "gt", "value": "10"}]}]}}),
    ("groupBy", {"keys": ["l_returnflag", "l_linestatus"], "aggregations": [{"column": "l_quantity", "operation": o, "alias": a} for o, a in (("sum", "sum_qty"), ("mean", "avg_qty"), ("count", "n"))]}),
)

# -- sources and sinks --------------------------------------------------------------------------------------


def _round_trip(spark: SparkSession, df: DataFrame, write: Callable, read: Callable) -> DataFrame:
    """Written to a new folder of the shared ones, and read back. Only a local session may do without a shared folder."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise StepError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(folder or tempfile.mkdtemp(prefix='cleanframe-')).rstrip('/')}/export-{uuid.uuid4().hex}"
    write(df, path)
    return read(spark, path)


CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("csv_round_trip", CUSTOMER_SQL)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return _round_trip(spark, df, lambda d, p: files.write_delimited(d, p, ";"), lambda s, p: files.read_delimited(s, p, ";", schema=CUSTOMER))


@query("tsv_inferred", CUSTOMER_SQL)
def tsv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return _round_trip(spark, df, lambda d, p: files.write_delimited(d, p, "\t"), lambda s, p: files.read_delimited(s, p, "\t")).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("csv_encoded_round_trip", "SELECT c_custkey, 'Größe ' || c_name AS c_name FROM customer")
def csv_encoded_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Größe "), "c_name").alias("c_name"))
    return _round_trip(spark, df, lambda d, p: files.write_delimited(d, p, encoding="ISO-8859-1"), lambda s, p: files.read_delimited(s, p, encoding="ISO-8859-1", schema="c_custkey bigint, c_name string"))


@query("csv_utf16", "SELECT c_custkey, 'Größe 日本 ' || c_name AS c_name FROM customer")
def csv_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Größe 日本 "), "c_name").alias("c_name"))
    return _round_trip(spark, df, lambda d, p: files.write_delimited(d, p, encoding="UTF-16"), lambda s, p: files.read_delimited(s, p, encoding="UTF-16", schema="c_custkey bigint, c_name string"))


@query("csv_quoted_inferred", "SELECT c_custkey::BIGINT AS c_custkey, c_acctbal, c_name || chr(10) || 'x' AS note FROM customer")
def csv_quoted_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.concat("c_name", F.lit("\nx")).alias("note"))
    return _round_trip(spark, df, files.write_delimited, lambda s, p: files.read_delimited(s, p, multi_line=True)).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("dialect_quotes", "SELECT 'semicolon' AS delimiter, chr(39) AS quote, 2::BIGINT AS fields, count(*) > 0 AS found FROM customer")
def dialect_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("; it's "), "c_mktsegment").alias("note"))
    got = _round_trip(spark, df, lambda d, p: files.write_delimited(d, p, ";", quote="'"), dialect.dialects)
    return got.groupBy("delimiter", "quote", "fields").agg((F.count("*") > 0).alias("found"))


@query("csv_lossy_utf8", "SELECT c_custkey, 'Gr' || chr(65533) || 'n ' || c_name AS c_name FROM customer")
def csv_lossy_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Grün "), "c_name").alias("c_name"))
    return _round_trip(spark, df, lambda d, p: files.write_delimited(d, p, encoding="ISO-8859-1"), lambda s, p: files.read_delimited(s, p, schema="c_custkey bigint, c_name string"))


@query("csv_quoted_lines", "SELECT c_custkey, c_name || chr(10) || '\"' || c_mktsegment || '\", x' AS note FROM customer")
def csv_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", x')).alias("note"))
    return _round_trip(spark, df, files.write_delimited, lambda s, p: files.read_delimited(s, p, schema="c_custkey bigint, note string", multi_line=True))


@query("csv_blank_files", "SELECT 0::BIGINT AS columns, 0::BIGINT AS rows FROM customer LIMIT 1")
def csv_blank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = table(spark, sf_dir, "customer").select(F.translate(F.substring("c_name", 1, 3), "Custom", "  \t").alias("value"))
    got = _round_trip(spark, blank, lambda d, p: d.write.text(p), files.read_delimited)
    return got.agg(F.lit(len(got.columns)).cast("long").alias("columns"), F.count(F.lit(1)).alias("rows"))


@query("export_refuses", "SELECT c_custkey, true AS refused FROM customer WHERE c_custkey <= 20")
def export_refuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second export to the same place is refused, and leaves the first one as it was."""
    from pyspark.errors import AnalysisException

    df, refused = table(spark, sf_dir, "customer").select("c_custkey"), []

    def write(d: DataFrame, path: str) -> None:
        files.write_parquet(d.where("c_custkey <= 20"), path)
        try:
            files.write_parquet(d, path)
        except AnalysisException:
            refused.append(path)

    return _round_trip(spark, df, write, files.read_parquet).withColumn("refused", F.lit(bool(refused)))


@query("session_table", "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus FROM orders WHERE o_totalprice > 300000")
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the session, by its name."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("cleanframe_orders")
    recipe = Recipe().then("filterRows", filterModel={"filters": [on("o_totalprice", ("gt", "300000"))]}).then("lowerText", column="o_orderstatus").then("selectColumns", columns=["o_orderkey", "o_orderstatus"])
    return recipe.apply(spark.table("cleanframe_orders")).df


@query("json_lines_round_trip", CUSTOMER_SQL)
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "customer"), files.write_json_lines, lambda s, p: files.read_json_lines(s, p, CUSTOMER))


@query("parquet_round_trip", CUSTOMER_SQL)
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "customer"), files.write_parquet, files.read_parquet)


@query("dialect_profile", "SELECT 'pipe' AS delimiter, 5::BIGINT AS fields, true AS header, count(*) > 0 AS found FROM customer")
def dialect_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    got = _round_trip(spark, df, lambda d, p: files.write_delimited(d, p, "|"), dialect.dialects)
    return got.groupBy("delimiter", "fields", "header").agg((F.count("*") > 0).alias("found"))


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = Frame(table(spark, sf_dir, "orders"), (SortRule("o_totalprice", True), SortRule("o_orderkey")))
    return page(frame, 100, 50, ["o_orderkey", "o_totalprice"])


# -- filters and sorts --------------------------------------------------------------------------------------


def filters(name: str, source: str, columns: list[str], where: str, *column_filters: dict, logic: str = "and", sort: list | None = None) -> None:
    base = EVENTS_SQL if source == "events" else source
    step(name, source, columns, f"SELECT {', '.join(columns)} FROM {base} WHERE {where}", ("filterRows", {"filterModel": {"logic": logic, "filters": list(column_filters), "sort": sort or []}}))


def on(column: str, *predicates: tuple, logic: str = "and", **more) -> dict:
    return {"column": column, "logic": logic, "predicates": [{"operator": p[0], "value": p[1] if len(p) > 1 else None, "secondValue": p[2] if len(p) > 2 else None} for p in predicates]} | more


filters("filter_compound", "lineitem", ["l_orderkey", "l_quantity", "l_discount", "l_returnflag"], "(l_quantity < 5 OR l_quantity >= 45) AND l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('A', 'R')",
        on("l_quantity", ("lt", "5"), ("gte", "45"), logic="or"), on("l_discount", ("between", "0.02", "0.05")), on("l_returnflag", selectedValues=["A", "R"]))
filters("filter_any", "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], "o_orderstatus = 'P' OR o_totalprice > 400000", on("o_orderstatus", ("equals", "P")), on("o_totalprice", ("gt", "400000")), logic="or")
filters("filter_contains", "customer", ["c_custkey", "c_mktsegment"], "lower(c_mktsegment) LIKE '%build%'", on("c_mktsegment", ("contains", "BuIlD")))
filters("filter_starts_ends", "part", ["p_partkey", "p_name"], "p_name LIKE 's%' AND p_name LIKE '%t'", on("p_name", ("startsWith", "s"), ("endsWith", "t")))
filters("filter_nulls", "events", ["event_id", "event_type"], "event_type IS NULL", on("event_type", ("isNull",)))
filters("filter_not_nulls", "events", ["event_id", "event_type"], "event_type IS NOT NULL", on("event_type", ("isNotNull",)))
filters("filter_nan", "events", ["event_id"], "event_id % 13 = 0", on("value", ("isNaN",)))
QUERIES["filter_nan"] = lambda spark, sf_dir: FilterModel.from_json({"filters": [on("value", ("isNaN",))]}).apply(Frame(events(spark, sf_dir))).df.select("event_id")
filters("filter_not_nan", "events", ["event_id"], "event_id % 13 <> 0", on("value", ("isNotNaN",)))
QUERIES["filter_not_nan"] = lambda spark, sf_dir: FilterModel.from_json({"filters": [on("value", ("isNotNaN",))]}).apply(Frame(events(spark, sf_dir))).df.select("event_id")
filters("filter_not_equals", "events", ["event_id", "event_type"], "event_type <> 'click'", on("event_type", ("notEquals", "click")))
filters("filter_values_and_nulls", "events", ["event_id", "event_type"], "event_type IN ('view', 'error') OR event_type IS NULL", on("event_type", selectedValues=["view", "error"], includeNulls=True))
filters("filter_time", "orders", ["o_orderkey", "o_orderdate"], "o_orderdate < TIMESTAMP '1996-01-01' AND o_orderdate >= TIMESTAMP '1995-06-01'", on("o_orderdate", ("lt", "1996-01-01"), ("gte", "1995-06-01T00:00:00")))


@query("filter_duration", "SELECT event_id FROM events WHERE event_id BETWEEN 600 AND 3723 OR event_id = 90")
def filter_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.make_dt_interval(secs=F.col("event_id")).alias("spent"))
    model = {"filters": [on("spent", ("between", "599.5", "0 days, 01:02:03")), on("spent", ("equals", "90"))], "logic": "or"}
    return FilterModel.from_json(model).filtered(df).select("event_id")


@query("filter_decimal", "SELECT o_orderkey FROM orders WHERE o_totalprice::DECIMAL(14, 2) >= 125000 AND o_totalprice::DECIMAL(14, 2) < 300000.25")
def filter_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    return FilterModel.from_json({"filters": [on("price", ("gte", ".125e+6"), ("lt", "300000.25"), type="decimal")]}).filtered(df).select("o_orderkey")


@query("filter_type_check", "SELECT l_orderkey, l_linenumber, true AS refused FROM lineitem WHERE l_quantity = 7")
def filter_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter made for another type is refused; that for the column's own type applies."""
    df, refused = table(spark, sf_dir, "lineitem"), False
    try:
        FilterModel.from_json({"filters": [on("l_quantity", ("equals", "7"), type="string")]}).filtered(df)
    except StepError:
        refused = True
    return FilterModel.from_json({"filters": [on("l_quantity", ("equals", "7"), type="float")]}).filtered(df).select("l_orderkey", "l_linenumber", F.lit(refused).alias("refused"))


@query("filter_carried_over", "SELECT p_partkey, p_size::VARCHAR AS p_size FROM part WHERE p_name LIKE 's%'")
def filter_carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of columns that are gone or of another type now are left out, the others stay."""
    before = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    after = Recipe().then("castColumn", column="p_size", dtype="string").then("dropColumns", columns=["p_brand"]).apply(before).df
    model = FilterModel.from_json({"filters": [on("p_name", ("startsWith", "s")), on("p_size", ("gt", "10")), on("p_brand", ("equals", "x"))]})
    return model.reconciled(before.schema, after.schema).filtered(after).select("p_partkey", "p_size")


step("sort_rows", "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"], "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders",
     ("sortRows", {"rules": [{"column": "o_orderpriority"}, {"column": "o_totalprice", "direction": "desc", "nulls": "first"}]}))


@query("top_k_after_sort", f"SELECT event_id, value FROM {EVENTS_SQL} WHERE value IS NOT NULL AND NOT isnan(value) ORDER BY value DESC, event_id LIMIT 25")
def top_k_after_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = Recipe().then("dropMissingRows", columns=["value"]).then("sortRows", rules=[{"column": "value", "direction": "desc"}]).apply(Frame(events(spark, sf_dir), BY_ID))
    return page(frame, 0, 25, ["event_id", "value"])


# -- rows ---------------------------------------------------------------------------------------------------
GONE = "(value IS NULL OR isnan(value))"
step("drop_missing_any", "events", ["event_id", "event_type", "value"], f"SELECT event_id, event_type, value FROM {EVENTS_SQL} WHERE NOT (event_type IS NULL OR {GONE})", ("dropMissingRows", {"columns": ["event_type", "value"], "how": "any"}))
step("drop_missing_all", "events", ["event_id", "event_type"], f"SELECT event_id, event_type FROM {EVENTS_SQL} WHERE NOT (event_type IS NULL AND {GONE})", ("dropMissingRows", {"columns": ["event_type", "value"], "how": "all"}))
QUERIES["drop_missing_all"] = lambda spark, sf_dir: Recipe().then("dropMissingRows", columns=["event_type", "value"], how="all").apply(Frame(events(spark, sf_dir))).df.select("event_id", "event_type")
for keep, rank in (("first", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"), ("last", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"), ("none", "count(*) OVER (PARTITION BY user_id, event_type) = 1")):
    step(f"dedupe_{keep}", "events", ["event_id", "user_id", "event_type"], f"SELECT event_id, user_id, event_type FROM {EVENTS_SQL} QUALIFY {rank}", ("dropDuplicates", {"columns": ["user_id", "event_type"], "keep": keep}))


@query("dedupe_descending", f"SELECT event_id, user_id, event_type FROM {EVENTS_SQL} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY props DESC NULLS LAST, event_id DESC) = 1")
def dedupe_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal rows by a descending text, then a descending number."""
    frame = Frame(events(spark, sf_dir).select("event_id", "user_id", "event_type", "props"), (SortRule("props", True), SortRule("event_id", True)))
    return Recipe().then("dropDuplicates", columns=["user_id", "event_type"]).apply(frame).df.select("event_id", "user_id", "event_type")


step("dedupe_rows", "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"], "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", ("dropDuplicates", {}))

# -- columns ------------------------------------------------------------------------------------------------
step("select_columns", "part", ["p_partkey", "p_name", "p_size"], "SELECT p_size, p_partkey FROM part", ("selectColumns", {"columns": ["p_size", "p_partkey"]}))
step("drop_columns", "part", ["p_partkey", "p_name", "p_size"], "SELECT p_partkey, p_name FROM part", ("dropColumns", {"columns": ["p_size"]}))
step("rename_column", "part", ["p_partkey", "p_size"], "SELECT p_partkey, p_size AS size FROM part", ("renameColumn", {"column": "p_size", "newName": "size"}))
step("clone_column", "part", ["p_partkey", "p_size"], "SELECT p_partkey, p_size, p_size AS copy FROM part", ("cloneColumn", {"column": "p_size", "newName": "copy"}))
step("cast_integer", "lineitem", ["l_orderkey", "l_extendedprice"], "SELECT l_orderkey, trunc(l_extendedprice)::BIGINT AS l_extendedprice FROM lineitem", ("castColumn", {"column": "l_extendedprice", "dtype": "integer"}))
step("cast_text", "part", ["p_partkey", "p_size"], "SELECT p_partkey, p_size::VARCHAR AS p_size FROM part", ("castColumn", {"column": "p_size", "dtype": "string"}))
step("cast_bad_text", "part", ["p_partkey", "p_brand"], "SELECT p_partkey, try_cast(p_brand AS BIGINT) AS p_brand FROM part", ("castColumn", {"column": "p_brand", "dtype": "integer"}))
step("cast_date", "orders", ["o_orderkey", "o_orderdate"], "SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders", ("castColumn", {"column": "o_orderdate", "dtype": "date"}))
for op, sql in (("add", "l_quantity + l_tax"), ("subtract", "l_quantity - l_tax"), ("multiply", "l_quantity * l_discount"), ("divide", "CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_quantity / l_discount END")):
    step(f"formula_{op}", "lineitem", ["l_orderkey", "l_quantity", "l_tax", "l_discount"], f"SELECT l_orderkey, l_quantity, l_tax, l_discount, {sql} AS r FROM lineitem", ("formula", {"leftColumn": "l_quantity", "operator": op, "rightColumn": "l_discount" if op in ("multiply", "divide") else "l_tax", "newColumn": "r"}))
step("formula_modulo", "lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, l_orderkey % l_linenumber AS r FROM lineitem", ("formula", {"leftColumn": "l_orderkey", "operator": "modulo", "rightColumn": "l_linenumber", "newColumn": "r"}))
step("formula_power", "lineitem", ["l_linenumber"], "SELECT l_linenumber, pow(l_linenumber::DOUBLE, 3) AS r FROM lineitem", ("formula", {"leftColumn": "l_linenumber", "operator": "power", "value": 3, "newColumn": "r"}))
step("text_length", "documents", ["doc_id", "text"], "SELECT doc_id, length(text) AS n FROM documents", ("textLength", {"column": "text", "newColumn": "n"}), ("dropColumns", {"columns": ["text"]}))

# -- text ---------------------------------------------------------------------------------------------------
step("find_replace", "part", ["p_partkey", "p_name"], "SELECT p_partkey, replace(p_name, 'ring', '<r>') AS p_name FROM part", ("findReplace", {"column": "p_name", "find": "ring", "replacement": "<r>"}))
step("find_replace_regex", "pages", ["page_id", "url"], r"SELECT page_id, regexp_replace(url, '^https?://([^/]+)/', '[\1] ', 'g') AS url FROM pages", ("findReplace", {"column": "url", "find": "^https?://([^/]+)/", "replacement": r"[\1] ", "regex": True}))
step("find_replace_empty", "part", ["p_partkey", "p_brand"], "SELECT p_partkey, '-' || array_to_string(string_split(p_brand, ''), '-') || '-' AS p_brand FROM part", ("findReplace", {"column": "p_brand", "find": "", "replacement": "-"}))
step("strip_text", "customer", ["c_custkey", "c_name"], "SELECT c_custkey, trim(c_name, 'Cr0') AS c_name FROM customer", ("stripText", {"column": "c_name", "characters": "Cr0"}))
step("split_text", "pages", ["page_id", "url"], "SELECT page_id, url, string_split(url, '/')[3] AS host FROM pages", ("splitText", {"column": "url", "delimiter": "/", "index": 2, "newColumn": "host"}))
step("split_text_columns", "part", ["p_partkey", "p_name"], "SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, string_split(p_name, ' ')[3] AS c FROM part", ("splitTextColumns", {"column": "p_name", "delimiter": " ", "newColumns": ["a", "b", "c"]}))
step("extract_regex", "pages", ["page_id", "url"], r"SELECT page_id, CASE WHEN regexp_matches(url, '/(en|de|fr|es)/(\d+)') THEN regexp_extract(url, '/(en|de|fr|es)/(\d+)', 1) END AS lang FROM pages", ("extractRegexGroup", {"column": "url", "pattern": r"/(en|de|fr|es)/(\d+)", "group": 1, "newColumn": "lang"}), ("dropColumns", {"columns": ["url"]}))
step("capitalize_text", "part", ["p_partkey", "p_name"], "SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS p_name FROM part", ("capitalizeText", {"column": "p_name"}))
step("lower_text", "customer", ["c_custkey", "c_mktsegment"], "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer", ("lowerText", {"column": "c_mktsegment"}))
step("upper_text", "part", ["p_partkey", "p_name"], "SELECT p_partkey, p_name, upper(p_name) AS u FROM part", ("upperText", {"column": "p_name", "newColumn": "u"}))

# -- encoders -----------------------------------------------------------------------------------------------
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
step("one_hot", "orders", ["o_orderkey", "o_orderpriority"], "SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{p}')::TINYINT AS \"o_orderpriority_{p}\"" for p in PRIORITIES) + " FROM orders", ("oneHotEncode", {"columns": ["o_orderpriority"]}))
step("multi_label", "part", ["p_partkey", "p_name"], "SELECT p_partkey, p_name, list_contains(string_split(p_name, ' '), 'red')::TINYINT AS has_red, list_contains(string_split(p_name, ' '), 'widget')::TINYINT AS has_widget FROM part", ("multiLabelBinarize", {"column": "p_name", "delimiter": " ", "prefix": "has_", "labels": ["red", "widget"]}))


@query("multi_label_found", "SELECT w AS label, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def multi_label_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Recipe().then("multiLabelBinarize", column="p_name", delimiter=" ", prefix="=", dropOriginal=True).apply(table(spark, sf_dir, "part").select("p_partkey", "p_name")).df
    made = [c for c in df.columns if c.startswith("=")]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c[1:]).alias("label"), F.col(f"`{c}`").alias("v")) for c in made])))
    return long.groupBy("label").agg(F.sum("v").alias("n"))


# -- numbers and times --------------------------------------------------------------------------------------
step("min_max_scale", "lineitem", ["l_orderkey", "l_quantity"], "SELECT l_orderkey, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS l_quantity FROM lineitem", ("minMaxScale", {"column": "l_quantity"}))
step("round_number", "lineitem", ["l_orderkey", "l_extendedprice"], "SELECT l_orderkey, l_extendedprice, round_even(l_extendedprice, 1) AS r FROM lineitem", ("roundNumber", {"column": "l_extendedprice", "decimals": 1, "newColumn": "r"}))
step("floor_number", "lineitem", ["l_orderkey", "l_extendedprice"], "SELECT l_orderkey, floor(l_extendedprice) AS l_extendedprice FROM lineitem", ("floorNumber", {"column": "l_extendedprice"}))
step("ceil_number", "lineitem", ["l_orderkey", "l_extendedprice"], "SELECT l_orderkey, ceil(l_extendedprice) AS l_extendedprice FROM lineitem", ("ceilNumber", {"column": "l_extendedprice"}))
step("format_datetime", "orders", ["o_orderkey", "o_orderdate"], "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y, %H:%M (%j)') AS o_orderdate FROM orders", ("formatDatetime", {"column": "o_orderdate", "format": "%d %b %Y, %H:%M (%j)"}))

# -- reshape and aggregate ----------------------------------------------------------------------------------
step("pivot_longer", "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_tax"], "SELECT l_orderkey, l_linenumber, 'l_discount' AS what, l_discount AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem", ("pivotLonger", {"columns": ["l_discount", "l_tax"], "labelColumn": "what", "valueColumn": "amount"}), ("selectColumns", {"columns": ["l_orderkey", "l_linenumber", "what", "amount"]}))
QUERIES["pivot_longer"] = lambda spark, sf_dir: Recipe().then("pivotLonger", columns=["l_discount", "l_tax"], labelColumn="what", valueColumn="amount").apply(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")).df.drop("__cleanframe_at")
KINDS = ["click", "error", "purchase", "signup", "view"]
step("pivot_wider", "events", ["user_id", "event_type", "event_id"], f"SELECT user_id, {', '.join(f'''max(CASE WHEN event_type = '{k}' THEN event_id END) AS {k}''' for k in KINDS)} FROM {EVENTS_SQL} WHERE event_type IS NOT NULL GROUP BY user_id",
     ("dropMissingRows", {"columns": ["event_type"]}), ("groupBy", {"keys": ["user_id", "event_type"], "aggregations": [{"column": "event_id", "operation": "max", "alias": "m"}]}), ("pivotWider", {"namesFrom": "event_type", "valuesFrom": "m", "outputs": [{"key": k, "name": k} for k in KINDS]}))
OPS = [("event_id", "sum", "s"), ("event_id", "mean", "me"), ("event_id", "min", "lo"), ("value", "max", "hi"), ("value", "median", "md"), ("value", "count", "n"), ("event_type", "nUnique", "u"), ("value", "first", "f"), ("event_type", "last", "l")]
step("group_by", "events", ["event_id", "user_id", "event_type", "value"], f"""
    SELECT user_id, sum(event_id)::DECIMAL(38, 0) AS s, avg(event_id) AS me, min(event_id) AS lo, max(v) AS hi, median(v) AS md, count(v) AS n, count(DISTINCT event_type) AS u,
           arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS f, arg_max(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS l
    FROM (SELECT *, CASE WHEN NOT isnan(value) THEN value END AS v FROM {EVENTS_SQL}) GROUP BY user_id""",
     ("groupBy", {"keys": ["user_id"], "aggregations": [{"column": c, "operation": o, "alias": a} for c, o, a in OPS]}))
step("group_by_text_extremes", "lineitem", ["l_linenumber", "l_returnflag", "l_shipdate"], "SELECT l_linenumber, min(l_returnflag) AS a, max(l_shipdate) AS b, count(l_returnflag) AS n FROM lineitem GROUP BY l_linenumber",
     ("groupBy", {"keys": ["l_linenumber"], "aggregations": [{"column": "l_returnflag", "operation": "min", "alias": "a"}, {"column": "l_shipdate", "operation": "max", "alias": "b"}, {"column": "l_returnflag", "operation": "count", "alias": "n"}]}))

step("group_by_medians", "lineitem", ["l_returnflag", "l_discount", "l_extendedprice", "l_linenumber"], "SELECT l_returnflag, median(l_discount) AS d, median(l_extendedprice) AS p, median(l_linenumber)::DOUBLE AS n, count(l_discount) AS c FROM lineitem GROUP BY l_returnflag",
     ("groupBy", {"keys": ["l_returnflag"], "aggregations": [{"column": "l_discount", "operation": "median", "alias": "d"}, {"column": "l_extendedprice", "operation": "median", "alias": "p"}, {"column": "l_linenumber", "operation": "median", "alias": "n"}, {"column": "l_discount", "operation": "count", "alias": "c"}]}))


def _shown(frame: Frame, rows: int, columns: list[str]) -> DataFrame:
    """The first rows of a frame and their places: a page, so few."""
    return page(frame, 0, rows, columns).withColumn("n", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


@query("group_order", f"SELECT user_id, s, n FROM (SELECT user_id, sum(event_id)::DECIMAL(38, 0) AS s, row_number() OVER (ORDER BY max(event_id) DESC) AS n FROM {EVENTS_SQL} GROUP BY user_id) WHERE n <= 20")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups keep the order of their first rows, here by descending id, for the steps that follow."""
    frame = Frame(events(spark, sf_dir).select("event_id", "user_id"), (SortRule("event_id", True),))
    grouped = Recipe().then("groupBy", keys=["user_id"], aggregations=[{"column": "event_id", "operation": "sum", "alias": "s"}]).apply(frame)
    return _shown(grouped, 20, ["user_id", "s"])


@query("pivot_order", "SELECT l_orderkey, a, n FROM (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, row_number() OVER (ORDER BY l_orderkey DESC) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey) WHERE n <= 30")
def pivot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivoted rows keep the order of the first rows of their ids."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    frame = Frame(rows.withColumn(ROW, F.col("l_orderkey") * 10 + F.col("l_linenumber")), (SortRule(ROW, True),))
    wide = Recipe().then("pivotWider", namesFrom="l_linenumber", valuesFrom="q", outputs=[{"key": 1, "name": "a"}, {"key": 2, "name": "b"}]).apply(frame)
    return _shown(wide, 30, ["l_orderkey", "a"])


# -- fills --------------------------------------------------------------------------------------------------
FILL = ["event_id", "user_id", "event_type", "value"]


def fill(name: str, column: str, sql: str, columns: list[str] = FILL, source: str = EVENTS_SQL, **replacement) -> None:
    step(name, "events", columns, f"SELECT {', '.join(c if c != column else f'{sql} AS {column}' for c in columns)} FROM {source}", ("fillMissingValues", {"column": column, "replacement": replacement}))


fill("fill_value", "value", f"CASE WHEN {GONE} THEN -1 ELSE value END", kind="value", value="-1")
fill("fill_value_text", "event_type", "coalesce(event_type, 'none')", kind="value", value="none")
fill("fill_median", "value", f"CASE WHEN {GONE} THEN (SELECT median(CASE WHEN NOT isnan(value) THEN value END) FROM {EVENTS_SQL}) ELSE value END", kind="median")
fill("fill_mode", "event_type", f"coalesce(event_type, (SELECT event_type FROM {EVENTS_SQL} WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC LIMIT 1))", kind="mostFrequent")
fill("fill_grouped_median", "value", f"CASE WHEN {GONE} THEN median(CASE WHEN NOT isnan(value) THEN value END) OVER (PARTITION BY user_id) ELSE value END", kind="groupedStatistic", keys=["user_id"], statistic="median")
fill("fill_grouped_mode", "event_type", f"""CASE WHEN event_type IS NULL THEN (SELECT CASE WHEN count(*) = 1 THEN max(t) END FROM (SELECT user_id AS u, event_type AS t, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r
    FROM {EVENTS_SQL} WHERE event_type IS NOT NULL GROUP BY user_id, event_type) AS m WHERE m.u = e.user_id AND m.r = 1) ELSE event_type END""", source=EVENTS_SQL + " AS e", kind="groupedStatistic", keys=["user_id"], statistic="mostFrequent")  # fmt: skip
PLACED = f"""(SELECT *, coalesce(nx, tot + 1) - coalesce(pv, 0) - 1 AS gap FROM (SELECT *, CASE WHEN NOT {GONE} THEN value END AS v, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS tot,
    max(CASE WHEN NOT {GONE} THEN event_id + 1 END) OVER (ORDER BY event_id) AS pv, min(CASE WHEN NOT {GONE} THEN event_id + 1 END) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM {EVENTS_SQL}))"""
BEFORE = "last_value(v IGNORE NULLS) OVER (ORDER BY event_id)"
AFTER = "first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
fill("fill_forward", "value", f"CASE WHEN {GONE} THEN coalesce({BEFORE}, value) ELSE value END", source=PLACED, kind="directional", direction="forward")
fill("fill_forward_gap", "value", f"CASE WHEN {GONE} AND gap <= 2 THEN coalesce({BEFORE}, value) ELSE value END", columns=[*FILL, "ts"], source=PLACED, kind="directional", direction="forward", orderBy=[{"column": "ts"}], maxGap=2)
fill("fill_backward", "value", f"CASE WHEN {GONE} AND gap <= 3 THEN coalesce({AFTER}, value) ELSE value END", source=PLACED, kind="directional", direction="backward", orderBy=[{"column": "event_id"}], maxGap=3)
BY_TEXT = "PARTITION BY event_type ORDER BY lpad(user_id::VARCHAR, 12, '0') DESC, event_id"
fill("fill_forward_partitioned", "value", f"CASE WHEN {GONE} THEN coalesce(last_value(CASE WHEN NOT {GONE} THEN value END IGNORE NULLS) OVER ({BY_TEXT}), value) ELSE value END", kind="value", value="0")
PARTITIONED = Recipe().then("fillMissingValues", column="value", replacement={"kind": "directional", "direction": "forward", "orderBy": [{"column": "key", "direction": "desc"}], "partitionBy": ["event_type"]})
QUERIES["fill_forward_partitioned"] = lambda spark, sf_dir: PARTITIONED.apply(Frame(events(spark, sf_dir).select(*FILL, F.lpad(F.col("user_id").cast("string"), 12, "0").alias("key")), BY_ID)).df.select(*FILL)
LINE = f"""(SELECT *, max(CASE WHEN NOT {GONE} THEN event_id END) OVER (ORDER BY event_id) AS xa, min(CASE WHEN NOT {GONE} THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xb,
    last_value(CASE WHEN NOT {GONE} THEN value END IGNORE NULLS) OVER (ORDER BY event_id) AS ya, first_value(CASE WHEN NOT {GONE} THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS yb FROM {EVENTS_SQL})"""
W = "((event_id - xa)::DOUBLE / (xb - xa)::DOUBLE)"
fill("fill_linear", "value", f"CASE WHEN {GONE} AND xa IS NOT NULL AND xb IS NOT NULL AND xb - xa - 1 <= 4 THEN ya * (1.0::DOUBLE - {W}) + yb * {W} ELSE value END", source=LINE, kind="linearInterpolation", coordinate="event_id", maxGap=4)


def _rounded(recipe: Recipe) -> Query:
    return lambda spark, sf_dir: recipe.apply(Frame(events(spark, sf_dir).select(*FILL), BY_ID)).result().withColumn("value", F.round("value", 6))


QUERIES["fill_mean"] = _rounded(Recipe().then("fillMissingValues", column="value", replacement={"kind": "mean"}))
ORACLE["fill_mean"] = f"SELECT event_id, user_id, event_type, round(CASE WHEN {GONE} THEN (SELECT avg(value) FROM {EVENTS_SQL} WHERE NOT {GONE}) ELSE value END, 6) AS value FROM {EVENTS_SQL}"
QUERIES["fill_grouped_mean"] = _rounded(Recipe().then("fillMissingValues", column="value", replacement={"kind": "groupedStatistic", "keys": ["event_type"], "statistic": "mean"}))
ORACLE["fill_grouped_mean"] = f"SELECT event_id, user_id, event_type, round(CASE WHEN {GONE} THEN avg(CASE WHEN NOT {GONE} THEN value END) OVER (PARTITION BY event_type) ELSE value END, 6) AS value FROM {EVENTS_SQL}"


@query("count_missing", f"SELECT count(*) FILTER (WHERE {GONE} AND event_id % 13 = 0) AS missing FROM {EVENTS_SQL}")
def count_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fill leaves missing: here NaN, where the fallback is NaN too."""
    df = events(spark, sf_dir).withColumn("other", F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)))
    filled = Recipe().then("fillMissingValues", column="value", replacement={"kind": "fallbackColumns", "columns": ["other"]}).apply(df).df
    return fill_steps.count_missing(filled, "value")


@query("fill_fallback", f"SELECT event_id, coalesce(event_type, CASE WHEN event_id % 2 = 0 THEN props END, 'user ' || user_id) AS event_type FROM {EVENTS_SQL}")
def fill_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumns({"a": F.when(F.col("event_id") % 2 == 0, F.col("props")), "b": F.concat(F.lit("user "), "user_id")})
    return Recipe().then("fillMissingValues", column="event_type", replacement={"kind": "fallbackColumns", "columns": ["a", "b"]}).apply(df).df.select("event_id", "event_type")


# -- by example, custom code --------------------------------------------------------------------------------
NAME = {"kind": "concat", "parts": [{"kind": "case", "to": "lower", "input": {"kind": "slice", "start": 0, "end": 4, "input": {"kind": "column", "name": "c_name"}}}, {"kind": "literal", "value": "-"}, {"kind": "regexExtract", "pattern": "[1-9][0-9]*", "group": 0, "input": {"kind": "column", "name": "c_name"}}]}
step("by_example_apply", "customer", ["c_custkey", "c_name"], "SELECT c_custkey, c_name, CASE WHEN regexp_matches(c_name, '[1-9][0-9]*') THEN lower(c_name[1:4]) || '-' || regexp_extract(c_name, '[1-9][0-9]*') END AS short FROM customer", ("byExample", {"program": NAME, "newColumn": "short"}))
step("by_example_arithmetic", "lineitem", ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, (l_orderkey * l_linenumber)::DECIMAL(38, 0) AS p FROM lineitem", ("byExample", {"program": {"kind": "arithmetic", "operator": "multiply", "left": {"kind": "column", "name": "l_orderkey"}, "right": {"kind": "column", "name": "l_linenumber"}}, "newColumn": "p"}))


@query("by_example_rank")
def by_example_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.concat_ws("/", F.split("o_orderpriority", "-")[1], "o_orderstatus").alias("wanted"))
    return ranked(df, ["o_orderpriority", "o_orderstatus"], "wanted")


@query("by_example_choice", "SELECT o_orderkey, string_split(o_orderpriority, '-')[2] || '/' || o_orderstatus AS made, true AS every FROM orders")
def by_example_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the programs that are right for all examples, applied."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.concat_ws("/", F.split("o_orderpriority", "-")[1], "o_orderstatus").alias("wanted"))
    return _chosen(df, ["o_orderpriority", "o_orderstatus"]).drop("single")


@query("by_example_ambiguous", "SELECT o_orderkey, o_orderstatus AS made, true AS every, false AS single FROM orders")
def by_example_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two equal inputs leave a choice between programs of one cost: none is the `single` best."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderstatus").alias("wanted"))
    return _chosen(df, ["a", "b"])


def _chosen(df: DataFrame, inputs: list[str]) -> DataFrame:
    first, second = ranked(df.select(*inputs, "wanted"), inputs, "wanted").where("rank <= 2").orderBy("rank").collect()
    single = (second["matched"], -second["cost"]) < (first["matched"], -first["cost"])
    made = Recipe().then("byExample", program=json.loads(first["program"]), newColumn="made").apply(df).df
    return made.select("o_orderkey", "made", F.lit(first["matched"] == first["rows"]).alias("every"), F.lit(single).alias("single"))


@query("custom_sql", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY l_returnflag")
def custom_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cleanframe.plans.recipe import Custom

    return Recipe((Custom(function=lambda d: d.where("l_linenumber = 1")), Custom(sql="SELECT l_returnflag, count(*) AS n FROM {df} GROUP BY l_returnflag"))).apply(table(spark, sf_dir, "lineitem")).df


# -- profiles -----------------------------------------------------------------------------------------------
@query("profile_counts", f"""SELECT 'event_type' AS "column", count(*) AS total, count(*) - count(event_type) AS nulls, 0::BIGINT AS nans, count(DISTINCT event_type) AS distinct FROM {EVENTS_SQL}
    UNION ALL SELECT 'value', count(*), count(*) - count(value), count(*) FILTER (WHERE isnan(value)), count(DISTINCT CASE WHEN NOT isnan(value) THEN value END) FROM {EVENTS_SQL}
    UNION ALL SELECT 'user_id', count(*), 0, 0, count(DISTINCT user_id) FROM {EVENTS_SQL}""")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.base_counts(events(spark, sf_dir), ["event_type", "value", "user_id"])


@query("profile_numeric", """SELECT 'l_quantity' AS "column", min(l_quantity) AS min, max(l_quantity) AS max, avg(l_quantity) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS std, sum(l_quantity) AS sum FROM lineitem
    UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber), avg(l_linenumber), median(l_linenumber), round(stddev_samp(l_linenumber), 6), sum(l_linenumber)::DOUBLE FROM lineitem""")
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"]).withColumn("std", F.round("std", 6))


@query("profile_text", """SELECT 'text' AS "column", count(*) FILTER (WHERE length(text) = 0) AS empty, min(length(text)) AS min_length, max(length(text)) AS max_length, avg(length(text)) AS mean_length FROM documents
    UNION ALL SELECT 'lang', count(*) FILTER (WHERE length(lang) = 0), min(length(lang)), max(length(lang)), avg(length(lang)) FROM documents""")
def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.text_summary(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("profile_boolean", """SELECT 'late' AS "column", count(*) FILTER (WHERE l_linenumber > 4) AS true_count, count(*) FILTER (WHERE l_linenumber <= 4) AS false_count FROM lineitem""")
def profile_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.boolean_summary(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") > 4).alias("late")), ["late"])


@query("profile_time", """SELECT 'o_orderdate' AS "column", min(o_orderdate)::VARCHAR AS first, max(o_orderdate)::VARCHAR AS last FROM orders""")
def profile_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.time_range(table(spark, sf_dir, "orders"), ["o_orderdate"])


@query("profile_top_values", " UNION ALL ".join(f"""SELECT '{c}' AS "column", value, n AS count, r AS rank FROM (SELECT {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS r FROM lineitem GROUP BY {c}) WHERE r <= 10""" for c in ("l_returnflag", "l_partkey", "l_linenumber")))
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_partkey", "l_linenumber"])


@query("profile_histogram", """WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem),
    g AS (SELECT i AS bin, a * ((20 - i) / 20::DOUBLE) + b * (i / 20::DOUBLE) AS low, CASE WHEN i = 19 THEN b ELSE a * ((19 - i) / 20::DOUBLE) + b * ((i + 1) / 20::DOUBLE) END AS high FROM e, range(20) AS t(i))
    SELECT bin, low, high, count(l_quantity) AS count FROM g LEFT JOIN lineitem ON l_quantity >= low AND (l_quantity < high OR bin = 19) GROUP BY bin, low, high""")
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_quantity")


SPREAD = ["l_quantity", "l_extendedprice", "l_linenumber", "l_discount"]


@query("profile_histograms", " UNION ALL ".join(f"""SELECT '{c}' AS "column", bin, low, high, count({c}) AS count FROM (SELECT i AS bin, a * ((n - i) / n) + b * (i / n) AS low, CASE WHEN i = n - 1 THEN b ELSE a * ((n - i - 1) / n) + b * ((i + 1) / n) END AS high, i = n - 1 AS top
    FROM (SELECT min({c})::DOUBLE AS a, max({c})::DOUBLE AS b, least(20, count(DISTINCT {c}))::DOUBLE AS n FROM lineitem), range(20) AS t(i) WHERE i < n) LEFT JOIN lineitem ON {c} >= low AND ({c} < high OR top) GROUP BY bin, low, high""" for c in SPREAD))
def profile_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histograms(table(spark, sf_dir, "lineitem"), SPREAD)


WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate", "l_linestatus"]


@query("profile_counts_wide", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS total, count(*) - count({c}) AS nulls, 0::BIGINT AS nans, count(DISTINCT {c}) AS distinct FROM lineitem""" for c in WIDE))
def profile_counts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.base_counts(table(spark, sf_dir, "lineitem"), WIDE)


@query("profile_dataset", f"""SELECT (SELECT count(*) FROM {EVENTS_SQL}) AS rows, (SELECT count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE {GONE}) FROM {EVENTS_SQL}) AS missing_cells,
    (SELECT count(*) FILTER (WHERE event_type IS NULL OR {GONE}) FROM {EVENTS_SQL}) AS rows_with_missing,
    (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM (SELECT user_id, event_type, CASE WHEN NOT isnan(value) THEN value END AS v FROM {EVENTS_SQL}) GROUP BY user_id, event_type, v)) AS duplicate_rows""")
def profile_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_stats(events(spark, sf_dir).select("user_id", "event_type", "value"))


@query("profile_missing", f"""SELECT 'event_type' AS "column", count(*) FILTER (WHERE event_type IS NULL) AS missing FROM {EVENTS_SQL} UNION ALL SELECT 'value', count(*) FILTER (WHERE {GONE}) FROM {EVENTS_SQL}""")
def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_by_column(events(spark, sf_dir).select("event_type", "value"))


@query("column_values", "SELECT p_name AS value, count(*) AS count FROM part WHERE lower(p_name) LIKE '%re%' GROUP BY p_name ORDER BY count DESC, value LIMIT 11")
def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_values(table(spark, sf_dir, "part"), "p_name", "RE", 10)


MOMENTS = ["l_quantity", "l_extendedprice"]


@query("profile_sampled")
def profile_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sampled_profile(table(spark, sf_dir, "lineitem"), MOMENTS, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("profile_sampled_moments", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS total, count(*) FILTER (WHERE {c} IS NULL) AS nulls, min({c}) AS min, max({c}) AS max, round(sum({c}), 2) AS sum, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem""" for c in MOMENTS))
def profile_sampled_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the sampled profile that is exact."""
    return profile_sampled(spark, sf_dir).select("column", "total", "nulls", "min", "max", F.round("sum", 2).alias("sum"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("profile_sampled_lengths", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS total, count(*) - count({c}) AS nulls, min(length({c})) AS min_length, max(length({c})) AS max_length, avg(length({c})) AS mean_length FROM documents""" for c in ("text", "source")))
def profile_sampled_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text lengths of the sampled profile are exact."""
    return profile.sampled_profile(table(spark, sf_dir, "documents"), ["text", "source"], ["doc_id"]).select("column", "total", "nulls", "min_length", "max_length", "mean_length")


@query("profile_sampled_duplicates")
def profile_sampled_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sampled_dataset(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id"])


@query("profile_sampled_values")
def profile_sampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sampled_top_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_partkey"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("profile_sampled_histogram")
def profile_sampled_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sampled_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("profile_numeric_wide", """SELECT 'l_extendedprice' AS "column", min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean, median(l_extendedprice) AS median, round(stddev_samp(l_extendedprice), 6) AS std, round(sum(l_extendedprice), 2) AS sum FROM lineitem""")
def profile_numeric_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.numeric_summary(table(spark, sf_dir, "lineitem"), ["l_extendedprice"])
    return out.select("column", "min", "max", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), F.round("sum", 2).alias("sum"))


@query("profile_nested", "SELECT to_json(string_split(p_name, ' '))::VARCHAR AS value, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, value LIMIT 11")
def profile_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_values(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words")), "words", "", 10)


# -- plans --------------------------------------------------------------------------------------------------
@query("step_diff", f"""SELECT 'changed' AS change, count(*) AS cells FROM {EVENTS_SQL} WHERE event_type IS NULL AND user_id < 10 HAVING count(*) > 0 UNION ALL SELECT 'removed', count(*) FROM {EVENTS_SQL} WHERE user_id >= 10 HAVING count(*) > 0""")
def step_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    after = Recipe().then("filterRows", filterModel={"filters": [on("user_id", ("lt", "10"))]}).then("fillMissingValues", column="event_type", replacement={"kind": "value", "value": "none"}).apply(before).df
    return diff_counts(step_diff(before, after, ["event_id"]))


@query("step_diff_repeated", """WITH x AS (SELECT l_orderkey AS k, l_linenumber::VARCHAR AS a, l_quantity::BIGINT::VARCHAR AS b FROM lineitem WHERE l_linenumber < 5), y AS (SELECT l_orderkey AS k, l_linenumber::VARCHAR AS a, (l_quantity::BIGINT % 40)::VARCHAR AS b FROM lineitem WHERE l_linenumber > 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b) AS n FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b) AS n FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)),
    j AS (SELECT l.k AS lk, r.k AS rk, coalesce((l.a <> r.a)::INT, 0) + coalesce((l.b <> r.b)::INT, 0) AS cells FROM l FULL JOIN r ON l.k = r.k AND l.n = r.n)
    SELECT CASE WHEN rk IS NULL THEN 'removed' WHEN lk IS NULL THEN 'added' ELSE 'changed' END AS change, sum(CASE WHEN lk IS NULL OR rk IS NULL THEN 1 ELSE cells END)::BIGINT AS cells FROM j GROUP BY ALL""")
def step_diff_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their order alone: rows of a key that repeats cancel, and the others pair off."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return diff_counts(step_diff(rows.where("l_linenumber < 5"), rows.where("l_linenumber > 1").withColumn("q", F.col("q") % 40), ["l_orderkey"]))


@query("recipe_from_json", "SELECT l_orderkey, l_quantity * l_tax AS t, lower(l_returnflag) AS l_returnflag FROM lineitem WHERE l_quantity >= 40")
def recipe_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = Recipe().then("filterRows", filterModel={"filters": [on("l_quantity", ("gte", "40"))]}).then("formula", leftColumn="l_quantity", operator="multiply", rightColumn="l_tax", newColumn="t").then("lowerText", column="l_returnflag").then("selectColumns", columns=["l_orderkey", "t", "l_returnflag"])
    return Recipe.from_json(recipe.to_json()).apply(table(spark, sf_dir, "lineitem")).df


@query("recipe_edited", "SELECT l_orderkey, l_linenumber, upper(l_returnflag) AS l_returnflag FROM lineitem WHERE l_quantity < 3")
def recipe_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step replaced, one taken out, and the rest replayed; then the plan up to its last step but one."""
    recipe = Recipe().then("filterRows", filterModel={"filters": [on("l_quantity", ("gt", "40"))]}).then("lowerText", column="l_returnflag").then("upperText", column="l_returnflag").then("dropColumns", columns=["l_returnflag"])
    edited = recipe.replaced(0, Step("filterRows", {"filterModel": {"filters": [on("l_quantity", ("lt", "3"))]}})).without(1)
    return edited.apply(table(spark, sf_dir, "lineitem"), upto=2).df.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("name_collisions", "SELECT p_partkey, 3::BIGINT AS refused FROM part WHERE p_size = 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New columns whose name is taken, whatever the case, are refused before anything runs."""
    df, refused = table(spark, sf_dir, "part"), 0
    for kind, params in (("renameColumn", {"column": "p_name", "newName": "P_SIZE"}), ("cloneColumn", {"column": "p_name", "newName": "p_partkey"}), ("textLength", {"column": "p_name", "newColumn": "P_Name"})):
        try:
            Recipe().then(kind, **params).apply(df)
        except StepError:
            refused += 1
    return df.where("p_size = 1").select("p_partkey", F.lit(refused).cast("long").alias("refused"))
