"""Scalar functions over whole tables, and code functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import repairs as R
from codestrata.functions import snippets as K
from codestrata.functions.answers import largest_json_udf
from codestrata.functions import text as T
from codestrata.plans import base as B
from codestrata.plans.catalog import query
from codestrata.sources.tables import table


@query(
    f"""WITH {B.DEPENDENCIES}, x AS (SELECT DISTINCT dep AS s FROM deps) SELECT s, {B.sql_strip("split_part(s, '(', 1)")} AS no_args, replace({B.sql_strip("split_part(s, '(', 1)")}, '.__init__', '') AS legacy,
    replace(regexp_replace({B.sql_strip("split_part(s, '(', 1)")}, '^\\.+', ''), '.__init__.', '.') AS canonical, regexp_replace(s, '^[^.]*\\.', '') AS tail, split_part(s, '.', -1) AS short, regexp_replace(s, '\\.?[^.]*$', '') AS owner,
    CASE WHEN split_part(s, '.', 1) = split_part(s, '.', 2) AND split_part(s, '.', 1) <> '' THEN regexp_replace(s, '^[^.]*\\.', '') ELSE s END AS one_root, CAST(length(s) - length(replace(s, '.', '')) AS BIGINT) AS dots FROM x"""
)
def name_functions(s, d):
    x = B.dependencies(s, d).select(F.col("dep").alias("s")).distinct()
    return x.select("s", T.no_args("s").alias("no_args"), T.legacy_name("s").alias("legacy"), T.canonical("s").alias("canonical"), T.drop_first_part("s").alias("tail"), T.last_part("s").alias("short"), T.parent_part("s").alias("owner"), T.one_root("s").alias("one_root"), T.dots("s").cast("long").alias("dots"))


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS column_name, sha256(coalesce(text, '')) AS content_hash, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS lines,
    replace(replace(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS unescaped, coalesce(lower(trim(lang)) IN ('true', '1', 'yes', 'y', 't', 'en'), FALSE) AS flag, TRY_CAST(regexp_extract(text, '\\d+') AS BIGINT) AS first_number FROM documents"""
)
def text_functions(s, d):
    """Figures of whole titles and texts; a first run of digits that is no 64-bit number is null."""
    t = F.coalesce("text", F.lit(""))
    x = table(s, d, "documents", "doc_id", "text", "title", "lang")
    return x.select(
        "doc_id", T.column_name(F.coalesce("title", F.lit(""))).alias("column_name"), F.sha2(t, 256).alias("content_hash"), F.size(F.split(t, "\n")).cast("long").alias("lines"), T.unescaped(t).alias("unescaped"),
        (T.truthy("lang") | F.coalesce(F.lower(F.trim("lang")) == "en", F.lit(False))).alias("flag"), T.safe_long(F.regexp_extract("text", r"\d+", 0)).alias("first_number"),
    )


@query(
    f"""WITH {B.METHODS}, l AS (SELECT id, string_split(method_code, chr(10)) AS l FROM meth WHERE method_code IS NOT NULL), i AS (SELECT id, l, list_min(list_transform(list_filter(l, lambda x: length(trim(x)) > 0), lambda x: length(x) - length(ltrim(x)))) AS n FROM l)
    SELECT id, array_to_string(list_transform(l, lambda x: CASE WHEN length(trim(x)) = 0 THEN '' ELSE x[coalesce(n, 0) + 1:] END), chr(10)) AS dedented, array_to_string(l[2:3], chr(10)) AS second_third, array_to_string(list_transform(l, lambda x, k: CASE WHEN k BETWEEN 2 AND 3 THEN '' ELSE x END), chr(10)) AS blanked FROM i"""
)
def line_functions(s, d):
    m = B.methods(s, d, "method_code").where("method_code is not null")
    return m.select("id", T.dedented("method_code").alias("dedented"), T.line_range("method_code", F.lit(2), F.lit(3)).alias("second_third"), T.blanked_lines("method_code", F.lit(2), F.lit(3)).alias("blanked"))


@query(f"WITH {B.METHODS} SELECT func_file, CAST(len(list_distinct(flatten(list(regexp_extract_all(method_code, '[A-Za-z_][A-Za-z0-9_]*'))))) AS BIGINT) AS identifiers FROM meth WHERE func_file IS NOT NULL AND method_code IS NOT NULL GROUP BY func_file")
def identifier_sets(s, d):
    m = B.methods(s, d, "func_file", "method_code").where("func_file is not null and method_code is not null")
    counted = m.select("func_file", F.explode_outer(T.identifiers("method_code")).alias("w"))
    return counted.groupBy("func_file").agg(F.count_distinct("w").alias("identifiers"))


@query(
    f"""WITH r AS (SELECT DISTINCT run_id, final_text FROM agent_result WHERE final_text IS NOT NULL), b AS (SELECT run_id, final_text, list_transform(regexp_extract_all(final_text, '(?s)```[^\\n`]*\\n(.*?)```', 1), lambda x: {B.sql_strip('x')}) AS b FROM r)
    SELECT run_id, CASE WHEN len(b) = 0 THEN {B.sql_strip('final_text')} ELSE list_reduce(b, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) END AS block FROM b"""
)
def longest_code_block(s, d):
    return table(s, d, "agent_result", "run_id", "final_text").where("final_text is not null").distinct().select("run_id", T.longest_block("final_text").alias("block"))


@query(
    f"""WITH {B.TASKS}, x AS (SELECT example_id, 'Complete ' || coalesce(split_part(namespace, '.', -1), '') || chr(10) || array_to_string(list_transform(string_split(coalesce(requirement.Functionality, ''), chr(10)), lambda s: '    # ' || {B.sql_strip('s')}), chr(10)) AS prompt FROM tasks)
    SELECT example_id, prompt, CASE WHEN length(prompt) > 120 THEN substring(prompt, 1, 120) || '...' ELSE prompt END AS preview FROM x"""
)
def prompt_table(s, d):
    t = B.tasks(s, d, "namespace", "requirement")
    prompt = T.filled("Complete {name}\n{comment}", name=T.last_part("namespace"), comment=T.commented(F.coalesce("requirement.Functionality", F.lit(""))))
    return t.select("example_id", prompt.alias("prompt")).withColumn("preview", T.clipped("prompt", 120))


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_valid(props) AS valid, CAST(epoch(ts)::BIGINT AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d') AS day FROM events"""
)
def json_and_time(s, d):
    e = table(s, d, "events", "event_id", "ts", "props")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_parse_json(props) is not null").alias("valid"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 + 0.5).cast("long").alias("seconds"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query()
def mccabe_token_len(s, d):
    """Complexity and token length of every method, with its rendered signature."""
    m = B.methods(s, d, "method_code")
    return m.select("id", K.facts("method_code", "complexity", "tokens", "signature").alias("f")).select("id", "f.*")


@query()
def complexity_summary(s, d):
    """Mean, median, 90th percentile and maximum of the complexity by file, and the share that does not parse."""
    m = B.methods(s, d, "func_file", "method_code").select("func_file", K.facts("method_code", "complexity").alias("f")).withColumn("c", F.col("f.complexity"))
    q = F.percentile("c", F.array(F.lit(0.5), F.lit(0.9)))
    g = m.groupBy("func_file").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), q.alias("q"), F.max("c").alias("most"), F.round(F.count_if(F.col("c").isNull()) / F.count("*"), 6).alias("failed"))
    return g.select("func_file", "n", "mean", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p90"), "most", "failed")


@query()
def code_notes(s, d):
    """Docstrings and comments of every method, and its skeleton."""
    return B.methods(s, d, "method_code").select("id", K.facts("method_code", "notes", "skeleton").alias("f")).select("id", "f.*")


@query()
def source_entities(s, d):
    """Entities of every method's code, taken as a source file of its own."""
    m = B.methods(s, d, "func_file", "method_code").where("func_file is not null and method_code is not null")
    return m.select("id", F.explode(K.entities("func_file", F.regexp_replace("method_code", r"(?m)^    ", ""))).alias("e")).select("id", "e.*")
