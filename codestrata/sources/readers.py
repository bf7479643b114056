"""Readers and writers of the record formats: JSONL, CSV, entity reports, source trees, graphs."""

from __future__ import annotations

import xml.sax.saxutils as _xml
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.sources.tables import ENTITY_REPORT


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, mode: str = "strict") -> DataFrame:
    """Records of JSON lines: "strict" fails on a bad line, "lenient" skips it, "count" keeps it with its text in
    ``bad``. Blank lines are no records; with an explicit schema nothing is inferred."""
    if mode == "count":
        fields = _parse_schema(spark, schema).add("bad", "string")
        return spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return spark.read.schema(schema).option("mode", {"strict": "FAILFAST", "lenient": "DROPMALFORMED"}[mode]).json(path)


def _parse_schema(spark: SparkSession, ddl: str) -> T.StructType:
    return spark.createDataFrame([], ddl).schema


def read_csv(spark: SparkSession, path: str, schema: str | None = None, fill: bool = False) -> DataFrame:
    """Table of texts: nothing is taken for a null (or, with ``fill``, nulls become ''), quoted fields may hold breaks and
    doubled quotes, rows of a wrong width are skipped."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "DROPMALFORMED")
    r = r.option("nullValue", None).option("emptyValue", "")
    df = (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)
    return df.na.fill("") if fill else df


def read_entity_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name, category, location, file) and edges (src, dst, kind, ord) of an analyzer's report, one JSON
    document with two arrays. ``ord`` is the place of the edge in the report."""
    report = spark.read.schema(ENTITY_REPORT).option("multiLine", True).json(path)
    v = report.select(F.explode("variables").alias("v"))
    c = report.select(F.posexplode("cells").alias("ord", "c"))
    entities = v.select("v.id", F.col("v.qualifiedName").alias("name"), "v.category", "v.location", F.col("v.File").alias("file"))
    return entities, c.select("c.src", F.col("c.dest").alias("dst"), "c.values.kind", F.col("ord").cast("long").alias("ord"))


def category_sets(entities: DataFrame) -> DataFrame:
    """(name, category) of what the recall rules use: variables, modules, packages, and unresolved attributes of a file
    with a path."""
    kept = F.col("category").isin("Variable", "Module", "Package") | ((F.col("category") == "Unresolved Attribute") & F.coalesce(F.col("file").contains("/"), F.lit(False)))
    return entities.where(kept).select("name", "category").distinct()


def read_sources(spark: SparkSession, root: str, pattern: str = "*.py", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of the source files below ``root``, with paths from there; folders of ``exclude`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/+", "")
    out = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))
    for folder in exclude:
        out = out.where(~F.concat(F.lit("/"), F.col("path")).contains(f"/{folder}/"))
    return out


def read_by_file_name(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines of many files with what a pattern finds in their base names, such as the task and stage."""
    df = spark.read.text(path).withColumn("_f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    for i, n in enumerate(names, 1):
        df = df.withColumn(n, F.regexp_extract("_f", pattern, i))
    return df.where(F.col("_f").rlike(pattern)).drop("_f")


def read_xlsx(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """A small sheet (a project list), by pandas on the driver; needs openpyxl. CSV is the format for large tables."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading .xlsx needs openpyxl; save the sheet as CSV") from e
    return renamed(spark.createDataFrame(pd.read_excel(path, dtype=str).fillna("")), aliases or {})


def renamed(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns by their own names: alias -> name, compared trimmed and without case."""
    low = {k.strip().lower(): v for k, v in aliases.items()}
    return df.withColumnsRenamed({c: low[c.strip().lower()] for c in df.columns if c.strip().lower() in low})


def parse_gml(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a graph file as flat dictionaries."""
    import re

    tokens = re.findall(r'"[^"]*"|[\[\]]|[^\s\[\]]+', text or "")
    at = 0

    def block() -> list[tuple]:
        nonlocal at
        items = []
        while at < len(tokens) and tokens[at] != "]":
            key = tokens[at]
            at += 1
            if at < len(tokens) and tokens[at] == "[":
                at += 1
                items.append((key, block()))
                at += 1
            elif at < len(tokens):
                v = tokens[at]
                items.append((key, _xml.unescape(v[1:-1], {"&quot;": '"', "&#10;": "\n", "&#39;": "'"}) if v[:1] == '"' else v))
                at += 1
        return items

    graph = dict(block()).get("graph", [])
    return [dict(v) for k, v in graph if k == "node"], [dict(v) for k, v in graph if k == "edge"]


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, id, attributes) and edges (file, src, dst, kind) of graph files, one file a task."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")

    def nodes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(f, n.get("id"), n) for f, v in zip(pdf.file, pdf.value) for n in parse_gml(v)[0]], columns=["file", "id", "attributes"])

    def edges(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(f, e.get("source"), e.get("target"), e.get("type") or e.get("kind")) for f, v in zip(pdf.file, pdf.value) for e in parse_gml(v)[1]], columns=["file", "src", "dst", "kind"])

    return files.mapInPandas(nodes, "file string, id string, attributes map<string,string>"), files.mapInPandas(edges, "file string, src string, dst string, kind string")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, by: list[str]) -> None:
    """Graphs as two tables, in folders by stage or size."""
    nodes.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/edges")


def trivial_graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, line) of the trivial graph format: "id label" of the nodes, then "src dst kind" of the edges."""
    a = nodes.select(F.lit(0).alias("section"), F.concat_ws(" ", "id", "label").alias("line"))
    return a.unionByName(edges.select(F.lit(1).alias("section"), F.concat_ws(" ", "src", "dst", "kind").alias("line")))


def adjacency_rows(edges: DataFrame, i: str, j: str, names: list[str]) -> DataFrame:
    """0/1 matrix of the links among ``names``, one row each; asked for by name, so its width is what the caller gave."""
    e = edges.where(F.col(j).isin(names)).groupBy(i).pivot(j, names).agg(F.lit(1))
    return e.na.fill(0)


def concatenated(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Records of several files with the place of their file in the list (``list_pos``)."""
    parts = [read_jsonl(spark, p, schema).withColumn("list_pos", F.lit(i)) for i, p in enumerate(paths, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_atomic_json(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines as a whole: the new one is written beside it and renamed over it, so a reader finds either the old or
    the new records."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}.new")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, kept = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.new", path, f"{path}.old"))
    fs = new.getFileSystem(conf)
    fs.delete(kept, True)
    if fs.exists(old):
        fs.rename(old, kept)
    fs.rename(new, old)
    fs.delete(kept, True)


def write_json_by(df: DataFrame, key: str, path: str) -> None:
    """A folder a key, each with one record: the key and the list of its rows in order; rows of a key are one list."""
    others = [c for c in df.columns if c != key]
    df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("rows")).withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(path)


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table: heading, columns, a line a row in the order of ``df``. For summaries: more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return f"## {title}\n\n" + "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in lines) + "\n"


def write_workbook(sheets: dict[str, DataFrame], path: str, most: int = 1_000_000) -> None:
    """Tables as the sheets of one workbook on the driver's disk, with a row of headings. A sheet has at most ``most`` rows; more are an error."""
    escape, quoteattr = _xml.escape, _xml.quoteattr

    def row(values: Iterator) -> str:
        cells = (f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values)
        return f"<row>{''.join(cells)}</row>"

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        links = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{links}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(f"<sheet name={quoteattr(name)} sheetId=\"{i}\" r:id=\"r{i}\"/>" for i, name in zip(n, sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{links}">{"".join(f"<Relationship Id=\"r{i}\" Type=\"{rel}/worksheet\" Target=\"worksheets/sheet{i}.xml\"/>" for i in n)}</Relationships>')
        for i, df in zip(n, sheets.values()):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData>{row(df.columns)}'.encode())
                for k, r in enumerate(df.toLocalIterator()):
                    if k >= most:
                        raise ValueError(f"more than {most} rows for one sheet")
                    out.write(row(r).encode())
                out.write(b"</sheetData></worksheet>")


def memoized(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Results of ``compute`` for the rows of ``df``, kept in a table at ``path``: only rows whose key (the hash of the column ``key``) is not
    there yet are computed, once a key, and appended. ``compute`` gets ``df`` with ``memo_key`` and must keep that column."""
    keyed = df.withColumn("memo_key", F.sha2(F.col(key).cast("string"), 256))
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target) else None
    todo = keyed.dropDuplicates(["memo_key"])
    todo = todo.join(known.select("memo_key"), "memo_key", "left_anti") if known is not None else todo
    compute(todo).write.mode("append").parquet(path)
    return keyed.select("memo_key").distinct().join(spark.read.parquet(path), "memo_key")
