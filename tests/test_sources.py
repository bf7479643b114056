import json

import pytest

from codestrata.sources import readers as S
from codestrata.sources.tables import METHOD


def test_jsonl(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"a": 1}\n\n{"a": \n{"a": 3, "x": 1}\n')
    assert sorted(r.a for r in S.read_jsonl(spark, str(p), "a int", "lenient").collect()) == [1, 3]
    assert S.read_jsonl(spark, str(p), "a int", "count").cache().where("bad is not null").count() == 1
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(p), "a int").collect()


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('ID,method_signature,func_file,method_code\n1,"f(a, b)",x.py,"def f(a, b):\n    return ""q"""\n2,g(),,\n')
    got = S.read_csv(spark, str(p), METHOD.replace("LONG", "STRING"), fill=True).orderBy("ID").collect()
    assert got[0].method_code.endswith('"q"') and got[1].func_file == ""


def test_report(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"variables": [{"id": 1, "qualifiedName": "m", "category": "Module"}, {"id": 2, "qualifiedName": "m.x", "category": "Unresolved Attribute", "File": "a/b.py"}, {"id": 3, "qualifiedName": "m.y", "category": "Unresolved Attribute", "File": "b.py"}], "cells": [{"src": 1, "dest": 2, "values": {"kind": "Use"}}]}))
    ent, edges = S.read_entity_report(spark, str(p))
    assert {r.name for r in S.category_sets(ent).collect()} == {"m", "m.x"} and edges.first().kind == "Use"


def test_tree_and_graph(spark, tmp_path):
    (tmp_path / "src" / "p").mkdir(parents=True)
    (tmp_path / "src" / "p" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "p" / "b.txt").write_text("no")
    assert [tuple(r) for r in S.read_sources(spark, str(tmp_path / "src")).collect()] == [("p/a.py", "x = 1\n")]
    g = tmp_path / "task_7_rank.gml"
    g.write_text('graph [ directed 1 node [ id 0 label "a.f" sig "x &#34;" ] node [ id 1 label "b" ] edge [ source 0 target 1 kind "Call" ] ]')
    nodes, edges = S.read_gml(spark, str(g))
    assert nodes.count() == 2 and edges.first().kind == "Call"
    assert S.read_by_file_name(spark, str(g), r"task_(\d+)_(\w+)\.gml", ["task", "stage"]).select("task", "stage").distinct().first() == ("7", "rank")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "Call"), (1, 3, "Use")], "src int, dst int, kind string")
    S.write_jsonl(df, str(tmp_path / "j"))
    assert S.concatenated(spark, [str(tmp_path / "j")] * 2, "src int, dst int, kind string").count() == 4
    S.write_csv(df, str(tmp_path / "c"))
    assert S.adjacency_rows(df, "src", "dst", ["2", "3"]).first()[1:] == (1, 1)
    assert S.trivial_graph_lines(spark.createDataFrame([(1, "a")], "id int, label string"), df).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x|y"), ("a", 2, None), ("b", 3, "<&>")], "k string, n int, t string")
    for rows in (df, df.limit(1)):
        S.write_atomic_json(rows, str(tmp_path / "j"))
        assert spark.read.json(str(tmp_path / "j")).count() == rows.count()
    assert [p.name for p in tmp_path.iterdir()] == ["j"]
    S.write_json_by(df, "k", str(tmp_path / "by"))
    got = {r["k"]: [x.n for x in r["rows"]] for r in spark.read.json(str(tmp_path / "by")).collect()}
    assert got == {"a": [1, 2], "b": [3]} and (tmp_path / "by" / "_key=a").is_dir()
    text = S.markdown_table(df.orderBy("n"), "Report")
    assert text.startswith("## Report\n\n| k | n | t |\n| --- | --- | --- |\n| a | 1 | x\\|y |\n| a | 2 |  |")
    with pytest.raises(ValueError):
        S.markdown_table(df, "Report", 2)


def test_workbook(spark, tmp_path):
    import xml.etree.ElementTree as ET
    import zipfile

    S.write_workbook({"one & two": spark.createDataFrame([("a", 1.5), ("<b>", None)], "k string, n double"), "none": spark.createDataFrame([], "k string")}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        parts = {n: ET.fromstring(z.read(n)) for n in z.namelist()}
    assert [e.get("name") for e in parts["xl/workbook.xml"].iter() if e.tag.endswith("}sheet")] == ["one & two", "none"]
    assert ["".join(r.itertext()) for r in parts["xl/worksheets/sheet1.xml"].iter() if r.tag.endswith("}row")] == ["kn", "a1.5", "<b>"]


def test_memo(spark, tmp_path):
    path, seen = str(tmp_path / "memo"), []

    def compute(df):
        seen.append(df.count())
        return df.selectExpr("memo_key", "upper(q) as answer")

    for asked, new in ((["a", "b", "a"], 2), (["b", "c"], 1), (["c"], 0)):
        got = S.memoized(spark.createDataFrame([(q,) for q in asked], "q string"), "q", compute, path)
        assert sorted(r.answer for r in got.collect()) == sorted({q.upper() for q in asked}) and seen[-1] == new
