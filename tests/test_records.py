import json
import random

from codestrata.operators.packed import parse_locations, parse_packed, split_packed
from codestrata.operators.shred import nested_rows, ordinals, path_text, path_values, pivot_group, shred_rows, shred_struct, triples

SHAPE = {"rows_key": "entities", "list_key": "attempts", "below": "final_locations", "columns": ("file", "symbol"), "inherited": ("file",)}


def vals(text):
    return [v for v, _ in parse_packed(text)]


def test_packed_values():
    assert vals("a, b;c | d\te\nf") == list("abcdef")
    assert vals("'x, y', \"p;q\", `m|n`") == ["x, y", "p;q", "m|n"]
    assert vals('"say ""hi"", twice"; it\'s fine') == ['say "hi", twice', "it's fine"]
    assert vals('["a", "b, c", "d[0]"]') == ["a", "b, c", "d[0]"]
    assert vals("x[1], f(), a=b") == ["x[1]", "f()", "a=b"]
    assert vals(None) == vals("") == vals(" , ;; ") == vals('""') == []
    assert vals("a,a") == ["a", "a"]


def test_packed_malformed():
    assert parse_packed('"open, x') == [("open", "malformed_quote"), ("x", "")]
    assert parse_packed("[a, b") == [("a", "malformed_bracket"), ("b", "")]
    assert parse_packed('"a" b, c')[1] == ("c", "")
    assert len(parse_packed("x," * 200_000)) == 200_000
    assert parse_packed('"' + "y" * 300_000)[0][1] == "malformed_quote"


def test_packed_brackets():
    """Several bracketed groups in one field, groups in groups, and brackets that belong to a value."""
    assert parse_packed("[a], [b]") == [("a", ""), ("b", "")] and parse_packed('["a"], ["b"]') == [("a", ""), ("b", "")]
    assert parse_packed("[[a, b], [c]]; d") == [(x, "") for x in "abcd"] and vals("[x[0], y[1]]") == ["x[0]", "y[1]"]
    assert vals("[a] b, c") == ["[a] b", "c"] and vals('["a]", \'[b\']') == ["a]", "[b"] and vals("[], [ ], [[]]") == []


def test_packed_fallbacks(spark):
    """Planted malformed fields: what was read by a fallback has its flag, the other values of the field none."""
    bracket, quote = "malformed_bracket", "malformed_quote"
    planted = {
        "[a, [b]": [("a", bracket), ("b", "")], '[ "a", b': [("a", bracket), ("b", "")], "[, a": [("a", bracket)], "a], b": [("a", bracket), ("b", "")], '"a"]': [("a", bracket)], "[a]]": [("a", bracket)],
        '["a", "b, c': [("a", bracket), ("b", quote), ("c", "")], "x[0, y]": [("x[0", ""), ("y", bracket)], "'a' b, c": [("a' b", quote), ("c", "")],
    }
    df = spark.createDataFrame(list(enumerate(planted)), "k long, t string")
    got = {(r.rec_id, r.pos): (r.val, r.flag) for r in split_packed(df, "k", "t").collect()}
    assert got == {(i, p): v for i, vs in enumerate(planted.values()) for p, v in enumerate(vs, 1)}


def test_packed_deep_and_long():
    """Nothing recurses and nothing takes more than time in proportion."""
    n = 100_000
    assert len(parse_packed("[a]," * n)) == n and parse_packed("[" * n + "a" + "]" * n) == [("a", "")]
    assert parse_packed("[" * n) == parse_packed("]" * n) == [] and vals("[" * n + "a")[-1] == "a" and vals("a[ " * n)[0].startswith("a[ a[")
    assert len(parse_packed("[a" * n + ",b]")) == 2 and len(parse_packed('"a" b, ' * n)) == n


def locs(text):
    return [v for v, _ in parse_locations(text) if v]


def test_locations():
    assert locs("a/b.py:f; `a/c.py`, 'a/d.py::G.h'") == ["a/b.py:f", "a/c.py", "a/d.py:G.h"]
    assert locs("```\na/b.py\nline: 3\nfunction: f\nmethod: G.h\na/c.py\n```") == ["a/b.py:f", "a/b.py:G.h", "a/c.py"]
    assert locs("1. `a/b.py` (Class: Größe)\n2) `a/b.py`") == ["a/b.py:Größe", "a/b.py"]
    assert locs("a/b.py\tf\na/b.py\t") == ["a/b.py:f", "a/b.py"]
    assert locs("a/b.py:12") == ["a/b.py"] and locs("a/b.py:variable: X") == ["a/b.py:X"]
    assert locs("see a/b.py: def f") == ["a/b.py:f"] and locs("a/b.py:class G") == ["a/b.py:G"]
    assert locs("No location could be verified.") == locs(None) == locs("function: f") == []


def test_split_packed(spark):
    df = spark.createDataFrame([(1, "a;b", 5), (2, None, 6), (3, "", 7), (None, "z", 8)], "k long, t string, pos int")
    rows = {tuple(r) for r in split_packed(df, "k", "t").collect()}
    assert rows == {(1, 1, "a", ""), (1, 2, "b", ""), (None, 1, "z", "")}
    assert split_packed(df.limit(0), "k", "t").count() == 0


def test_shred(spark):
    docs = [
        {"final_locations": {"entities": [None, {"file": "a", "symbol": "s"}, {"symbol": None}]}},
        {"attempts": [{"result": {"final_locations": {"files": [{"file": "f", "entities": [{"symbol": "x"}]}, "g"], "entities": {"file": "h"}}}}, {}, {"result": {"final_locations": json.dumps({"entities": [{"file": "j"}]})}}]},
        {"final_locations": None},
    ]
    texts = [(i, json.dumps(x)) for i, x in enumerate(docs)] + [(8, '{"final_locations": {"entities": [{"file"'), (9, None), (10, " ")]
    df = spark.createDataFrame(texts, "rec_id long, file string")
    got = {tuple(r) for r in shred_rows(df, "rec_id", "file", **SHAPE).collect()}
    assert got == {(0, 1, 1, "a", "s"), (0, 1, 2, "", ""), (1, 1, 1, "f", "x"), (1, 1, 2, "h", ""), (1, 3, 1, "j", "")}
    assert shred_rows(df.limit(0), "rec_id", "file", **SHAPE).count() == 0


def test_triples_pivot(spark):
    read = lambda text: [(path_text(s), tuple(ordinals(s)), v) for s, v in triples(text)]
    assert read('{"a": [{"b": 1}, null]}') == [("", (), {}), ("a", (), []), ("a[]", (1,), {}), ("a[].b", (1,), 1), ("a[]", (2,), None)]
    assert read('{"a.b": {"c[]": "[2]"}}')[-1] == (r"a\.b.c\[\][]", (1,), 2)
    df = spark.createDataFrame([(1, json.dumps({"a": [{"b": 1, "c": [{"d": "x"}, {"d": "y"}]}, {"c": [{"d": "z"}]}]}))], "k long, j string")
    t = path_values(df, "k", "j")
    inner = {(r.rec_id, tuple(r.parent), r.ordinal, r.d) for r in pivot_group(t, "a[].c[]", {"d": "d"}).collect()}
    assert inner == {(1, (1,), 1, "x"), (1, (1,), 2, "y"), (1, (2,), 1, "z")}
    outer = {(r.rec_id, tuple(r.parent), r.ordinal, r.b) for r in pivot_group(t, "a[]", {"b": "b"}).collect()}
    assert outer == {(1, (), 1, "1"), (1, (), 2, None)}


def test_stream_reads_what_json_reads():
    rng = random.Random(3)

    def made(depth):
        kind = rng.randrange(8 if depth < 5 else 5)
        if kind < 5:
            return [None, True, rng.randint(-9, 99), rng.random() * 1e6, rng.choice(["", "ü\n\"x", "[1, 2", '{"k": [1]}', "[]"])][kind]
        return {rng.choice("abc.["): made(depth + 1) for _ in range(rng.randrange(4))} if kind < 7 else [made(depth + 1) for _ in range(rng.randrange(4))]

    def leaves(v):
        if isinstance(v, str) and v[:1] in ("{", "["):
            try:
                v = json.loads(v)
            except ValueError:
                pass
        if isinstance(v, (dict, list)):
            return [type(v)()] + [x for y in (v.values() if isinstance(v, dict) else v) for x in leaves(y)]
        return [v]

    for _ in range(300):
        value = made(0)
        text = json.dumps(value, indent=rng.choice([None, 1]))
        assert [v for _, v in triples(text)] == leaves(value)
        broken = text[: rng.randrange(len(text))] + rng.choice(["", "]", "}", ",", '"', "x"])
        try:
            json.loads(broken)
        except ValueError:
            assert triples(broken) == []
    for bad in ("[1,]", '{"a":1,}', '{"a" 1}', "1 2", "-", "01", "[1 2]", "{1: 2}", "'a'"):
        assert triples(bad) == []


def test_deep_records():
    n = 50_000
    assert triples("[" * n) == [] and len(triples("[" * n + "]" * n)) == n and len(triples('{"a":"' + "[" * n + '"}')) == 2
    deep = '{"final_locations":' + '{"entities":' * n + "1" + "}" * (n + 1)
    assert len(nested_rows(triples(deep), **SHAPE)) == n - 1


def test_shred_struct(spark):
    """Null arrays, structs and elements; names with dots; arrays of values; the link is all ordinals but the last."""
    schema = "k long, v struct<a: array<struct<b: int, c: array<string>, `d.e`: struct<f: int>>>, g: string>"
    rows = [(1, ([(5, ["x", None, "y"], (7,)), None, (None, None, None)], "g")), (2, (None, None)), (3, None)]
    t = shred_struct(spark.createDataFrame(rows, schema), "k", "v")
    got = {name: {tuple(r) for r in df.collect()} for name, df in t.items()}
    assert got == {"": {(1, "g"), (2, None), (3, None)}, "a[]": {(1, 1, 5, 7), (1, 2, None, None)}, "a[].c[]": {(1, 1, 1, "x"), (1, 1, 2, "y")}}
    assert t["a[]"].columns == ["rec_id", "ord_1", "b", r"d\.e.f"]
