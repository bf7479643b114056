from codestrata.functions import answers as A
from codestrata.functions import repairs as R
from codestrata.functions import snippets as K
from codestrata.functions.snippets import Snippet as S

SRC = "X = 1\n\n\nclass A(B):\n    def f(self, a=1):  # note\n        '''Doc.'''\n        if a and X:\n            return [i for i in a if i]\n\n\ndef g(): return 2\n"


def test_figures():
    assert K.complexity(S(SRC)) == 1 + 1 + 1 + 2 and K.complexity(S("return x if y else z")) == 2
    assert K.complexity(S("def (")) is None and K.complexity(S(None)) is None and K.complexity(S(" ")) is None
    assert K.token_length(S("a = 1  # c\n")) == 3 and K.token_length(S("")) == 0 and K.token_length(S("x = (")) >= 3
    assert K.notes(S(SRC)) == "Doc..note" and K.notes(S("x = ( # open")) == "open"
    assert K.outer_functions(S(SRC)) == 2 and K.outer_functions(S("def (")) == 0
    assert K.rendered_signature(S("def f(a, /, b=1, *c, d: int = 2, **e): pass")) == "f(a, /, b, *c, d, **e)"


def test_repairs():
    assert R.unwrapped("```python\ndef f(x):\n    return x\n```", "m.f") == "    return x" and R.unwrapped("def g(): pass", "m.f") == "def g(): pass"
    assert R.first_line_indented("x = 1\n    y = 2\n") == "    x = 1\n    y = 2\n" and R.first_line_indented("x = 1\n") == "x = 1\n"
    assert R.indent_levelled(" x = 1\n    y = 2") == "    x = 1\n    y = 2" and R.indent_levelled("if x:\n    y") == "if x:\n    y"
    assert R.only_completion("def f(x):\n    '''Does it.'''\n    return 1", "def f(x):", "", "Does it.") == "    \n    return 1"
    assert K.masked_body(SRC, "f", 5, 5).splitlines()[5].strip() == "pass" and len(K.masked_body(SRC, "f", 5, 5).splitlines()) == len(SRC.splitlines())
    assert K.masked_body(SRC, "zz", 1, 2) is None


def test_structure():
    assert {e[1:3] for e in K.entities_of("src/m.py", S(SRC, wrap=False))} == {("X", "variable"), ("A", "class"), ("A.f", "function"), ("g", "function")}
    assert K.entities_of("src/m.py", S(SRC, wrap=False))[1][3] == "m.A"
    assert K.used_globals(S(SRC), "f") == ["X"] and K.skeleton(S(SRC)).startswith("class A(B):\n    def f(self, a=1): ...")


def test_json():
    assert A.largest_json('see {"a": 1} or {"b": {"c": 2}} end') == '{"b": {"c": 2}}' and A.largest_json("none") is None
    assert A.fields_between('{"description": "d, "flow": "x\\ny"}', ["description", "flow"])["flow"] == "x\ny"
    assert R.fitted_messages([("user", "u" * 5), ("tool", "t" * 50), ("assistant", "a" * 5)], 30) == [("user", "u" * 5), ("tool", "t" * 17 + "..."), ("assistant", "a" * 5)]


def test_method_code():
    body = "class A:\n    @p\n    def f(self):\n        return 1\n\n\ndef g(x):\n    return x\n"
    assert K.method_source(body, "m.g", 7, 8) == "def g(x):\n    return x" and K.method_source(body, "m.A.f") == "    @p\n    def f(self):\n        return 1"
    assert K.method_source("def g(x):\n    return x\n\ndef broken(:\n", "g").startswith("def g(x):\n    return x") and K.method_source(body, "zz") is None and K.method_source(None, "g") is None
    assert K.definition_in("Here:\n```python\ndef g(x):\n    return 2\n```\nDone.", "g") == "def g(x):\n    return 2" and K.definition_in("none", "g") is None
    assert K.java_notes("/** Does it.\n * @param x y\n */ int f() { return 1; // one\n}") == "Does it..one"


def test_repairs_more():
    assert {"if", "else", "for", "with", "match", "case", "async", "class", "finally"} <= R.opening_words() and not {"return", "await", "lambda", "not"} & R.opening_words()
    assert R.unwrapped("def f(x): return x", "f") == "return x" and R.unwrapped("x = 1\ndef f(): pass", "f") == "x = 1\ndef f(): pass" and R.unwrapped(None, "f") == ""
    assert R.indent_levelled("@p\n    x") == "@p\n    x" and R.indent_levelled(None) == "" and R.first_line_indented(None) == ""
    assert R.fitted_messages([("tool", "abc")], 10) == [("tool", "abc")]
    assert K.masked_body("\n\ndef f(x): return x\n", "f", 3, 3) == "\n\ndef f(x): pass\n" and K.masked_body("def (", "f", 1, 1) is None
    assert K.outer_functions(S("def f():\n    class A:\n        def g(self): pass\n")) == 1 and K.complexity(S("match x:\n    case 1: pass\n    case _: pass")) == 3
