import time
import ast
import glob
import json
import os
import sys
import tomllib
import warnings

import pytest

from cairnlake.llm.grammar_code import check_go, check_javascript, check_shell
from cairnlake.llm.grammar_data import check_json, check_toml, check_yaml
from cairnlake.llm.grammar_python import check as check_python
from cairnlake.llm.peg import Lexicon, Parser
from cairnlake.llm.syntax_errors import assemble, deep_json, diagnose, parse_files, rates, line_of

SCHEMA = "id string, repository_id string, blob_sha string, chunker_version string, language string, path string, start_line int, end_line int, content string, chunk string, valid string"


def test_parser_generator():
    lex = Lexicon()
    p = Parser("file <- (stmt NL)* EOF\nstmt << A '=' expr\nexpr <- term ('+' term)*\nterm <- A / '(' expr ')' / !'x' N", lex)
    kinds = lambda t: "".join(lex[{"a": "A", "1": "N", "\n": "NL"}.get(c, c)] for c in t)
    assert p.parse(kinds("a=a+1\na=(a)\n"), "file")[0] > 0
    assert p.parse(kinds("a=a+\n"), "file") == (-1, 4)
    assert p.parse(kinds("a=a+1\na=(a\n"), "file")[0] == -1 and p.shared


def test_python_against_the_standard_library():
    sys.setrecursionlimit(20_000)
    seen = wrong = 0
    for path in sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[:120]:
        text = open(path, encoding="utf-8").read()
        seen, wrong = seen + 1, wrong + (check_python(text) is not None)
    assert seen > 100 and wrong <= 3  # the parser of the library has the last word on those


@pytest.mark.parametrize("text", [
    "def f(x)\n    return x\n", "if x:\npass\n", "x = (1,\n", "x = 'a\n", "print 'x'\n", "def f():\n\tif x:\n        y\n", "f() = 1\n", "a b\n", "class A:\n", "try:\n    x\ny\n", "x = 1 +\n", "<<<<<<< HEAD\nx\n=======\n", "else:\n  x\n",
    "x = {1: 2, 3}\n", "f(a=1, 2)\n", "return = 1\n", "x = 012\n", "  x = 1\n", "lambda: (yield\n", "for x in y\n  z\n", "x = “a”\n", 'f"{a +}"\n', "@dec\nx = 1\n", "match x:\n    y\n"])
def test_python_rejected(text):
    with warnings.catch_warnings(), pytest.raises(SyntaxError):
        warnings.simplefilter("ignore")
        ast.parse(text)
    assert check_python(text) is not None


@pytest.mark.parametrize("text", [
    "", "x\n", "match = 1\nmatch x:\n    case [1, *_] if y: pass\n    case A(b=c) | {'k': v, **r}:\n        z\n", "async def f[T](a, /, b: int = 1, *c, d, **e) -> None:\n    async with a as b, c: await d\n", "x = yield_ = 1; y: int = 2\n",
    "f(*a, **b, c=1)\n[x for y in z if w for v in u]\n", "with (a as b, c):\n    pass\n", "try:\n    a\nexcept* (B, C) as e:\n    d\nelse: f\nfinally:\n    g\n", "if (n := len(a)) > 1: pass\n", "x = f'{a!r:>{w}} {b.c[0]}' 'd' r'e'.f\n", "a = b if c else lambda *d, e=1: d\n",
    "@a.b(c)\nclass D(E, metaclass=F):\n    '''doc'''\n", "def f():\n    yield\n    x = yield from y\n", "type A[B] = C\n", "x = 1_000j + 0xFF + .5e3\n", "a[1:2, ::3, ...] @= b\n", "x = [\n1,\n  2]\n\n# c\n", "del a, (b, c)\nglobal d\n"])
def test_python_accepted(text):
    ast.parse(text)
    assert check_python(text) is None


def test_data_languages_against_the_standard_library():
    for text in ('{"a": [1, -2.5e3, "\\u00e9", null, true]}', "[]", '"x"', "", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", "[NaN]", "01", '["\t"]', "[1]]", "nul", '{"a" 1}', "-", '"\\x"'):
        try:
            json.loads(text, parse_constant=lambda w: 1 / 0)
            good = True
        except (ValueError, ZeroDivisionError):
            good = False
        assert (check_json(text) is None) is good, text
    for text in ("a = 1\na = 2\n", "[a]\nb=1\n[a]\n", "[[a]]\nb=1\n[[a]]\nb=2\n", "a.b = 1\na.c = 2\n", "x = [1,\n 2, # c\n]\n", "d = 1979-05-27T07:32:00Z\n", "a = 01\n", "a = 'x\n", 's = """a\nb"""\n', "t = {a = 1}\n", "t = {a = 1,}\n",
                 "a\n", "[a\n", "a = 1 b = 2\n", '"a b" = 1\n', "<<<<<<< x\n", "a = +inf\n", "", "a = {b = 1}\na.c = 2\n", "t = {a = 1, a = 2}\n", "[a.b]\n[a]\nb.c = 1\n", "[a]\n[a.b]\n[[c]]\n[c.d]\n[[c]]\n[c.d]\n", "[a.b.c]\n[a]\nx = 1\n", "a.b = 1\n[a]\n", "a = 0x_1\n",
                 "a = 2020-13-01\n", "a = 07:32:00\n", 'a = "\\ud800"\n', "a = '\x01'\n", "a = -0x1\n", "1.5 = 2\n[1]\n"):
        try:
            tomllib.loads(text)
            good = True
        except ValueError:
            good = False
        assert (check_toml(text) is None) is good, text


@pytest.mark.parametrize("text, good", [
    ("a: 1\nb:\n  - x\n  - y: 2\n    z: 3\nc: [1, {a: b}]\n", 1), ("- - a\n  - b\n", 1), ("a: |\n  x: y\nb: >-\n  z\n", 1), ("a: &b 1\nc: *b\n<<: *b\n", 1), ("---\na: 1\n---\nb\n", 1), ("a: x\n  y\n", 1), ("a: [\n  1,\n]\n", 1), ("list:\n- a\n", 1), ("a: # c\n- b\nd: *e # f\n", 1), ("--- |\n  x\n", 1), ("a:\n  &b\n  c: d\n", 1), ('a: "b\\\\d"\n', 1), ('a: "\\d"\n', 0), ("? a\n: b\n? - c\n  - d\n: e: f\n", 1), (": a\n", 0), ("{a: b}: c\n[1]: 2\n", 1), ("a: {b: c}: d\n", 0), ("?\n  a: b\n:\n  c\n", 1),
    ("a: b: c\n", 0), ("a: 'x\n", 0), ("a: [1, 2\n", 0), ("a: 1\n\tb: 2\n", 0), ("a:\n  b\n c: d\n", 0), ("a: 1\n<<<<<<< HEAD\nb: 2\n", 0), ("a: b\n- c\n", 0), ("a: @x\n", 0)])
def test_yaml(text, good):
    assert (check_yaml(text) is None) is bool(good)


CODE = [
    (check_javascript, "const a = {b, c: [1,,2], d() { return 1 }, get e() { return 2 }, ...f};\nexport default a\n", 1), (check_javascript, "if (a) {\n", 0), (check_javascript, "a b\n", 0), (check_javascript, "let x = /[/]/g.test(y) / 2;\n", 1),
    (check_javascript, "for (const [k, v] of m) f(k);\nconst f = async (a, {b = 1}, ...c) => { await a; };\n", 1), (check_javascript, "`a ${b + `c ${d}`} e`\n", 1), (check_javascript, "foo(1, 2\n", 0), (check_javascript, "<<<<<<< HEAD\n", 0),
    (check_javascript, "class A extends B { #p = 1; static x = 2; constructor() { super(); } async *g() { yield 1; } }\n", 1), (check_javascript, "const s = 'abc\n", 0), (check_javascript, "<div>a</div>\n", 0), (check_javascript, "}\n", 0),
    (check_go, "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", 0), (check_go, "package a\nfunc (t *T) F(a, b int) (x int, err error) {\n\tfor i := range m {\n\t\tx++\n\t}\n\treturn a[1:], nil\n}\n", 1), (check_go, "func f() {}\n", 0),
    (check_go, "package a\nfunc f() {\n", 0), (check_go, "package a\nvar m = map[string][]T{\"a\": {{A: 1}}}\ntype I interface {\n\tM(int) error\n}\n", 1), (check_go, "package a\nx := 1\n", 0), (check_go, "package a\nfunc f() { x := }\n", 0),
    (check_shell, "if [ -f x ]; then echo a; else b; fi\nfor f in a b; do x; done\ncase $x in a|b) c ;; *) d ;; esac\n", 1), (check_shell, "f() {\n  a=$(cat \"$b\") <<EOF\nif (\nEOF\n}\n", 1), (check_shell, "if a; then b\n", 0), (check_shell, "echo 'abc\n", 0),
    (check_shell, "(a) 2>/dev/null\nexit 2\nwhile read x; do y; done < <(z)\n[[ $a =~ ^(b|c)$ ]] && d {fd}>&1\n", 1), (check_javascript, "x = a &&\n  /b/.test(c) || d / e / f\n", 1), (check_go, "package a\nfunc f() {\n\tswitch {\n\tcase a.b != \"\", c(d):\n\t\te()\n\t}\n}\n", 1),
    (check_shell, "done\n", 0), (check_shell, "}\n", 0), (check_shell, "echo \"a $(b)\" >> c 2>&1 && d\n", 1), (check_shell, "for x in a; do done\n", 0)]


@pytest.mark.parametrize("check, text, good", CODE)
def test_code_languages(check, text, good):
    assert (check(text) is None) is bool(good)


def test_assembly():
    assert assemble([(1, "a\r\nb"), (4, "c\n")])[0] == "a\nb\n\nc\n"
    assert assemble([(1, "a\nb\nc"), (2, "B\nC")])[0] == "a\nB\nC"
    assert assemble([(1, "a"), (1, "abc")])[0] == "abc"


@pytest.mark.parametrize("chunks", [[(1, "a\nb"), (2_000_000_000, "c\nd\n"), (2_000_000_010, "e")], [(7, "a\nb"), (7, "A"), (50, "c\nd\n"), (51, "D"), (2_000_000_010, "e")], [(90, "a")], [(1, "a\n"), (2, "b"), (9, "c")]])
def test_lines_of_files_with_gaps(chunks):
    text, jumps = assemble(chunks)
    assert len(text) < 60
    want = {c: s + n for s, content in chunks for n, c in enumerate(content.split("\n")) if c}
    assert all(line_of(n, jumps) == want[c] for n, c in enumerate(text.split("\n"), 1) if c) and line_of(None, jumps) is None


def test_diagnosis():
    assert diagnose("json", "[NaN]")[0] is False and diagnose("python", "x = 1")[0] is True
    assert diagnose("python", "def f():\n    x = (1,\n")[2] == "truncated"
    assert diagnose("go", "package a\n<<<<<<< HEAD\nvar a = 1\n=======\nvar b = 1\n>>>>>>> x\n")[1:] == (2, "merge conflict")
    assert diagnose("javascript", "<!doctype html>\n<p>x</p>\n")[2] == "other language"
    assert diagnose("python", "\x00\x01PK\x03\x04" * 9)[2] == "not text"


def test_deep_files():
    n = 50_000
    assert diagnose("json", "[" * n + "]" * n) == (True, None, None) and diagnose("json", '{"a": [' * n + "1")[::2] == (False, "truncated")
    assert diagnose("json", "\n".join("[" * n) + "1 2" + "]" * n)[:2] == (False, n) and diagnose("json", "[" * n + "1,]" + "]" * n)[0] is False
    for language, head, a, b, tail in (("python", "x = ", "[", "]", "\n"), ("javascript", "x = ", "[", "]", ";\n"), ("go", "package a\nvar x = 1 + ", "(", ")", "\n"), ("yaml", "a: ", "[", "]", "\n"), ("toml", "x = ", "[", "]", "\n"), ("shell", "", "(\n", ")\n", "")):
        inner = {"go": "1", "shell": "ls\n"}.get(language, "")
        assert diagnose(language, head + a * 20_000 + inner + b * 20_000 + tail) == (True, None, None), language
        assert diagnose(language, head + a * 20_000 + inner)[::2] == (False, "truncated"), language
    assert diagnose("javascript", "x = " + "[" * 200_000) == (None, None, "too deep")
    for text in ('{"a": [1, -2.5e3, "\\u00e9", true, null, {}, []]}', '{"a" 1}', "[1 2]", "[,]", "{,}", '{"a": 1,}', "01", "[NaN]", '"\t"', "", "1 1", "]", '{"a"}', "{1: 2}", "-", "[1", '["a": 1]', " 1 ", "truex"):
        assert (deep_json(text) is None) == diagnose("json", text)[0], text


def test_long_quoted_scalars_in_yaml():
    lines = "\n".join(["  word"] * 5_000)
    for q in "\"'":
        assert diagnose("yaml", f"a: {q}x\n{lines}{q}\nb: [{q}x\n{lines}{q}, 1]\n") == (True, None, None)
    assert diagnose("yaml", f"a: 'x\n{lines}\nb: 1\n")[0] is False


def test_files(spark):
    data = [("1", "r", "b1", "1", "python", "a.py", 1, 9, "def f():", "c", "v"), ("2", "r", "b1", "1", "python", "a.py", 2, 2, "    return 1", "c", "v"), ("2", "r", "b1", "1", "python", "a.py", 2, 2, "    return 1", "c", "v"),
            ("3", "r", "b2", "1", "python", "b.py", 1, 1, "def f(:", None, None), ("4", "r", "b2", "0", "python", "b.py", None, None, "x = 1", None, None), ("5", "r", "b3", "1", "markdown", "c.md", 1, 1, "(((", None, None),
            ("6", "r", "b4", "1", None, "d", 1, 1, "(((", None, None), ("7", None, None, "1", "json", None, 1, 1, None, None, None), ("8", "r", "b5", "1", "python", "e.py", 1, 1, "x = 1\n" * 100_000, None, None), ("9", "r", "b6", "1", "toml", "f", 0, 1, "", None, None)]
    d = spark.createDataFrame(data, SCHEMA)
    got = {(r["blob_sha"], r["chunker_version"]): r["valid"] for r in parse_files(d).collect()}
    assert got == {("b1", "1"): True, ("b2", "1"): False, ("b2", "0"): True, (None, "1"): False, ("b5", "1"): True, ("b6", "1"): True}
    r = {(x["repository_id"], x["language"]): (x["files"], x["invalid"], x["rate"]) for x in rates(parse_files(d)).collect()}
    assert r[("r", "python")] == (4, 1, 0.25)
    assert parse_files(spark.createDataFrame([], SCHEMA)).count() == 0


LONG = {"spaces": "x" + " " * 200_000 + "y", "tabs": "\t" * 200_000 + "x", "returns": "\r" * 200_000, "comments": "/* " * 70_000, "strings": "'a\n" * 70_000, "word": "a" * 200_000, "digits": "7" * 200_000, "keys": "a b " * 50_000 + ": c", "blocks": "a: |\n" * 40_000}


@pytest.mark.parametrize("language", ("python", "javascript", "go", "shell", "json", "yaml", "toml"))
def test_linear(language):
    for name, text in LONG.items():
        began = time.process_time()
        diagnose(language, text)
        assert time.process_time() - began < 4, name
