import time

import pytest

from cairnlake.llm.generated_files import classify, features, notice
from tests.conftest import rows

SCHEMA = "id string, repository_id string, path string, patch string, repo string, kind string, text string"


def run(spark, data):
    d = spark.createDataFrame([(str(i) if k is None else k, r, p, t, "x", "y", "z") for i, (k, r, p, t) in enumerate(data)], SCHEMA)
    return {(r["repo"], r["path"]): (r["kind"], r["by"]) for r in classify(d).collect()}


@pytest.mark.parametrize("text, kind", [
    ("@generated by x 3.2", "generated"), ("Code generated by protoc. DO NOT EDIT.", "generated"), ("<auto-generated />", "generated"), ("do not hand-edit: written by scripts/x", "generated"),
    ("-- output of x, do not modify --", "generated"), ("This file was created automatically by x;", "generated"), ("Automatisch erzeugt mit x, nicht von Hand ändern", "generated"), ("Vendored copy of x", "vendored"),
    ("x v1.2.3 | (c) the x authors | MIT", "vendored"), ("Copyright the x project contributors", "vendored"), ("writes the DO NOT EDIT banner into the output files", None), ("checks that @generated is there", None),
    ("Licensed under the MIT license.", None), ("@license MIT", None), ("Permission is hereby granted, free of charge, to any person", None), ("(c) 2024 this file is generated by x", "generated"), ("(c) shard team", None), ("merge the rows", None)])
def test_notices(text, kind):
    assert notice(text) == kind


def test_notice_only_in_header_comments():
    head = "@@ -0,0 +1,2 @@\n+# @generated\n+x = 1\n"
    assert features(head, True)[0] == 1
    assert features("@@ -0,0 +1,2 @@\n+x = 1\n+# @generated\n", True)[0] == 0
    assert features('@@ -1 +1 @@\n+mark = "@generated"\n', True)[0] == 0


def test_notice_below_a_long_header():
    banner = "".join(f"# rule {i} of the house\n" for i in range(60))
    assert features(banner + "# @generated\nx = 1\n# @generated\n", False)[0] == 1
    assert features("@@ -0,0 +1,62 @@\n" + "".join(f"+{x}\n" for x in banner.splitlines()) + "+# @generated\n+x = 1\n", True)[0] == 1


def test_files(spark):
    table = "@@ -1 +1 @@\n var t = []int{\n" + "+  0x23, 0xc2, 0xd6,\n" * 8 + " }"
    dense = "@@ -1 +1 @@\n+" + "var a=b(c);d&&(e=f[3]);" * 60
    code = "@@ -1,2 +1,3 @@\n def f(x):\n+    return x + 1\n"
    got = run(spark, [
        (None, "r", "a/yarn.lock", None), (None, "r", "vendor/pkg/x.go", None), (None, "r", "src/vendor/mine.py", code), (None, "r", "x.min.js", None), (None, "r", "p/x_pb2.py", ""), (None, "r", "data/t.go", table),
        (None, "r", "static/d.js", dense), (None, "r", "src/f.py", code), (None, "r", "src/g.py", code), (None, "r", "src/g.py", "@@ -1 +1 @@\n+# Code generated by x. DO NOT EDIT.\n"), ("same", "r", "src/h.py", code), ("same", "r", "src/h.py", code),
        (None, None, "src/f.py", None), (None, "r", None, code), (None, "r", "config/lock12.json", '@@ -1 +1 @@\n+  "a_1": 7449,\n'), (None, "r", "dist/build.py", code), (None, "r", "", "x" * 1_000_000)])
    assert got == {("r", "a/yarn.lock"): ("lockfile", "path"), ("r", "vendor/pkg/x.go"): ("vendored", "path"), ("r", "src/vendor/mine.py"): ("source", None), ("r", "x.min.js"): ("minified", "path"),
                   ("r", "p/x_pb2.py"): ("generated", "path"), ("r", "data/t.go"): ("data", "lines"), ("r", "static/d.js"): ("minified", "lines"), ("r", "src/f.py"): ("source", None), ("r", "src/g.py"): ("generated", "notice"),
                   ("r", "src/h.py"): ("source", None), (None, "src/f.py"): ("source", None), ("r", "config/lock12.json"): ("source", None), ("r", "dist/build.py"): ("source", None), ("r", ""): ("source", None)}


def test_empty(spark):
    assert rows(classify(spark.createDataFrame([], SCHEMA))) == []


LONG = ["7" * 10**6 + "x", "1.1" * 330_000 + "x", "1," * 500_000 + "x", "# " + "1.1." * 250_000 + " do not edit", "# " + "do not edit " * 80_000, "# the " * 160_000, "\\x41" * 250_000, "((((" * 250_000 + "x", "1" + " " * 10**6 + "x", "#" * 10**6,
        "# @generate " * 80_000, "A" * 10**6, "'" + "A" * 10**6]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_linear(text):
    began = time.process_time()
    features(text, False)
    features("@@ -1 +1 @@\n+" + text, True)
    assert time.process_time() - began < 2


def test_data_lines():
    data = ["1, 2, 3,", "{0x1F, 0xab},", "-1.5e3, 2., .5f", "[[1, 2], [3, 4]],", "'" + "QUJD" * 12 + "',", "7" * 10_000]
    code = ["x = 1", "1 + f(2)", "127.0.0.1x", "7" * 10_000 + "x", "1e"]
    for lines, want in ((data, len(data)), (code, 0)):
        assert features("\n".join(x for x in lines if len(x) < 300), False)[5] == sum(len(x) < 300 for x in lines) * (want > 0)


def test_one_long_string_is_not_minified(spark):
    long = "x" * 20 + "|yz" * 300
    code = "\n".join(f"+  call{i}(a, b);" for i in range(7))
    got = run(spark, [(None, "r", "a.js", f"@@ -0,0 +1,8 @@\n{code}\n+const PATTERN = '{long}';"), (None, "r", "b.js", f"@@ -0,0 +1,3 @@\n+/* licence */\n+!function(){{{long}}}();\n+{long}"), (None, "r", "c.js", f"@@ -0,0 +1 @@\n+{long}")])
    assert {k[1]: v[0] for k, v in got.items()} == {"a.js": "source", "b.js": "minified", "c.js": "minified"}
