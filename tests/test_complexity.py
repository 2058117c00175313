"""Complexity and lines of code of small files in several languages."""

import time

from quarry.plans import registry
from quarry.sources import complexity

PYTHON = '''import os


def plain(a, b=(1, 2)):
    """Doc: if and or."""
    return a  # if


class K:
    async def method(self, x):
        if x and (x > 1 or
                  x < 5):
            return [i for i in x if i]

        def inner():
            while True:
                pass
        try:
            return "if" if x else 0
        except ValueError:
            return 1


last = 3
'''
JS = """// if (x) {}
function plain(a) { return a; }
const arrow = (x) => { if (x) { return 1; } };
class K {
  method(x, y) {
    for (let i = 0; i < 3; i++) { if (x && y || !x) { call(function named() { return x ? 1 : 2; }); } }
    switch (x) { case 1: break; case 2: break; default: }
    try { run(); } catch (e) { /* if */ }
    return "if (";
  }
}
"""
GO = 'func Add(a int) (int, error) {\n\tfor i := 0; i < a; i++ {\n\t\tif a > 1 && a < 3 {\n\t\t\treturn a, nil\n\t\t}\n\t}\n\treturn `if`, nil\n}\n'


def test_functions_by_language():
    assert complexity.functions_of("a.py", PYTHON) == [("plain", 4, 6, 1), ("method", 10, 21, 8), ("inner", 15, 17, 2)]
    assert complexity.functions_of("a.js", JS) == [("plain", 2, 2, 1), ("method", 5, 10, 8), ("named", 6, 6, 2)]
    assert complexity.functions_of("a.go", GO) == [("Add", 1, 8, 4)]
    assert complexity.functions_of("a.txt", "x") is None and complexity.functions_of("a.c", None) == [] and complexity.functions_of("a.c", "int f(void) { if (1) {") == [("f", 1, 1, 2)]
    assert complexity.lines_of_code("a.go", GO + "\n// note\n\n/* two\nlines */ x\n") == 9 and complexity.lines_of_code("a.py", "# c\n\nx = '''a\nb'''\ny\n") == 2


def test_files_as_rows_and_long_files(spark):
    rows = [("a.py", PYTHON), ("b.rb", "def x; end"), ("c.java", None), (None, "x"), ("d.py", "def f(:\n  x"), ("d/e.ts", "")]
    got = {r["path"]: (r["loc"], r["n_functions"], r["complexity"]) for r in complexity.file_metrics(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"a.py": (17, 3, 11.0), "c.java": (0, 0, 0.0), "d.py": (2, 1, 1.0), "d/e.ts": (0, 0, 0.0)}
    began = time.time()
    complexity.functions_of("a.js", "f(a) { if (a) { 'x\n" * 30_000 + "/*" * 30_000)
    complexity.functions_of("a.py", "def f():\n    if x: pass\n" * 30_000)
    assert time.time() - began < 20


def test_query_reads_every_order(spark):
    rows = registry.QUERIES["code_metrics"](spark, "/root/testdata/sf0.001").collect()
    orders = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    assert len(rows) == orders and all(r["complexity"] == 3 * r["n_functions"] for r in rows)


def test_a_file_is_tokenised_once(monkeypatch):
    runs = []
    plain = complexity.tokens
    monkeypatch.setattr(complexity, "tokens", lambda *a: runs.append(a) or plain(*a))
    for path, text in (("a.py", PYTHON), ("a.js", JS), ("a.go", GO)):
        runs.clear()
        assert complexity.measured(path, text) is not None and len(runs) == 1
        assert complexity.measured(path, text) == (complexity.lines_of_code(path, text), complexity.functions_of(path, text))
    assert complexity.measured("a.txt", "x") is None
