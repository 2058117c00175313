"""Cyclomatic complexity and lines of code of source files, by a state machine over tokens.

One pass over a file's tokens (comments and strings are single tokens) tracks where functions begin and end: in languages with braces a name, its
parameters and an opening brace; in Python `def` with its indentation. A function's complexity is 1 plus its branch tokens, those of functions inside it
not counted. Files are rows; a task holds one file's tokens at a time. Files of unknown languages give no row; null content is empty; unclosed
functions end with the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.chunking import SUFFIXES, suffix

#: Tokens that add a branch, by family of languages.
BRANCHES = {
    "python": frozenset("if elif for while except and or case".split()),
    "brace": frozenset("if for foreach while case catch && || ?".split()),
    "go": frozenset("if for case && ||".split()),
    "rust": frozenset("if for while match && || ?".split()),
    "kotlin": frozenset("if for while when catch && || ?:".split()),
}
#: Words before parentheses and a brace that begin no function.
CONTROL = frozenset("if for foreach while switch catch match when return synchronized using lock with do else try elif sizeof new".split())
COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
STRINGS = r"\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?|`(?:\\.|[^`\\])*+`?"
BRACE_TOKEN = re.compile(rf"(?P<skip>{COMMENTS}|{STRINGS})|(?P<line>\n)|(?P<word>[^\W\d]\w*)|(?P<op>&&|\|\||\?\.|\?:|\?\?|=>|->|::)|(?P<one>\S)", re.S)
PYTHON_TOKEN = re.compile(r"(?P<skip>#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?)|(?P<line>\n)|(?P<word>[^\W\d]\w*)|(?P<one>\S)", re.S)
ROWS = "name string, start_line int, end_line int, complexity int"


def family(path: str) -> str | None:
    language = SUFFIXES.get(suffix(path))
    return language if language in ("python", "go", "rust", "kotlin") else "brace" if language and language not in ("ruby", "proto") else None


def tokens(text: str, pattern: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Token, line (from 1) and column of the first token that follows on it; strings are given as `""`."""
    line, start = 1, 0
    for m in pattern.finditer(text):
        kind = m.lastgroup
        if kind == "line":
            line, start = line + 1, m.end()
        elif kind == "skip":
            if not m[0].startswith(("#", "//", "/*")):
                yield '""', line, m.start() - start
            line += m[0].count("\n")
            if "\n" in m[0]:
                start = m.start() + m[0].rindex("\n") + 1
        else:
            yield m[0], line, m.start() - start


def in_braces(found: list[tuple[str, int, int]], branches: frozenset[str]) -> Iterator[tuple[str, int, int, int]]:
    """Functions of a language with braces, as they end."""
    open_: list[list] = []  # name, first line, depth, complexity
    depth = parens = 0
    name, candidate, line = "", None, 1  # candidate: name, line and parentheses open before its own
    for token, line, _ in found:
        if token == "(":
            if name:
                candidate = None if name in CONTROL else (name, line, parens)
            parens += 1
        elif token == ")":
            parens = max(0, parens - 1)
        elif token == "{":
            depth += 1
            if candidate and parens == candidate[2]:
                open_.append([*candidate[:2], depth, 1])
            candidate = None
        elif token == "}":
            if open_ and open_[-1][2] == depth:
                own = open_.pop()
                yield own[0], own[1], line, own[3]
            depth = max(0, depth - 1)
            candidate = None
        elif token in (";", "=>") and candidate and parens == candidate[2]:
            candidate = None
        if token in branches and open_:
            open_[-1][3] += 1
        name = token if token.isidentifier() else ""
    while open_:
        own = open_.pop()
        yield own[0], own[1], line, own[3]


def in_python(found: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """Functions of a Python file, as they end."""
    open_: list[list] = []  # name, first line, column, complexity, last line
    row = parens = 0
    defining = False
    for token, line, column in found:
        if line != row and parens == 0:  # the first token of a logical line ends what is indented as much or more
            while open_ and column <= open_[-1][2]:
                own = open_.pop()
                yield own[0], own[1], own[4], own[3]
            first = column
        row = line
        if defining:
            open_.append([token, line, first, 1, line])
            defining = False
        elif token == "def" and parens == 0:
            defining = True
        elif token in "([{":
            parens += 1
        elif token in ")]}":
            parens = max(0, parens - 1)
        for own in open_:
            own[4] = line
        if token in BRANCHES["python"] and open_:
            open_[-1][3] += 1
    while open_:
        own = open_.pop()
        yield own[0], own[1], own[4], own[3]


def measured(path: str, text: str | None) -> tuple[int, list[tuple[str, int, int, int]]] | None:
    """Lines that hold a token beside comments, and the functions in order, from one pass over the text; None for unknown languages."""
    kind = family(path)
    if kind is None:
        return None
    found = list(tokens(text or "", PYTHON_TOKEN if kind == "python" else BRACE_TOKEN))
    functions = in_python(found) if kind == "python" else in_braces(found, BRANCHES[kind])
    return len({t[1] for t in found}), sorted(functions, key=lambda r: (r[1], r[2], r[0]))


def functions_of(path: str, text: str | None) -> list[tuple[str, int, int, int]] | None:
    """Name, first and last line and complexity of each function, in order; None for unknown languages."""
    own = measured(path, text)
    return own and own[1]


def lines_of_code(path: str, text: str | None) -> int:
    """Lines that hold a token beside comments."""
    return len({line for _, line, _ in tokens(text or "", PYTHON_TOKEN if family(path) == "python" else BRACE_TOKEN)})


def file_metrics(files: DataFrame) -> DataFrame:
    """path, loc, n_functions, complexity (the sum over functions) and functions (name, start_line, end_line, complexity) of files (path, content) in known languages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["content"], strict=True):
                own = measured(path, text)
                if own is not None:
                    loc, found = own
                    names = ("name", "start_line", "end_line", "complexity")
                    out.append((path, loc, len(found), float(sum(f[3] for f in found)), [dict(zip(names, f, strict=True)) for f in found]))
            yield pd.DataFrame(out, columns=["path", "loc", "n_functions", "complexity", "functions"])

    return files.where(F.col("path").isNotNull()).select("path", "content").mapInPandas(run, "path string, loc int, n_functions int, complexity double, functions array<struct<name: string, start_line: int, end_line: int, complexity: int>>")
