"""Chunking against a plain quadratic splitter, fenced blocks, header sections and symbol borders."""

import hashlib
import random
import re
import time

import pytest

from quarry.operators import chunking
from quarry.plans import registry

SF = "/root/testdata/sf0.001"


def plain_split(text, marks, size, overlap):
    """By lists and re.split, as the rules say, without regard to time."""
    k = next(i for i, m in enumerate(marks) if m in text)
    if marks[k]:
        bits = re.split(f"({re.escape(marks[k])})", text)
        parts = [x for x in [bits[0], *("".join(bits[i : i + 2]) for i in range(1, len(bits), 2))] if x]
    else:
        parts = list(text)
    out, run = [], []

    def flush():
        held = []
        for p in run:
            if held and sum(map(len, held)) + len(p) > size:
                out.append("".join(held).strip())
                while sum(map(len, held)) > overlap or (held and sum(map(len, held)) + len(p) > size):
                    held = held[1:]
            held.append(p)
        out.append("".join(held).strip())
        run.clear()

    for p in parts:
        if len(p) < size:
            run.append(p)
        else:
            flush()
            out += plain_split(p, marks[k + 1 :], size, overlap) if marks[k + 1 :] else [p]
    flush()
    return [x for x in out if x]


def plain_markdown(text, size, overlap):
    spans = [m.span() for m in re.finditer(r"(```|~~~)(\w*)\n(.*?)\1", text, re.DOTALL)]
    if not spans:
        return plain_split(text, chunking.PLAIN, size, overlap)
    out, cur, last = [], "", 0
    for a, b in [*spans, (len(text), len(text))]:
        if text[last:a].strip():
            for i, p in enumerate(plain_split(text[last:a], chunking.PLAIN, size, overlap)):
                if i == 0 and cur and len(cur) + len(p) <= size:
                    cur += p
                else:
                    out.append(cur.strip())
                    cur = p
        if b > a:
            if cur and len(cur) + b - a > size:
                out.append(cur.strip())
                cur = text[a:b]
            else:
                cur += text[a:b]
        last = b
    return [x for x in [*out, cur.strip()] if x]


def made(rng, n):
    return "".join(rng.choice(["word ", "a", "é☃ ", "\n", "\n\n", "\n\n\n", "```py\n", "```\n", "~~~\n", "~~~", "# Head\n", "longerwordwithoutspaces" * 3, "\ndef f", "\nclass B", " " * 4]) for _ in range(n))


@pytest.mark.parametrize("size,overlap", [(1, 0), (20, 0), (40, 15), (60, 59), (300, 50)])
def test_chunks_equal_the_plain_rules(size, overlap):
    rng = random.Random(size)
    for n in [0, 1, 2, 5, 30, 30, 120, 120, 300] * 4:
        text = made(rng, n)
        assert chunking.chunk(text, None, size, overlap) == (plain_markdown(text, size, overlap) if text.strip() else [])
        assert chunking.chunk(text, "x/a.py", size, overlap) == (plain_split(text, chunking.separators("a.py"), size, overlap) if text.strip() else [])


def test_documents_equal_the_plain_rules(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {(r["doc_id"], r["chunk_index"]): (r["n_chars"], r["chunk_hash"]) for r in registry.QUERIES["document_chunks"](spark, SF).collect()}
    want = {(i, k): (len(c), hashlib.sha256(c.encode()).hexdigest()) for i, t in docs.items() if t and t.strip() for k, c in enumerate(plain_markdown(t, 1500, 200))}
    assert got == want


def test_fences_stay_whole():
    code = "\n".join(f"line_{i} = {i}" for i in range(100))
    text = f"# Intro\n\nSome text.\n\n```python\n{code}\n```\n\nMore.\n\n~~~\nshort\n~~~\nend ```open\n never closed"
    chunks = chunking.split_markdown(text, 300, 50)
    assert sum(code in c for c in chunks) == 1 and any("~~~\nshort\n~~~" in c for c in chunks) and chunks[-1].endswith("never closed")
    assert [text[a:b] for a, b in chunking.fences(text)] == [f"```python\n{code}\n```", "~~~\nshort\n~~~"]
    began = time.time()
    chunking.chunk("```a\n" * 60_000 + "~~~\n" * 3)
    chunking.chunk("x" * 300_000, None, 1500, 200)
    assert time.time() - began < 10


def test_changed_parts_change_only_their_chunks():
    part = lambda k, words: f"## Part {k}\n\n" + f"{words} {k} " * 60
    one = chunking.chunk("\n\n".join(part(k, "same words") for k in range(6)), "a.md", 500, 50)
    two = chunking.chunk("\n\n".join(part(k, "other" if k == 3 else "same words") for k in range(6)), "a.md", 500, 50)
    assert one == chunking.chunk("\n\n".join(part(k, "same words") for k in range(6)), "a.md", 500, 50)
    assert 3 <= len(set(one) & set(two)) < len(set(one))


def test_header_sections(spark):
    text = "intro\n# A\none\n## B\ntwo\n```\n# not a header\n```\n### C\n" + "long words here. " * 40 + "\n# D\n#nothing\nlast"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "plain")], "doc_id long, text string")
    got = [(r["doc_id"], r["chunk_index"], r["headers"], r["content"]) for r in chunking.header_chunks(rows, ["doc_id"], size=300, overlap=30).orderBy("doc_id", "chunk_index").collect()]
    own = [g for g in got if g[0] == 1]
    assert own[0] == (1, 0, None, "intro") and own[1] == (1, 1, "A", "# A\none") and own[2][2:] == ("A > B", "## B\ntwo\n```\n# not a header\n```")
    assert {g[2] for g in own[3:-1]} == {"A > B > C"} and len(own) > 6 and own[-1][2:] == ("D", "# D\n#nothing\nlast") and [g[1] for g in own] == list(range(len(own)))
    assert [g for g in got if g[0] != 1] == [(4, 0, None, "plain")]


def test_header_sections_of_whole_documents(spark):
    rows = registry.QUERIES["header_sections"](spark, SF).collect()
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = set()
    for i, t in docs.items():
        text, k = "# " + t.replace("\n\n", "\n## part\n"), 0
        lines, starts = re.findall(r"[^\n]*\n|[^\n]+", text), []
        fenced = [m.span() for m in re.finditer(r"(```|~~~)(\w*)\n(.*?)\1", text, re.DOTALL)]
        at = 0
        for line in lines:
            if re.match(r"#{1,4}[ \t]", line) and not any(a <= at < b for a, b in fenced):
                starts.append(at)
            at += len(line)
        for a, b in zip([0, *starts], [*starts, len(text)], strict=True):
            part = text[a:b].strip()
            for c in [] if not part else [part] if len(part) <= 1500 else plain_markdown(part, 1500, 200):
                want.add((i, k, hashlib.sha256(c.encode()).hexdigest()))
                k += 1
    assert {(r["doc_id"], r["chunk_index"], r["chunk_hash"]) for r in rows} == want


def test_symbol_borders(spark):
    body = "\n".join(f"    line_{i} = {i}" for i in range(100))
    code = f'"""Doc."""\nimport os\n\nLIMIT = 42\n\n\ndef small():\n    return LIMIT\n\n\n@wraps\nclass Big:\n    """A class."""\n\n    def inner(self):\n        return 1\n\n\ndef large():\n{body}\n'
    files = [("a.py", code), ("b.py", "def broken(:\n  x"), ("c.md", "# Head\n\ntext"), ("d.py", ""), ("e.py", None), ("f.js", "function a() {}\nfunction b() {}")]
    frame = spark.createDataFrame(files, "path string, content string")
    got = [tuple(r) for r in chunking.symbol_chunks(frame, ["path"], size=500, overlap=50).select("path", "chunk_index", "symbol_name", "symbol_kind", "content").orderBy("path", "chunk_index").collect()]
    own = [g for g in got if g[0] == "a.py"]
    assert own[0][2:] == ("small", "function", "def small():\n    return LIMIT") and own[1][2:4] == ("Big", "class") and own[1][4].startswith("class Big:")
    assert len([g for g in own if g[2] == "large"]) > 2 and own[-1][2:] == ("__module__", "module", '"""Doc."""\nimport os\n\nLIMIT = 42\n\n\n\n\n@wraps')
    assert {g[0] for g in got} == {"a.py", "b.py", "c.md", "f.js"} and all(g[2] is None for g in got if g[0] != "a.py")
    assert [r["content"] for r in chunking.code_blocks(frame.withColumnRenamed("content", "text").where("path = 'c.md'"), ["path"]).collect()] == []
