"""Chunks of documents and code: a recursive separator splitter with a carried overlap, whole fenced blocks, header sections and symbol borders.

Documents are dealt out by Spark, a row each; the small functions here cut one text in time linear in its length (times the
separators), and each task yields rows as it goes, so it holds one document's chunks at most.

Splitting: a text is cut before every match of the first separator that it has; pieces shorter than `size` are packed greedily into
chunks, each chunk beginning with the last pieces of the one before, `overlap` characters at most; longer pieces are cut by
the next separators. Chunks are trimmed and never empty. Fenced blocks (``` or ~~~ up to the same mark) are never cut: they join the running chunk
if they fit, and stand alone if they are longer than `size`.

Cases: null, empty and blank texts have no chunk; an unclosed fence is text; paths with an unknown suffix are split as plain text.
"""

from __future__ import annotations

import ast
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SIZE, OVERLAP = 1500, 200
PLAIN = ("\n\n", "\n", " ", "")
#: Words at which lines of a language begin a piece, in order; PLAIN follows.
WORDS = {
    "python": "class|def|\tdef",
    "js": "function|const|let|var|class|if|for|while|switch|case|default",
    "ts": "enum|interface|namespace|type|class|function|const|let|var|if|for|while|switch|case|default",
    "java": "class|public|protected|private|static|if|for|while|switch|case",
    "go": "func|var|const|type|if|for|switch|case",
    "rust": "fn|const|let|if|while|for|loop|match|const",
    "ruby": "def|class|if|unless|while|for|do|begin|rescue",
    "php": "function|class|if|foreach|while|do|switch|case",
    "c": "class|void|int|float|double|if|for|while|switch|case",
    "csharp": "interface|enum|implements|delegate|event|class|abstract|public|protected|private|static|return|if|continue|for|foreach|while|switch|break|case|else|try|throw|finally|catch",
    "swift": "func|class|struct|enum|if|for|while|do|switch|case",
    "kotlin": "class|public|protected|private|internal|companion|fun|val|var|if|for|while|when|case|else",
    "scala": "class|object|def|val|var|if|for|while|match|case",
    "proto": "message|service|enum|option|import|syntax",
}
#: The language of a suffix.
SUFFIXES = {
    "py": "python", "js": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "c", "hpp": "c",
    "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "proto": "proto",
}
MARKDOWN = ("md", "mdx", "rst", "txt", "adoc")
OPENING = re.compile(r"(```|~~~)\w*\n")
HEADER = re.compile(r"(#{1,4})[ \t]+(.*)")


def suffix(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def separators(path: str | None) -> tuple[str, ...]:
    language = SUFFIXES.get(suffix(path))
    return (*(f"\n{w} " for w in WORDS[language].split("|")), *PLAIN) if language else PLAIN


def pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Chunks of neighbouring pieces."""
    held, total = deque(), 0
    for piece in pieces:
        if held and total + len(piece) > size:
            if chunk := "".join(held).strip():
                yield chunk
            while total > overlap or (total and total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    if chunk := "".join(held).strip():
        yield chunk


def split(text: str, marks: tuple[str, ...], size: int, overlap: int) -> Iterator[str]:
    """The chunks of a text without regard to fences."""
    at = next(i for i, m in enumerate(marks) if m in text)  # "" is in every text
    mark, rest = marks[at], marks[at + 1 :]
    if mark:
        cuts = [0, *(m.start() for m in re.finditer(re.escape(mark), text)), len(text)]
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    else:
        pieces = list(text)
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        yield from pack(short, size, overlap)
        short = []
        if rest:
            yield from split(piece, rest, size, overlap)
        else:
            yield piece
    yield from pack(short, size, overlap)


def fences(text: str) -> Iterator[tuple[int, int]]:
    """Where fenced blocks begin and end."""
    at, closed = 0, {"```": True, "~~~": True}
    while m := OPENING.search(text, at):
        end = text.find(m[1], m.end()) if closed[m[1]] else -1
        if end < 0:  # no such mark follows, for later openings neither
            closed[m[1]] = False
            at = m.start() + 1
        else:
            at = end + 3
            yield m.start(), at


def split_markdown(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text whose fenced blocks stay whole."""
    out, running, last = [], "", 0
    blocks = list(fences(text))
    if not blocks:
        return list(split(text, PLAIN, size, overlap))

    def joined(part: str, fits: bool) -> str:
        if fits:
            return running + part
        if running.strip():
            out.append(running.strip())
        return part

    for start, end in [*blocks, (len(text), len(text))]:
        if text[last:start].strip():
            for i, part in enumerate(split(text[last:start], PLAIN, size, overlap)):
                running = joined(part, i == 0 and running != "" and len(running) + len(part) <= size)
        if end > start:
            running = joined(text[start:end], running == "" or len(running) + end - start <= size)
        last = end
    joined("", False)
    return out


def chunk(text: str | None, path: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks by the file's kind: markdown and texts without a path keep their fences, others are split by language."""
    if not text or not text.strip():
        return []
    return split_markdown(text, size, overlap) if not path or suffix(path) in MARKDOWN else list(split(text, separators(path), size, overlap))


def sections(text: str) -> Iterator[tuple[str | None, str]]:
    """Header path (titles of levels 1 to 4 joined by ` > `) and text of each part of a markdown text that begins at a header outside fences."""
    inside = deque(fences(text))
    titles: dict[int, str] = {}
    start = at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        while inside and inside[0][1] <= at:
            inside.popleft()
        m = None if inside and inside[0][0] <= at else HEADER.match(line)
        if m:
            if text[start:at].strip():
                yield " > ".join(titles[k] for k in sorted(titles)) or None, text[start:at].strip()
            start = at
            titles = {k: v for k, v in titles.items() if k < len(m[1])} | {len(m[1]): m[2].strip()}
        at += len(line)
    if text[start:].strip():
        yield " > ".join(titles[k] for k in sorted(titles)) or None, text[start:].strip()


def symbols(text: str, path: str) -> list[tuple[str, str, int, int]]:
    """Top-level symbols of a Python file: name, kind, first and last line. None for other files and those that don't parse."""
    if suffix(path) != "py":
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
    return [(n.name, kinds[type(n)], n.lineno, n.end_lineno or n.lineno) for n in tree.body if type(n) in kinds]


def symbol_chunks_of(text: str | None, path: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[str | None, str | None, str]]:
    """Symbol name, kind and content of each chunk; lines outside of symbols follow as `__module__`. Files without symbols are chunked as documents."""
    if not text or not text.strip():
        return
    found = symbols(text, path)
    if not found:
        yield from ((None, None, c) for c in chunk(text, path, size, overlap))
        return
    lines, covered = text.split("\n"), set()
    for name, kind, first, last in found:
        content = "\n".join(lines[first - 1 : last])
        covered |= set(range(first - 1, last))
        for part in [content] if len(content) <= size else split(content, separators(path), size, overlap):
            yield name, kind, part
    rest = "\n".join(line for i, line in enumerate(lines) if i not in covered).strip()
    if rest:
        yield from (("__module__", "module", part) for part in split(rest, separators(path), size, overlap))


def rows_of(docs: DataFrame, keep: list[str], cut: Callable[..., Iterator[tuple]], fields: list[StructField], text: str, path: str | None, batch_chars: int = 1 << 22) -> DataFrame:
    """A row for each tuple that `cut` (text, path) gives, with the kept columns, a running number and the content's hash."""
    out = StructType([*(docs.schema[k] for k in keep), StructField("chunk_index", IntegerType()), *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0
        for batch in batches:
            paths = batch["_path"] if path else [None] * len(batch)
            kept = list(zip(*(batch[k] for k in keep), strict=True)) if keep else [()] * len(batch)
            for key, t, p in zip(kept, batch["_text"], paths, strict=True):
                for i, row in enumerate(cut(t, p)):
                    held.append((*key, i, *row))
                    chars += len(row[-1])
                    if chars > batch_chars:
                        yield pd.DataFrame(held, columns=out.names, dtype=object)
                        held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=out.names, dtype=object)

    cols = [*(F.col(k) for k in keep), F.col(text).alias("_text"), *([F.col(path).alias("_path")] if path else [])]
    return docs.select(*cols).mapInPandas(run, out).withColumn("chunk_hash", F.sha2("content", 256))


CONTENT = StructField("content", StringType())


def document_chunks(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns, chunk_index, content and chunk_hash."""
    return rows_of(docs, keep, lambda t, p: ((c,) for c in chunk(t, p, size, overlap)), [CONTENT], text, path)


def header_chunks(docs: DataFrame, keep: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sections by headers, long ones split further: the kept columns, chunk_index, headers, content, chunk_hash."""

    def cut(t: str | None, _: str | None) -> Iterator[tuple]:
        for headers, section in sections(t or ""):
            for part in [section] if len(section) <= size else split_markdown(section, size, overlap):
                yield headers, part

    return rows_of(docs, keep, cut, [StructField("headers", StringType()), CONTENT], text, None)


def symbol_chunks(files: DataFrame, keep: list[str], text: str = "content", path: str = "path", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks at the borders of top-level symbols: the kept columns, chunk_index, symbol_name, symbol_kind, content, chunk_hash."""
    fields = [StructField("symbol_name", StringType()), StructField("symbol_kind", StringType()), CONTENT]
    return rows_of(files, keep, lambda t, p: symbol_chunks_of(t, p or "", size, overlap), fields, text, path)


def code_blocks(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Fenced blocks: the kept columns, chunk_index, content, chunk_hash."""
    return rows_of(docs, keep, lambda t, _: ((t[a:b],) for a, b in fences(t or "")), [CONTENT], text, None)
