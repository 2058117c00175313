"""Facts from source files, given as rows (path, content): outlines, schemas, jobs, routes, and which parser a file needs."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTLINE = "path string, name string, kind string, parent string, start_line int, end_line int"


def _symbols(path: str, content: str | None) -> Iterator[tuple]:
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, parent = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                name = f"{parent}.{child.name}" if parent else child.name
                yield path, name, kind, parent, child.lineno, child.end_lineno
                todo.append((child, name))
            else:
                todo.append((child, parent))


def python_outline(files: DataFrame) -> DataFrame:
    """Nested symbols of Python files: path, name (dotted), kind, parent, start_line, end_line. Files that don't parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OUTLINE.split(", ")]
        for b in batches:
            yield pd.DataFrame([s for p, c in zip(b["path"], b["content"], strict=True) for s in _symbols(p, c)], columns=names)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, OUTLINE)


def migrations(files: DataFrame) -> DataFrame:
    """Tables and columns that migration scripts create: tbl, column, type; and added columns."""
    created = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?s)create_table\(\s*['\"](\w+['\"].*?)\n\s*\)"), F.lit(1))).alias("t"))
    cols = F.regexp_extract_all("t", F.lit(r"Column\(\s*(['\"]\w+['\"]\s*,\s*[\w.]+)"), F.lit(1))
    one = created.select(F.regexp_extract("t", r"^(\w+)", 1).alias("tbl"), F.explode(cols).alias("c"))
    added = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?s)add_column\(\s*(['\"]\w+['\"]\s*,\s*[\w.]*Column\(\s*['\"]\w+['\"]\s*,\s*[\w.]+)"), F.lit(1))).alias("a"))
    two = added.select(F.regexp_extract("a", r"^['\"](\w+)", 1).alias("tbl"), F.regexp_extract("a", r"Column\(\s*(.*)$", 1).alias("c"))
    name, kind = F.regexp_extract("c", r"^['\"](\w+)", 1), F.lower(F.regexp_extract("c", r"(\w+)$", 1))
    return one.union(two).select("tbl", name.alias("column"), kind.alias("type"))


def orm_models(files: DataFrame) -> DataFrame:
    """Classes with __tablename__ and their mapped columns: tbl, column."""
    models = files.select(F.explode(F.split("content", r"(?m)(?=^class )")).alias("c")).where(F.col("c").contains("__tablename__"))
    cols = F.regexp_extract_all("c", F.lit(r"(?m)^\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:mapped_column|Column|db\.Column)\("), F.lit(1))
    return models.select(F.regexp_extract("c", r"__tablename__\s*=\s*['\"](\w+)", 1).alias("tbl"), F.explode(cols).alias("column"))


def jobs(files: DataFrame) -> DataFrame:
    """Scheduled and CI jobs: path, kind (workflow, cron or kubernetes) and schedule (null without one)."""
    cron = F.nullif(F.regexp_extract("content", r"(?m)(?:cron|schedule):\s*['\"]?((?:[\d*/,\-]+\s+){4}[\d*/,\-]+)", 1), F.lit(""))
    line = F.nullif(F.regexp_extract("content", r"(?m)^((?:[\d*/,\-]+\s+){4}[\d*/,\-]+)\s+\S", 1), F.lit(""))
    kind = F.when(F.col("content").rlike(r"(?m)^kind:\s*(Cron)?Job\b"), "kubernetes").when(F.col("path").rlike(r"\.(github|gitlab)|workflows?/"), "workflow").when(F.col("path").rlike(r"crontab|\.cron$"), "cron")
    return files.select("path", kind.alias("kind"), F.when(kind == "cron", line).otherwise(cron).alias("schedule")).where("kind is not null")


def ui_routes(files: DataFrame) -> DataFrame:
    """Routes of router elements and tables: path, route."""
    found = F.regexp_extract_all("content", F.lit(r"(?:<Route[^>]*\bpath=|\bpath:\s*)[{]?['\"`]([^'\"`]+)"), F.lit(1))
    return files.where(F.col("path").rlike(r"\.(tsx?|jsx?|vue)$")).select("path", F.explode(found).alias("route"))


def parser_for(path: Column, content: Column) -> Column:
    """Which parser a file needs, by name and content; null if none."""
    p = F.lower(path)
    return (
        F.when(p.endswith(".proto"), "protobuf")
        .when(p.rlike(r"\.(graphql|gql)$"), "graphql")
        .when(p.rlike(r"\.(json|ya?ml)$") & content.rlike(r"\b(openapi|swagger)\b"), "openapi")
        .when(p.endswith(".sql"), "sql_ddl")
        .when(p.endswith(".py") & content.rlike(r"\b(create_table|add_column)\("), "migrations")
        .when(p.endswith(".py") & content.contains("__tablename__"), "orm_models")
        .when(p.rlike(r"(^|/)(test_[^/]*\.py|[^/]*_test\.(py|go)|[^/]*\.(test|spec)\.[jt]sx?)$"), "tests")
        .when(p.rlike(r"workflows?/|crontab|\.cron$"), "jobs")
        .when(p.rlike(r"\.(tsx|jsx|vue)$"), "ui_routes")
        .when(p.endswith(".py"), "python_outline")
    )


def register(spark: SparkSession) -> None:
    """Make the table function quarry_outline(path, content) callable from SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=OUTLINE)
    class Outline:
        def eval(self, path: str, content: str):
            yield from _symbols(path, content)

    spark.udtf.register("quarry_outline", Outline)
