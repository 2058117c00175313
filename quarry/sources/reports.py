"""Parsers of report and specification files, given as rows (path, content); all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import canonical_path


def _records(files: DataFrame, end: str) -> DataFrame:
    return files.select("path", F.explode(F.split("content", end)).alias("rec"))


def lcov(files: DataFrame) -> DataFrame:
    """LCOV: file, lines, hit and coverage (percent) of each SF record."""
    rec = _records(files, "end_of_record")
    counts = F.regexp_extract_all("rec", F.lit(r"(?m)^DA:\d+,(\d+)"), F.lit(1))
    rows = rec.select(F.regexp_extract("rec", r"(?m)^SF:(.*)$", 1).alias("file"), counts.alias("n")).where("file <> ''")
    rows = rows.select(canonical_path(F.col("file")).alias("file"), F.size("n").alias("lines"), F.size(F.filter("n", lambda x: x.cast("long") > 0)).alias("hit"))
    return rows.withColumn("coverage", F.when(F.col("lines") > 0, 100.0 * F.col("hit") / F.col("lines")))


def cobertura(files: DataFrame) -> DataFrame:
    """Cobertura XML: file and coverage of each class with a line-rate."""
    tags = F.regexp_extract_all("content", F.lit(r"(<class\s[^>]*>)"), F.lit(1))
    rows = files.select(F.explode(tags).alias("t"))
    rate = F.regexp_extract("t", r'line-rate="([^"]*)"', 1).try_cast("double")
    return rows.select(canonical_path(F.regexp_extract("t", r'filename="([^"]*)"', 1)).alias("file"), (100.0 * rate).alias("coverage")).where("file <> ''")


def generic_json(files: DataFrame) -> DataFrame:
    """{"files": {path: {"coverage": percent}}} reports."""
    parsed = F.from_json("content", "struct<files:map<string,struct<coverage:double>>>")
    return files.select(F.explode(parsed["files"]).alias("file", "v")).select(canonical_path(F.col("file")).alias("file"), F.col("v.coverage").alias("coverage"))


def protocol(content: Column) -> Column:
    """Which parser a report needs."""
    head = F.ltrim(content)
    return F.when(head.rlike(r"(?m)^(SF|TN):"), "lcov").when(head.rlike(r"<coverage[\s>]"), "cobertura").when(head.startswith("{"), "json").otherwise("unknown")


def coverage(files: DataFrame) -> DataFrame:
    """Mean clamped coverage of each file over all reports, whatever their protocol."""
    p = files.withColumn("p", protocol(F.col("content")))
    parts = [f(p.where(F.col("p") == k)).select("file", "coverage") for k, f in (("lcov", lcov), ("cobertura", cobertura), ("json", generic_json))]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.groupBy("file").agg(F.avg(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "coverage"))).alias("coverage"), F.count("*").alias("reports"))


def numstat(log: DataFrame) -> DataFrame:
    """git log --numstat text, one commit a row (header `commit|ts|author`, then ins<TAB>del<TAB>path lines): commit, ts, author, file, ins, del.

    Binary files (- counts) count as 0; a rename {a => b} is the new path.
    """
    head = F.split(F.regexp_extract("entry", r"^([^\n]*)", 1), r"\|")
    lines = F.regexp_extract_all("entry", F.lit(r"(?m)^((?:\d+|-)\t(?:\d+|-)\t.*)$"), F.lit(1))
    rows = log.select(head.alias("h"), F.explode(lines).alias("l")).select("h", F.split("l", "\t").alias("c"))
    path = F.regexp_replace(F.regexp_replace(F.col("c")[2], r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    num = lambda i: F.coalesce(F.col("c")[i].try_cast("long"), F.lit(0))
    return rows.select(F.col("h")[0].alias("commit"), F.col("h")[1].alias("ts"), F.col("h")[2].alias("author"), canonical_path(path).alias("file"), num(0).alias("ins"), num(1).alias("del"))


def openapi(files: DataFrame) -> DataFrame:
    """Endpoints of OpenAPI JSON: path, method, operation_id, route."""
    paths = F.from_json("content", "struct<paths:map<string,map<string,struct<operationId:string>>>>")["paths"]
    rows = files.select("path", F.explode(paths).alias("route", "ops")).select("path", "route", F.explode("ops").alias("method", "op"))
    return rows.where(F.col("method").isin("get", "put", "post", "delete", "patch", "head", "options")).select("path", F.upper("method").alias("method"), "route", F.col("op.operationId").alias("operation_id"))


def sql_ddl(files: DataFrame) -> DataFrame:
    """Columns of CREATE TABLE statements: tbl, column, type."""
    t = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?is)(create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.\"]+\s*\(.*?\)\s*;)"), F.lit(1))).alias("s"))
    body = F.regexp_extract("s", r"(?is)\((.*)\)\s*;", 1)
    rows = t.select(F.regexp_replace(F.regexp_extract("s", r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)", 1), '"', "").alias("tbl"), F.explode(F.split(body, r",(?![^()]*\))")).alias("c"))
    rows = rows.withColumn("c", F.trim(F.regexp_replace("c", r"\s+", " "))).where(~F.col("c").rlike(r"(?i)^(primary|foreign|unique|constraint|check|key)\b"))
    return rows.select("tbl", F.regexp_replace(F.regexp_extract("c", r"^(\S+)", 1), '"', "").alias("column"), F.lower(F.regexp_extract("c", r"^\S+ ([A-Za-z]+(?:\([^)]*\))?)", 1)).alias("type"))


def protobuf(files: DataFrame) -> DataFrame:
    """Messages, enums, services and their RPCs: kind and name."""
    d = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*((?:message|enum|service|rpc)\s+\w+)"), F.lit(1))).alias("d"))
    return d.select(F.regexp_extract("d", r"^(\w+)", 1).alias("kind"), F.regexp_extract("d", r"(\w+)$", 1).alias("name"))


def graphql(files: DataFrame) -> DataFrame:
    """Types and operations of GraphQL documents: kind and name."""
    d = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*((?:type|input|enum|interface|union|scalar|query|mutation|subscription)\s+\w+)"), F.lit(1))).alias("d"))
    return d.select(F.regexp_extract("d", r"^(\w+)", 1).alias("kind"), F.regexp_extract("d", r"(\w+)$", 1).alias("name"))


def tests(files: DataFrame) -> DataFrame:
    """Test cases of Python, JS/TS and Go files: path and name."""
    py = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:async\s+)?def\s+(test_\w+)"), F.lit(1))
    js = F.regexp_extract_all("content", F.lit(r"(?m)\b(?:it|test)\(\s*['\"`]([^'\"`]+)"), F.lit(1))
    go = F.regexp_extract_all("content", F.lit(r"(?m)^func\s+(Test\w+)\s*\("), F.lit(1))
    found = F.when(F.col("path").endswith(".py"), py).when(F.col("path").endswith(".go"), go).when(F.col("path").rlike(r"\.[jt]sx?$"), js).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.explode(found).alias("name"))


def lsif(lines: DataFrame) -> DataFrame:
    """LSIF JSON lines (value): file, start_line, start_col, end_line, end_col of every range in a document, by joins on vertex ids."""
    v = lines.select(F.from_json("value", "struct<id:string,type:string,label:string,uri:string,start:struct<line:int,character:int>,end:struct<line:int,character:int>,outV:string,inV:string,inVs:array<string>>").alias("x")).select("x.*")
    docs = v.where("type = 'vertex' and label = 'document'").select(F.col("id").alias("doc"), "uri")
    ranges = v.where("type = 'vertex' and label = 'range'").select("id", "start", "end")
    holds = v.where("type = 'edge' and label = 'contains'").select(F.col("outV").alias("doc"), F.explode(F.coalesce("inVs", F.array("inV"))).alias("id"))
    j = holds.join(docs, "doc").join(ranges, "id")
    return j.select(F.col("uri").alias("file"), F.col("start.line").alias("start_line"), F.col("start.character").alias("start_col"), F.col("end.line").alias("end_line"), F.col("end.character").alias("end_col"))


#: Suffixes and names of files that are indexed, and folders that are not.
INDEXED = (
    "md mdx rst txt adoc py js ts tsx jsx java go rs rb php c cpp h hpp cs swift kt scala sh bash zsh sql html css scss sass less json yaml yml toml xml graphql proto dockerfile"
).split()
NAMED = ("Dockerfile", "Makefile", "CMakeLists.txt", "README", "LICENSE", "CHANGELOG", "CONTRIBUTING")
SKIPPED = ("node_modules", "vendor", "dist", "build", "__pycache__", "venv")
SHOWN = (".github", ".gitlab")


def eligible(path: Column, size: Column, max_bytes: int = 1 << 20, vendored: Column | None = None) -> Column:
    """Whether a file is indexed: a known suffix or name, not hidden (but for SHOWN), not in a skipped folder or one of `vendored` (an array of paths), at most max_bytes (an unknown size counts as fitting)."""
    name = F.element_at(F.split(path, "/"), -1)
    known = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)).isin(INDEXED) | name.isin(*NAMED)
    skipped = F.exists(F.split(path, "/"), lambda p: (p.startswith(".") & ~p.isin(*SHOWN)) | p.isin(*SKIPPED))
    within = F.lit(False) if vendored is None else F.coalesce(F.exists(vendored, lambda v: (path == v) | path.startswith(F.concat(F.rtrim(v, F.lit("/")), F.lit("/")))), F.lit(False))
    return known & ~skipped & ~within & (size.isNull() | (size <= max_bytes))
