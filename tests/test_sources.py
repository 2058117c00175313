"""Source-file parsers, the read-only guard, and review operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import review
from quarry.sources import code, web


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, content string")


def test_outline(spark):
    src = "class A:\n    def f(self):\n        def g(): pass\n\nasync def h(): pass\n"
    got = rows(code.python_outline(files(spark, ("a.py", src), ("b.py", "def ("), ("c.txt", "def x(): pass"))))
    assert [(r[1], r[2], r[3]) for r in got] == [("A", "class", None), ("A.f", "method", "A"), ("A.f.g", "function", "A.f"), ("h", "function", None)]
    code.register(spark)
    files(spark, ("a.py", src)).createOrReplaceTempView("src_files")
    assert spark.sql("SELECT o.name FROM src_files, LATERAL quarry_outline(path, content) o").count() == 4


def test_schemas(spark):
    m = "op.create_table(\n 'users',\n sa.Column('id', sa.Integer),\n sa.Column('mail', sa.String(9)),\n)\nop.add_column('users', sa.Column('age', sa.Integer))\n"
    assert rows(code.migrations(files(spark, ("m.py", m)))) == [("users", "age", "integer"), ("users", "id", "integer"), ("users", "mail", "string")]
    o = "class U(Base):\n    __tablename__ = 'users'\n    id: Mapped[int] = mapped_column(primary_key=True)\n    n = Column(String)\n"
    assert rows(code.orm_models(files(spark, ("o.py", o)))) == [("users", "id"), ("users", "n")]


def test_jobs_and_routes(spark):
    f = files(spark, (".github/workflows/a.yml", "on:\n  schedule:\n    - cron: '0 3 * * 1'\n"), ("crontab", "5 4 * * * run.sh\n"), ("k.yaml", "kind: CronJob\nspec:\n  schedule: \"*/5 * * * *\"\n"), ("x.txt", ""))
    assert rows(code.jobs(f)) == [(".github/workflows/a.yml", "workflow", "0 3 * * 1"), ("crontab", "cron", "5 4 * * *"), ("k.yaml", "kubernetes", "*/5 * * * *")]
    assert rows(code.ui_routes(files(spark, ("a.tsx", '<Route path="/a" element={<A/>}/>, {path: "/b"}')))) == [("a.tsx", "/a"), ("a.tsx", "/b")]


def test_parser_choice(spark):
    f = files(spark, ("a.proto", ""), ("b.json", '{"openapi": "3"}'), ("tests/test_x.py", ""), ("m.py", "op.create_table("), ("n.py", ""), ("z.bin", ""))
    assert [r[0] for r in f.select(code.parser_for(F.col("path"), F.col("content"))).collect()] == ["protobuf", "openapi", "tests", "migrations", "python_outline", None]


def test_links_and_scope(spark):
    p = spark.createDataFrame([(1, "http://a.b/x/y?q", '<a href="/x/z#f">1</a><a class="k" href="http://c/d">2</a>')], "page_id int, url string, html string")
    assert rows(web.links(p).select("link", web.in_scope(F.col("link"), F.col("url")))) == [("http://a.b/x/z", True), ("http://c/d", False)]


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) DELETE FROM t"])
def test_read_only_guard_refuses(spark, sql):
    with pytest.raises(ValueError, match="read-only"):
        review.read_only_sql(spark, sql)


def test_read_only_guard_allows(spark):
    assert review.read_only_sql(spark, "SELECT 'drop table; x' AS a, n FROM t;", t=spark.createDataFrame([(1,)], "n int")).collect()[0]["n"] == 1


def test_processes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 3)], "src long, dst long")
    assert [r["path"] for r in review.processes(e, depth=4).collect()] == [[1, 2, 3, 4], [9, 3, 4]]


def test_candidates(spark):
    c = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.86), ("a", 3, 0.7), ("b", 4, 0.5)], "k string, i int, s double")
    assert rows(review.select_candidates(c, "k", "s", 0.6, 0.06).select("i", "ambiguous")) == [(1, True), (2, True)]
