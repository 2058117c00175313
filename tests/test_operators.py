"""Operators on small literal inputs, and iterative graph operators against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import scalars, vectors
from quarry.operators import changes, graphs, iterate, search
from quarry.sources import reports
from quarry.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rank_fusion(spark):
    fts = spark.createDataFrame([("a", 1), ("b", 2)], "id string, fts_rank int")
    vec = spark.createDataFrame([("a", 2), ("c", 1)], "id string, vector_rank int")
    got = {r["id"]: r["rrf_score"] for r in search.reciprocal_rank_fusion(fts, vec).collect()}
    assert got == {"a": pytest.approx(1 / 61 + 1 / 62), "b": pytest.approx(1 / 62), "c": pytest.approx(1 / 61)}
    assert search.reciprocal_rank_fusion(fts.limit(0), vec.limit(0)).count() == 0


def test_bus_factor(spark):
    c = spark.createDataFrame([("x", 1, 80.0), ("x", 2, 20.0), ("y", 1, 50.0), ("y", 2, 30.0), ("y", 3, 20.0), ("z", 1, 0.0)], "k string, author int, amount double")
    assert rows(changes.bus_factor(c, "k")) == [("x", 1), ("y", 2), ("z", 0)]


def test_upper_percentile(spark):
    v = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)] + [(2, 7.0)], "g int, v double")
    assert rows(changes.upper_percentile(v, "v", 0.75, ["g"])) == [(1, 4.0), (2, 7.0)]


def test_scalars(spark):
    one = spark.createDataFrame([(2.0, 50.0, "./src\\a//b/./c.py", "HTTPServerName")], "c double, cov double, p string, n string")
    got = one.select(scalars.crap(F.col("c"), F.col("cov")), scalars.crap(F.col("c"), F.lit(None).cast("double")), scalars.canonical_path(F.col("p")), scalars.snake_case(F.col("n")), scalars.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0))).first()
    assert tuple(got) == (2.5, None, "src/a/b/c.py", "http_server_name", 1.0)


def test_jaccard_of_empty_sets(spark):
    d = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(vectors.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def test_pairings_cap(spark):
    t = spark.createDataFrame([(1, "a", 5.0), (1, "b", 3.0), (1, "c", 1.0), (2, "a", 1.0), (2, "b", 1.0)], "commit int, file string, adds double")
    assert rows(changes.pairings(t, "file").select("a", "b", "co", "jaccard")) == [("a", "b", 2, 1.0), ("a", "c", 1, 0.5), ("b", "c", 1, 0.5)]
    assert rows(changes.pairings(t, "file", 2).select("a", "b", "co")) == [("a", "b", 2)]


def test_file_coupling(spark):
    r = spark.createDataFrame([(1, 2, "f", "f"), (1, 3, "f", "g")], "src int, dst int, src_file string, dst_file string")
    assert rows(changes.file_coupling(r)) == [("f", 0, 1, 1, 2, 0.5, 1.0), ("g", 1, 0, 1, 0, 1.0, 0.0)]


def test_line_duplication_counts_texts_not_repeats(spark):
    d = spark.createDataFrame([(1, "same line here\nsame line here\nother line 1"), (2, "same  line here"), (3, "# same line here\nshort")], "doc_id int, text string")
    assert rows(changes.line_duplication(d)) == [(1, 3, pytest.approx(2 / 3)), (2, 1, 1.0)]


def test_enclosing_takes_the_narrowest(spark):
    r = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 3, 5), ("g", 3, 0, 9)], "file string, range_id int, lo int, hi int")
    p = spark.createDataFrame([("f", 7, 4), ("f", 8, 9), ("g", 9, 10)], "file string, point int, at int")
    assert rows(graphs.enclosing(p, r)) == [(7, 2), (8, 1)]


def test_drift(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.9)], "k string, v double")
    b = spark.createDataFrame([("y", 0.52), ("z", 0.8), ("w", 1.0)], "k string, v double")
    assert rows(graphs.drift(a, b, "k", "v", 0.05).select("k", "delta")) == [("w", "added"), ("x", "removed"), ("z", "changed")]


def test_chunks_overlap_and_cover(spark):
    text = "".join(random.Random(1).choice("abc \n") for _ in range(3333))
    got = search.fixed_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"), 500, 100).orderBy("doc_id", "chunk_index").collect()
    own = [r["chunk"] for r in got if r["doc_id"] == 1]
    assert own[0] + "".join(c[100:] for c in own[1:]) == text
    assert [r["chunk"] for r in got if r["doc_id"] == 2] == [""]


def test_reports(spark):
    lcov = "TN:\nSF:./src/a.py\nDA:1,1\nDA:2,0\nend_of_record\n"
    xml = '<?xml version="1.0"?><coverage><class name="a" filename="src/a.py" line-rate="1.0"><line/></class></coverage>'
    js = '{"files": {"src/b.py": {"coverage": 140}}}'
    files = spark.createDataFrame([("1", lcov), ("2", xml), ("3", js), ("4", "???")], "path string, content string")
    assert rows(reports.coverage(files)) == [("src/a.py", 75.0, 2), ("src/b.py", 100.0, 1)]


def test_specifications(spark):
    def one(text, path="x"):
        return spark.createDataFrame([(path, text)], "path string, content string")

    assert rows(reports.openapi(one('{"paths": {"/a": {"get": {"operationId": "ga"}, "parameters": {}}}}'))) == [("x", "GET", "/a", "ga")]
    assert rows(reports.sql_ddl(one("CREATE TABLE t (id INT PRIMARY KEY, p NUMERIC(3,2), FOREIGN KEY (id) REFERENCES u(id));"))) == [("t", "id", "int"), ("t", "p", "numeric(3,2)")]
    assert rows(reports.protobuf(one("message M {}\nservice S {\n  rpc Get (M) returns (M);\n}"))) == [("message", "M"), ("rpc", "Get"), ("service", "S")]
    assert rows(reports.graphql(one("type Q { a: Int }\nenum E { A }"))) == [("enum", "E"), ("type", "Q")]
    assert rows(reports.tests(one("def test_a():\n  pass\nasync def test_b(): pass", "t.py"))) == [("t.py", "test_a"), ("t.py", "test_b")]
    log = spark.createDataFrame([("c1|2024|me\n3\t1\tsrc/{a => b}/x.py\n-\t-\timg.png",)], "entry string")
    assert rows(reports.numstat(log).select("file", "ins", "del")) == [("img.png", 0, 0), ("src/b/x.py", 3, 1)]


def test_lsif(spark):
    lines = ['{"id":"1","type":"vertex","label":"document","uri":"a.ts"}', '{"id":"2","type":"vertex","label":"range","start":{"line":1,"character":2},"end":{"line":1,"character":5}}', '{"id":"3","type":"edge","label":"contains","outV":"1","inVs":["2"]}']
    assert rows(reports.lsif(spark.createDataFrame([(x,) for x in lines], "value string"))) == [("a.ts", 1, 2, 1, 5)]


def test_upsert_sink(spark, tmp_path):
    write = events.upsert_sink(str(tmp_path), "k", "v")
    write(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), 0)
    for _ in range(2):  # a repeated batch changes nothing
        write(spark.createDataFrame([(2, 5), (3, 1)], "k int, v int"), 1)
    assert rows(spark.read.parquet(f"{tmp_path}/v=1")) == [(1, 1), (2, 5), (3, 1)]


def brute_reach(edges):
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for s, t in edges:
                if s == x and t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[a] = seen
    return reach


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=14))
def test_components_match_brute_force(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    reach = brute_reach(set(edges))
    cycles = {}
    for a, r in reach.items():
        own = {b for b in r if a in reach.get(b, ()) and b != a}
        if own:
            cycles[a] = max(own | {a})
    assert dict(rows(iterate.strongly_connected(df))) == cycles
    both = brute_reach({(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b})
    assert dict(rows(iterate.connected_components(df))) == {a: min(r | {a}) for a, r in both.items()}


def test_strongly_connected_has_no_round_limit(spark, monkeypatch):
    # greatest ids fall along the edges, so each round takes out one component; a loop over range(rounds) would end after two
    monkeypatch.setattr(iterate, "range", lambda *a: range(min(a[0], 2)) if len(a) == 1 else range(*a), raising=False)
    pairs = [(8, 7), (6, 5), (4, 3), (2, 1)]
    edges = [e for a, b in pairs for e in ((a, b), (b, a))] + [(x[0], y[0]) for i, x in enumerate(pairs) for y in pairs[i + 1 :]]
    got = dict(rows(iterate.strongly_connected(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {x: a for a, b in pairs for x in (a, b)}


def test_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)], "src long, dst long")
    assert iterate.shortest_path(e, 1, 5, 4).first()["path"] == [1, 2, 3, 5]
    assert iterate.shortest_path(e, 1, 5, 2).count() == 0
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = iterate.simple_paths(e, one(1), one(5), one(2), 4, 20).collect()
    assert [(r["path"], r["confidence"]) for r in got] == [([1, 4, 3, 5], "high")]


def test_communities_are_a_partition(spark):
    clique = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(0, 10, 0.1)]
    got = dict(rows(iterate.louvain_pass(spark.createDataFrame(clique, "src long, dst long, w double"), rounds=8)))
    assert len(got) == 8
    assert {got[i] for i in range(4)}.isdisjoint({got[i] for i in range(10, 14)})
