"""Every query with oracle SQL against DuckDB, at the smallest scale factor."""

import os

import duckdb
import pytest

from quarry.operators import review
from quarry.plans import frames, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else format(v, ".9g")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted((tuple(normal(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


def test_every_query_is_named_once():
    assert len(registry.QUERIES) > 90
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_queries_without_oracle_read_the_whole_graph(spark):
    edges = frames.part_edges(spark, SF)
    ids = {x for r in edges.collect() for x in r}
    assert {r["id"] for r in registry.QUERIES["communities_modularity"](spark, SF).collect()} == ids
    want = sorted(">".join(map(str, r["path"])) for r in review.processes(edges).collect())
    assert sorted(r["path"] for r in registry.QUERIES["process_detection"](spark, SF).collect()) == want
