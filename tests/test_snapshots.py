"""Snapshots replaced by partition, versions under optimistic checks, and merged sketches within their bounds."""

import os
import random

import pytest

from quarry.operators import sketches, snapshots
from quarry.plans import registry


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_replacing_touches_only_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "scenario string, file long, churn long")
    snapshots.replace_partitions(make([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)]), path, ["scenario"])
    before = files(f"{path}/scenario=b")
    snapshots.replace_partitions(make([("a", 3, 7), ("c", 1, 1)]), path, ["scenario"])
    assert before and files(f"{path}/scenario=b") == before
    assert {tuple(r) for r in spark.read.parquet(path).select("scenario", "file", "churn").collect()} == {("a", 3, 7), ("b", 1, 30), ("c", 1, 1)}


def test_versions_are_published_only_over_the_one_that_was_read(spark, tmp_path):
    path = f"{tmp_path}/v"
    make = lambda *n: spark.createDataFrame([(x,) for x in n], "x long")
    schema = make(1).schema
    assert snapshots.versions(spark, path).collect() == []
    assert snapshots.publish(make(1, 2), path, "to be/é=1", 0) == 1 and snapshots.publish(make(5), path, "007", 0) == 1
    assert snapshots.publish(make(3), path, "to be/é=1", 1) == 2
    rows = lambda: {(r["scenario"], r["version"], r["x"]) for r in snapshots.latest(spark, path, schema).collect()}
    want = {("to be/é=1", 2, 3), ("007", 1, 5)}
    assert rows() == want
    before = files(path)
    for stale in (0, 1, 3):
        with pytest.raises(snapshots.StaleVersion):
            snapshots.publish(make(9), path, "to be/é=1", stale)
    spark.range(1).write.parquet(snapshots.folder(path, "claims", "007", 2))  # another writer is about to publish
    with pytest.raises(snapshots.StaleVersion):
        snapshots.publish(make(9), path, "007", 1)
    make(8).write.parquet(snapshots.folder(path, "data", "007", 2))  # ... and died before its commit
    assert rows() == want and all(files(path)[f] == t for f, t in before.items())
    assert snapshots.publish(make(), path, "to be/é=1", 2) == 3 and rows() == {("007", 1, 5)}


def test_merged_sketches_stay_within_their_bounds(spark):
    rng = random.Random(6)
    data = [(f"d{i % 7}", f"t{i % 3}", rng.randrange(30_000), rng.expovariate(1.0)) for i in range(60_000)]
    base = sketches.sketched(spark.createDataFrame(data, "day string, kind string, user long, value double"), ["day", "kind"], "user", "value")
    got = {(r["level"], r["day"], r["kind"]): r for r in sketches.estimates(sketches.rolled_up(base, ["day", "kind"])).collect()}
    assert len(got) == 21 + 7 + 1
    for (level, day, kind), r in got.items():
        own = [x for x in data if (level > 1 or x[0] == day) and (level > 0 or x[1] == kind)]
        exact, values = len({x[2] for x in own}), sorted(x[3] for x in own)
        assert r["n"] == len(own) and abs(r["n_distinct"] / exact - 1) < (4 / 64 if exact > 4096 else 1e-9)
        for q in (50, 95):
            rank = sum(v <= r[f"q{q}"] for v in values) / len(values)
            assert abs(rank - q / 100) < 0.02


def test_sketch_rollup_is_exact_for_many_users(spark, tmp_path):
    """More users than a theta sketch of 2**16 entries counts exactly; a null user counts as a row only."""
    e = spark.range(70_000).selectExpr("id as user_id", "if(id % 7 = 0, 'view', 'click') as event_type", "timestamp_seconds(id % 2 * 86400) as ts", "1.0d as value")
    e.union(e.limit(1).selectExpr("cast(null as long)", "'view'", "ts", "value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_type"], r["day"]): (r["n"], r["n_distinct"]) for r in registry.QUERIES["sketch_rollup"](spark, str(tmp_path)).collect()}
    assert got[None, None] == (70_001, 70_000) and got["view", None] == (10_001, 10_000) and got["click", None] == (60_000, 60_000)
    assert sum(n for (_, day), (n, _) in got.items() if day) == 70_001
    e.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in registry.QUERIES["sketch_rollup"](spark, str(tmp_path)).collect()] == [(None, None, 2, 0, 0)]
