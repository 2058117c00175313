"""Temporal coupling: pairs against brute force, and tasks that grow with the lines of orders."""

from itertools import combinations

from quarry.operators.changes import pairings
from quarry.plans import frames

SF = "/root/testdata/sf0.001"


def test_pairings_match_brute_force_with_a_cap_and_nulls(spark):
    rows = [(c, f, float((7 * c + 3 * f) % 5)) for c in range(12) for f in range(c % 7)] + [(None, 1, 1.0), (None, 2, 1.0), (3, None, 0.5)]
    per = {}
    for c, f, adds in rows:
        if c is not None and f is not None:
            per.setdefault(c, []).append((adds, f))
    want = {}
    for files in per.values():
        for a, b in combinations(sorted(f for _, f in sorted(files, reverse=True)[:4]), 2):
            want[a, b] = want.get((a, b), 0) + 1
    for parts in (None, 3):
        got = pairings(spark.createDataFrame(rows, "commit long, file long, adds double"), "file", 4, parts=parts)
        assert "Join" not in str(got.select("a", "b", "co")._jdf.queryExecution().optimizedPlan()).split("Generate")[-1]  # commits aren't joined with themselves
        assert {(r["a"], r["b"]): r["co"] for r in got.collect()} == want


def test_tasks_by_commit_grow_with_the_lines(spark, monkeypatch):
    few = frames.commit_parts(spark, SF)
    monkeypatch.setattr(frames, "LINES", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert frames.commit_parts(spark, SF) == lines // 500 + 1 > few
    assert frames.touches(spark, SF).rdd.getNumPartitions() == lines // 500 + 1
