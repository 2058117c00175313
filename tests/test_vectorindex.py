"""The vector index against brute force: recall of probes, exactness with all cells, and similar pairs."""

import numpy as np
import pytest

from quarry.operators import vectorindex

pytestmark = pytest.mark.usefixtures("few_partitions")

SF = "/root/testdata/sf0.01"


def clusters(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    return [(i, (centres[i % 9] + rng.normal(scale=0.5, size=d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("threshold,rows", [(0.9, 2048), (0.75, 40)])
def test_similar_pairs_are_exact(spark, threshold, rows, monkeypatch):
    monkeypatch.setattr(vectorindex, "ROWS", rows)
    data = clusters(300, 12, 3)
    data += [(500, data[4][1]), (501, [2 * x for x in data[4][1]]), (502, None), (503, [0.0] * 12), (504, [None] + [1.0] * 11), (None, data[4][1])]
    frame = spark.createDataFrame([(i, v, None if i is None else i % 2) for i, v in data], "id long, vector array<double>, side int")
    fine = {i: np.array(v) / np.linalg.norm(v) for i, v in data if i is not None and v is not None and None not in v and np.linalg.norm(v) > 0}
    want = {(a, b) for a in fine for b in fine if a < b and fine[a] @ fine[b] >= threshold}
    got = [tuple(r) for r in vectorindex.similar_pairs(frame, threshold, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    got = {tuple(r) for r in vectorindex.similar_pairs(frame, threshold, 8, block_col="side").collect()}
    assert got == {(a, b) for a, b in want if a % 2 == b % 2}
    assert vectorindex.similar_pairs(frame.limit(0), threshold, 8).collect() == []


def recall_of(spark, table, path, cells, probes, k=10):
    vectorindex.build(table, path, cells)
    queries = table.where("vec_id % 10 = 0").selectExpr("vec_id as qid", "embedding as q")
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    ids = np.array(sorted(v))
    x = np.array([v[i] / np.linalg.norm(v[i]) for i in ids])
    want = {q: [int(ids[j]) for j in np.lexsort((ids, -(x @ (v[q] / np.linalg.norm(v[q])))))[:k]] for q in v if q % 10 == 0}
    got = {q: [] for q in want}
    for r in vectorindex.nearest(spark, path, queries, k, probes).orderBy("qid", "rank").collect():
        got[r["qid"]].append(r["id"])
    return np.mean([len(set(got[q]) & set(w)) / k for q, w in want.items()]), got == want


def test_recall_of_few_probes_in_clusters(spark, tmp_path):
    table = spark.createDataFrame(clusters(900, 24, 5), "vec_id long, embedding array<double>")
    assert recall_of(spark, table, f"{tmp_path}/i", 12, 3)[0] >= 0.9


def test_recall_on_the_embeddings_and_exactness_of_all_cells(spark, tmp_path):
    """These vectors hardly cluster, so most cells must be probed."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert recall_of(spark, table, f"{tmp_path}/i", 16, 11)[0] >= 0.9
    assert recall_of(spark, table, f"{tmp_path}/j", 16, 16)[1]


def test_nearest_distances_over_many_blocks(spark, monkeypatch):
    """Every pair of a block is compared once it takes several blocks of rows; copies, zero vectors and odd rows included."""
    monkeypatch.setattr(vectorindex, "WIDE", 16)
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)] + [(120, 0, [0.0] * 6), (121, 1, [2.0] * 6), (122, 1, [4.0] * 6), (123, 7, [1.0] * 6)]
    frame = spark.createDataFrame([*rows, (None, 0, [1.0] * 6), (124, None, [1.0] * 6), (125, 0, None), (126, 0, [None] * 6)], "k long, b int, e array<float>")
    want = {}
    for i, b, v in rows:
        for j, c, w in rows:
            if i != j and b == c:
                norm = sum(x * x for x in v) ** 0.5 * sum(x * x for x in w) ** 0.5
                want[i] = min(want.get(i, 9.0), 1 - (sum(x * y for x, y in zip(v, w, strict=True)) / norm if norm > 1e-12 else 0.0))
    got = {r["id"]: r["dist"] for r in vectorindex.nearest_distances(frame, "k", "e", "b").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-13 for k in want)
